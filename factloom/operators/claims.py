"""Acceptance of claim drafts against the transcript they cite: the first rule that a draft breaks names its rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: markers, patterns and vocabularies of the rules
CONDITION_MARKS, INVALIDATION_MARKS = ("如果", "若", "条件"), ("证伪", "失效")
NEGATIVE, POSITIVE = ("下降", "下滑", "减少", "亏损", "利空", "不", "未"), ("增长", "上升", "改善", "盈利", "利好")
FUTURE, PAST = ("将", "预计", "预测", "未来", "明年"), ("去年", "曾", "已经", "此前")
RISKY = ("营收", "收入", "利润", "估值", "价格", "收益", "增长", "财务")
NUMBER_PATTERNS = (
    r"(?<!\d)\d{6}(?!\d)",
    r"(?<!\d)\d+(?:[.,]\d+)?(?:%|％)(?!\d)",
    r"(?:人民币|美元|港元|CNY|USD|HKD|¥|￥|\$)\s?\d+(?:[.,]\d+)?(?:万|亿|百万|千|元)?",
    r"\d+(?:[.,]\d+)?(?:万亿|亿|万|百万|千|元)",
    r"(?:19|20)\d{2}\s*(?:年|[-/.]\d{1,2}(?:月|[-/.]\d{1,2}日?)?)",
    r"(?:19|20)\d{2}\s*[Qq季度]\s*[1-4]?|[Qq]\s*[1-4]\s*(?:19|20)\d{2}",
    r"[零一二三四五六七八九十百千万亿两]+(?:元|年|月|日|季度|%)?",
)
ENTITY = r"(?<![A-Za-z0-9])[A-Z][A-Za-z0-9.&-]{1,}|[一-鿿]{2,}"
NO_ENTITIES = ("如果", "预计", "可能", "公司", "行业", "增长", "下降", "同比", "环比", "季度", "今年", "明年")
METRICS = "(?:营收|收入|利润|毛利率|销量|订单|价格|估值)"
CLAUSE_END, JOINED = r"[；;。！？!?]", METRICS + ".*(?:以及|同时|并且|，|、|和).*" + METRICS
CLAIM_TYPES = ("PRICE", "RETURN", "VALUATION", "FINANCIAL_METRIC", "CORPORATE_EVENT", "INDUSTRY_RELATION", "FORECAST", "OPINION", "INFERENCE")
SENTIMENTS, TENSES = ("BULLISH", "BEARISH", "NEUTRAL", "UNCERTAIN"), ("PAST", "PRESENT", "FUTURE", "CONDITIONAL", "UNKNOWN")

#: What a draft holds. scope is the range that a thesis covers and its three rhetorical spans; other roles have none.
DRAFT = """draft_id long, media_id long, semantic_segment_id string, quality string, claim_type string, quote string, statement string, subject_key string, subject_name string, predicate string, object_text string, object_value string,
    condition_text string, invalidation_text string, sentiment string, assertion_tense string, confidence double, evidence array<int>, condition_evidence array<int>, invalidation_evidence array<int>,
    expressions array<struct<raw: string, target: string, evidence: array<int>, confidence: double>>,
    anchors array<struct<frame_id: string, bbox: array<double>, ocr_text: string, visual_label: string, model_id: string, model_version: string, confidence: double, support_type: string>>,
    role string, scope struct<first: int, last: int, proposal: array<int>, argument: array<int>, conclusion: array<int>>"""


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return text.rlike("|".join(terms))


def _held(needle: Column, haystack: Column) -> Column:
    """Whether the haystack contains the needle, letter case and blanks around it aside."""
    return F.contains(F.lower(haystack), F.regexp_replace(F.lower(needle), r"(?U)^\s+|\s+$", ""))


def numbers(text: Column) -> Column:
    """The hard numeric tokens of a text, without blanks and in upper case."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NUMBER_PATTERNS]))
    return F.array_distinct(F.transform(found, lambda t: F.upper(F.replace(F.regexp_replace(t, r"(?U)\s+", ""), F.lit("％"), F.lit("%")))))


def polarity(text: Column) -> Column:
    return F.when(_any(text, NEGATIVE), "NEGATIVE").when(_any(text, POSITIVE), "POSITIVE").otherwise("NEUTRAL")


def tense(text: Column) -> Column:
    return F.when(_any(text, CONDITION_MARKS), "CONDITIONAL").when(_any(text, FUTURE), "FUTURE").when(_any(text, PAST), "PAST").when(text != "", "PRESENT").otherwise("UNKNOWN")


def atomic(statement: Column) -> Column:
    """One clause, and no two metrics joined in it."""
    clauses = F.filter(F.split(statement, CLAUSE_END), lambda c: F.regexp_replace(c, r"(?U)\s", "") != "")
    return (F.size(clauses) == 1) & ~statement.rlike(JOINED)


def _share(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c <= 1), F.lit(False))


def _filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _schema_ok() -> Column:
    texts = [_filled(F.col(c)) for c in ("semantic_segment_id", "quote", "statement", "predicate")] + [F.col("subject_key").isNotNull()]
    whole = F.coalesce(F.size("evidence") > 0, F.lit(False)) & _share(F.col("confidence"))
    for t in texts:
        whole &= t
    for column, known in (("claim_type", CLAIM_TYPES), ("sentiment", SENTIMENTS), ("assertion_tense", TENSES)):
        whole &= F.coalesce(F.col(column).isin(*known), F.lit(False))
    whole &= F.forall(F.coalesce("expressions", F.array().cast("array<struct<raw: string, target: string, evidence: array<int>, confidence: double>>")), lambda e: e["raw"].isNotNull() & F.coalesce(F.size(e["evidence"]) > 0, F.lit(False)) & _share(e["confidence"]))
    return whole & F.coalesce(F.forall("anchors", lambda a: _share(a["confidence"]) & F.coalesce(F.size(a["bbox"]) == 4, F.lit(False)) & (_filled(a["ocr_text"]) | _filled(a["visual_label"]))), F.lit(True))


def _scope_ok() -> Column:
    """A thesis: its range in order, covered by the transcript end to end, cited in full, its three spans in it and in order."""
    s, allowed = F.col("scope"), F.col("__allowed")
    spans = [F.coalesce(s[n], F.array().cast("array<int>")) for n in ("proposal", "argument", "conclusion")]
    ok = (s["last"] >= s["first"]) & (F.array_min(spans[1]) >= F.array_min(spans[0])) & (F.array_min(spans[2]) >= F.array_min(spans[1]))
    ok &= (F.array_min(allowed) == s["first"]) & (F.array_max(allowed) == s["last"]) & F.exists(allowed, lambda i: (i >= F.col("__first")) & (i <= F.col("__last")))
    for span in spans:
        ok &= F.size(F.array_except(span, allowed)) == 0
    ok &= (F.size(F.array_except("evidence", allowed)) == 0) & (F.size(F.array_except(allowed, "evidence")) == 0)
    return F.coalesce(ok, F.lit(False))


def rejections(drafts: DataFrame, transcript: DataFrame, segments: DataFrame) -> DataFrame:
    """(draft_id, rejection): of each draft (DRAFT) the first rule that it breaks, null where it is accepted.

    transcript (media_id, segment_index, text) has one row a segment, segments (media_id, semantic_segment_id, start_index,
    end_index) one a semantic segment. A draft may cite what lies in its semantic segment; a thesis (role THESIS) cites the
    whole range of its scope. The rules are, in order: the transcript's quality isn't PASS; a required field is missing or out of its
    vocabulary; no such semantic segment; coordinates; the quote isn't in what is cited; more than one clause or metric;
    condition, then invalidation; numbers; predicate; object; subject; polarity; tense; entities; times; anchors.
    draft_id is unique. Null arrays are empty. Texts come to drafts by one join on (media_id, segment_index).
    """
    none = F.array().cast("array<int>")
    cited = F.flatten(F.array(*[F.coalesce(c, none) for c in ("evidence", "condition_evidence", "invalidation_evidence")], F.coalesce(F.flatten(F.transform("expressions", lambda e: F.coalesce(e["evidence"], none))), none)))
    rows = drafts.withColumn("__cited", F.array_distinct(cited))
    spots = rows.select("draft_id", "media_id", F.explode("__cited").alias("segment_index"))
    texts = spots.join(transcript.select("media_id", "segment_index", F.coalesce("text", F.lit("")).alias("__text")), ["media_id", "segment_index"]).groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("segment_index", "__text"))).alias("__texts"))
    theses = drafts.where("role = 'THESIS'").select("draft_id", F.col("media_id").alias("__media"), "scope.first", "scope.last")
    allowed = theses.join(transcript, (F.col("__media") == F.col("media_id")) & F.col("segment_index").between(F.col("first"), F.col("last"))).groupBy("draft_id").agg(F.collect_set("segment_index").alias("__allowed"))
    homes = segments.select(F.col("media_id").alias("__m"), F.col("semantic_segment_id").alias("__s"), F.col("start_index").alias("__first"), F.col("end_index").alias("__last"))
    rows = rows.join(homes, (F.col("media_id") == F.col("__m")) & (F.col("semantic_segment_id") == F.col("__s")), "left").join(texts, "draft_id", "left").join(allowed, "draft_id", "left")
    rows = rows.withColumn("__texts", F.coalesce("__texts", F.map_from_arrays(none, F.array().cast("array<string>")))).withColumn("__allowed", F.coalesce("__allowed", none))

    def said(indices: Column) -> Column:
        return F.array_join(F.transform(F.coalesce(indices, none), lambda i: F.try_element_at("__texts", i)), " ")

    def grounded(text: str, where: str) -> Column:
        return F.coalesce(F.size(where) > 0, F.lit(False)) & _held(F.col(text), said(F.col(where)))

    thesis = F.coalesce(F.col("role") == "THESIS", F.lit(False))
    inside = lambda i: F.when(thesis, F.array_contains("__allowed", i)).otherwise((i >= F.col("__first")) & (i <= F.col("__last")))
    citable = (F.size("__cited") > 0) & F.forall("__cited", lambda i: inside(i) & F.map_contains_key("__texts", i)) & (~thesis | _scope_ok())
    rows = rows.withColumn("__primary", said(F.col("evidence")))
    rows = rows.withColumn("__text", F.when(thesis, F.col("quote")).otherwise(F.col("__primary")))
    text, statement = F.col("__text"), F.col("statement")
    entities = F.filter(F.regexp_extract_all(statement, F.lit(ENTITY), F.lit(0)), lambda e: ~e.isin(*NO_ENTITIES) & (F.length(e) >= 2))
    timed = F.forall("expressions", lambda e: _held(e["raw"], said(e["evidence"])) & (~_filled(e["target"]) | _held(e["target"], said(e["evidence"])) | (e["target"] == e["raw"])))
    seen = F.forall("anchors", lambda a: _filled(a["frame_id"]) & _filled(a["model_id"]) & _filled(a["model_version"]) & F.forall(a["bbox"], lambda b: F.coalesce(F.abs(b) < float("inf"), F.lit(False))))
    guessed = F.exists("anchors", lambda a: a["support_type"] == "INFERRED_VISUAL")
    risky = (F.size(numbers(statement)) > 0) | _any(F.concat("predicate", statement), RISKY)
    broken = [
        ("TRANSCRIPT_QUALITY_NOT_PASS", ~F.coalesce(F.col("quality") == "PASS", F.lit(False))),
        ("SCHEMA_INVALID", ~_schema_ok()),
        ("SEMANTIC_SEGMENT_MISMATCH", F.col("__s").isNull()),
        ("EVIDENCE_COORDINATE_INVALID", ~F.coalesce(citable, F.lit(False))),
        ("QUOTE_NOT_VERBATIM", ~_held(F.col("quote"), F.col("__primary"))),
        ("NOT_ATOMIC", ~atomic(statement)),
        ("CONDITION_NOT_GROUNDED", _any(F.col("quote"), CONDITION_MARKS) & ~_filled(F.col("condition_text"))),
        ("INVALIDATION_NOT_GROUNDED", _any(F.col("quote"), INVALIDATION_MARKS) & ~_filled(F.col("invalidation_text"))),
        ("CONDITION_NOT_GROUNDED", _filled(F.col("condition_text")) & ~grounded("condition_text", "condition_evidence")),
        ("INVALIDATION_NOT_GROUNDED", _filled(F.col("invalidation_text")) & ~grounded("invalidation_text", "invalidation_evidence")),
        ("HARD_FACT_MISMATCH", F.size(F.array_except(numbers(statement), numbers(text))) > 0),
        ("PREDICATE_MISMATCH", ~_held(F.col("predicate"), text)),
        ("HARD_FACT_MISMATCH", _filled(F.col("object_text")) & ~_held(F.col("object_text"), text)),
        ("HARD_FACT_MISMATCH", F.col("object_value").isNotNull() & ~_held(F.col("object_value"), text)),
        ("SUBJECT_MISMATCH", (_filled(F.col("subject_key")) & ~_held(F.col("subject_key"), text)) | (_filled(F.col("subject_name")) & ~_held(F.col("subject_name"), text))),
        ("POLARITY_MISMATCH", (polarity(statement) != polarity(text)) & (polarity(statement) != "NEUTRAL")),
        ("TENSE_MISMATCH", (tense(statement) != tense(text)) & (tense(statement) != "UNKNOWN") | (F.col("assertion_tense") != "UNKNOWN") & (F.col("assertion_tense") != tense(text))),
        ("ENTITY_MISMATCH", ~F.forall(entities, lambda e: _held(e, text))),
        ("TEMPORAL_NOT_GROUNDED", ~F.coalesce(timed, F.lit(True))),
        ("VISUAL_ANCHOR_INVALID", ~F.coalesce(seen, F.lit(True))),
        ("INFERRED_VISUAL_HIGH_RISK", F.coalesce(guessed, F.lit(False)) & risky),
    ]
    code = F.lit(None).cast("string")
    for name, rule in reversed(broken):
        code = F.when(rule, name).otherwise(code)
    return rows.select("draft_id", code.alias("rejection"))
