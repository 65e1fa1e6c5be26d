"""Text queries over `documents`, `pages` and `conversations`; forms that the tables lack stand as literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import retrieval
from factloom.plans.catalog import dealt, query, table, tuples

ENGLISH_KINDS = {"CATALYST": ("with",), "RISK": ("und", "risk"), "VALUATION": ("pe", "pb"), "EARNINGS": ("que",)}


@query("t1_whitespace", r"""SELECT doc_id, length(trim(regexp_replace(text, '[\t\n\r\f\v ]+', ' ', 'g'))) AS n_collapsed, length(regexp_replace(text, '[\t\n\r\f\v ]+', '', 'g')) AS n_compact FROM documents""")
def t1_whitespace(spark, sf_dir):
    """Lengths of texts with white space collapsed and removed."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(tx.collapsed(t)).alias("n_collapsed"), F.length(tx.compact(t)).alias("n_compact"))


@query(
    "t4_statement_extraction",
    r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([!?;])[\s]*', '\1' || chr(1), 'g'), chr(1))) AS raw FROM documents),
    s AS (SELECT doc_id, trim(regexp_replace(raw, '[\t\n\r\f\v ]+', ' ', 'g')) AS statement FROM p)
    SELECT sha256(rtrim(lower(statement), '。！？!?；;')) AS knowledge_uid, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n_docs FROM s WHERE length(statement) >= 6 GROUP BY 1""",
)
def t4_statement_extraction(spark, sf_dir):
    """Statements of at least six characters, one for each canonical form, with the first document that makes them."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("raw")).select("doc_id", tx.collapsed(F.col("raw")).alias("s")).where("length(s) >= 6")
    uid = F.sha2(F.rtrim(F.lower("s"), F.lit("。！？!?；;")), 256)
    return parts.groupBy(uid.alias("knowledge_uid")).agg(F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    "t5_kind_and_sentiment",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'with') THEN 'CATALYST' WHEN contains(lower(text), 'und') OR contains(lower(text), 'risk') THEN 'RISK'
      WHEN contains(lower(text), 'pe') OR contains(lower(text), 'pb') THEN 'VALUATION' WHEN contains(lower(text), 'que') THEN 'EARNINGS' ELSE 'CLAIM' END AS kind,
      CASE WHEN u > d THEN 'BULLISH' WHEN d > u THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM
    (SELECT doc_id, text, contains(lower(text), 'good')::INT + contains(lower(text), 'the')::INT AS u, contains(lower(text), 'stupid')::INT + contains(lower(text), 'worthless')::INT + contains(lower(text), 'der')::INT AS d FROM documents)""",
)
def t5_kind_and_sentiment(spark, sf_dir):
    """Kind by first matching term list and sentiment by term counts."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.kind(t, ENGLISH_KINDS).alias("kind"), tx.sentiment(t, ("good", "the"), ("stupid", "worthless", "der")).alias("sentiment"))


STATEMENTS = (
    "(1, '公司业绩增长，订单突破'), (2, '监管政策带来风险'), (3, '股价下跌，大股东减持'), (4, '600519 净利润改善'), (5, '没有关键词'), (6, '估值偏高 PE 30'), (7, '支撑位在压力位之下'), (8, '建议减仓后加仓'), (9, 'Bullish and bearish'), (10, '')"
)


@query(
    "t7_chinese_rules",
    f"""SELECT id, CASE WHEN contains(s, '指引') THEN 'GUIDANCE' WHEN contains(s, '业绩') OR contains(s, '营收') OR contains(s, '净利润') THEN 'EARNINGS' WHEN contains(s, '订单') OR contains(s, '合同') THEN 'ORDER_CONTRACT'
      WHEN contains(s, '扩产') THEN 'CAPACITY' WHEN contains(s, '发布') THEN 'PRODUCT_LAUNCH' WHEN contains(s, '政策') OR contains(s, '监管') THEN 'POLICY_REGULATION' WHEN contains(s, '收购') THEN 'M_AND_A'
      WHEN contains(s, '回购') THEN 'BUYBACK' WHEN contains(s, '减持') THEN 'SHAREHOLDER_CHANGE' WHEN contains(s, '风险') THEN 'RISK' END AS event_type,
    CASE WHEN contains(s, '支撑') THEN 'support_level' WHEN contains(s, '压力') OR contains(s, '阻力') THEN 'resistance_level' WHEN contains(s, '减仓') THEN 'reduce_position' WHEN contains(s, '加仓') THEN 'increase_position' ELSE 'state' END AS predicate_key,
    CASE WHEN regexp_matches(s, '催化|订单|政策利好|涨价') THEN 'CATALYST' WHEN regexp_matches(s, '风险|下滑|减持|处罚') THEN 'RISK' WHEN regexp_matches(lower(s), '估值|市盈率|pe|pb') THEN 'VALUATION' WHEN regexp_matches(s, '营收|利润|业绩|毛利率') THEN 'EARNINGS' ELSE 'CLAIM' END AS kind,
    CASE WHEN len(list_filter(['增长','利好','上涨','增持','突破','改善','bullish'], lambda x: contains(lower(s), x))) > len(list_filter(['下跌','利空','风险','减持','恶化','bearish'], lambda x: contains(lower(s), x))) THEN 'BULLISH'
      WHEN len(list_filter(['增长','利好','上涨','增持','突破','改善','bullish'], lambda x: contains(lower(s), x))) < len(list_filter(['下跌','利空','风险','减持','恶化','bearish'], lambda x: contains(lower(s), x))) THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment,
    CASE WHEN event_type IS NULL THEN NULL ELSE 'evt_' || substr(sha256(id || ':' || event_type), 1, 32) END AS financial_event_id
    FROM (SELECT e.event_id AS id, p.s FROM events e JOIN (VALUES {STATEMENTS}) AS p(n, s) ON p.n = CAST(e.props::JSON->>'k' AS BIGINT) % {tuples(STATEMENTS)} + 1)""",
)
def t7_chinese_rules(spark, sf_dir):
    """Event type, predicate, kind and sentiment of Chinese statements, and the event's id."""
    s = F.col("s")
    out = dealt(spark, sf_dir, STATEMENTS, "id, s").select("id", tx.first_term(s, tx.EVENT_TERMS).alias("event_type"), tx.first_term(s, tx.PREDICATE_TERMS, "state").alias("predicate_key"), tx.kind(s).alias("kind"), tx.sentiment(s).alias("sentiment"))
    return out.withColumn("financial_event_id", F.expr("'evt_' || substr(sha2(concat(id, ':', event_type), 256), 1, 32)"))


IDENTIFIERS = "(1, 'id 11010519491231002X end'), (2, 'mail a.b@c.example and 13812345678'), (3, '+86 13900000000'), (4, '123456789012345678901'), (5, 'none'), (6, 'x@y.zz 110105194912310021')"


@query(
    "t10_pii_redaction",
    r"""WITH a AS (SELECT id, s, regexp_replace(s, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\1[REDACTED:CN_NATIONAL_ID]\2', 'g') AS s1 FROM (VALUES """
    + IDENTIFIERS
    + r""") AS t(id, s)), b AS (SELECT *, regexp_replace(s1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED:EMAIL]', 'g') AS s2 FROM a),
    c AS (SELECT *, regexp_replace(s2, '(^|[^0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}($|[^0-9])', '\1[REDACTED:CN_MOBILE]\2', 'g') AS s3 FROM b)
    SELECT id, s3 AS redacted, list_filter([CASE WHEN s1 <> s THEN 'CN_NATIONAL_ID' END, CASE WHEN s2 <> s1 THEN 'EMAIL' END, CASE WHEN s3 <> s2 THEN 'CN_MOBILE' END], lambda x: x IS NOT NULL) AS kinds FROM c""",
    over=IDENTIFIERS,
)
def t10_pii_redaction(spark, sf_dir):
    """Direct identifiers replaced in order: national id, email, mobile."""
    text, kinds = tx.redacted_pii(F.col("s"))
    return dealt(spark, sf_dir, IDENTIFIERS, "id, s").select("id", text.alias("redacted"), kinds.alias("kinds"))


@query(
    "t10_documents_redacted",
    r"""SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED:EMAIL]', 'g')) AS digest FROM documents
    WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AND NOT regexp_matches(text, '(^|[^0-9])([0-9]{17}[0-9Xx]|(\+?86[- ]?)?1[3-9][0-9]{9})($|[^0-9])')""",
)
def t10_documents_redacted(spark, sf_dir):
    """Documents whose only identifiers are addresses, without them."""
    text, kinds = tx.redacted_pii(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), kinds.alias("kinds")).where(F.array_join("kinds", ",") == "EMAIL").drop("kinds")


CREDENTIALS = "(1, 'https://u.example/p/q?token=1#f'), (2, 'call with Bearer abc.def now'), (3, 'a key=123&x=1 token=zz'), (4, 'monkey=1'), (5, 'plain'), (6, 'ftp://h/x?y')"


@query(
    "t11_credential_redaction",
    r"""SELECT id, CASE WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+[^?#]*)', 1)
    ELSE regexp_replace(regexp_replace(s, '(?i)\bbearer\s+\S+', 'Bearer <redacted>', 'g'), '(?i)\b(token|sig(?:nature)?|x-amz-(?:signature|credential)|authorization|cookie|key)=[^\s&]+', '\1=<redacted>', 'g') END AS redacted FROM (VALUES """
    + CREDENTIALS
    + ") AS t(id, s)",
    over=CREDENTIALS,
)
def t11_credential_redaction(spark, sf_dir):
    """URLs without query and fragment; credentials replaced elsewhere."""
    return dealt(spark, sf_dir, CREDENTIALS, "id, s").select("id", tx.redacted_credentials(F.col("s")).alias("redacted"))


@query("t13_public_urls", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/?#@\s]+([/?#]|$)') THEN regexp_extract(url, '^(https://[^/?#@\s]+[^?#]*)', 1) END AS public_url FROM pages")
def t13_public_urls(spark, sf_dir):
    """Public form of page addresses; null for what is not https."""
    return table(spark, sf_dir, "pages").select("page_id", tx.public_url(F.col("url")).alias("public_url"))


FACTS = "(1, '营收 12.5亿元 同比 30%'), (2, 'AAPL 与 600519.SH 在 2024 Q3'), (3, 'USD 15.2 和 ¥3万'), (4, '无'), (5, '123456 7890')"


@query(
    "t27_hard_facts",
    rf"SELECT id, regexp_extract_all(s, '(?:\d+(?:\.\d+)?%|(?:人民币|美元|港元|CNY|USD|HKD|¥|\$)\s?\d+(?:\.\d+)?(?:亿(?:元)?|万(?:元)?|千(?:元)?|元)?|\d+(?:\.\d+)?(?:亿(?:元)?|万(?:元)?|千(?:元)?|元)|(?:20\d{{2}}\s*[Qq][1-4]|[Qq][1-4]\s*20\d{{2}})|(?:[A-Z]{{1,5}}|\d{{6}})(?:\.[A-Z]{{2}})?)') AS facts FROM (VALUES {FACTS}) AS t(id, s)",
    over=FACTS,
)
def t27_hard_facts(spark, sf_dir):
    """Numbers, quarters and symbols that a transcript must not change."""
    return dealt(spark, sf_dir, FACTS, "id, s").select("id", tx.hard_facts(F.col("s")).alias("facts"))


@query(
    "f20_grounding",
    r"""SELECT a.doc_id, len(list_filter(regexp_extract_all(a.text, '\d+\.\d+|\d{2,}'), lambda t: NOT contains(b.text, t))) = 0 AS grounded FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2 WHERE regexp_matches(a.text, '\d')""",
)
def f20_grounding(spark, sf_dir):
    """Whether every number of a document occurs in the one it is held against."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    source = docs.select(F.col("doc_id").alias("source_id"), F.col("text").alias("source"))
    pairs = docs.where("text RLIKE '[0-9]'").join(source, F.expr("source_id = doc_id div 2"))
    numbers = F.regexp_extract_all("text", F.lit(r"\d+\.\d+|\d{2,}"), F.lit(0))
    return pairs.select("doc_id", F.forall(numbers, lambda t: F.contains(F.col("source"), t)).alias("grounded"))


@query("t30_token_estimate", "SELECT doc_id, CAST(ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4) AS BIGINT) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS tokens FROM documents")
def t30_token_estimate(spark, sf_dir):
    """Estimated model tokens of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(
    "t23_bigram_overlap",
    """SELECT c.conv_id, c.turn, round(CASE WHEN len(own) = 0 THEN 1.0 ELSE len(list_filter(own, lambda p: contains(src, p))) / len(own) END, 6) AS overlap FROM
    (SELECT a.conv_id, a.turn, b.text AS src, list_distinct(list_filter([substr(a.text, i, 2) FOR i IN range(1, length(a.text))], lambda p: trim(p) <> '')) AS own FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) c""",
)
def t23_bigram_overlap(spark, sf_dir):
    """Share of a turn's character pairs that the turn before has."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.selectExpr("conv_id", "turn + 1 AS turn", "text AS src")
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.bigram_overlap(F.col("text"), F.col("src")), 6).alias("overlap"))


@query(
    "t32_titles",
    r"SELECT doc_id, substr(trim(trim(regexp_replace(text, '[\t\n\r\f\v ]+', ' ', 'g')), '，。,. '), 1, 28) AS title FROM documents",
)
def t32_titles(spark, sf_dir):
    """Titles: the first 28 characters of the cleaned text."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.title(F.col("text")).alias("title"))


NAMES = "(1, 'acme corp', 'acne corp'), (2, 'acme corp', 'acme cor'), (3, 'zeta', 'alpha'), (4, 'abc', 'abc'), (5, 'abcd', 'abxy')"


@query("t24_edit_distance", f"SELECT id, levenshtein(a, b) <= 1 AS same FROM (VALUES {NAMES}) AS t(id, a, b)", over=NAMES)
def t24_edit_distance(spark, sf_dir):
    """Names that differ in one character at most."""
    return dealt(spark, sf_dir, NAMES, "id, a, b").select("id", (F.levenshtein("a", "b", 1) >= 0).alias("same"))


@query(
    "j20_fuzzy_names",
    """SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND levenshtein(a.p_name, b.p_name) <= 1""",
)
def j20_fuzzy_names(spark, sf_dir):
    """Entities of the same window whose names differ in one character at most."""
    part = table(spark, sf_dir, "part").where("p_name IS NOT NULL").select("p_partkey", "p_brand", "p_size", "p_name")
    names = retrieval.one_edit(part, ["p_brand", "p_size"], "p_name", "other")
    left = part.withColumnRenamed("p_partkey", "left_key").join(names, ["p_brand", "p_size", "p_name"]).select("left_key", "p_brand", "p_size", "other")
    right = part.selectExpr("p_partkey AS right_key", "p_brand", "p_size", "p_name AS other")
    return left.join(right, ["p_brand", "p_size", "other"]).where("left_key < right_key").select("left_key", "right_key")


PLAYLISTS = "(1, '#EXTM3U'), (2, '#EXT-X-KEY:METHOD=NONE'), (3, '#ext-x-key:method=aes-128,URI=k'), (4, '#EXT-X-KEY:METHOD=SAMPLE-AES'), (5, '#EXT-X-KEY:FOO')"


@query(
    "f27_drm_class",
    f"""SELECT id, CASE WHEN NOT starts_with(upper(s), '#EXT-X-KEY') OR contains(upper(s), 'METHOD=NONE') THEN 'NONE' WHEN contains(upper(s), 'METHOD=AES-128') THEN 'AES_128' WHEN contains(upper(s), 'METHOD=SAMPLE-AES') THEN 'SAMPLE_AES' ELSE 'UNKNOWN_ENCRYPTED' END AS drm FROM (VALUES {PLAYLISTS}) AS t(id, s)""",
    over=PLAYLISTS,
)
def f27_drm_class(spark, sf_dir):
    """Encryption that playlists declare."""
    return dealt(spark, sf_dir, PLAYLISTS, "id, s").select("id", tx.drm(F.col("s")).alias("drm"))


@query(
    "f26_sensitive_documents",
    r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(bearer\s+\S+|\b(token|sig(nature)?|authorization|cookie|key)\s*=\s*[^\s&]+)')",
)
def f26_sensitive_documents(spark, sf_dir):
    """Documents with a credential in them."""
    return table(spark, sf_dir, "documents").where(r"text RLIKE r'(?i)(bearer\s+\S+|\b(token|sig(nature)?|authorization|cookie|key)\s*=\s*[^\s&]+)'").select("doc_id")


@query("f19_low_value", "SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 8 AND 240 AND NOT regexp_matches(text, '(?i)^(ok|thanks|hello)')")
def f19_low_value(spark, sf_dir):
    """Statements of 8 to 240 characters that are no mere phrase."""
    return table(spark, sf_dir, "conversations").where("length(text) BETWEEN 8 AND 240 AND NOT text RLIKE '(?i)^(ok|thanks|hello)'").select("conv_id", "turn")


@query(
    "t8_predicate_keys",
    f"""SELECT e.event_id AS id, CASE WHEN contains(s, '支撑') THEN 'support_level' WHEN contains(s, '压力') OR contains(s, '阻力') THEN 'resistance_level' WHEN contains(s, '减仓') THEN 'reduce_position' WHEN contains(s, '加仓') THEN 'increase_position' ELSE 'state' END AS predicate_key
    FROM events e JOIN (VALUES {STATEMENTS}) AS p(n, s) ON p.n = CAST(e.props::JSON->>'k' AS BIGINT) % {tuples(STATEMENTS)} + 1""",
)
def t8_predicate_keys(spark, sf_dir):
    """Predicate of what each event says, by its first key word."""
    return dealt(spark, sf_dir, STATEMENTS, "id, s").select("id", tx.first_term(F.col("s"), tx.PREDICATE_TERMS, "state").alias("predicate_key"))
