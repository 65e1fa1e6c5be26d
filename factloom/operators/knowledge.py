"""Knowledge operators: point-in-time filters over nested rows, eligibility, grounding, boundaries, frames, cross-checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import contains_any

# Term lists in order of precedence.
DOMAIN_TERMS = {
    "FINANCIAL_SECTOR_CAPITAL_POLICY": ("资本补充", "银行资本", "银行", "保险"),
    "AI_INFERENCE_COMPUTE": ("ai推理", "推理算力", "gpu", "算力", "芯片"),
    "INFORMATION_INFRASTRUCTURE_POLICY": ("信息基础设施", "基础设施投资", "信息基建"),
    "CENTRAL_BANK_GOLD_RESERVES": ("黄金储备", "黄金", "央行储备"),
    "PORTFOLIO_RISK_MANAGEMENT": ("仓位", "资金池", "止损", "均线", "杠杆", "风险预算", "集中度"),
}
NEGATIVE, POSITIVE = ("下降", "下滑", "减少", "亏损", "利空", "不", "未"), ("增长", "上升", "改善", "盈利", "利好")
CONDITIONAL, FUTURE, PAST = ("如果", "若", "条件"), ("将", "预计", "预测", "未来", "明年"), ("去年", "曾", "已经", "此前")
CAUSAL, OPINION = ("因为", "导致", "推动", "从而", "所以"), ("应当", "不要", "建议", "我认为", "看好", "看空")
METRICS = "(?:营收|收入|利润|毛利率|销量|订单|价格|估值)"
FACT_TYPES = ("PRICE", "RETURN", "VALUATION", "FINANCIAL_METRIC", "CORPORATE_EVENT", "INDUSTRY_RELATION")


def polarity(text: Column) -> Column:
    return F.when(contains_any(text, NEGATIVE), "NEGATIVE").when(contains_any(text, POSITIVE), "POSITIVE").otherwise("NEUTRAL")


def tense(text: Column) -> Column:
    return F.when(contains_any(text, CONDITIONAL), "CONDITIONAL").when(contains_any(text, FUTURE), "FUTURE").when(contains_any(text, PAST), "PAST").when(text != "", "PRESENT").otherwise("UNKNOWN")


def atomic(text: Column) -> Column:
    """One clause that joins no two metrics."""
    clauses = F.filter(F.split(text, "[；;。！？!?]"), lambda c: F.trim(c) != "")
    return (F.size(clauses) == 1) & ~F.regexp_like(text, F.lit(METRICS + ".*(?:以及|同时|并且|，|、|和).*" + METRICS))


def claim_nature(claim_type: Column, text: Column) -> Column:
    kind = F.upper(claim_type)
    inferred = F.when(contains_any(text, CAUSAL), "CAUSAL_THESIS").otherwise("OPINION")
    return F.when(kind.isin("FORECAST", "OPINION"), kind).when(kind == "INFERENCE", inferred).when(contains_any(text, OPINION), "OPINION").when(kind.isin(*FACT_TYPES), "FACT").otherwise("METHOD")


def pit_match(mode: str, quality: Column, available: Column, source_available: Column, at: Column) -> Column:
    """Point-in-time filter by mode; a row that has no availability of its own passes in SYSTEM mode only."""
    system = F.coalesce(available <= at, F.lit(True))
    public = F.coalesce(source_available <= at, F.lit(False))
    if mode == "SYSTEM":
        return system
    if mode == "PUBLIC_STRICT":
        return system & public & F.coalesce(F.upper(quality) == "EXACT", F.lit(False))
    if mode == "PUBLIC_ALLOW_PROXY":
        return system & public & F.coalesce(F.upper(quality).isin("EXACT", "PUBLISHED_TIME_PROXY", "INGEST_TIME_UPPER_BOUND"), F.lit(False))
    raise ValueError(f"unknown mode {mode}")


def has_role(bindings: Column, role: str) -> Column:
    return F.exists(bindings, lambda b: b["role"] == role)


def state_in_events(events: Column, business: Column, known: Column) -> Column:
    """Status of the latest visible event of an array of (effective_at, recorded_at, event_id, to_status); null if none is visible."""
    seen = F.filter(events, lambda e: (e["effective_at"] <= business) & (e["recorded_at"] <= known))
    return F.array_max(F.transform(seen, lambda e: F.struct(e["effective_at"], e["recorded_at"], e["event_id"], e["to_status"].alias("to_status"))))["to_status"]


def public_strict(lifecycle: Column, review: Column, contradiction: Column, grounding: Column, rank: Column, least: int, evidence: Column) -> Column:
    primary = F.exists(evidence, lambda e: (e["ownership"] == "PRIMARY") & (e["modality"] == "transcript"))
    clean = (lifecycle == "ACTIVE") & (F.coalesce(review, F.lit("")) != "HUMAN_REVIEW_REQUIRED") & (F.coalesce(F.trim(contradiction), F.lit("")) == "")
    return F.coalesce(clean & (grounding == "GROUNDED") & (rank >= least) & primary, F.lit(False))


def first_failure(rules: dict[str, Column]) -> Column:
    """Name of the first rule, in order, whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def reconcile_boundaries(proposals: DataFrame, keys: Sequence[str], index: str, confidence: str, overlap: int) -> DataFrame:
    """(keys, index, support): one boundary for each cluster of proposals within `overlap`; all repeated ones of a cluster stay."""
    once = proposals.groupBy(*keys, index).agg(F.count("*").alias("support"), F.max(confidence).alias("best"))
    order = Window.partitionBy(*keys).orderBy(index)
    gap = F.col(index) - F.lag(index).over(order) > overlap
    clusters = once.withColumn("cluster", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "cluster")
    rank = F.row_number().over(inside.orderBy(F.desc_nulls_last("best"), F.desc("support"), index))
    judged = clusters.withColumns({"rank": rank, "repeated": F.max((F.col("support") > 1).cast("int")).over(inside)})
    return judged.where("(repeated = 1 AND support > 1) OR (repeated = 0 AND rank = 1)").select(*keys, index, "support")


def plan_frames(windows: DataFrame, media: str, window: str, center: str, duration: str, signal: str, nearby: int = 1000, spread: Sequence[int] = (-3000, -2000, -1000, 1000, 2000, 3000), per_media: int = 120) -> DataFrame:
    """(media, timestamp_ms, reason, n_windows): frames to extract. Centres and high signals always stay; nearby ones within the media's budget."""
    local = F.expr(f"concat(array(struct(0 AS off, 0 AS priority)), IF({signal}, transform(array({', '.join(map(str, spread))}), o -> struct(o AS off, 1 AS priority)), transform(array({-nearby}, {nearby}), o -> struct(o AS off, 2 AS priority))))")
    spots = windows.select(media, window, duration, center, F.inline(local))
    at = F.least(F.greatest(F.col(center) + F.col("off"), F.lit(0)), F.col(duration))
    merged = spots.withColumn("timestamp_ms", at.cast("long")).groupBy(media, "timestamp_ms").agg(F.min("priority").alias("priority"), F.countDistinct(window).alias("n_windows"))
    mandatory = F.sum((F.col("priority") < 2).cast("int")).over(Window.partitionBy(media))
    rank = F.row_number().over(Window.partitionBy(media, F.col("priority") < 2).orderBy("priority", "timestamp_ms"))
    kept = merged.withColumns({"must": mandatory, "rank": rank}).where(f"priority < 2 OR rank <= greatest(0, {per_media} - must)")
    names = F.element_at(F.array(*map(F.lit, ("KNOWLEDGE_CENTER", "HIGH_SIGNAL", "KNOWLEDGE_NEARBY"))), F.col("priority") + 1)
    return kept.select(media, "timestamp_ms", names.alias("reason"), "n_windows")


def unique_containment(mentions: DataFrame, cards: DataFrame, key: str, at: str, start: str, end: str, card: str, mention: str) -> DataFrame:
    """(mention, card, reason): the one card whose stage contains the mention, else why there is none."""
    from factloom.operators.intervals import range_join

    met = range_join(mentions, cards, [key], at, start, end, 20_000).groupBy(mention).agg(F.countDistinct(card).alias("n"), F.min(card).alias("one"))
    out = mentions.join(met, mention, "left")
    return out.select(mention, F.when(F.col("n") == 1, F.col("one")).alias(card), F.when(F.col("n") == 1, "LINKED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED").alias("reason"))


def smallest_container(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, span: str, point: str, after: int = 8) -> DataFrame:
    """(point, span): the smallest span that contains the point or ends at most `after` before it."""
    dealt = spans.withColumn("__at", F.explode(F.sequence(F.col(start), F.col(end) + after)))
    met = points.join(dealt, [*keys], "inner").where(F.col("__at") == F.col(at))
    return met.groupBy(point).agg(F.min_by(span, F.struct(F.col(at) > F.col(end), F.col(end) - F.col(start), F.col(span))).alias(span))


def visual_admission(pairs: DataFrame, keys: Sequence[str], relation: str) -> DataFrame:
    """(keys, admitted): CONTRADICTS beats SUPPORTS; a repeated observation of the same scope is rejected."""
    got = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_set(relation).alias("kinds"))
    said = F.when(F.col("n") > F.size("kinds"), "REJECTED_DUPLICATE").when(F.array_contains("kinds", "CONTRADICTS"), "CONTRADICTS").when(F.array_contains("kinds", "SUPPORTS"), "SUPPORTS").otherwise("NONE")
    return got.select(*keys, said.alias("admitted"))


def cross_check(transcript: Column, visual: Column, aligned: Column, anchors: Sequence[str], material: Sequence[str], kinds: Sequence[str]) -> Column:
    """Relation of a frame to its narration from two structs of fact arrays, one field for each kind."""
    both = {k: F.arrays_overlap(transcript[k], visual[k]) for k in kinds}
    clash = {k: (F.size(F.array_except(transcript[k], visual[k])) > 0) & (F.size(F.array_except(visual[k], transcript[k])) > 0) for k in kinds}
    any_of = lambda found, names: F.greatest(*[found[k].cast("int") for k in names], F.lit(0)) > 0
    empty = F.lit(True)
    for k in kinds:
        empty = empty & (F.size(visual[k]) == 0)
    return F.when(empty, "UNKNOWN").when(~aligned, "UNRELATED").when(any_of(both, anchors) & any_of(clash, material), "CONTRADICTS").when(any_of(both, kinds), "SUPPORTS").otherwise("UNRELATED")
