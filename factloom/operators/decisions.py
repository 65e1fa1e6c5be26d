"""Decision tables as CASE expressions: lifecycle, signals, verification, quality, retries, retention, source policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lifetimes in seconds (None: driven by events), support ranks, retry delays, retention days, temporal classes.
TTL_SECONDS = {"PRICE": 3600, "RETURN": 3600, "VALUATION": 86_400, "FINANCIAL_METRIC": 3650 * 86_400, "CORPORATE_EVENT": 3650 * 86_400, "INDUSTRY_RELATION": None, "FORECAST": None, "OPINION": 90 * 86_400}
SUPPORT_RANK = {"UNSUPPORTED": 0, "SOURCE_LOCATED": 1, "NEEDS_REVIEW": 2, "SOURCE_SUPPORTED": 3, "CROSS_MODAL_SUPPORTED": 4, "EXTERNALLY_VERIFIED": 5, "VALIDATED": 5}
OUTBOX_DELAYS = (60, 300, 1800, 7200, 43_200)
RETENTION_DAYS = {"raw_media": 7, "subtitle": 30, "transcript": 90, "knowledge": 3650}
TEMPORAL_CLASSES = {
    "METHOD": ("DURABLE", None, 730.0), "CONCEPT": ("DURABLE", None, 730.0), "CAUSAL_THESIS": ("CYCLICAL", 365, 90.0), "FACT": ("SNAPSHOT", 2, 1.0), "STATE": ("SNAPSHOT", 14, 5.0),
    "FORECAST": ("EVENT_BOUND", 90, 21.0), "TECHNICAL_SIGNAL": ("SNAPSHOT", 7, 2.0), "ACTION": ("EVENT_BOUND", 14, 5.0), "RISK_CONDITION": ("EVENT_BOUND", 30, 10.0), "MODEL_INFERENCE": ("SNAPSHOT", 14, 5.0),
}
DOMAIN_CLASSES = {("MACRO", "STATE"): ("CYCLICAL", 45, 14.0), ("INDUSTRY", "STATE"): ("CYCLICAL", 90, 30.0), ("CAPITAL_FLOW", "STATE"): ("SNAPSHOT", 7, 3.0), ("TRADING", "ACTION"): ("EVENT_BOUND", 14, 5.0)}
FACT_TYPES = ("PRICE", "RETURN", "VALUATION", "FINANCIAL_METRIC", "CORPORATE_EVENT", "INDUSTRY_RELATION")


def lookup(key: Column, values: dict, default=None) -> Column:
    """A small constant mapping; unknown and null keys give the default."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def support_rank(status: Column) -> Column:
    return lookup(status, SUPPORT_RANK, 0)


def lifecycle_action(claim_type: Column, status: Column, as_of: Column, available: Column, target: Column) -> Column:
    """KEEP, MARK_STALE or OUTCOME_REVIEW with its reason, as a struct. Lifetimes end strictly after; target dates count on the day."""
    ttl = lookup(claim_type, {k: v for k, v in TTL_SECONDS.items() if v is not None})
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.coalesce(available, as_of).cast("timestamp"))
    said = lambda action, reason: F.struct(F.lit(action).alias("action"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(~F.coalesce(status.isin("ACTIVE", "VALIDATED"), F.lit(False)), said("KEEP", "NOT_ACTIVE"))
        .when((claim_type == "FORECAST") & (target.cast("date") <= as_of.cast("date")), said("OUTCOME_REVIEW", "FORECAST_TARGET_DATE_REACHED"))
        .when(claim_type == "FORECAST", said("KEEP", "FORECAST_PENDING"))
        .when(ttl.isNull(), said("KEEP", "EVENT_DRIVEN"))
        .when(age > ttl, said("MARK_STALE", F.concat(F.lit("TTL_EXPIRED:"), claim_type)))
        .otherwise(said("KEEP", "WITHIN_TTL"))
    )


def temporal_policy(kind: Column, domain: Column, as_of: Column, now: Column) -> Column:
    """Struct of temporal class, end of validity, half-life and whether it has expired by `now`."""
    pick = lambda i: lookup(F.concat_ws("/", domain, kind), {f"{d}/{k}": v[i] for (d, k), v in DOMAIN_CLASSES.items()})
    base = lambda i, d: lookup(kind, {k: v[i] for k, v in TEMPORAL_CLASSES.items()}, d)
    special = pick(0).isNotNull()
    days = F.when(special, pick(1)).otherwise(base(1, 14)).cast("int")
    until = F.date_add(as_of.cast("date"), days)
    return F.struct(F.coalesce(pick(0), base(0, "SNAPSHOT")).alias("temporal_class"), until.alias("valid_to"), F.when(special, pick(2)).otherwise(base(2, 5.0)).alias("half_life_days"), F.coalesce(until < now.cast("date"), F.lit(False)).alias("expired"))


def signal_decision(category: Column, claim_type: Column, support: Column, has_evidence: Column, confidence: Column, verification: Column, threshold: float = 0.6) -> Column:
    """Struct (status, reason, signal_type) of the signal policy's table."""
    status = F.coalesce(verification, F.lit("VERIFICATION_PENDING"))
    said = lambda s, r, t: F.struct(F.lit(s).alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"), F.lit(t).alias("signal_type"))
    fact = (category == "FACT") | claim_type.isin(*FACT_TYPES)
    plain = (support == "SUPPORTED") & has_evidence
    out = (
        F.when(fact & ~support.isin("SUPPORTED", "PARTIALLY_SUPPORTED"), said("SUPPRESSED", "INSUFFICIENT_SOURCE_SUPPORT", "FACT"))
        .when(fact & (status == "VERIFIED"), said("NORMAL", "VERIFIED_FACT", "FACT"))
        .when(fact & (status == "PARTIALLY_VERIFIED"), said("DEGRADED", "PARTIAL_VERIFICATION", "FACT"))
        .when(fact & (status == "CONTRADICTED"), said("CONTRADICTION", "CONTRADICTED_FACT", "FACT"))
        .when(fact, said("SUPPRESSED", status, "FACT"))
    )
    for name, who in (("FORECAST", "AUTHOR"), ("OPINION", "AUTHOR"), ("INFERENCE", "SYSTEM")):
        mine = (claim_type == name) | (category == name)
        good = plain & (confidence >= threshold) if name == "FORECAST" else plain
        out = out.when(mine & good, said("NORMAL", f"{who}_{name}", name)).when(mine, said("SUPPRESSED", f"INSUFFICIENT_{name}_SUPPORT", name))
    return out.otherwise(said("SUPPRESSED", "UNKNOWN_CLAIM_TYPE", "UNKNOWN"))


def deviation_percent(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)) * 100


def support_score(checks: Sequence[Column], overlap: Column) -> Column:
    """Three quarters for the checks passed, one for the overlap, within [0, 1], four places."""
    passed = sum((c.cast("int") for c in checks), F.lit(0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), passed / len(checks) * 0.75 + overlap * 0.25)), 4)


def evidence_quality(has_evidence: Column, has_range: Column, confidence: Column) -> Column:
    """LOW without located evidence, UNKNOWN without a measure; unknown is never good."""
    return F.when(~has_evidence | ~has_range, "LOW").when(confidence.isNull(), "UNKNOWN").when(confidence < 0.45, "LOW").when(confidence < 0.7, "MEDIUM").otherwise("HIGH")


def quality_gate(support: Column, quality: Column) -> Column:
    """verification_status after the quality gate."""
    capped = F.when((quality == "UNKNOWN") & support.isin("SOURCE_SUPPORTED", "CROSS_MODAL_SUPPORTED"), "SOURCE_LOCATED").otherwise(support)
    return F.when(support == "UNSUPPORTED", "UNSUPPORTED").when(quality == "LOW", "NEEDS_REVIEW").otherwise(capped)


def ocr_level(score: Column) -> Column:
    return F.when(score >= 0.95, "HIGH").when(score >= 0.85, "MEDIUM").otherwise("LOW")


def outbox_state(attempts: Column, failed: Column, delays: Sequence[int] = OUTBOX_DELAYS) -> Column:
    """Struct (status, retry_in_s): failures wait ever longer, then go to the dead letters."""
    wait = F.try_element_at(F.array(*map(F.lit, delays)), attempts.cast("int"))
    return F.when(~failed, F.struct(F.lit("PUBLISHED").alias("status"), F.lit(None).cast("int").alias("retry_in_s"))).when(attempts > len(delays), F.struct(F.lit("DEAD_LETTER").alias("status"), F.lit(None).cast("int").alias("retry_in_s"))).otherwise(F.struct(F.lit("RETRY").alias("status"), wait.alias("retry_in_s")))


def backoff(attempts: Column, base: int, ceiling: int = 3600, steps: int = 8) -> Column:
    return F.least(F.lit(ceiling), (base * F.pow(F.lit(2), F.least(attempts - 1, F.lit(steps)))).cast("int"))


def retention_decision(artifact_class: Column, created: Column, now: Column, held: Column, days: dict[str, int] = RETENTION_DAYS) -> Column:
    expires = F.date_add(created.cast("date"), lookup(artifact_class, days).cast("int"))
    return F.when(held, "LEGAL_HOLD").when(expires <= now.cast("date"), "EXPIRE").otherwise("KEEP")


def allowed_sources(requests: DataFrame, policies: DataFrame, source: str, use: str, rate: str) -> DataFrame:
    """requests with `allowed`: a governed source, a use that its policy lists, and a rate under its limit. policies is a dimension."""
    mine = policies.select(F.col("source_type").alias("__s"), "allowed_uses", "rate_limit")
    ok = F.coalesce(F.array_contains("allowed_uses", F.col(use)), F.lit(False)) & F.coalesce(F.col("rate_limit").isNull() | (F.col(rate) < F.col("rate_limit")), F.lit(True))
    return requests.join(mine, F.col(source) == F.col("__s"), "left").withColumn("allowed", F.col("__s").isNotNull() & ok).drop("__s", "allowed_uses", "rate_limit")


def numeric_match(low_a: Column, high_a: Column, low_b: Column, high_b: Column, unit_a: Column, unit_b: Column, approximate: Column) -> Column:
    """Values given as ranges agree if units do and ranges meet; an approximate value reaches a tenth further."""
    reach = F.when(approximate, 0.1).otherwise(0.0)
    return F.coalesce(unit_a == unit_b, F.lit(False)) & (low_a - F.abs(low_a) * reach <= high_b) & (low_b <= high_a + F.abs(high_a) * reach)
