"""Verification of claims: what each needs, what is reused, what is due, and which bindings are broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Claim types, result states and retry delays that results must agree on.
QUANT_TYPES = ("PRICE", "RETURN", "VALUATION", "FINANCIAL_METRIC")
FACT_TYPES = (*QUANT_TYPES, "CORPORATE_EVENT", "INDUSTRY_RELATION")
TERMINAL = ("VERIFIED", "CONTRADICTED", "PARTIALLY_VERIFIED", "NOT_VERIFIABLE", "EXPIRED", "MANUAL_REVIEW")
BOUND = ("VERIFIED", "CONTRADICTED", "PARTIALLY_VERIFIED")
PENDING = "VERIFICATION_PENDING"
RETRY_SECONDS = (60, 300, 1800, 7200, 43200)
OUTCOMES = {"MATCH": "VERIFIED", "CONFLICT": "CONTRADICTED", "PARTIAL": "PARTIALLY_VERIFIED", "PENDING": PENDING, "NOT_FOUND": "NOT_VERIFIABLE"}


def category(claim_type: Column) -> Column:
    """FACT for types that state facts, else the type itself; null for null."""
    return F.when(claim_type.isin(*FACT_TYPES), "FACT").otherwise(claim_type)


def requirement(claim_type: Column) -> Column:
    return F.when(claim_type.isin(*QUANT_TYPES), "ASYNC_REQUIRED").when(claim_type.isin(*FACT_TYPES), "NOT_VERIFIABLE").otherwise("NOT_REQUIRED")


def outcome(status: Column) -> Column:
    """A provider's answer in the words of results; an empty or missing one is NOT_VERIFIABLE."""
    said = F.upper(F.coalesce(F.nullif(status, F.lit("")), F.lit("NOT_VERIFIABLE")))
    names = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return F.coalesce(names[said], said)


def missing_bindings(status: Column, bindings: dict[str, Column]) -> Column:
    """Names of the bindings that a result of this status needs and lacks."""
    lacking = F.filter(F.array(*[F.when(c.isNull() | (F.trim(c.cast("string")) == ""), name) for name, c in bindings.items()]), lambda x: x.isNotNull())
    return F.when(status.isin(*BOUND), lacking).otherwise(F.array().cast("array<string>"))


def retry_state(failures: Column) -> tuple[Column, Column]:
    """(status, seconds to wait) after so many failed attempts: MANUAL_REVIEW once the delays are used up."""
    delays = F.array(*map(F.lit, RETRY_SECONDS))
    over = failures > len(RETRY_SECONDS)
    return F.when(over, "MANUAL_REVIEW").otherwise(PENDING), F.when(~over & (failures > 0), F.element_at(delays, failures.cast("int")))


def initial_plan(claims: DataFrame, results: DataFrame, provider: str, at: Column, policy: str) -> DataFrame:
    """(claim_id, requirement, artifact_status, action, ref): what each claim starts with at an instant.

    claims: claim_id, claim_type; results: claim_id, verification_id, status, available_at, policy, where pending rows
    are jobs. The latest terminal result known then under the policy (of several with one id and time the greatest status) is reused, else an active job, else a job is made.
    Claims that nobody can check get a terminal result whose id does not depend on the time.
    """
    known = results.where(F.col("available_at") <= at)
    done = known.where(F.col("status").isin(*TERMINAL) & (F.col("policy") == policy)).groupBy("claim_id").agg(F.max(F.struct("available_at", "verification_id", "status")).alias("done"))
    jobs = known.where(F.col("status") == PENDING).groupBy("claim_id").agg(F.min("verification_id").alias("job"))
    need = requirement(F.col("claim_type"))
    own = F.concat(F.lit("verification-"), F.substring(F.sha2(F.concat_ws("|", F.col("claim_id").cast("string"), F.lit(provider), F.col("requirement")), 256), 1, 32))
    waits = F.col("requirement") == "ASYNC_REQUIRED"
    reused = F.when(waits, F.col("done").isNotNull()).otherwise(F.coalesce(F.col("done.status") == F.col("requirement"), F.lit(False)))
    action = F.when(reused, "REUSE_RESULT").when(~waits, "NEW_RESULT").when(F.col("job").isNotNull(), "REUSE_JOB").otherwise("NEW_JOB")
    joined = claims.select("claim_id", need.alias("requirement")).join(done, "claim_id", "left").join(jobs, "claim_id", "left").withColumn("action", action)
    return joined.select(
        "claim_id",
        "requirement",
        F.when(F.col("action") == "REUSE_RESULT", F.col("done.status")).when(waits, PENDING).otherwise(F.col("requirement")).alias("artifact_status"),
        "action",
        F.when(F.col("action") == "REUSE_RESULT", F.col("done.verification_id").cast("string"))
        .when(F.col("action") == "NEW_RESULT", own)
        .when(F.col("action") == "REUSE_JOB", F.col("job").cast("string"))
        .otherwise(F.concat(F.lit("verify-job-"), F.col("claim_id").cast("string"), F.lit(f"-{provider}")))
        .alias("ref"),
    )


def closure_faults(entries: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """(verification_id, fault) of entries whose durable row is missing, of another claim or status, or not visible yet."""
    durable = rows.select(F.col("verification_id"), F.col("claim_id").alias("c"), F.col("status").alias("s"), F.col("available_at").alias("v"), F.lit(True).alias("found"))
    fault = F.when(F.col("found").isNull(), "ROW_MISSING").when(~(F.col("c").eqNullSafe(F.col("claim_id")) & F.col("s").eqNullSafe(F.col("status"))), "LINEAGE_MISMATCH").when(F.col("v").isNull() | (F.col("v") > at), "NOT_VISIBLE")
    return entries.join(durable, "verification_id", "left").select("verification_id", fault.alias("fault")).where("fault IS NOT NULL")
