"""Verification queries: `orders` stand for claims, `lineitem` for the ledger of results and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import verification as vf
from factloom.plans.catalog import query, table

AT = "1998-01-01"
CLAIMS_SQL = """SELECT o_orderkey AS claim_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'PRICE' WHEN '2-HIGH' THEN 'FINANCIAL_METRIC' WHEN '3-MEDIUM' THEN 'CORPORATE_EVENT' WHEN '5-LOW' THEN 'FORECAST' ELSE 'OPINION' END AS claim_type, o_orderstatus FROM orders"""
RESULTS_SQL = """SELECT l_orderkey AS claim_id, l_orderkey * 10 + l_linenumber AS verification_id, CASE l_returnflag WHEN 'R' THEN 'VERIFIED' WHEN 'A' THEN 'CONTRADICTED' ELSE 'VERIFICATION_PENDING' END AS status,
    CAST(l_shipdate AS DATE) AS available_at, CASE WHEN l_linestatus = 'F' THEN 'rule.v1' ELSE 'rule.v2' END AS policy FROM lineitem"""


def claims(spark, sf_dir):
    kind = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'PRICE' WHEN '2-HIGH' THEN 'FINANCIAL_METRIC' WHEN '3-MEDIUM' THEN 'CORPORATE_EVENT' WHEN '5-LOW' THEN 'FORECAST' ELSE 'OPINION' END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), kind.alias("claim_type"), "o_orderstatus")


def results(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "VERIFIED").when(F.col("l_returnflag") == "A", "CONTRADICTED").otherwise(vf.PENDING)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("verification_id"),
        status.alias("status"),
        F.to_date("l_shipdate").alias("available_at"),
        F.when(F.col("l_linestatus") == "F", "rule.v1").otherwise("rule.v2").alias("policy"),
    )


def at():
    return F.lit(AT).cast("date")


@query("f25_quant_verifiable", f"SELECT claim_id, CASE WHEN claim_type IN ('PRICE', 'FINANCIAL_METRIC', 'CORPORATE_EVENT') THEN 'FACT' ELSE claim_type END AS category, claim_type IN ('PRICE', 'FINANCIAL_METRIC') AS verifiable FROM ({CLAIMS_SQL})")
def f25_quant_verifiable(spark, sf_dir):
    """Category of each claim and whether market data can check it."""
    kind = F.col("claim_type")
    return claims(spark, sf_dir).select("claim_id", vf.category(kind).alias("category"), kind.isin(*vf.QUANT_TYPES).alias("verifiable"))


@query(
    "k9_initial_plan",
    f"""WITH known AS (SELECT * FROM ({RESULTS_SQL}) WHERE available_at <= DATE '{AT}'),
    done AS (SELECT claim_id, max(struct_pack(a := available_at, b := verification_id, c := status)) AS d FROM known WHERE status <> 'VERIFICATION_PENDING' AND policy = 'rule.v1' GROUP BY claim_id),
    jobs AS (SELECT claim_id, min(verification_id) AS job FROM known WHERE status = 'VERIFICATION_PENDING' GROUP BY claim_id)
    SELECT claim_id, 'ASYNC_REQUIRED' AS requirement, coalesce(d.c, 'VERIFICATION_PENDING') AS artifact_status, CASE WHEN d IS NOT NULL THEN 'REUSE_RESULT' WHEN job IS NOT NULL THEN 'REUSE_JOB' ELSE 'NEW_JOB' END AS action,
      CASE WHEN d IS NOT NULL THEN CAST(d.b AS VARCHAR) WHEN job IS NOT NULL THEN CAST(job AS VARCHAR) ELSE 'verify-job-' || claim_id || '-quant' END AS ref
    FROM ({CLAIMS_SQL}) LEFT JOIN done USING (claim_id) LEFT JOIN jobs USING (claim_id) WHERE claim_type IN ('PRICE', 'FINANCIAL_METRIC')
    UNION ALL SELECT claim_id, r, r, 'NEW_RESULT', 'verification-' || substr(sha256(claim_id || '|quant|' || r), 1, 32)
    FROM (SELECT claim_id, CASE WHEN claim_type = 'CORPORATE_EVENT' THEN 'NOT_VERIFIABLE' ELSE 'NOT_REQUIRED' END AS r FROM ({CLAIMS_SQL}) WHERE claim_type NOT IN ('PRICE', 'FINANCIAL_METRIC'))""",
)
def k9_initial_plan(spark, sf_dir):
    """What each claim starts with: a reused result or job, or a new one."""
    return vf.initial_plan(claims(spark, sf_dir), results(spark, sf_dir), "quant", at(), "rule.v1")


@query(
    "k10_closure_faults",
    f"""SELECT verification_id, fault FROM (SELECT e.verification_id, CASE WHEN l.k IS NULL THEN 'ROW_MISSING' WHEN e.status <> l.status THEN 'LINEAGE_MISMATCH' WHEN l.available_at > DATE '{AT}' THEN 'NOT_VISIBLE' END AS fault FROM ({RESULTS_SQL}) e LEFT JOIN
    (SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_discount > 0.07 THEN 'EXPIRED' WHEN l_returnflag = 'R' THEN 'VERIFIED' WHEN l_returnflag = 'A' THEN 'CONTRADICTED' ELSE 'VERIFICATION_PENDING' END AS status, CAST(l_shipdate AS DATE) AS available_at FROM lineitem WHERE l_tax < 0.07) l ON l.k = e.verification_id) WHERE fault IS NOT NULL""",
)
def k10_closure_faults(spark, sf_dir):
    """Entries of a snapshot that the durable rows do not bear out."""
    status = F.when(F.col("l_discount") > 0.07, "EXPIRED").when(F.col("l_returnflag") == "R", "VERIFIED").when(F.col("l_returnflag") == "A", "CONTRADICTED").otherwise(vf.PENDING)
    kept = table(spark, sf_dir, "lineitem").where("l_tax < 0.07")
    durable = kept.select(F.expr("l_orderkey * 10 + l_linenumber").alias("verification_id"), F.col("l_orderkey").alias("claim_id"), status.alias("status"), F.to_date("l_shipdate").alias("available_at"))
    return vf.closure_faults(results(spark, sf_dir), durable, at())


@query(
    "k11_retry_states",
    """SELECT o_custkey, n AS failures, CASE WHEN n > 5 THEN 'MANUAL_REVIEW' ELSE 'VERIFICATION_PENDING' END AS status, CASE WHEN n BETWEEN 1 AND 5 THEN [60, 300, 1800, 7200, 43200][n] END AS delay_seconds
    FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY o_custkey)""",
)
def k11_retry_states(spark, sf_dir):
    """State and delay of each customer's verification after its failed attempts (open orders)."""
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("failures"))
    status, delay = vf.retry_state(F.col("failures"))
    return counted.select("o_custkey", "failures", status.alias("status"), delay.alias("delay_seconds"))


@query(
    "l9_binding_faults",
    f"""SELECT verification_id, array_to_string(list_filter([CASE WHEN t <= 0.02 THEN 'market_snapshot_id' END, CASE WHEN d >= 0.08 THEN 'market_data_version' END, CASE WHEN q < 3 THEN 'fact_date' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM (SELECT l_orderkey * 10 + l_linenumber AS verification_id, l_tax AS t, l_discount AS d, l_quantity AS q, l_returnflag FROM lineitem) WHERE l_returnflag IN ('R', 'A') AND (t <= 0.02 OR d >= 0.08 OR q < 3)""",
)
def l9_binding_faults(spark, sf_dir):
    """Results that claim a check against market data without naming it."""
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "VERIFIED").when(F.col("l_returnflag") == "A", "CONTRADICTED").otherwise(vf.PENDING)
    bindings = {"market_snapshot_id": F.when(F.col("l_tax") > 0.02, "snapshot"), "market_data_version": F.when(F.col("l_discount") >= 0.08, "").otherwise("v1"), "fact_date": F.when(F.col("l_quantity") >= 3, F.to_date("l_shipdate"))}
    return lines.select(F.expr("l_orderkey * 10 + l_linenumber").alias("verification_id"), F.array_join(vf.missing_bindings(status, bindings), ",").alias("missing")).where("missing <> ''")


@query("l57_provider_outcomes", "SELECT event_id, CASE event_type WHEN 'view' THEN 'VERIFIED' WHEN 'click' THEN 'CONTRADICTED' WHEN 'purchase' THEN 'PARTIALLY_VERIFIED' WHEN 'signup' THEN 'NOT_VERIFIABLE' ELSE 'NOT_VERIFIABLE' END AS status FROM events")
def l57_provider_outcomes(spark, sf_dir):
    """Answers of a provider in the words of results; errors answer nothing."""
    said = F.expr("CASE event_type WHEN 'view' THEN 'match' WHEN 'click' THEN 'Conflict' WHEN 'purchase' THEN 'PARTIAL' WHEN 'signup' THEN 'not_found' WHEN 'error' THEN '' END")
    return table(spark, sf_dir, "events").select("event_id", vf.outcome(said).alias("status"))


@query("l69_jobs_to_enqueue", f"SELECT claim_id, 'verify-job-' || claim_id || '-quant' AS job_id FROM ({CLAIMS_SQL}) c WHERE claim_type IN ('PRICE', 'FINANCIAL_METRIC') AND NOT EXISTS (SELECT 1 FROM ({RESULTS_SQL}) r WHERE r.claim_id = c.claim_id AND r.status = 'VERIFICATION_PENDING')")
def l69_jobs_to_enqueue(spark, sf_dir):
    """Jobs of claims that need one and have none; what is queued already stays as it is."""
    queued = results(spark, sf_dir).where(F.col("status") == vf.PENDING)
    wanted = claims(spark, sf_dir).where(F.col("claim_type").isin(*vf.QUANT_TYPES)).join(queued, "claim_id", "left_anti")
    return wanted.select("claim_id", F.concat(F.lit("verify-job-"), F.col("claim_id").cast("string"), F.lit("-quant")).alias("job_id"))


@query("l52_pending_liveness", f"SELECT verification_id, live FROM (SELECT *, struct_pack(a := available_at, b := verification_id) = max(struct_pack(a := available_at, b := verification_id)) OVER (PARTITION BY claim_id) AS live FROM ({RESULTS_SQL})) WHERE status = 'VERIFICATION_PENDING'")
def l52_pending_liveness(spark, sf_dir):
    """Pending jobs, and whether they are still the head of their claim."""
    rows = results(spark, sf_dir)
    heads = rows.groupBy("claim_id").agg(F.max(F.struct("available_at", "verification_id")).alias("head"))
    return rows.where(F.col("status") == vf.PENDING).join(heads, "claim_id").select("verification_id", (F.struct("available_at", "verification_id") == F.col("head")).alias("live"))


@query("l55_dual_heads", f"SELECT claim_id, max(struct_pack(a := available_at, b := verification_id)).b AS latest, (max(struct_pack(a := available_at, b := verification_id)) FILTER (status = 'VERIFIED')).b AS latest_verified FROM ({RESULTS_SQL}) GROUP BY claim_id")
def l55_dual_heads(spark, sf_dir):
    """Latest and latest verified result of each claim, one aggregate of each."""
    head = F.struct("available_at", "verification_id")
    heads = results(spark, sf_dir).groupBy("claim_id").agg(F.max(head).alias("a"), F.max(F.when(F.col("status") == "VERIFIED", head)).alias("v"))
    return heads.select("claim_id", F.col("a.verification_id").alias("latest"), F.col("v.verification_id").alias("latest_verified"))


@query(
    "k24_initial_signals",
    f"SELECT claim_id, 'signal-' || substr(sha256(claim_id || '|' || s), 1, 24) AS signal_id, s AS status FROM (SELECT claim_id, coalesce(r.s, 'VERIFICATION_PENDING') AS s FROM ({CLAIMS_SQL}) LEFT JOIN (SELECT claim_id, max(struct_pack(a := available_at, b := verification_id, c := status)).c AS s FROM ({RESULTS_SQL}) WHERE available_at <= DATE '{AT}' GROUP BY claim_id) r USING (claim_id))",
)
def k24_initial_signals(spark, sf_dir):
    """A signal for every claim with its latest known state, pending where there is none."""
    latest = results(spark, sf_dir).where(F.col("available_at") <= at()).groupBy("claim_id").agg(F.max(F.struct("available_at", "verification_id", "status"))["status"].alias("status"))
    made = claims(spark, sf_dir).join(latest, "claim_id", "left").select("claim_id", F.coalesce("status", F.lit(vf.PENDING)).alias("status"))
    return made.select("claim_id", F.concat(F.lit("signal-"), F.substring(F.sha2(F.concat_ws("|", F.col("claim_id").cast("string"), "status"), 256), 1, 24)).alias("signal_id"), "status").dropDuplicates(["signal_id"])


@query(
    "k22_initial_lifecycle",
    """SELECT target_type, to_status, support, count(*) AS n FROM (SELECT 'CLAIM' AS target_type, CASE WHEN o_orderstatus = 'P' THEN 'EXTRACTED' ELSE 'ACTIVE' END AS to_status, CASE WHEN o_orderstatus = 'P' THEN 'SOURCE_LOCATED' ELSE 'SOURCE_SUPPORTED' END AS support FROM orders
    UNION ALL SELECT 'OCCURRENCE', CASE WHEN o_orderstatus = 'P' THEN 'EXTRACTED' ELSE 'ACTIVE' END, CASE WHEN o_orderstatus = 'P' THEN 'SOURCE_LOCATED' ELSE 'SOURCE_SUPPORTED' END FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY ALL""",
)
def k22_initial_lifecycle(spark, sf_dir):
    """First states of claims and their occurrences: what needs review is only extracted, and located at most."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("review"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    targets = orders.select(F.lit("CLAIM").alias("target_type"), "review").unionAll(found.select(F.lit("OCCURRENCE"), "review"))
    state = F.when(F.col("review"), "EXTRACTED").otherwise("ACTIVE").alias("to_status")
    return targets.groupBy("target_type", state, F.when(F.col("review"), "SOURCE_LOCATED").otherwise("SOURCE_SUPPORTED").alias("support")).agg(F.count("*").alias("n"))


@query("k13_effect_retries", "SELECT event_id, CASE WHEN n >= 10 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS status, least(3600, 30 * CAST(pow(2, least(n - 1, 8)) AS BIGINT)) AS delay_seconds FROM (SELECT event_id, CAST(floor(value / 8) AS BIGINT) + 1 AS n FROM events WHERE event_type = 'error')")
def k13_effect_retries(spark, sf_dir):
    """Delay of failed index effects: it doubles up to an hour, and ten attempts are the last."""
    n = (F.floor(F.col("value") / 8) + 1).alias("n")
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", n)
    return failed.select("event_id", F.when(F.col("n") >= 10, "DEAD_LETTER").otherwise("RETRY").alias("status"), F.expr("least(3600L, 30 * CAST(pow(2, least(n - 1, 8)) AS BIGINT))").alias("delay_seconds"))


@query("k14_commit_times", "SELECT o_orderkey, greatest(c, m) AS commit_at, c >= m AS accepted FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 60 AS c FROM orders) JOIN (SELECT l_orderkey AS o_orderkey, max(CAST(l_shipdate AS DATE)) AS m FROM lineitem GROUP BY 1) USING (o_orderkey)")
def k14_commit_times(spark, sf_dir):
    """Commit time of a snapshot: no earlier than any dependency; an earlier candidate is not accepted."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("m"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 60).alias("c")).join(last, "o_orderkey")
    return orders.select("o_orderkey", F.greatest("c", "m").alias("commit_at"), (F.col("c") >= F.col("m")).alias("accepted"))


LEGAL = ("signup>view", "view>view", "view>click", "click>view", "click>purchase", "purchase>view", "error>view")


@query("k12_illegal_transitions", f"SELECT event_id, was || '>' || event_type AS step FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL AND was || '>' || event_type NOT IN {LEGAL}")
def k12_illegal_transitions(spark, sf_dir):
    """Steps of a run that its state machine does not allow."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = table(spark, sf_dir, "events").select("event_id", F.concat(was, F.lit(">"), F.col("event_type")).alias("step"))
    return steps.where(F.col("step").isNotNull() & ~F.col("step").isin(*LEGAL))
