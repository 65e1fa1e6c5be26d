"""Decision queries: lifecycle, signal policy, verification, retention, retries, source policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import decisions as de
from factloom.plans.catalog import dealt, query, rows, table

TYPES = ("PRICE", "VALUATION", "FORECAST", "OPINION", "INDUSTRY_RELATION", "RETURN", "CORPORATE_EVENT")
TYPE_SQL = "(['PRICE','VALUATION','FORECAST','OPINION','INDUSTRY_RELATION','RETURN','CORPORATE_EVENT'])[CAST(event_id % 7 AS INT) + 1]"
NOW = "2024-01-20 12:00:00"


def of(names, index):
    """The element of a constant list at index (from 0)."""
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


@query(
    "d12_lifecycle_actions",
    f"""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'KEEP' WHEN t = 'FORECAST' AND CAST(ts AS DATE) + 3 <= DATE '2024-01-20' THEN 'OUTCOME_REVIEW' WHEN t IN ('FORECAST', 'INDUSTRY_RELATION') THEN 'KEEP'
      WHEN epoch(TIMESTAMP '{NOW}') - CAST(floor(epoch(ts)) AS BIGINT) > CASE t WHEN 'PRICE' THEN 3600 WHEN 'RETURN' THEN 3600 WHEN 'VALUATION' THEN 86400 WHEN 'OPINION' THEN 7776000 ELSE 315360000 END THEN 'MARK_STALE' ELSE 'KEEP' END AS action,
    CASE WHEN event_type NOT IN ('view', 'click') THEN 'NOT_ACTIVE' WHEN t = 'FORECAST' AND CAST(ts AS DATE) + 3 <= DATE '2024-01-20' THEN 'FORECAST_TARGET_DATE_REACHED' WHEN t = 'FORECAST' THEN 'FORECAST_PENDING' WHEN t = 'INDUSTRY_RELATION' THEN 'EVENT_DRIVEN'
      WHEN epoch(TIMESTAMP '{NOW}') - CAST(floor(epoch(ts)) AS BIGINT) > CASE t WHEN 'PRICE' THEN 3600 WHEN 'RETURN' THEN 3600 WHEN 'VALUATION' THEN 86400 WHEN 'OPINION' THEN 7776000 ELSE 315360000 END THEN 'TTL_EXPIRED:' || t ELSE 'WITHIN_TTL' END AS reason
    FROM (SELECT *, {TYPE_SQL} AS t FROM events)""",
)
def d12_lifecycle_actions(spark, sf_dir):
    """What becomes of each piece of knowledge at an instant, and why."""
    ev = table(spark, sf_dir, "events").withColumn("t", of(TYPES, F.expr("event_id % 7")))
    status = F.when(F.col("event_type").isin("view", "click"), "ACTIVE").otherwise("EXPIRED")
    act = de.lifecycle_action(F.col("t"), status, F.lit(NOW).cast("timestamp_ntz"), F.col("ts"), F.date_add(F.col("ts").cast("date"), 3))
    return ev.select("event_id", act.alias("a")).select("event_id", "a.action", "a.reason")


KINDS = ("METHOD", "FACT", "STATE", "FORECAST", "ACTION", "RISK_CONDITION", "OTHER")
DOMAINS = ("MACRO", "INDUSTRY", "TRADING", "GENERAL")


@query(
    "d13_temporal_policy",
    f"""SELECT event_id, CASE WHEN d = 'MACRO' AND k = 'STATE' THEN 'CYCLICAL' WHEN d = 'INDUSTRY' AND k = 'STATE' THEN 'CYCLICAL' WHEN d = 'TRADING' AND k = 'ACTION' THEN 'EVENT_BOUND' ELSE
        CASE k WHEN 'METHOD' THEN 'DURABLE' WHEN 'FORECAST' THEN 'EVENT_BOUND' WHEN 'ACTION' THEN 'EVENT_BOUND' WHEN 'RISK_CONDITION' THEN 'EVENT_BOUND' ELSE 'SNAPSHOT' END END AS temporal_class,
      CAST(ts AS DATE) + days AS valid_to, coalesce(CAST(ts AS DATE) + days < DATE '2024-01-20', false) AS expired FROM
    (SELECT *, CASE WHEN d = 'MACRO' AND k = 'STATE' THEN 45 WHEN d = 'INDUSTRY' AND k = 'STATE' THEN 90 ELSE CASE k WHEN 'METHOD' THEN NULL WHEN 'FACT' THEN 2 WHEN 'FORECAST' THEN 90 WHEN 'RISK_CONDITION' THEN 30 ELSE 14 END END AS days FROM
    (SELECT *, (['METHOD','FACT','STATE','FORECAST','ACTION','RISK_CONDITION','OTHER'])[CAST(event_id % 7 AS INT) + 1] AS k, (['MACRO','INDUSTRY','TRADING','GENERAL'])[CAST(user_id % 4 AS INT) + 1] AS d FROM events))""",
)
def d13_temporal_policy(spark, sf_dir):
    """Temporal class and end of validity by kind, with overrides by domain."""
    policy = de.temporal_policy(of(KINDS, F.expr("event_id % 7")), of(DOMAINS, F.expr("user_id % 4")), F.col("ts"), F.lit(NOW).cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", policy.alias("p")).select("event_id", "p.temporal_class", "p.valid_to", "p.expired")


CLAIM_TYPES = ("PRICE", "FORECAST", "OPINION", "INFERENCE", "RUMOUR")
SUPPORTS = ("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED")
RESULTS = ("VERIFIED", "PARTIALLY_VERIFIED", "CONTRADICTED")


@query(
    "m13_signal_policy",
    """SELECT l_orderkey, l_linenumber, CASE WHEN t = 'PRICE' AND s = 'UNSUPPORTED' THEN 'SUPPRESSED' WHEN t = 'PRICE' AND v = 'VERIFIED' THEN 'NORMAL' WHEN t = 'PRICE' AND v = 'PARTIALLY_VERIFIED' THEN 'DEGRADED' WHEN t = 'PRICE' AND v = 'CONTRADICTED' THEN 'CONTRADICTION'
      WHEN t = 'FORECAST' AND s = 'SUPPORTED' AND e AND c >= 0.6 THEN 'NORMAL' WHEN t IN ('OPINION', 'INFERENCE') AND s = 'SUPPORTED' AND e THEN 'NORMAL' ELSE 'SUPPRESSED' END AS status,
      CASE WHEN t = 'PRICE' AND s = 'UNSUPPORTED' THEN 'INSUFFICIENT_SOURCE_SUPPORT' WHEN t = 'PRICE' AND v = 'VERIFIED' THEN 'VERIFIED_FACT' WHEN t = 'PRICE' AND v = 'PARTIALLY_VERIFIED' THEN 'PARTIAL_VERIFICATION' WHEN t = 'PRICE' AND v = 'CONTRADICTED' THEN 'CONTRADICTED_FACT' WHEN t = 'PRICE' THEN 'VERIFICATION_PENDING'
      WHEN t = 'FORECAST' THEN CASE WHEN s = 'SUPPORTED' AND e AND c >= 0.6 THEN 'AUTHOR_FORECAST' ELSE 'INSUFFICIENT_FORECAST_SUPPORT' END WHEN t = 'OPINION' THEN CASE WHEN s = 'SUPPORTED' AND e THEN 'AUTHOR_OPINION' ELSE 'INSUFFICIENT_OPINION_SUPPORT' END
      WHEN t = 'INFERENCE' THEN CASE WHEN s = 'SUPPORTED' AND e THEN 'SYSTEM_INFERENCE' ELSE 'INSUFFICIENT_INFERENCE_SUPPORT' END ELSE 'UNKNOWN_CLAIM_TYPE' END AS reason
    FROM (SELECT *, (['PRICE','FORECAST','OPINION','INFERENCE','RUMOUR'])[CAST(l_partkey % 5 AS INT) + 1] AS t, (['SUPPORTED','PARTIALLY_SUPPORTED','UNSUPPORTED'])[CAST(l_suppkey % 3 AS INT) + 1] AS s, l_linenumber % 3 <> 0 AS e, l_discount * 10 AS c,
      CASE WHEN l_orderkey % 4 < 3 THEN (['VERIFIED','PARTIALLY_VERIFIED','CONTRADICTED'])[CAST(l_orderkey % 4 AS INT) + 1] END AS v FROM lineitem)""",
)
def m13_signal_policy(spark, sf_dir):
    """Signal status and reason of every claim."""
    verdict = F.when(F.expr("l_orderkey % 4 < 3"), of(RESULTS, F.expr("l_orderkey % 4 % 3")))
    made = de.signal_decision(F.lit(""), of(CLAIM_TYPES, F.expr("l_partkey % 5")), of(SUPPORTS, F.expr("l_suppkey % 3")), F.expr("l_linenumber % 3 <> 0"), F.col("l_discount") * 10, verdict)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("d")).select("l_orderkey", "l_linenumber", "d.status", "d.reason")


@query(
    "m4_price_deviation",
    "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_extendedprice / l_quantity - p_retailprice) / greatest(abs(p_retailprice), 1e-9) * 100 <= 1.0 THEN 'MATCH' ELSE 'CONFLICT' END AS outcome FROM lineitem JOIN part ON p_partkey = l_partkey",
)
def m4_price_deviation(spark, sf_dir):
    """Claimed unit prices against reference prices, within one per cent."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    both = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"))
    return both.select("l_orderkey", "l_linenumber", F.when(de.deviation_percent(F.col("price"), F.col("p_retailprice")) <= 1.0, "MATCH").otherwise("CONFLICT").alias("outcome"))


@query(
    "m5_support_scores",
    """SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, ((l_discount > 0.01)::INT + (l_tax > 0.01)::INT + (l_quantity > 5)::INT + (l_returnflag = 'N')::INT + (l_linestatus = 'O')::INT + (l_linenumber < 4)::INT + 1) / 7 * 0.75 + l_discount * 0.25)), 4) AS score,
    CASE WHEN l_linenumber = 7 THEN 'LOW' WHEN l_tax * 12 < 0.45 THEN 'LOW' WHEN l_tax * 12 < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS quality,
    CASE WHEN l_returnflag = 'R' THEN 'UNSUPPORTED' WHEN l_linenumber = 7 OR l_tax * 12 < 0.45 THEN 'NEEDS_REVIEW' ELSE 'SOURCE_SUPPORTED' END AS verification_status FROM lineitem""",
)
def m5_support_scores(spark, sf_dir):
    """Support score, evidence quality and status after the quality gate."""
    checks = [F.expr(e) for e in ("l_discount > 0.01", "l_tax > 0.01", "l_quantity > 5", "l_returnflag = 'N'", "l_linestatus = 'O'", "l_linenumber < 4", "true")]
    quality = de.evidence_quality(F.lit(True), F.col("l_linenumber") != 7, F.col("l_tax") * 12)
    support = F.when(F.col("l_returnflag") == "R", "UNSUPPORTED").otherwise("SOURCE_SUPPORTED")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", de.support_score(checks, F.col("l_discount")).alias("score"), quality.alias("quality"), de.quality_gate(support, quality).alias("verification_status"))


EVIDENCE = "(1, true, true, 0.9), (2, true, true, CAST(NULL AS DOUBLE)), (3, true, true, 0.44), (4, true, true, 0.45), (5, true, false, 0.9), (6, false, true, 0.9), (7, true, true, 0.0), (8, true, true, 0.7)"


@query(
    "m9_evidence_quality",
    f"SELECT id, CASE WHEN NOT e OR NOT r THEN 'LOW' WHEN c IS NULL THEN 'UNKNOWN' WHEN c < 0.45 THEN 'LOW' WHEN c < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS quality, CASE WHEN c >= 0.95 THEN 'HIGH' WHEN c >= 0.85 THEN 'MEDIUM' ELSE 'LOW' END AS ocr_level FROM (VALUES {EVIDENCE}) AS t(id, e, r, c)",
    over=EVIDENCE,
)
def m9_evidence_quality(spark, sf_dir):
    """Quality of evidence; a confidence of 0 is a measure, none is not."""
    return dealt(spark, sf_dir, EVIDENCE, "id, e, r, c").select("id", de.evidence_quality(F.col("e"), F.col("r"), F.col("c")).alias("quality"), de.ocr_level(F.col("c")).alias("ocr_level"))


STATUSES = "(1, 'UNSUPPORTED'), (2, 'SOURCE_LOCATED'), (3, 'NEEDS_REVIEW'), (4, 'SOURCE_SUPPORTED'), (5, 'CROSS_MODAL_SUPPORTED'), (6, 'VALIDATED'), (7, 'other'), (8, CAST(NULL AS VARCHAR(9)))"


@query(
    "f9_support_threshold",
    f"SELECT id, CASE s WHEN 'SOURCE_LOCATED' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 WHEN 'SOURCE_SUPPORTED' THEN 3 WHEN 'CROSS_MODAL_SUPPORTED' THEN 4 WHEN 'VALIDATED' THEN 5 ELSE 0 END AS support_rank FROM (VALUES {STATUSES}) AS t(id, s)",
    over=STATUSES,
)
def f9_support_threshold(spark, sf_dir):
    """Ranks of support; unknown ones are lowest."""
    return dealt(spark, sf_dir, STATUSES, "id, s").select("id", de.support_rank(F.col("s")).alias("support_rank"))


@query(
    "q4_outbox_states",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'PUBLISHED' WHEN n > 5 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS status, CASE WHEN event_type = 'error' AND n <= 5 THEN ([60, 300, 1800, 7200, 43200])[CAST(n AS INT)] END AS retry_in_s,
    least(3600, CAST(30 * pow(2, least(n - 1, 8)) AS INT)) AS backoff_s FROM (SELECT *, 1 + event_id % 7 AS n FROM events)""",
)
def q4_outbox_states(spark, sf_dir):
    """Next state of outbox rows and the wait before the next attempt."""
    n = F.expr("1 + event_id % 7")
    state = de.outbox_state(n, F.col("event_type") == "error")
    return table(spark, sf_dir, "events").select("event_id", state.alias("s"), de.backoff(n, 30).alias("backoff_s")).select("event_id", "s.status", "s.retry_in_s", "backoff_s")


CLASSES = ("raw_media", "subtitle", "transcript", "knowledge")


@query(
    "d15_retention",
    """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'LEGAL_HOLD' WHEN CAST(ts AS DATE) + ([7, 30, 90, 3650])[CAST(event_id % 4 AS INT) + 1] <= DATE '2024-02-15' THEN 'EXPIRE' ELSE 'KEEP' END AS decision FROM events""",
)
def d15_retention(spark, sf_dir):
    """Artifacts to expire, keep, or hold."""
    made = de.retention_decision(of(CLASSES, F.expr("event_id % 4")), F.col("ts"), F.lit("2024-02-15").cast("date"), F.expr("user_id % 10 = 0"))
    return table(spark, sf_dir, "events").select("event_id", made.alias("decision"))


POLICIES = "('bilibili', 'ingest,transcribe,derive', 30), ('xiaoe', 'ingest,transcribe,derive', 10), ('free', 'ingest', CAST(NULL AS INT))"
REQUESTS = "(1, 'bilibili', 'ingest', 29), (2, 'bilibili', 'ingest', 30), (3, 'xiaoe', 'train', 0), (4, 'free', 'ingest', 9999), (5, 'unknown', 'ingest', 0), (6, 'xiaoe', 'derive', 9)"


@query(
    "f17_source_policy",
    f"SELECT id, s IS NOT NULL AND list_contains(string_split(u, ','), use) AND (lim IS NULL OR rate < lim) AS allowed FROM (VALUES {REQUESTS}) AS r(id, source, use, rate) LEFT JOIN (VALUES {POLICIES}) AS p(s, u, lim) ON s = source",
    over=REQUESTS,
)
def f17_source_policy(spark, sf_dir):
    """Requests that source policies allow; unknown sources are denied."""
    policies = rows(spark, POLICIES, "source_type, u, rate_limit").withColumn("allowed_uses", F.split("u", ","))
    return de.allowed_sources(dealt(spark, sf_dir, REQUESTS, "id, source, use, rate"), policies, "source", "use", "rate").select("id", "allowed")


NUMERICS = "(1, 100.0, 100.0, 105.0, 105.0, 'CNY', 'CNY', true), (2, 100.0, 100.0, 105.0, 105.0, 'CNY', 'CNY', false), (3, 10.0, 20.0, 20.0, 30.0, '%', '%', false), (4, 1.0, 1.0, 1.0, 1.0, '%', 'x', false), (5, 1.0, 2.0, 3.0, 4.0, 'x', 'x', false)"


@query(
    "m3_numeric_match",
    f"SELECT id, ua = ub AND a - abs(a) * CASE WHEN ap THEN 0.1 ELSE 0 END <= d AND c <= b + abs(b) * CASE WHEN ap THEN 0.1 ELSE 0 END AS agrees FROM (VALUES {NUMERICS}) AS t(id, a, b, c, d, ua, ub, ap)",
    over=NUMERICS,
)
def m3_numeric_match(spark, sf_dir):
    """Numeric claims that agree with their source."""
    a, b, c, d, ua, ub, ap = map(F.col, ("a", "b", "c", "d", "ua", "ub", "ap"))
    return dealt(spark, sf_dir, NUMERICS, "id, a, b, c, d, ua, ub, ap").select("id", de.numeric_match(a, b, c, d, ua, ub, ap).alias("agrees"))


@query("d3_month_shift", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start FROM orders")
def d3_month_shift(spark, sf_dir):
    """Calendar arithmetic: a month on (clamped), month end, Monday of the week, quarter start."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "add_months(CAST(o_orderdate AS DATE), 1) AS next_month", "last_day(CAST(o_orderdate AS DATE)) AS month_end", "CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start", "CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start")


LABELS = "(1, '2024-03-15'), (2, '2024-02'), (3, '2023'), (4, '2024 Q3'), (5, '2024H1'), (6, '2024年5月'), (7, 'soon')"


@query(
    "d9_period_labels",
    f"""SELECT id, CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(s AS DATE) WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}$') THEN make_date(y, CAST(substr(s, 6, 2) AS INT), 1) WHEN regexp_matches(s, 'Q[1-4]$') THEN make_date(y, q * 3 - 2, 1)
      WHEN regexp_matches(s, 'H[12]$') THEN make_date(y, q * 6 - 5, 1) WHEN regexp_matches(s, '^\\d{{4}}年\\d{{1,2}}月$') THEN make_date(y, m, 1) WHEN regexp_matches(s, '^\\d{{4}}$') THEN make_date(y, 1, 1) END AS start_date,
    CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(s AS DATE) WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}$') THEN last_day(make_date(y, CAST(substr(s, 6, 2) AS INT), 1)) WHEN regexp_matches(s, 'Q[1-4]$') THEN last_day(make_date(y, q * 3, 1))
      WHEN regexp_matches(s, 'H[12]$') THEN last_day(make_date(y, q * 6, 1)) WHEN regexp_matches(s, '^\\d{{4}}年\\d{{1,2}}月$') THEN last_day(make_date(y, m, 1)) WHEN regexp_matches(s, '^\\d{{4}}$') THEN make_date(y, 12, 31) END AS end_date
    FROM (SELECT *, TRY_CAST(substr(s, 1, 4) AS INT) AS y, TRY_CAST(right(s, 1) AS INT) AS q, TRY_CAST(regexp_extract(s, '年(\\d+)月', 1) AS INT) AS m FROM (VALUES {LABELS}) AS t(id, s))""",
    over=LABELS,
)
def d9_period_labels(spark, sf_dir):
    """First and last day of period labels; what names no period has neither."""
    from factloom.functions import temporal

    start, end = temporal.period(F.col("s"))
    return dealt(spark, sf_dir, LABELS, "id, s").select("id", start.alias("start_date"), end.alias("end_date"))


@query(
    "k8_verification_requirement",
    "SELECT event_id, CASE WHEN t IN ('PRICE', 'VALUATION', 'RETURN', 'CORPORATE_EVENT') THEN 'ASYNC' WHEN user_id % 2 = 0 THEN 'NOT_VERIFIABLE' ELSE 'NOT_REQUIRED' END AS requirement FROM (SELECT *, " + TYPE_SQL + " AS t FROM events)",
)
def k8_verification_requirement(spark, sf_dir):
    """Which claims a provider can check, which are facts beyond it, and which need no check."""
    t = of(TYPES, F.expr("event_id % 7"))
    need = F.when(t.isin("PRICE", "VALUATION", "RETURN", "CORPORATE_EVENT"), "ASYNC").when(F.expr("user_id % 2 = 0"), "NOT_VERIFIABLE").otherwise("NOT_REQUIRED")
    return table(spark, sf_dir, "events").select("event_id", need.alias("requirement"))


CHECKS = "(1, '营收增长', '公司营收增长30%'), (2, '股价下跌', '股价上涨'), (3, '今年利润', '去年利润'), (4, '无方向', '平稳')"


@query(
    "m6_direction_and_overlap",
    f"""SELECT id, CASE WHEN contains(c, '增长') OR contains(c, '上涨') THEN contains(s, '增长') OR contains(s, '上涨') WHEN contains(c, '下跌') THEN contains(s, '下跌') ELSE true END AS direction_match,
    CASE WHEN contains(c, '今年') AND contains(s, '去年') THEN false ELSE true END AS time_match,
    round(len(list_filter(list_distinct([substr(c, i, 2) FOR i IN range(1, length(c))]), lambda p: contains(s, p))) / len(list_distinct([substr(c, i, 2) FOR i IN range(1, length(c))])), 6) AS overlap FROM (VALUES {CHECKS}) AS t(id, c, s)""",
    over=CHECKS,
)
def m6_direction_and_overlap(spark, sf_dir):
    """Direction, time words and overlap of a claim with its source."""
    c, s = F.col("c"), F.col("s")
    sign = lambda x: tx.contains_any(x, ("增长", "上涨")).cast("int") - tx.contains_any(x, ("下跌",)).cast("int")
    clash = F.contains(c, F.lit("今年")) & F.contains(s, F.lit("去年"))
    return dealt(spark, sf_dir, CHECKS, "id, c, s").select("id", ((sign(c) == 0) | (sign(c) == sign(s))).alias("direction_match"), (~clash).alias("time_match"), F.round(tx.bigram_overlap(c, s), 6).alias("overlap"))
