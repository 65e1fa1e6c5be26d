"""As-of queries: lifecycle ledger over `events`, prices over `lineitem` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import asof
from factloom.plans.catalog import dealt, query, table

BUSINESS, KNOWN = "2024-01-20 00:00:00", "2024-01-20 06:00:00"
LEDGER_SQL = "SELECT *, ts + to_minutes(CAST(props::JSON->>'k' AS BIGINT)) AS recorded FROM events"


def ledger(spark, sf_dir):
    """events as a lifecycle ledger: what happened at ts became known props.k minutes later."""
    lag = "ts + make_dt_interval(0, 0, CAST(get_json_object(props, '$.k') AS INT)) AS recorded"
    return table(spark, sf_dir, "events").selectExpr("user_id", "ts", "event_id", "event_type", "value", lag)


def instant(text):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "j7_bitemporal_asof",
    f"""SELECT user_id, max_by(event_type, struct_pack(a := ts, b := recorded, c := event_id)) AS status,
        max_by(event_id, struct_pack(a := ts, b := recorded, c := event_id)) AS event_id, max(ts) AS effective_at
    FROM ({LEDGER_SQL}) WHERE ts <= TIMESTAMP '{BUSINESS}' AND recorded <= TIMESTAMP '{KNOWN}' GROUP BY user_id""",
)
def j7_bitemporal_asof(spark, sf_dir):
    """Status of every target as of one instant, as known at another."""
    found = asof.bitemporal_asof(ledger(spark, sf_dir), ["user_id"], "ts", "recorded", "event_id", ["event_type", "event_id", "ts"], instant(BUSINESS), instant(KNOWN))
    return found.selectExpr("user_id", "event_type AS status", "event_id", "ts AS effective_at")


@query(
    "f8_ledger_active",
    f"""SELECT user_id, event_id FROM (SELECT user_id, max_by(event_type, struct_pack(a := ts, b := recorded, c := event_id)) AS s,
        max_by(event_id, struct_pack(a := ts, b := recorded, c := event_id)) AS event_id
        FROM ({LEDGER_SQL}) WHERE ts <= TIMESTAMP '{BUSINESS}' AND recorded <= TIMESTAMP '{KNOWN}' GROUP BY user_id) WHERE s IN ('view', 'click')""",
)
def f8_ledger_active(spark, sf_dir):
    """Targets whose state in force is one of the active ones."""
    return j7_bitemporal_asof(spark, sf_dir).where("status IN ('view', 'click')").select("user_id", "event_id")


@query(
    "q9_late_known_events",
    f"""SELECT event_type, count(*) AS n_late FROM ({LEDGER_SQL})
    WHERE ts <= TIMESTAMP '{BUSINESS}' AND recorded > TIMESTAMP '{BUSINESS}' AND recorded <= TIMESTAMP '{KNOWN}' GROUP BY event_type""",
)
def q9_late_known_events(spark, sf_dir):
    """Events that had happened at the cut-off and became known after it; none is dropped for being late."""
    late = ledger(spark, sf_dir).where((F.col("ts") <= instant(BUSINESS)) & (F.col("recorded") > instant(BUSINESS)) & (F.col("recorded") <= instant(KNOWN)))
    return late.groupBy("event_type").agg(F.count("*").alias("n_late"))


@query(
    "j8_latest_terminal_verification",
    f"""SELECT user_id, max_by(event_id, struct_pack(a := recorded, b := event_id)) AS verification_id FROM ({LEDGER_SQL})
    WHERE event_type IN ('purchase', 'error') AND recorded <= TIMESTAMP '{KNOWN}' AND CASE WHEN value < 30 THEN 'v1' ELSE 'v2' END = 'v2' GROUP BY user_id""",
)
def j8_latest_terminal_verification(spark, sf_dir):
    """Latest terminal result available at an instant, under the wanted version of the policy that decided it."""
    done = ledger(spark, sf_dir).where(F.col("event_type").isin("purchase", "error") & (F.col("recorded") <= instant(KNOWN)))
    done = done.withColumn("policy_version", F.when(F.col("value") < 30, "v1").otherwise("v2")).where("policy_version = 'v2'")
    return asof.latest(done, ["user_id"], ["recorded", "event_id"], ["event_id"]).withColumnRenamed("event_id", "verification_id")


@query(
    "j6_price_asof",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CAST(l.l_shipdate AS DATE) AS event_date, b.bar_date, b.bar_price FROM
      (SELECT * FROM lineitem WHERE l_returnflag = 'R') l LEFT JOIN LATERAL
      (SELECT CAST(x.l_shipdate AS DATE) AS bar_date, x.l_extendedprice AS bar_price FROM lineitem x
       WHERE x.l_returnflag = 'N' AND x.l_partkey = l.l_partkey AND CAST(x.l_shipdate AS DATE) <= CAST(l.l_shipdate AS DATE)
         AND CAST(x.l_shipdate AS DATE) >= CAST(l.l_shipdate AS DATE) - 90
       ORDER BY CAST(x.l_shipdate AS DATE) DESC, x.l_orderkey * 10 + x.l_linenumber DESC LIMIT 1) b ON true""",
)
def j6_price_asof(spark, sf_dir):
    """Last price of the part within 90 days before a return, from lines that were kept."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "CAST(l_shipdate AS DATE) AS d", "l_extendedprice AS price")
    left = lines.where("l_returnflag = 'R'").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "d AS event_date")
    bars = lines.where("l_returnflag = 'N'").selectExpr("l_partkey", "d AS bar_date", "price AS bar_price", "l_orderkey * 10 + l_linenumber AS line")
    return asof.asof_join(left, bars, ["l_partkey"], "event_date", "bar_date", 90, ["bar_date", "bar_price"], "line")


@query(
    "s14_source_heads",
    """SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS head_id,
        max_by(event_id, struct_pack(a := ts, b := event_id)) FILTER (event_type = 'purchase') AS verified_id FROM events GROUP BY user_id""",
)
def s14_source_heads(spark, sf_dir):
    """Newest and newest verified snapshot of each source, whatever the order of arrival."""
    heads = asof.newest_heads(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id"], F.col("event_type") == "purchase")
    return heads.selectExpr("user_id", "head.event_id AS head_id", "verified_head.event_id AS verified_id")


@query(
    "w14_payload_fold",
    f"""SELECT user_id, event_type AS field, max_by(value, event_id) AS value FROM ({LEDGER_SQL})
    WHERE ts <= TIMESTAMP '{BUSINESS}' AND recorded <= TIMESTAMP '{KNOWN}' GROUP BY user_id, event_type""",
)
def w14_payload_fold(spark, sf_dir):
    """Visible payloads merged in chain order (event id), field by field; the last one to set a field wins."""
    seen = ledger(spark, sf_dir).where((F.col("ts") <= instant(BUSINESS)) & (F.col("recorded") <= instant(KNOWN))).withColumnRenamed("event_type", "field")
    return asof.fold_payload(seen, "user_id", "field", "value", "event_id")


@query(
    "w15_latest_verified_result",
    """SELECT o_custkey, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS result_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
)
def w15_latest_verified_result(spark, sf_dir):
    """Latest finished result of each claim."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return asof.latest(done, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]).withColumnRenamed("o_orderkey", "result_id")


CLAIM_EVENTS = (
    "(1, 'A', TIMESTAMP '2024-01-01 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-02 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00'),"
    "(2, 'B', TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-04 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-03 00:00:00'),"
    "(3, 'C', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-04 00:00:00', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-04 00:00:00'),"
    "(4, 'D', TIMESTAMP '2024-01-01 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-09 00:00:00', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)),"
    "(5, 'E', TIMESTAMP '2023-06-01 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-10 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-10 00:00:00'),"
    "(6, 'F', TIMESTAMP '2024-01-11 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00')"
)
CLAIM_COLUMNS = "event_id, event_type, business_from, business_to, known_from, known_to, available_from"


@query(
    "q9_three_clock_visibility",
    f"""SELECT event_id, coalesce(known_from <= TIMESTAMP '2024-01-10' AND (known_to IS NULL OR TIMESTAMP '2024-01-10' < known_to) AND available_from <= TIMESTAMP '2024-01-10'
      AND (business_from IS NULL OR business_from <= TIMESTAMP '2024-01-10') AND (business_to IS NULL OR TIMESTAMP '2024-01-10' < business_to), false) AS visible
    FROM (VALUES {CLAIM_EVENTS}) AS t({CLAIM_COLUMNS})""",
    over=CLAIM_EVENTS, key="event_id",
)
def q9_three_clock_visibility(spark, sf_dir):
    """Visibility of claim state events at the same instant on all three clocks; ends are exclusive."""
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    see = asof.visible("business_from", "known_from", "available_from", at, at, at, "business_to", "known_to")
    return dealt(spark, sf_dir, CLAIM_EVENTS, CLAIM_COLUMNS).select("event_id", see.alias("visible"))
