"""Calendar queries: ship dates of `lineitem` as sessions of exchanges in two versions, `orders` as references to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import calendars
from factloom.plans.catalog import query, table

#: A flag's ship dates are its exchange's sessions; version 2 has only open lines and became available in 1998. Versions of
#: the fiscal calendars (years that begin in April) are one a year: each knows the quarters up to its own.
SESSIONS = """SELECT l_returnflag AS calendar_id, 1 AS version, TIMESTAMP{ntz} '1996-01-01 00:00:00' AS available_at, CAST(l_shipdate AS DATE) AS session_date FROM {lineitem}
    UNION ALL SELECT l_returnflag, 2, TIMESTAMP{ntz} '1998-06-01 00:00:00', CAST(l_shipdate AS DATE) FROM {lineitem} WHERE l_linestatus = 'O'"""
REFS = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'N' WHEN '3-MEDIUM' THEN 'R' ELSE CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'Z' END END AS calendar_id, o_orderdate AS as_of,
    CAST(floor(o_totalprice / 1000) AS INT) - 200 AS {offset}, CASE WHEN o_orderstatus <> 'P' THEN concat(CAST(year(o_orderdate) AS {text}), '-Q', CAST(quarter(o_orderdate) AS {text})) ELSE 'soon' END AS period_label FROM {orders}"""
PERIODS = """SELECT calendar_id, CAST(v AS INT) AS version, make_date(CAST(v AS INT), 1, 15) AS available_at, concat(CAST(y AS {text}), '-Q', CAST(q AS {text})) AS period_label, make_date(CAST(y AS INT), CAST(3 * q - 2 AS INT), 1) AS start_date,
    CASE WHEN q = 4 THEN make_date(CAST(y + 1 AS INT), 1, 1) ELSE make_date(CAST(y AS INT), CAST(3 * q + 1 AS INT), 1) END - INTERVAL 1 DAY AS end_date FROM (SELECT DISTINCT l_returnflag AS calendar_id, year(l_shipdate) AS v FROM {lineitem} WHERE l_shipdate >= TIMESTAMP{ntz} '1996-01-01 00:00:00') AS c
    CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS y, quarter(l_shipdate) AS q FROM {lineitem}) AS p WHERE y <= v"""
_DUCK = {"ntz": "", "text": "VARCHAR", "lineitem": "lineitem", "orders": "orders", "offset": '"offset"'}
_SPARK = {"ntz": "_NTZ", "text": "STRING", "lineitem": "{lineitem}", "orders": "{orders}", "offset": "offset"}


def _tables(spark, sf_dir):
    return {"lineitem": table(spark, sf_dir, "lineitem"), "orders": table(spark, sf_dir, "orders")}


def refs(spark, sf_dir):
    return spark.sql(REFS.format(**_SPARK), orders=_tables(spark, sf_dir)["orders"])


@query(
    "d7_session_references",
    f"""WITH s AS (SELECT DISTINCT * FROM ({SESSIONS.format(**_DUCK)})), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY calendar_id, version ORDER BY session_date) AS number FROM s), v AS (SELECT DISTINCT calendar_id, version, available_at FROM s),
    r AS ({REFS.format(**_DUCK)}), h AS (SELECT r.*, v.version, v.available_at FROM r ASOF LEFT JOIN v ON v.calendar_id = r.calendar_id AND r.as_of >= v.available_at),
    b AS (SELECT h.*, n.session_date AS base_date, n.number FROM h ASOF LEFT JOIN n ON n.calendar_id = h.calendar_id AND n.version = h.version AND CAST(h.as_of AS DATE) >= n.session_date)
    SELECT o_orderkey, b.version, b.base_date, t.session_date AS target_date, CASE WHEN b.version IS NULL AND b.calendar_id IN (SELECT calendar_id FROM v) THEN '{calendars.VIOLATION}' WHEN b.version IS NULL THEN '{calendars.NOT_FOUND}' WHEN t.session_date IS NOT NULL THEN '{calendars.RESOLVED}' ELSE '{calendars.OUT_OF_RANGE}' END AS status
    FROM b LEFT JOIN n t ON t.calendar_id = b.calendar_id AND t.version = b.version AND t.number = b.number + b."offset" """,
)
def d7_session_references(spark, sf_dir):
    """The session so many sessions before or after each order, by the calendar as it was known then."""
    sessions = spark.sql(SESSIONS.format(**_SPARK), lineitem=_tables(spark, sf_dir)["lineitem"])
    return calendars.resolve_sessions(refs(spark, sf_dir), sessions).select("o_orderkey", "version", "base_date", "target_date", "status")


@query(
    "d7_fiscal_references",
    f"""WITH p AS ({PERIODS.format(**_DUCK)}), v AS (SELECT DISTINCT calendar_id, version, available_at FROM p), r AS ({REFS.format(**_DUCK)}), h AS (SELECT r.*, v.version FROM r ASOF LEFT JOIN v ON v.calendar_id = r.calendar_id AND r.as_of >= v.available_at)
    SELECT o_orderkey, h.version, p.start_date, CAST(p.end_date AS DATE) AS end_date, CASE WHEN h.version IS NULL AND h.calendar_id IN (SELECT calendar_id FROM v) THEN '{calendars.VIOLATION}' WHEN h.version IS NULL THEN '{calendars.NOT_FOUND}' WHEN p.start_date IS NOT NULL THEN '{calendars.RESOLVED}' ELSE '{calendars.OUT_OF_RANGE}' END AS status
    FROM h LEFT JOIN p ON p.calendar_id = h.calendar_id AND p.version = h.version AND p.period_label = h.period_label""",
)
def d7_fiscal_references(spark, sf_dir):
    """The bounds of the fiscal quarter that each order names, by the calendar as it was known then."""
    periods = spark.sql(PERIODS.format(**_SPARK), lineitem=_tables(spark, sf_dir)["lineitem"]).withColumn("available_at", F.col("available_at").cast("timestamp_ntz"))
    return calendars.resolve_periods(refs(spark, sf_dir), periods).select("o_orderkey", "version", "start_date", F.col("end_date").cast("date").alias("end_date"), "status")
