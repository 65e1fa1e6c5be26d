"""Signal, cue and time queries over literal rows and the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.functions import text as tx
from factloom.operators import signals as sg
from factloom.plans.catalog import dealt, query, table

WHEN = (
    "(1, '2024年5月3日'), (2, '2024年第二季度'), (3, '第三季度'), (4, '今年1季度'), (5, 'YTD'), (6, 'TTM'), (7, 'NTM'), (8, '昨天'), (9, '明日'), (10, '以后'), (11, '永久'), (12, '2023'), (13, '2024 Q3'), (14, '2024-02-30')"
)


@query(
    "d1_time_expressions",
    """SELECT * FROM (VALUES (1, DATE '2024-05-03', DATE '2024-05-03', 'DAY'), (2, DATE '2024-04-01', DATE '2024-06-30', 'QUARTER'), (3, DATE '2024-07-01', DATE '2024-09-30', 'QUARTER'), (4, DATE '2024-01-01', DATE '2024-03-31', 'QUARTER'),
    (5, DATE '2024-01-01', DATE '2024-03-15', 'ROLLING'), (6, DATE '2024-03-15' - 365, DATE '2024-03-15', 'ROLLING'), (7, DATE '2024-03-15', DATE '2024-03-15' + 365, 'ROLLING'), (8, DATE '2024-03-14', DATE '2024-03-14', 'DAY'), (9, DATE '2024-03-16', DATE '2024-03-16', 'DAY'),
    (10, NULL, NULL, 'UNRESOLVED'), (11, NULL, NULL, 'TIMELESS'), (12, DATE '2023-01-01', DATE '2023-12-31', 'PERIOD'), (13, DATE '2024-07-01', DATE '2024-09-30', 'PERIOD'), (14, NULL, NULL, 'UNRESOLVED')) AS t(id, start_date, end_date, kind)""",
    over=WHEN,
)
def d1_time_expressions(spark, sf_dir):
    """Time expressions against the day 2024-03-15."""
    found = temporal.resolve(F.col("s"), F.lit("2024-03-15").cast("date"))
    return dealt(spark, sf_dir, WHEN, "id, s").select("id", found.alias("t")).select("id", "t.start_date", "t.end_date", "t.kind")


CUE_TEXTS = "(1, '营收 12.5亿元，看K线'), (2, '600519 上涨'), (3, '2024年5月3日 政策公告'), (4, '平安银行与半导体芯片'), (5, '随便聊聊'), (6, '关注上游设备')"


@query(
    "t29_cues",
    f"""SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(s, '(^|[^A-Za-z0-9])\\d+(?:,\\d{{3}})*(?:\\.\\d+)?($|[^A-Za-z0-9])') THEN 'NUMERIC' END, CASE WHEN regexp_matches(s, '\\d+(?:\\.\\d+)?\\s*(?:%|％|亿元|万亿元|万元|万|亿|倍|个|台|吨|美元|人民币|USD|CNY)') THEN 'UNIT' END,
      CASE WHEN regexp_matches(s, '(?:19|20)\\d{{2}}(?:年|[-/.])(?:0?[1-9]|1[0-2])(?:月|[-/.])?(?:0?[1-9]|[12]\\d|3[01])?') THEN 'DATE' END, CASE WHEN regexp_matches(s, '(^|[^0-9])\\d{{6}}($|[^0-9])') THEN 'TICKER' END, CASE WHEN regexp_matches(s, '[一-龥A-Za-z]{{2,16}}(?:股份有限公司|有限公司|集团|银行|证券|科技|控股)') THEN 'COMPANY' END,
      CASE WHEN regexp_matches(s, '产品|型号|芯片|GPU|CPU|服务器|软件|平台|版本') THEN 'PRODUCT' END, CASE WHEN regexp_matches(s, '行业|板块|赛道|产业链|金融|算力|半导体|银行业') THEN 'INDUSTRY' END, CASE WHEN regexp_matches(s, 'K线|走势图|曲线|图表|成交量|均线|支撑位|压力位') THEN 'CHART' END,
      CASE WHEN regexp_matches(s, '政策|文件|通知|公告|规划|条例|意见|增资|降准') THEN 'POLICY_DOCUMENT' END, CASE WHEN regexp_matches(s, '关注|關注|上游|设备|設備|弹性|彈性') THEN 'TARGET_CUE' END], lambda x: x IS NOT NULL), ',') AS cues,
    array_to_string(list_filter(['算力', '黄金', '半导体', 'AI', '消费', '券商', '银行', '新能源', '医药'], lambda x: contains(s, x)), ',') AS themes FROM (VALUES {CUE_TEXTS}) AS t(id, s)""",
    over=CUE_TEXTS,
)
def t29_cues(spark, sf_dir):
    """Cues for frames and themes of texts."""
    s = F.col("s")
    return dealt(spark, sf_dir, CUE_TEXTS, "id, s").select("id", F.array_join(tx.cues(s), ",").alias("cues"), F.array_join(tx.themes(s, ("算力",)), ",").alias("themes"))


CLAIMS = "(1, 'AAPL rose 12%', 'AAPL said it rose 12% today'), (2, 'AAPL rose 13%', 'AAPL rose 12%'), (3, 'no tokens here', ''), (4, 'BRK.B at 3,5', 'BRK.B')"


@query("k1_token_grounding", "SELECT * FROM (VALUES (1, '', true), (2, '13%', false), (3, '', true), (4, '3,5', false)) AS t(id, missing, grounded)", over=CLAIMS)
def k1_token_grounding(spark, sf_dir):
    """Hard tokens of conclusions that their evidence lacks."""
    lost = tx.ungrounded(F.col("c"), F.col("e"))
    return dealt(spark, sf_dir, CLAIMS, "id, c, e").select("id", F.array_join(lost, "|").alias("missing"), (F.size(lost) == 0).alias("grounded"))


@query("t2_corrections", r"SELECT conv_id, turn, CASE WHEN text <> trim(regexp_replace(text, '[\t\n\r\f\v ]+', ' ', 'g')) THEN 1 ELSE 0 END AS n_corrections FROM conversations")
def t2_corrections(spark, sf_dir):
    """Turns whose white space a clean transcript changes."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tx.corrections(F.col("text"))).alias("n_corrections"))


@query(
    "a6_signal_projection",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN 'signal-' || substr(sha256(l_suppkey || ':' || l_partkey || ':' || l_linenumber), 1, 32) END AS signal_id, CASE WHEN l_returnflag = 'A' THEN 'MISSING_LINEAGE' END AS reason FROM lineitem""",
)
def a6_signal_projection(spark, sf_dir):
    """Signals with complete lineage, and why others are none."""
    units = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS snapshot", "l_partkey AS claim", "l_linenumber AS occurrence", "'seg' AS segment", "IF(l_returnflag = 'A', NULL, l_returnflag) AS lifecycle")
    return sg.project(units, "snapshot", "claim", "occurrence", "segment", "lifecycle").select("l_orderkey", "l_linenumber", "signal_id", "reason")


PAYLOADS = """(1, '{"claim":1,"order":2}'), (2, '{"claim":1}'), (3, '{"leverage":1,"order":0,"x":{"position":1}}'), (4, '[]')"""


@query("f28_trading_fields", f"SELECT id, array_to_string(list_sort(list_intersect(CASE WHEN json_type(s::JSON) = 'OBJECT' THEN json_keys(s::JSON) ELSE [] END, ['order', 'position', 'leverage', 'trade_authorization'])), ',') AS forbidden FROM (VALUES {PAYLOADS}) AS t(id, s)", over=PAYLOADS)
def f28_trading_fields(spark, sf_dir):
    """Top-level fields that a content signal must not carry."""
    return dealt(spark, sf_dir, PAYLOADS, "id, s").select("id", F.coalesce(F.array_join(sg.trading_fields(F.col("s")), ","), F.lit("")).alias("forbidden"))


@query(
    "w9_transcript_selection",
    """SELECT user_id, CASE WHEN r IS NULL THEN NULL ELSE r % 100000000 END AS event_id FROM (SELECT user_id, min(CASE WHEN value > 30 AND event_type IN ('signup', 'click', 'view') THEN CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 100000000 ELSE 200000000 END + event_id END) AS r FROM events GROUP BY user_id)""",
)
def w9_transcript_selection(spark, sf_dir):
    """First passing candidate of each video by authority."""
    made = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "CASE event_type WHEN 'signup' THEN 'OFFICIAL_SUBTITLE' WHEN 'click' THEN 'AUTO_SUBTITLE' WHEN 'view' THEN 'ASR' END AS source", "value > 30 AS passed")
    return sg.select_transcript(made, "user_id", "source", "event_id", "passed")


@query(
    "g3_registry_merge",
    """WITH a AS (SELECT c_custkey AS k, (['OPEN', 'AUTO_RESOLVED', 'MANUAL_RESOLVED', 'SUPERSEDED'])[CAST(c_custkey % 4 AS INT) + 1] AS s, c_custkey % 4 AS p FROM customer WHERE c_nationkey >= 8), b AS (SELECT c_custkey AS k, (['OPEN', 'AUTO_RESOLVED', 'MANUAL_RESOLVED', 'SUPERSEDED'])[CAST(c_custkey // 4 % 4 AS INT) + 1] AS s, c_custkey // 4 % 4 AS p FROM customer WHERE c_acctbal < 8000)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.p > a.p THEN b.s ELSE a.s END AS s FROM a FULL JOIN b ON a.k = b.k""",
)
def g3_registry_merge(spark, sf_dir):
    """Conflict states after a rerun: they advance but never fall back."""
    names = "array('OPEN', 'AUTO_RESOLVED', 'MANUAL_RESOLVED', 'SUPERSEDED')"
    base = table(spark, sf_dir, "customer")
    old = base.where("c_nationkey >= 8").selectExpr("c_custkey AS k", f"{names}[CAST(c_custkey % 4 AS INT)] AS s")
    new = base.where("c_acctbal < 8000").selectExpr("c_custkey AS k", f"{names}[CAST(c_custkey div 4 % 4 AS INT)] AS s")
    return sg.advance(old, new, "k", "s", ["OPEN", "AUTO_RESOLVED", "MANUAL_RESOLVED", "SUPERSEDED"])


@query("j3_evidence_owners", "SELECT part, min(src) AS first_source, claim FROM (SELECT l_partkey AS part, l_orderkey AS claim, 0 AS src FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_partkey, l_orderkey, 1 FROM lineitem WHERE l_returnflag = 'R') GROUP BY part, claim")
def j3_evidence_owners(spark, sf_dir):
    """Claims that own a piece of evidence, final owners before legacy ones."""
    lines = table(spark, sf_dir, "lineitem")
    final = lines.where("l_linestatus = 'F'").selectExpr("l_partkey AS part", "l_orderkey AS claim", "0 AS src")
    legacy = lines.where("l_returnflag = 'R'").selectExpr("l_partkey AS part", "l_orderkey AS claim", "1 AS src")
    return final.unionByName(legacy).groupBy("part", "claim").agg(F.min("src").alias("first_source"))


@query("j5_retention_candidates", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal < 0")
def j5_retention_candidates(spark, sf_dir):
    """Artifacts with their source and locator."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.where("s_acctbal < 0").join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("g26_counters", "SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS label, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM events GROUP BY 1, 2")
def g26_counters(spark, sf_dir):
    """Counters by allowed labels."""
    label = F.when(F.col("value") > 50, "high").otherwise("low")
    return table(spark, sf_dir, "events").groupBy("event_type", label.alias("label")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total_cents"))


@query("o10_entities_capped", "SELECT conv_id, turn, array_to_string(list_slice(list_distinct_ordered, 1, 12), ',') AS entities FROM (SELECT conv_id, turn, list_reduce(list_prepend([]::VARCHAR[], [[w] FOR w IN regexp_extract_all(text, '[A-Z][a-z]+')]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM conversations)")
def o10_entities_capped(spark, sf_dir):
    """First twelve distinct names of a text, in order."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.slice(names, 1, 12), ",").alias("entities"))


@query("d14_forecast_reviews", "SELECT o_orderkey, CAST(min(l_shipdate) AS DATE) AS target_end FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey HAVING CAST(min(l_shipdate) AS DATE) < DATE '1998-06-01'")
def d14_forecast_reviews(spark, sf_dir):
    """Open forecasts whose earliest target has ended before the evaluation."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("target_end")).where("target_end < DATE '1998-06-01'")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey").distinct().join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "target_end")
