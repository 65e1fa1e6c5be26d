"""Classes of statements and time expressions; the tables have no Chinese text, so events say phrases by their k."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import semantics as sm
from factloom.functions import text as tx
from factloom.plans.catalog import dealt, query, table

STATEMENTS = """(1, 'FORECAST', '银行业绩有望反弹'), (2, 'PRICE', 'GPU价格上涨5%'), (3, 'INFERENCE', '因为算力不足，所以订单增加'), (4, 'INFERENCE', '黄金储备走高'), (5, 'RETURN', '我认为仓位太高'), (6, '', '信息基建流程'), (7, 'FORECAST', '预测值为3'), (8, 'OPINION', '平淡'), (9, 'PRICE', '收益 -5%'), (10, 'PRICE', '收益 ＋ 三')"""

DIGITS = "(1, '百二十三'), (2, '百分之五'), (3, 'x零')"
BEGINNINGS = "(1, '自2023年起'), (2, '从2024Q2以来'), (3, 'Since 2022'), (4, 'from 2021-3'), (5, '2024年')"


def statements(spark, sf_dir):
    return dealt(spark, sf_dir, STATEMENTS, "id, kind, s")


@query("t18_domains", "SELECT * FROM (VALUES (1, 'FINANCIAL_SECTOR_CAPITAL_POLICY'), (2, 'AI_INFERENCE_COMPUTE'), (3, 'AI_INFERENCE_COMPUTE'), (4, 'CENTRAL_BANK_GOLD_RESERVES'), (5, 'PORTFOLIO_RISK_MANAGEMENT'), (6, 'INFORMATION_INFRASTRUCTURE_POLICY'), (7, 'UNKNOWN'), (8, 'UNKNOWN'), (9, 'UNKNOWN'), (10, 'UNKNOWN')) AS t(id, domain)", over=STATEMENTS)
def t18_domains(spark, sf_dir):
    """Primary domain of statements."""
    return statements(spark, sf_dir).select("id", sm.domain(F.col("s")).alias("domain"))


@query("t19_natures", "SELECT * FROM (VALUES (1, 'FORECAST'), (2, 'FACT'), (3, 'CAUSAL_THESIS'), (4, 'OPINION'), (5, 'OPINION'), (6, 'METHOD'), (7, 'FORECAST'), (8, 'OPINION'), (9, 'FACT'), (10, 'FACT')) AS t(id, nature)", over=STATEMENTS)
def t19_natures(spark, sf_dir):
    """Nature of claims by type and words."""
    return statements(spark, sf_dir).select("id", sm.nature(F.col("kind"), F.col("s")).alias("nature"))


@query("t21_roles", "SELECT * FROM (VALUES (1, 'IMPLICATION'), (2, 'EVIDENCE'), (3, 'MECHANISM'), (4, 'EVIDENCE'), (5, 'EVIDENCE'), (6, 'EVIDENCE'), (7, 'EVIDENCE'), (8, 'EVIDENCE'), (9, 'EVIDENCE'), (10, 'EVIDENCE')) AS t(id, role)", over=STATEMENTS)
def t21_roles(spark, sf_dir):
    """Part that claims play in an argument."""
    return statements(spark, sf_dir).select("id", sm.role(F.col("kind"), F.col("s")).alias("role"))


@query("l10_directions", "SELECT * FROM (VALUES (1, NULL), (2, 'UP'), (3, 'UP'), (4, 'UP'), (5, NULL), (6, NULL), (7, NULL), (8, NULL), (9, 'DOWN'), (10, NULL)) AS t(id, direction)", over=STATEMENTS)
def l10_directions(spark, sf_dir):
    """Direction by words, else by signed numbers."""
    return statements(spark, sf_dir).select("id", sm.direction(F.col("s")).alias("direction"))


@query("l12_plain_digits", "SELECT * FROM (VALUES (1, '百2十3'), (2, '5'), (3, 'x0')) AS t(id, s)", over=DIGITS)
def l12_plain_digits(spark, sf_dir):
    """Chinese digits as Arabic ones."""
    return dealt(spark, sf_dir, DIGITS, "id, s").select("id", sm.plain_digits(F.col("s")).alias("s"))


TIMES = "(1, '盘前公告'), (2, 'After-hours'), (3, '集合竞价'), (4, '休市'), (5, '盘中'), (6, '预计2026Q2'), (7, '计划 明年'), (8, '下修预期'), (9, '2024')"


@query("d6_sessions", "SELECT * FROM (VALUES (1, 'PREMARKET'), (2, 'AFTERHOURS'), (3, 'AUCTION'), (4, 'CLOSED'), (5, 'REGULAR'), (6, NULL), (7, NULL), (8, NULL), (9, NULL)) AS t(id, session)", over=TIMES)
def d6_sessions(spark, sf_dir):
    """Market session that an expression names."""
    return dealt(spark, sf_dir, TIMES, "id, s").select("id", sm.market_session(F.col("s")).alias("session"))


@query("d2_assertions", "SELECT * FROM (VALUES (1, NULL), (2, NULL), (3, NULL), (4, NULL), (5, NULL), (6, 'EXPECTED'), (7, 'PLANNED'), (8, 'REVISED'), (9, NULL)) AS t(id, status)", over=TIMES)
def d2_assertions(spark, sf_dir):
    """Whether a time is expected, planned or revised."""
    return dealt(spark, sf_dir, TIMES, "id, s").select("id", sm.assertion(F.col("s")).alias("status"))


@query("d4_open_ended", "SELECT * FROM (VALUES (1, DATE '2023-01-01', 'CY2023'), (2, DATE '2024-04-01', '2024Q2'), (3, DATE '2022-01-01', 'CY2022'), (4, DATE '2021-07-01', '2021Q3'), (5, NULL, NULL)) AS t(id, start_date, label)", over=BEGINNINGS)
def d4_open_ended(spark, sf_dir):
    """Expressions that only have a beginning."""
    start, label = sm.open_start(F.col("s"))
    return dealt(spark, sf_dir, BEGINNINGS, "id, s").select("id", start.alias("start_date"), label.alias("label"))


@query("d8_role_defaults", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'FORECAST' WHEN 'A' THEN 'INTERVAL' ELSE 'INSTANT' END AS scope, CASE WHEN l_returnflag = 'R' THEN 'EXPECTED' ELSE 'ACTUAL' END AS assertion FROM lineitem")
def d8_role_defaults(spark, sf_dir):
    """Scope and assertion that the role of each binding implies."""
    role = F.when(F.col("l_returnflag") == "R", "FORECAST_TARGET").when(F.col("l_returnflag") == "A", "CONDITION_PERIOD").otherwise("ASSERTED")
    scope, assertion = sm.role_defaults(role, F.lit("INSTANT"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scope.alias("scope"), assertion.alias("assertion"))


@query("d11_weeks_and_days", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) + 7 AS next_start, CAST(date_trunc('week', o_orderdate) AS DATE) + 13 AS next_end, CAST(date_trunc('week', o_orderdate) AS DATE) AS this_start, CAST(o_orderdate AS DATE) + 1 AS tomorrow FROM orders")
def d11_weeks_and_days(spark, sf_dir):
    """Next week, this week and tomorrow, seen from the day of each order."""
    day = F.to_date("o_orderdate")
    (a, b), (c, _), (d, _) = (sm.week_or_day(F.lit(s), day) for s in ("下周", "本周", "明天"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("next_start"), b.alias("next_end"), c.alias("this_start"), d.alias("tomorrow"))


@query("m10_reading_levels", "SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount >= 0.95 THEN 'HIGH' WHEN 1 - l_discount >= 0.93 THEN 'MEDIUM' WHEN 1 - l_discount >= 0.85 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM lineitem")
def m10_reading_levels(spark, sf_dir):
    """How far a reading of a frame can be trusted."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sm.reading_level(1 - F.col("l_discount")).alias("level"))


@query("t22_locatable_quotes", "SELECT a.conv_id, a.turn, contains(lower(b.text), lower(trim(a.text))) AS located FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 0")
def t22_locatable_quotes(spark, sf_dir):
    """Whether each turn stands as a whole in the first one, case ignored."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("first"))
    return turns.join(first, "conv_id").select("conv_id", "turn", F.contains(F.lower("first"), F.lower(F.trim("text"))).alias("located"))


@query("t6_sentiments", "SELECT * FROM (VALUES (1, 'NEUTRAL'), (2, 'BULLISH'), (3, 'NEUTRAL'), (4, 'NEUTRAL'), (5, 'NEUTRAL'), (6, 'NEUTRAL'), (7, 'NEUTRAL'), (8, 'NEUTRAL'), (9, 'NEUTRAL'), (10, 'NEUTRAL')) AS t(id, sentiment)", over=STATEMENTS)
def t6_sentiments(spark, sf_dir):
    """Sentiment of statements by their words."""
    return statements(spark, sf_dir).select("id", tx.sentiment(F.col("s")).alias("sentiment"))
