"""Knowledge queries: statements as literal rows, ledgers and frames from `events`, boundaries from `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import knowledge as kn
from factloom.plans.asof import LEDGER_SQL, ledger
from factloom.plans.catalog import dealt, query, rows, table
from factloom.plans.intervals import FRAMES_SQL, SEGMENTS_SQL, frames, segments

SAID = "(1, 'FORECAST', '公司预计明年利润增长'), (2, 'INFERENCE', '因为降价，所以销量上升'), (3, 'PRICE', '股价已经下滑'), (4, 'PRICE', '我认为看好'), (5, 'OTHER', '收入和利润以及订单'), (6, 'OPINION', 'GPU 芯片算力'), (7, 'VALUATION', '如果银行资本补充；估值改善'), (8, 'METHOD', '')"


def has(words):
    return "(" + " OR ".join(f"contains(s, '{w}')" for w in words) + ")"


@query(
    "t20_statement_classes",
    f"""SELECT id, CASE WHEN {has(kn.NEGATIVE)} THEN 'NEGATIVE' WHEN {has(kn.POSITIVE)} THEN 'POSITIVE' ELSE 'NEUTRAL' END AS polarity,
    CASE WHEN {has(kn.CONDITIONAL)} THEN 'CONDITIONAL' WHEN {has(kn.FUTURE)} THEN 'FUTURE' WHEN {has(kn.PAST)} THEN 'PAST' WHEN s <> '' THEN 'PRESENT' ELSE 'UNKNOWN' END AS tense,
    CASE WHEN {has(('资本补充', '银行资本', '银行', '保险'))} THEN 'FINANCIAL_SECTOR_CAPITAL_POLICY' WHEN regexp_matches(lower(s), 'ai推理|推理算力|gpu|算力|芯片') THEN 'AI_INFERENCE_COMPUTE' WHEN regexp_matches(s, '信息基础设施|基础设施投资|信息基建') THEN 'INFORMATION_INFRASTRUCTURE_POLICY' WHEN regexp_matches(s, '黄金|央行储备') THEN 'CENTRAL_BANK_GOLD_RESERVES' WHEN regexp_matches(s, '仓位|资金池|止损|均线|杠杆|风险预算|集中度') THEN 'PORTFOLIO_RISK_MANAGEMENT' ELSE 'UNKNOWN' END AS domain,
    CASE WHEN t IN ('FORECAST', 'OPINION') THEN t WHEN t = 'INFERENCE' THEN CASE WHEN {has(kn.CAUSAL)} THEN 'CAUSAL_THESIS' ELSE 'OPINION' END WHEN {has(kn.OPINION)} THEN 'OPINION' WHEN t IN ('PRICE', 'VALUATION') THEN 'FACT' ELSE 'METHOD' END AS nature,
    len(list_filter(string_split_regex(s, '[；;。！？!?]'), lambda c: trim(c) <> '')) = 1 AND NOT regexp_matches(s, '{kn.METRICS}.*(?:以及|同时|并且|，|、|和).*{kn.METRICS}') AS atomic FROM (VALUES {SAID}) AS v(id, t, s)""",
    over=SAID,
)
def t20_statement_classes(spark, sf_dir):
    """Polarity, tense, domain, nature and atomicity of statements."""
    from factloom.functions.text import kind

    s, t = F.col("s"), F.col("t")
    return dealt(spark, sf_dir, SAID, "id, t, s").select("id", kn.polarity(s).alias("polarity"), kn.tense(s).alias("tense"), kind(s, kn.DOMAIN_TERMS, "UNKNOWN").alias("domain"), kn.claim_nature(t, s).alias("nature"), kn.atomic(s).alias("atomic"))


AT = "TIMESTAMP '2024-01-10 00:00:00'"
UNITS = (
    "(1, 'EXACT', TIMESTAMP '2024-01-09 00:00:00', TIMESTAMP '2024-01-08 00:00:00'), (2, 'EXACT', TIMESTAMP '2024-01-11 00:00:00', TIMESTAMP '2024-01-08 00:00:00'), (3, 'PUBLISHED_TIME_PROXY', TIMESTAMP '2024-01-09 00:00:00', TIMESTAMP '2024-01-10 00:00:00'),"
    "(4, 'UNKNOWN', TIMESTAMP '2024-01-09 00:00:00', CAST(NULL AS TIMESTAMP)), (5, CAST(NULL AS VARCHAR(9)), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)), (6, 'EXACT', TIMESTAMP '2024-01-09 00:00:00', TIMESTAMP '2024-01-10 00:00:01')"
)


@query(
    "f3_pit_modes",
    f"""SELECT id, coalesce(a <= {AT}, true) AS system, coalesce(a <= {AT}, true) AND coalesce(s <= {AT}, false) AND coalesce(q = 'EXACT', false) AS public_strict,
    coalesce(a <= {AT}, true) AND coalesce(s <= {AT}, false) AND coalesce(q IN ('EXACT', 'PUBLISHED_TIME_PROXY', 'INGEST_TIME_UPPER_BOUND'), false) AS public_allow_proxy FROM (VALUES {UNITS}) AS t(id, q, a, s)""",
    over=UNITS,
)
def f3_pit_modes(spark, sf_dir):
    """Which units each point-in-time mode shows."""
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    see = lambda mode: kn.pit_match(mode, F.col("q"), F.col("a"), F.col("s"), at)
    return dealt(spark, sf_dir, UNITS, "id, q, a, s").select("id", see("SYSTEM").alias("system"), see("PUBLIC_STRICT").alias("public_strict"), see("PUBLIC_ALLOW_PROXY").alias("public_allow_proxy"))


@query(
    "f7_embedded_state",
    f"SELECT user_id % 400 AS unit, max_by(event_type, struct_pack(a := ts, b := recorded, c := event_id)) FILTER (ts <= TIMESTAMP '2024-01-15' AND recorded <= TIMESTAMP '2024-01-16') AS state FROM ({LEDGER_SQL}) GROUP BY 1",
)
def f7_embedded_state(spark, sf_dir):
    """State in force from the events that a unit carries in an array."""
    carried = ledger(spark, sf_dir).groupBy(F.expr("user_id % 400 AS unit")).agg(F.collect_list(F.struct(F.col("ts").alias("effective_at"), F.col("recorded").alias("recorded_at"), "event_id", F.col("event_type").alias("to_status"))).alias("events"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return carried.select("unit", kn.state_in_events(F.col("events"), at("2024-01-15 00:00:00"), at("2024-01-16 00:00:00")).alias("state"))


@query(
    "f11_public_strict",
    """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber <> 6 AND l_partkey % 9 <> 0 AND l_suppkey % 6 >= 3 AND (l_linenumber % 2 = 0 OR l_returnflag = 'N') GROUP BY l_orderkey""",
)
def f11_public_strict(spark, sf_dir):
    """Units fit for public use: active, reviewed, undisputed, grounded, well supported, with primary evidence."""
    item = F.expr("array(named_struct('ownership', IF(l_linenumber % 2 = 0, 'PRIMARY', 'SECONDARY'), 'modality', 'transcript'), named_struct('ownership', IF(l_returnflag = 'N', 'PRIMARY', 'OTHER'), 'modality', 'transcript'))")
    ok = kn.public_strict(F.expr("IF(l_linestatus = 'O', 'ACTIVE', 'EXPIRED')"), F.expr("IF(l_linenumber = 6, 'HUMAN_REVIEW_REQUIRED', NULL)"), F.expr("IF(l_partkey % 9 = 0, 'g', ' ')"), F.lit("GROUNDED"), F.expr("l_suppkey % 6"), 3, item)
    return table(spark, sf_dir, "lineitem").where(ok).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "f14_item_validation",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL THEN 'PRIORITY_MISSING' WHEN o_totalprice <= 1000 THEN 'VALUE_TOO_SMALL' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'STATUS_UNKNOWN' WHEN o_orderpriority = '5-LOW' AND o_totalprice > 100000 THEN 'PRIORITY_INCONSISTENT' END AS reason_code FROM orders""",
)
def f14_item_validation(spark, sf_dir):
    """First rule that each item breaks."""
    c = F.col
    rules = {"PRIORITY_MISSING": c("o_orderpriority").isNull(), "VALUE_TOO_SMALL": c("o_totalprice") <= 1000, "STATUS_UNKNOWN": ~c("o_orderstatus").isin("F", "O"), "PRIORITY_INCONSISTENT": (c("o_orderpriority") == "5-LOW") & (c("o_totalprice") > 100_000)}
    return table(spark, sf_dir, "orders").select("o_orderkey", kn.first_failure(rules).alias("reason_code"))


PROPOSED_SQL = "SELECT user_id, CAST(floor(value) AS BIGINT) AS idx, round(value / 100, 6) AS conf FROM events WHERE event_type <> 'view'"


@query(
    "w4_boundaries",
    f"""WITH o AS (SELECT user_id, idx, count(*) AS support, max(conf) AS best FROM ({PROPOSED_SQL}) GROUP BY user_id, idx),
    g AS (SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) > 2, false) AS gap FROM o), c AS (SELECT *, sum(gap::INT) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cl FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, cl ORDER BY best DESC NULLS LAST, support DESC, idx) AS rn, max((support > 1)::INT) OVER (PARTITION BY user_id, cl) AS rep FROM c)
    SELECT user_id, idx, support FROM r WHERE (rep = 1 AND support > 1) OR (rep = 0 AND rn = 1)""",
)
def w4_boundaries(spark, sf_dir):
    """Boundary proposals of overlapping blocks reconciled."""
    proposals = table(spark, sf_dir, "events").where("event_type <> 'view'").selectExpr("user_id", "CAST(floor(value) AS BIGINT) AS idx", "round(value / 100, 6) AS conf")
    return kn.reconcile_boundaries(proposals, ["user_id"], "idx", "conf", 2)


@query(
    "w12_frame_plan",
    f"""WITH w AS (SELECT conv_id, turn, (start_ms + end_ms) // 2 AS c, d, role = 'user' AS sig FROM (SELECT *, max(end_ms) OVER (PARTITION BY conv_id) AS d FROM ({SEGMENTS_SQL}))),
    s AS (SELECT conv_id, turn, d, c + off AS t, pr FROM w, (VALUES (0, 0, 0), (0, 0, 1), (-3000, 1, 1), (-2000, 1, 1), (-1000, 1, 1), (1000, 1, 1), (2000, 1, 1), (3000, 1, 1), (-1000, 2, 0), (1000, 2, 0)) AS o(off, pr, sg) WHERE sg = sig::INT),
    m AS (SELECT conv_id, CAST(least(greatest(t, 0), d) AS BIGINT) AS timestamp_ms, min(pr) AS pr, count(DISTINCT turn) AS n_windows FROM s GROUP BY 1, 2),
    r AS (SELECT *, sum((pr < 2)::INT) OVER (PARTITION BY conv_id) AS must, row_number() OVER (PARTITION BY conv_id, pr < 2 ORDER BY pr, timestamp_ms) AS rn FROM m)
    SELECT conv_id, timestamp_ms, (['KNOWLEDGE_CENTER', 'HIGH_SIGNAL', 'KNOWLEDGE_NEARBY'])[pr + 1] AS reason, n_windows FROM r WHERE pr < 2 OR rn <= greatest(0, 12 - must)""",
)
def w12_frame_plan(spark, sf_dir):
    """Frames to extract of each video; mandatory ones may pass the budget."""
    from pyspark.sql import Window

    windows = segments(spark, sf_dir).withColumn("d", F.max("end_ms").over(Window.partitionBy("conv_id"))).selectExpr("conv_id", "turn", "(start_ms + end_ms) div 2 AS c", "d", "role = 'user' AS sig")
    return kn.plan_frames(windows, "conv_id", "turn", "c", "d", "sig", per_media=12)


@query(
    "j13_unique_links",
    f"""SELECT f.frame_id, CASE WHEN n = 1 THEN one END AS card, CASE WHEN n = 1 THEN 'LINKED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS reason FROM ({FRAMES_SQL}) f LEFT JOIN
    (SELECT f.frame_id, count(DISTINCT s.turn) AS n, min(s.turn) AS one FROM ({FRAMES_SQL}) f JOIN ({SEGMENTS_SQL}) s ON s.conv_id = f.conv_id AND f.at_ms BETWEEN s.start_ms - 500 AND s.end_ms + 500 GROUP BY f.frame_id) m USING (frame_id)""",
)
def j13_unique_links(spark, sf_dir):
    """Mentions linked to the one card that contains them."""
    cards = segments(spark, sf_dir).selectExpr("conv_id", "turn AS card", "start_ms - 500 AS s", "end_ms + 500 AS e")
    return kn.unique_containment(frames(spark, sf_dir).select("frame_id", "conv_id", "at_ms"), cards, "conv_id", "at_ms", "s", "e", "card", "frame_id")


SPANS = "(1, 'A', 0, 10), (1, 'B', 3, 5), (1, 'C', 20, 22), (2, 'D', 1, 1)"
POINTS = "(1, 1, 4), (2, 1, 8), (3, 1, 18), (4, 1, 19), (5, 1, 31), (6, 2, 9), (7, 2, 10), (8, 3, 1)"


@query(
    "j14_containing_thesis",
    f"SELECT point, arg_min(span, struct_pack(a := at_i > e, b := e - s, c := span)) AS span FROM (VALUES {POINTS}) AS p(point, k, at_i) JOIN (VALUES {SPANS}) AS q(k, span, s, e) USING (k) WHERE at_i BETWEEN s AND e + 8 GROUP BY point",
    over=POINTS, key="point",
)
def j14_containing_thesis(spark, sf_dir):
    """Claims under the smallest thesis that contains them, or one that ended at most eight segments before."""
    return kn.smallest_container(dealt(spark, sf_dir, POINTS, "point, k, at_i"), rows(spark, SPANS, "k, span, s, e"), ["k"], "at_i", "s", "e", "span", "point")


@query(
    "k18_visual_admission",
    """SELECT user_id, day, CASE WHEN n > k THEN 'REJECTED_DUPLICATE' WHEN c THEN 'CONTRADICTS' WHEN s THEN 'SUPPORTS' ELSE 'NONE' END AS admitted FROM
    (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT r) AS k, bool_or(r = 'CONTRADICTS') AS c, bool_or(r = 'SUPPORTS') AS s FROM (SELECT *, CASE event_type WHEN 'error' THEN 'CONTRADICTS' WHEN 'click' THEN 'SUPPORTS' ELSE event_type END AS r FROM events) GROUP BY 1, 2)""",
)
def k18_visual_admission(spark, sf_dir):
    """Relation admitted for each scope of visual observations."""
    seen = table(spark, sf_dir, "events").selectExpr("user_id", "CAST(ts AS DATE) AS day", "CASE event_type WHEN 'error' THEN 'CONTRADICTS' WHEN 'click' THEN 'SUPPORTS' ELSE event_type END AS r")
    return kn.visual_admission(seen, ["user_id", "day"], "r")


FACTS = "(1, 'acme', '10', 'acme', '10', true), (2, 'acme', '10', 'acme', '12', true), (3, 'acme', '10', '', '', true), (4, 'acme', '10', 'acme', '10', false), (5, 'acme', '10', 'zeta', '99', true), (6, 'acme', '10', 'zeta', '10', true)"


@query(
    "m12_cross_check",
    f"""SELECT id, CASE WHEN ve = '' AND vn = '' THEN 'UNKNOWN' WHEN NOT al THEN 'UNRELATED' WHEN te = ve AND tn <> vn THEN 'CONTRADICTS' WHEN te = ve OR tn = vn THEN 'SUPPORTS' ELSE 'UNRELATED' END AS relation FROM (VALUES {FACTS}) AS t(id, te, tn, ve, vn, al)""",
    over=FACTS,
)
def m12_cross_check(spark, sf_dir):
    """Relation of what a frame shows to what is said."""
    facts = lambda e, n: F.struct(F.array_remove(F.array(e), "").alias("ENTITY"), F.array_remove(F.array(n), "").alias("NUMBER"))
    r = dealt(spark, sf_dir, FACTS, "id, te, tn, ve, vn, al").select("id", "al", facts("te", "tn").alias("t"), facts("ve", "vn").alias("v"))
    return r.select("id", kn.cross_check(F.col("t"), F.col("v"), F.col("al"), ["ENTITY"], ["NUMBER"], ["ENTITY", "NUMBER"]).alias("relation"))


@query("m14_trust_status", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'EXTERNAL_MATCH' WHEN 'error' THEN 'EXTERNAL_CONFLICT' WHEN 'view' THEN 'VERIFICATION_PENDING' ELSE 'EXTERNAL_NOT_FOUND' END AS verification, CASE event_type WHEN 'purchase' THEN 'EXTERNALLY_VERIFIED' WHEN 'error' THEN 'EXTERNAL_CONFLICT' WHEN 'view' THEN 'NOT_CHECKED' ELSE 'NOT_FOUND' END AS truth FROM events")
def m14_trust_status(spark, sf_dir):
    """Trust status from a provider's outcome."""
    from factloom.operators.decisions import lookup

    outcome = lookup(F.col("event_type"), {"purchase": "MATCH", "error": "CONFLICT", "view": "PENDING"}, "NOT_FOUND")
    verification = lookup(outcome, {"MATCH": "EXTERNAL_MATCH", "CONFLICT": "EXTERNAL_CONFLICT", "PENDING": "VERIFICATION_PENDING"}, "EXTERNAL_NOT_FOUND")
    truth = lookup(outcome, {"MATCH": "EXTERNALLY_VERIFIED", "CONFLICT": "EXTERNAL_CONFLICT", "PENDING": "NOT_CHECKED"}, "NOT_FOUND")
    return table(spark, sf_dir, "events").select("event_id", verification.alias("verification"), truth.alias("truth"))


@query(
    "g18_token_preservation",
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]+') AS a, regexp_extract_all(regexp_replace(text, 'The', 'the'), '[A-Z][a-z]+') AS b FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 1.0 ELSE round(len(list_filter(a, lambda x: len(list_filter(b, lambda y: y = x)) >= len(list_filter(a, lambda y: y = x)))) / len(a), 6) END AS preserved FROM t""",
)
def g18_token_preservation(spark, sf_dir):
    """Share of a text's hard tokens that a corrected version keeps as often."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit("[A-Z][a-z]+"), F.lit(0))
    both = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("a"), tokens(F.expr("concat(if(instr(text, 'The') > 0, substr(text, 1, instr(text, 'The') - 1), ''), if(instr(text, 'The') > 0, 'the', ''), if(instr(text, 'The') > 0, substr(text, instr(text, 'The') + 3), text))")).alias("b"))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    kept = F.size(F.filter("a", lambda x: count(F.col("b"), x) >= count(F.col("a"), x)))
    return both.select("conv_id", "turn", F.when(F.size("a") == 0, 1.0).otherwise(F.round(kept / F.size("a"), 6)).alias("preserved"))


@query("q2_due_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q2_due_jobs(spark, sf_dir):
    """Jobs that are due: pending ones past their wait, and those whose lease has run out."""
    return table(spark, sf_dir, "orders").where("(o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAYS <= TIMESTAMP_NTZ '1998-01-01 00:00:00') OR o_orderstatus = 'P'").select("o_orderkey")


@query("l61_merged_history", "SELECT claim, min(source) AS first_source, count(*) AS n FROM (SELECT o_custkey AS claim, 1 AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_acctbal < 0 UNION ALL SELECT l_suppkey, 3 FROM lineitem WHERE l_returnflag = 'R') GROUP BY claim")
def l61_merged_history(spark, sf_dir):
    """Verification history of claims from three ledgers."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey AS claim", "1 AS source")
    b = table(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS claim", "2 AS source")
    c = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_suppkey AS claim", "3 AS source")
    return a.unionByName(b).unionByName(c).groupBy("claim").agg(F.min("source").alias("first_source"), F.count("*").alias("n"))


@query("l65_sealed_comparison", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'UNEXPECTED' ELSE 'MISSING' END AS fault FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def l65_sealed_comparison(spark, sf_dir):
    """Signals that a sealed publication lacks or has beyond its manifest."""
    flag = lambda f: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct()
    both = flag("A").withColumn("a", F.lit(True)).join(flag("R").withColumn("b", F.lit(True)), "k", "full")
    return both.where("a IS NULL OR b IS NULL").select("k", F.when(F.col("a").isNull(), "UNEXPECTED").otherwise("MISSING").alias("fault"))
