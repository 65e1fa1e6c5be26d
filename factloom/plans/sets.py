"""Filters, membership, guards, rollups, orderings and set algebra over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.plans.catalog import query, table


@query("s2_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def s2_point_lookup(spark, sf_dir):
    """One row by its key; the filter reaches the scan."""
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "s8_last_bar",
    """WITH d AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS bar_date, max_by(l_extendedprice, l_orderkey * 10 + l_linenumber) AS close FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(close) OVER (PARTITION BY l_partkey ORDER BY bar_date) AS previous FROM d)
    SELECT l_partkey, max(bar_date) AS bar_date, max_by(close, bar_date) AS close, max(struct_pack(a := bar_date, b := previous)).b AS previous FROM p WHERE bar_date BETWEEN DATE '1997-06-15' - 15 AND DATE '1997-06-15' GROUP BY l_partkey""",
)
def s8_last_bar(spark, sf_dir):
    """Last bar of each part within 15 days up to a day, with the close before it."""
    lines = table(spark, sf_dir, "lineitem")
    bars = lines.groupBy("l_partkey", F.to_date("l_shipdate").alias("bar_date")).agg(F.max_by("l_extendedprice", F.expr("l_orderkey * 10 + l_linenumber")).alias("close"))
    chained = bars.withColumn("previous", F.lag("close").over(Window.partitionBy("l_partkey").orderBy("bar_date")))
    near = chained.where("bar_date BETWEEN DATE '1997-06-15' - 15 AND DATE '1997-06-15'")
    return near.groupBy("l_partkey").agg(F.max(F.struct("bar_date", "close", "previous")).alias("b")).select("l_partkey", "b.*")


@query("s17_index_payload", "SELECT conv_id, min_by(role, turn) AS first_role, max(turn) AS last_turn, count(*) AS n_bindings FROM conversations GROUP BY conv_id")
def s17_index_payload(spark, sf_dir):
    """Flat payload of an index entry: only the first binding's role travels."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max("turn").alias("last_turn"), F.count("*").alias("n_bindings"))


@query("f4_role_filter", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01')")
def f4_role_filter(spark, sf_dir):
    """Claims with a binding of a role that overlaps an interval."""
    bound = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(bound, "o_orderkey", "left_semi")


@query("f6_attribute_filter", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 42")
def f6_attribute_filter(spark, sf_dir):
    """Equality on a field inside attributes."""
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("long") == 42).select("event_id")


@query("f12_externally_grounded", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def f12_externally_grounded(spark, sf_dir):
    """Items of primary grade whose truth was confirmed outside; unlabelled ones are not."""
    confirmed = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(confirmed, "doc_id")


@query("f13_numeric_claims", "SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN false WHEN quality = 0 THEN true END, regexp_matches(text, '[0-9]')) AS numeric_claim FROM documents LEFT JOIN labels USING (doc_id)")
def f13_numeric_claims(spark, sf_dir):
    """A declared flag decides; else a digit in the statement does."""
    declared = F.when(F.col("toxic") == 1, False).when(F.col("quality") == 0, True)
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(declared, F.col("text").rlike("[0-9]")).alias("numeric_claim"))


@query("f16_authority", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderpriority LIKE '1-%'")
def f16_authority(spark, sf_dir):
    """Rows that meet every condition of authority at once."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderdate <= TIMESTAMP_NTZ '1997-01-01' AND o_orderpriority LIKE '1-%'").select("o_orderkey")


@query(
    "f21_unit_schema",
    """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'missing_statement' WHEN role NOT IN ('user', 'assistant') THEN 'unknown_knowledge_kind' WHEN length(text) < 20 THEN 'missing_evidence' END AS reason,
    array_to_string(list_filter([CASE WHEN turn = 0 THEN 'filled_title' END, CASE WHEN length(text) > 240 THEN 'capped_statement' END], lambda x: x IS NOT NULL), ',') AS repairs FROM conversations""",
)
def f21_unit_schema(spark, sf_dir):
    """First rule that a unit breaks, and the repairs that it had."""
    reason = F.when(F.trim("text") == "", "missing_statement").when(~F.col("role").isin("user", "assistant"), "unknown_knowledge_kind").when(F.length("text") < 20, "missing_evidence")
    repairs = F.filter(F.array(F.when(F.col("turn") == 0, "filled_title"), F.when(F.length("text") > 240, "capped_statement")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"), F.array_join(repairs, ",").alias("repairs"))


@query("f22_high_risk", "SELECT l_orderkey, bool_or(l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity > 45) AS high_risk FROM lineitem GROUP BY l_orderkey")
def f22_high_risk(spark, sf_dir):
    """Cards with an unresolved item of a high-risk kind."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.expr("l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity > 45")).alias("high_risk"))


@query("f23_review_partition", "SELECT source, count(*) FILTER (l.doc_id IS NOT NULL) AS resolved, count(*) FILTER (l.doc_id IS NULL) AS unresolved FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def f23_review_partition(spark, sf_dir):
    """Review items that are settled and those that are open, by source."""
    settled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("settled"))
    seen = table(spark, sf_dir, "documents").select("doc_id", "source").join(settled, "doc_id", "left")
    return seen.groupBy("source").agg(F.count("settled").alias("resolved"), F.count_if(F.col("settled").isNull()).alias("unresolved"))


@query("j4_frame_facts", "SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS frame_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def j4_frame_facts(spark, sf_dir):
    """Facts with the frame that they were read from."""
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("frame_date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(frames, "l_orderkey")


@query("j15_members", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag")
def j15_members(spark, sf_dir):
    """Rows that belong to a snapshot."""
    members = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(members, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("j22_guards", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def j22_guards(spark, sf_dir):
    """Owners with one kind of evidence and none of another: one pass over the evidence."""
    kinds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("has"), F.bool_or(F.col("l_returnflag") == "A").alias("bars")).where("has AND NOT bars")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(kinds, "o_orderkey", "left_semi")


@query("j23_latest_publication", "SELECT o_orderkey, c_name, CAST(o_orderdate AS DATE) AS published FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def j23_latest_publication(spark, sf_dir):
    """Latest ready publication with its snapshot (a top-1 report): the top is taken before the join."""
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return last.join(owners, "o_custkey").select("o_orderkey", "c_name", F.to_date("o_orderdate").alias("published"))


@query("g20_distinct_lines", "SELECT doc_id, md5(array_to_string(list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 8), '|')) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)")
def g20_distinct_lines(spark, sf_dir):
    """First eight different lines of each text, in order (eight is the report's length)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.slice(F.array_distinct(F.split("text", "\n")), 1, 8), "|")).alias("digest"))


@query("g21_summaries", "SELECT conv_id, min_by(text, turn) AS core, count(*) AS n_points, round(least(0.95, 0.5 + 0.03 * count(*)), 6)::DOUBLE AS confidence FROM conversations GROUP BY conv_id")
def g21_summaries(spark, sf_dir):
    """Core statement and confidence of a summary."""
    confidence = F.round(F.least(F.lit(0.95), F.lit(0.5) + 0.03 * F.count("*")), 6)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("core"), F.count("*").alias("n_points"), confidence.alias("confidence"))


@query(
    "g24_readiness",
    """SELECT component, p AS pending, d AS dead_letters, (p <= 100 AND d = 0) AS ready, array_to_string(list_filter([CASE WHEN p > 100 THEN 'index_backlog_exceeded' END, CASE WHEN d > 0 THEN 'projection_dead_letter' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT o_orderpriority AS component, count(*) FILTER (o_orderstatus = 'O') AS p, count(*) FILTER (o_orderstatus = 'P') AS d FROM orders GROUP BY 1)""",
)
def g24_readiness(spark, sf_dir):
    """Why a component is not ready."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("component")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_if(F.col("o_orderstatus") == "P").alias("dead_letters"))
    reasons = F.filter(F.array(F.when(F.col("pending") > 100, "index_backlog_exceeded"), F.when(F.col("dead_letters") > 0, "projection_dead_letter")), lambda x: x.isNotNull())
    return counted.select("component", "pending", "dead_letters", (F.size(reasons) == 0).alias("ready"), F.array_join(reasons, ",").alias("reasons"))


@query(
    "g28_validation_report",
    """SELECT lang, count(*) FILTER (r IS NULL) AS accepted, count(r) AS rejected, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS reasons FROM (SELECT lang, CASE WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 10000 THEN 'too_long' END AS r FROM documents) GROUP BY lang""",
)
def g28_validation_report(spark, sf_dir):
    """Reports of parts merged: sums, and the reasons that occur."""
    reason = F.when(F.col("n_chars") < 100, "too_short").when(F.col("n_chars") > 10000, "too_long").alias("r")
    return table(spark, sf_dir, "documents").select("lang", reason).groupBy("lang").agg(F.count_if(F.col("r").isNull()).alias("accepted"), F.count("r").alias("rejected"), F.array_join(F.array_sort(F.collect_set("r")), ",").alias("reasons"))


@query("w16_source_heads", "SELECT o_custkey, 'latest' AS policy, max(o_orderkey) AS head FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, 'latest-verified', max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def w16_source_heads(spark, sf_dir):
    """Heads of each source under both policies, from one aggregate."""
    heads = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("a"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("v"))
    return heads.selectExpr("o_custkey", "stack(2, 'latest', a, 'latest-verified', v) AS (policy, head)").where("head IS NOT NULL")


@query("o3_newest_first", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS place FROM orders QUALIFY place <= 20")
def o3_newest_first(spark, sf_dir):
    """The twenty newest (a top-k report)."""
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).cast("long").alias("place"))


@query("o5_canonical_arrays", "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus || l_linenumber, ',' ORDER BY l_returnflag, l_linestatus, l_linenumber) AS items FROM lineitem GROUP BY l_orderkey")
def o5_canonical_arrays(spark, sf_dir):
    """Items of each bundle in canonical order."""
    items = F.array_sort(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda x: F.concat(x["l_returnflag"], x["l_linestatus"], x["l_linenumber"].cast("string"))), ",").alias("items"))


@query("o6_unit_priority", "SELECT conv_id, max_by(turn, struct_pack(a := CASE role WHEN 'assistant' THEN 6 WHEN 'user' THEN 3 ELSE 1 END, b := -length(text), c := -turn)) AS best FROM conversations GROUP BY conv_id")
def o6_unit_priority(spark, sf_dir):
    """Unit of the highest priority: kind, then the shorter statement, then the earlier one."""
    score = F.when(F.col("role") == "assistant", 6).when(F.col("role") == "user", 3).otherwise(1)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("turn", F.struct(score, -F.length("text"), -F.col("turn"))).alias("best"))


@query("o9_trimmed_top", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o9_trimmed_top(spark, sf_dir):
    """Ten dearest that pass the filter (a top-k report): filtered first, so nothing is fetched beyond the ten."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("u1_stable_sets", "SELECT source, count(DISTINCT sha256(text)) AS n_members, min(sha256(text)) AS first_member FROM documents GROUP BY source")
def u1_stable_sets(spark, sf_dir):
    """Members of each set by identity, whatever their order and repeats."""
    return table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h")).groupBy("source").agg(F.countDistinct("h").alias("n_members"), F.min("h").alias("first_member"))


def turns_with_next(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])


PAIRS_SQL = "SELECT a.conv_id, a.turn, a.text, b.text AS next FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"


@query("u3_number_subsets", rf"SELECT conv_id, turn, len(list_filter(regexp_extract_all(next, '\d+'), lambda x: NOT list_contains(regexp_extract_all(text, '\d+'), x))) = 0 AS covered FROM ({PAIRS_SQL})")
def u3_number_subsets(spark, sf_dir):
    """Whether all numbers of a turn stand in the one before it."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"))
    return turns_with_next(spark, sf_dir).select("conv_id", "turn", (F.size(F.array_except(numbers("next"), numbers("text"))) == 0).alias("covered"))


@query("u4_ordered_union", f"SELECT conv_id, turn, md5(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ')) AS digest FROM (SELECT conv_id, turn, list_concat(string_split(text, ' '), string_split(next, ' ')) AS a FROM ({PAIRS_SQL}))")
def u4_ordered_union(spark, sf_dir):
    """Words of two turns together, each once, in order of first appearance."""
    both = F.array_distinct(F.concat(F.split("text", " "), F.split("next", " ")))
    return turns_with_next(spark, sf_dir).select("conv_id", "turn", F.md5(F.array_join(both, " ")).alias("digest"))


STRATA = ["click", "error", "purchase", "signup", "view"]


@query("u5_missing_strata", f"SELECT user_id, array_to_string(list_filter({STRATA}, lambda x: NOT list_contains(s, x)), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY user_id)")
def u5_missing_strata(spark, sf_dir):
    """Required strata that a group lacks."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_except(F.array(*map(F.lit, STRATA)), F.collect_set("event_type")), ",").alias("missing"))


@query("u6_gap_fill", "SELECT l_orderkey, l_linenumber, 'OFFICIAL' AS origin FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey, l_linenumber, 'SPEECH' FROM lineitem a WHERE l_returnflag <> 'N' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'N')")
def u6_gap_fill(spark, sf_dir):
    """Segments of the official track, and of speech only where there is none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    official = lines.where("l_returnflag = 'N'")
    added = lines.where("l_returnflag <> 'N'").join(official.select("l_orderkey"), "l_orderkey", "left_anti")
    return official.select("l_orderkey", "l_linenumber", F.lit("OFFICIAL").alias("origin")).unionByName(added.select("l_orderkey", "l_linenumber", F.lit("SPEECH").alias("origin")))
