"""Identity and lineage queries: ids and roots over `orders` and `lineitem`, hash chains over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import lineage
from factloom.plans.catalog import query, table
from factloom.plans.replay import SNAPSHOTS_SQL


@query(
    "a1_content_ids",
    """SELECT l_orderkey, l_linenumber, 'claim-' || substr(sha256('{"flag":"' || l_returnflag || '","line":' || l_linenumber || ',"order":' || l_orderkey || ',"part":' || l_partkey || '}'), 1, 24) AS claim_id FROM lineitem""",
)
def a1_content_ids(spark, sf_dir):
    """Claim ids from canonical JSON."""
    made = lineage.content_id("claim-", 24, order=F.col("l_orderkey"), line=F.col("l_linenumber"), part=F.col("l_partkey"), flag=F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("claim_id"))


@query(
    "a3_root_hashes",
    """SELECT l_orderkey, sha256('{' || string_agg('"' || l_linenumber || '":"' || l_partkey || '"', ',' ORDER BY l_linenumber) || '}') AS root_hash FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL_KEYS) GROUP BY l_orderkey""".replace("ALL_KEYS", "l_orderkey, l_linenumber"),
)
def a3_root_hashes(spark, sf_dir):
    """Root of each order over the map from slot to artifact."""
    slots = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").cast("string").alias("artifact"))
    return lineage.root_hash(slots, "l_orderkey", "l_linenumber", "artifact")


CHAIN_SQL = "SELECT user_id, event_id, sha256(event_type || '|' || event_id) AS event_hash, lag(sha256(event_type || '|' || event_id)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_hash FROM events"


@query("w13_event_chain", CHAIN_SQL)
def w13_event_chain(spark, sf_dir):
    """Hash-linked events of each claim."""
    out = lineage.chain(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type"))
    return out.select("user_id", "event_id", "event_hash", "previous_hash")


@query(
    "w13_chain_faults",
    f"""WITH c AS (SELECT user_id, event_hash, CASE WHEN event_id % 50 = 0 THEN 'lost' WHEN event_id % 77 = 0 THEN NULL ELSE previous_hash END AS p FROM ({CHAIN_SQL}))
    SELECT user_id, CAST(count(p) - count(DISTINCT p) AS BIGINT) AS forks, count(*) FILTER (p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c d WHERE d.user_id = c.user_id AND d.event_hash = c.p)) AS broken, count(*) FILTER (p IS NULL) AS heads FROM c GROUP BY user_id""",
)
def w13_chain_faults(spark, sf_dir):
    """Forks, broken links and heads of tampered chains."""
    bad = w13_event_chain(spark, sf_dir).withColumn("previous_hash", F.expr("CASE WHEN event_id % 50 = 0 THEN 'lost' WHEN event_id % 77 = 0 THEN NULL ELSE previous_hash END"))
    return lineage.chain_faults(bad, "user_id", "event_hash", "previous_hash")


@query("a5_hash_verification", "SELECT count(*) AS n, count(*) FILTER (sha256(text) = sha256(trim(text))) AS n_valid FROM documents")
def a5_hash_verification(spark, sf_dir):
    """Recomputed hashes against recorded ones (of the trimmed text)."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(F.sha2("text", 256) == F.sha2(F.trim("text"), 256)).alias("n_valid"))


_EDGES_SQL = f"""s AS MATERIALIZED ({SNAPSHOTS_SQL.replace("struct(o_orderdate, o_orderkey)", "struct_pack(a := o_orderdate, b := o_orderkey)")}),
    e AS MATERIALIZED (SELECT id AS c, parent AS p FROM s WHERE parent IS NOT NULL UNION SELECT id, supersedes FROM s WHERE supersedes IS NOT NULL)"""


def snapshot_edges(spark, sf_dir):
    """(nodes, edges): a customer's orders of a year as artifacts that were made from one another, cycles and lost parents among them."""
    held = spark.sql(SNAPSHOTS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    edges = held.selectExpr("id AS c", "parent AS p").unionByName(held.selectExpr("id AS c", "supersedes AS p")).where("p IS NOT NULL").distinct()
    return held.select("id"), edges


@query("a4_lineage_ancestors", f"WITH RECURSIVE {_EDGES_SQL}, w AS (SELECT c AS node, p AS ancestor FROM e UNION SELECT w.node, e.p FROM w JOIN e ON e.c = w.ancestor) SELECT node, ancestor, node = ancestor AS cyclic FROM w")
def a4_lineage_ancestors(spark, sf_dir):
    """All ancestors of each artifact; an artifact that is its own ancestor is on a cycle."""
    return lineage.ancestors(snapshot_edges(spark, sf_dir)[1], "c", "p").withColumn("cyclic", F.col("node") == F.col("ancestor"))


@query("a4_missing_parents", f"WITH {_EDGES_SQL} SELECT c, p FROM e WHERE p NOT IN (SELECT id FROM s)")
def a4_missing_parents(spark, sf_dir):
    """Edges to artifacts that do not exist."""
    nodes, edges = snapshot_edges(spark, sf_dir)
    return lineage.missing_parents(edges, nodes, "c", "p", "id")


@query("a9_dangling_references", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def a9_dangling_references(spark, sf_dir):
    """References to artifacts outside the closure."""
    part = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query(
    "l53_slot_comparison",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 'MATCH' ELSE 'DIFFERENT' END AS outcome FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_nationkey <> 3) a
    FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'changed' ELSE c_mktsegment END AS v FROM customer WHERE c_acctbal >= 0) b ON a.k = b.k""",
)
def l53_slot_comparison(spark, sf_dir):
    """Slots of a replay against those of the original."""
    base = table(spark, sf_dir, "customer")
    left = base.where("c_nationkey <> 3").selectExpr("c_custkey AS k", "c_mktsegment AS v")
    right = base.where("c_acctbal >= 0").selectExpr("c_custkey AS k", "IF(c_custkey % 7 = 0, 'changed', c_mktsegment) AS v")
    return lineage.compare_slots(left, right, "k", "v")


@query(
    "a10_resume_points",
    "SELECT l_orderkey, max(CASE WHEN ok THEN l_linenumber END) AS resume_after FROM (SELECT l_orderkey, l_linenumber, bool_and(l_quantity > 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)) GROUP BY l_orderkey",
)
def a10_resume_points(spark, sf_dir):
    """Last step of each run up to which all checkpoints are valid."""
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    return lineage.valid_prefix(steps, ["l_orderkey"], "l_linenumber", F.col("q") > 3)


@query("d16_commit_candidates", "SELECT o_orderkey, greatest(max(o_orderdate), max(l_shipdate)) AS committed_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def d16_commit_candidates(spark, sf_dir):
    """Earliest time at which a snapshot may commit: the latest of its dependencies."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    both = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.max("o_orderdate").alias("ordered")).join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", F.greatest("ordered", "shipped").alias("committed_at"))


@query(
    "k6_occurrence_ids",
    """SELECT o_orderkey, 'co_' || substr(sha256(o_orderkey || '|' || list_aggregate(list_sort(list_distinct(list(l_partkey))), 'string_agg', ',')), 1, 61) AS occurrence_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def k6_occurrence_ids(spark, sf_dir):
    """Occurrence ids over the set of evidence, whatever its order and role."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    both = table(spark, sf_dir, "orders").select("o_orderkey").distinct().join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.array_join(F.col("refs").cast("array<string>"), ","))
    return both.select("o_orderkey", F.concat(F.lit("co_"), F.substring(F.sha2(text, 256), 1, 61)).alias("occurrence_id"))
