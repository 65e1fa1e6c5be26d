"""Retrieval queries over `documents`, `customer`, `part` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import retrieval as rt
from factloom.plans.catalog import query, table


@query("f1_filtered_search", "SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size = 10")
def f1_filtered_search(spark, sf_dir):
    """Equality filters; empty ones do not filter."""
    part = table(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    return rt.matching(part, None, [], p_brand=brand, p_size=10, p_type=None).select("p_partkey", "p_name")


@query("f2_text_search", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%000%1%' OR c_mktsegment ILIKE '%000%1%'")
def f2_text_search(spark, sf_dir):
    """Substring search in any case over several columns; % stays a wildcard."""
    return rt.matching(table(spark, sf_dir, "customer"), "000%1", ["c_name", "c_mktsegment"]).select("c_custkey")


@query("o1_ranked_search", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20")
def o1_ranked_search(spark, sf_dir):
    """Top documents of a language: filtered first, then limited."""
    return rt.ranked(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 20)


@query("o2_pit_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def o2_pit_listing(spark, sf_dir):
    """First rows by availability, then id."""
    return table(spark, sf_dir, "orders").where("o_orderdate <= TIMESTAMP_NTZ '1997-01-01 00:00:00'").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query(
    "o7_vector_top_k",
    "SELECT vec_id, round(score, 5) AS score FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, vec_id LIMIT 10)",
)
def o7_vector_top_k(spark, sf_dir):
    """Ten nearest vectors to one of them, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    return rt.nearest(vectors, vectors.where("vec_id = 7"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 5))


@query(
    "o8_top_lines_per_group",
    "SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 4",
)
def o8_top_lines_per_group(spark, sf_dir):
    """Four best lines of each part."""
    order = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(order)).where("rank <= 4").select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query(
    "j17_hydration",
    "SELECT doc_id, rank, lang, n_chars FROM (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings ORDER BY label, vec_id LIMIT 25) JOIN documents USING (doc_id)",
)
def j17_hydration(spark, sf_dir):
    """Index candidates with their rows, in the index's order."""
    hits = rt.ranked(table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "label"), -F.col("label"), "doc_id", 25)
    return rt.hydrate(hits, table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "rank", "lang", "n_chars")


@query(
    "j18_fallback_fill",
    """WITH a AS (SELECT doc_id, 0 AS source FROM documents WHERE lang = 'es' AND n_chars > 3000), b AS (SELECT doc_id, 1 AS source FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM a))
    SELECT doc_id, source FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY source, doc_id LIMIT 40""",
)
def j18_fallback_fill(spark, sf_dir):
    """Hits of the narrow search, filled up from the wide one."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 3000")
    return rt.filled(docs.where("lang = 'es'").select("doc_id"), docs.select("doc_id"), "doc_id", "doc_id", 40)


@query("o11_truncation", "SELECT least(count(*), 100) AS returned, greatest(count(*) - 100, 0) AS truncated FROM documents WHERE lang = 'de'")
def o11_truncation(spark, sf_dir):
    """How many items a bundle of at most 100 returns and leaves out."""
    return table(spark, sf_dir, "documents").where("lang = 'de'").selectExpr("least(count(*), 100L) AS returned", "greatest(count(*) - 100, 0L) AS truncated")


@query(
    "j1_claim_occurrences",
    "SELECT o_orderkey, l_linenumber, c_mktsegment, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND p_size < 5",
)
def j1_claim_occurrences(spark, sf_dir):
    """Claims with their members and occurrences: filters and columns reach the scans, join order is the optimizer's."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    parts = table(spark, sf_dir, "part").where("p_size < 5").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("o_orderkey", "l_linenumber", "c_mktsegment", "p_brand")


@query("j2_claims_with_evidence", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j2_claims_with_evidence(spark, sf_dir):
    """Claims that have evidence and an owner in good standing; semi-joins, so nothing is multiplied."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS o_orderkey")
    owners = table(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi").join(owners, "o_custkey", "left_semi").select("o_orderkey")


@query("j21_backfill_candidates", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j21_backfill_candidates(spark, sf_dir):
    """Owners for which nothing has been written yet."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("j19_alias_containment", "SELECT p_partkey, alias FROM part, (VALUES ('red'), ('blue'), ('steel'), ('1'), ('part')) AS a(alias) WHERE contains(lower(p_name), alias)")
def j19_alias_containment(spark, sf_dir):
    """Dictionary aliases contained in names: the dictionary is a constant array, so there is no join at all."""
    aliases = F.array(*map(F.lit, ("red", "blue", "steel", "1", "part")))
    found = F.filter(aliases, lambda a: F.contains(F.lower("p_name"), a))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("alias"))


@query(
    "j16_hierarchy_links",
    "SELECT c.n_nationkey AS child, c.n_regionkey AS parent, r.siblings FROM nation c JOIN (SELECT n_regionkey, list_sort(list(n_nationkey)) AS siblings FROM nation GROUP BY n_regionkey) r USING (n_regionkey)",
)
def j16_hierarchy_links(spark, sf_dir):
    """Children with their parent and the parent's sorted children."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    children = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_nationkey")).alias("siblings"))
    return nation.join(children, "n_regionkey").selectExpr("n_nationkey AS child", "n_regionkey AS parent", "siblings")


@query("f24_formal_signals", "SELECT l_suppkey, count(*) AS support_count, min(l_orderkey) AS first_claim FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey HAVING count(*) >= 5")
def f24_formal_signals(spark, sf_dir):
    """Signals of members in an availability range that enough claims support."""
    members = table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS l_suppkey")
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate BETWEEN TIMESTAMP_NTZ '1996-01-01 00:00:00' AND TIMESTAMP_NTZ '1998-12-31 00:00:00'").select("l_suppkey", "l_orderkey")
    return lines.join(members, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("support_count"), F.min("l_orderkey").alias("first_claim")).where("support_count >= 5")
