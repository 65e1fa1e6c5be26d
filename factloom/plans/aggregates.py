"""Aggregate queries: conflicts over prices in `lineitem`, corroboration and quality over `documents`, `labels` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import conflict, quality
from factloom.plans.catalog import dealt, query, table

CLAIMS_SQL = """SELECT l_partkey, l_orderkey * 10 + l_linenumber AS claim_id, CAST(l_quantity AS BIGINT) AS value, round(1 - l_discount, 2) AS confidence, l_suppkey % 7 = 0 AS verified,
    'window-' || (((CAST(l_shipdate AS DATE) - DATE '0001-01-01') + 1) // 30) AS w FROM lineitem"""


def claims(spark, sf_dir):
    """Quantities that suppliers claim for a part in a window of 30 days."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_orderkey * 10 + l_linenumber AS claim_id", "CAST(l_quantity AS BIGINT) AS value", "round(1 - l_discount, 2) AS confidence", "l_suppkey % 7 = 0 AS verified", "CAST(l_shipdate AS DATE) AS d")
    return lines.withColumn("w", conflict.window_key(F.col("d"))).drop("d")


@query("g1_conflicts", f"SELECT l_partkey, w, count(*) AS n_claims, count(DISTINCT value) AS n_values, min(claim_id) AS first_id FROM ({CLAIMS_SQL}) GROUP BY l_partkey, w HAVING count(DISTINCT value) > 1")
def g1_conflicts(spark, sf_dir):
    """Parts with more than one claimed quantity in the same window."""
    splits = table(spark, sf_dir, "lineitem").rdd.getNumPartitions()
    return conflict.detect(claims(spark, sf_dir), ["l_partkey", "w"], "value", "claim_id", conflict.PARTS * splits)


@query(
    "g2_auto_resolution",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, w ORDER BY confidence DESC, claim_id) AS rn FROM ({CLAIMS_SQL})),
    g AS (SELECT l_partkey, w, count(*) FILTER (verified) AS nv, min(claim_id) FILTER (verified) AS vid, max(claim_id) FILTER (rn = 1) AS bid, round(max(confidence) FILTER (rn = 1) - max(confidence) FILTER (rn = 2), 9) >= 0.1 AS clear
      FROM r GROUP BY l_partkey, w HAVING count(DISTINCT value) > 1)
    SELECT l_partkey, w, CASE WHEN nv = 1 OR clear THEN 'AUTO_RESOLVED' ELSE 'OPEN' END AS resolution_status, CASE WHEN nv = 1 THEN 'EXTERNAL_VERIFICATION_WINS' WHEN clear THEN 'HIGHER_SOURCE_CONFIDENCE' ELSE 'MANUAL_REVIEW' END AS resolution_policy,
    CASE WHEN nv = 1 THEN vid WHEN clear THEN bid END AS preferred_claim_id FROM g""",
)
def g2_auto_resolution(spark, sf_dir):
    """How each conflict resolves: verification, a clear lead in confidence, or not at all."""
    return conflict.auto_resolve(claims(spark, sf_dir), ["l_partkey", "w"], "claim_id", "value", "confidence", "verified")


UNITS_SQL = """SELECT user_id % 20 AS subject, event_type AS predicate, user_id AS source, CASE WHEN value > 60 THEN 'BULLISH' WHEN value < 40 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment, event_id % 4 <> 0 AS supported FROM events"""


def units(spark, sf_dir):
    side = "CASE WHEN value > 60 THEN 'BULLISH' WHEN value < 40 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment"
    return table(spark, sf_dir, "events").selectExpr("user_id % 20 AS subject", "event_type AS predicate", "user_id AS source", side, "event_id % 4 <> 0 AS supported")


@query(
    "g4_corroboration",
    f"""SELECT subject, predicate, greatest(u, d) AS corroborating_count, least(u, d) AS contradicting_count, ns AS independent_source_count, round(n / greatest(ns, 1), 6) AS attention_score,
    round((u - d) / greatest(sp, 1), 6) AS consensus_score, round(least(u, d) / greatest(sp, 1), 6) AS disagreement_score FROM
    (SELECT subject, predicate, count(*) FILTER (supported AND sentiment = 'BULLISH') AS u, count(*) FILTER (supported AND sentiment = 'BEARISH') AS d, count(*) FILTER (supported) AS sp, count(DISTINCT CASE WHEN supported THEN source END) AS ns, count(*) AS n FROM ({UNITS_SQL}) GROUP BY subject, predicate) WHERE ns > 0""",
)
def g4_corroboration(spark, sf_dir):
    """Strength of each narrative across independent sources; it verifies nothing."""
    return conflict.corroboration(units(spark, sf_dir), ["subject", "predicate"], "source", "sentiment", "supported")


@query(
    "g5_narratives",
    f"""SELECT subject, count(DISTINCT source) AS distinct_sources, count(*) AS n_units, CASE WHEN count(DISTINCT sentiment) > 1 THEN 'MIXED' ELSE min(sentiment) END AS consensus FROM ({UNITS_SQL}) WHERE supported GROUP BY subject""",
)
def g5_narratives(spark, sf_dir):
    """Sources, units and consensus of each subject."""
    mood = F.when(F.countDistinct("sentiment") > 1, "MIXED").otherwise(F.min("sentiment"))
    return units(spark, sf_dir).where("supported").groupBy("subject").agg(F.countDistinct("source").alias("distinct_sources"), F.count("*").alias("n_units"), mood.alias("consensus"))


@query(
    "g6_exact_merge",
    "SELECT sha256(lower(trim(text))) AS merge_key, min(doc_id) AS first_id, list_sort(list(DISTINCT source)) AS evidence, max(n_chars) AS confidence, count(*) AS n_merged FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def g6_exact_merge(spark, sf_dir):
    """Equal statements merged: first id, all sources, greatest confidence."""
    return conflict.merge_exact(table(spark, sf_dir, "documents"), F.sha2(F.lower(F.trim("text")), 256), "doc_id", "source", "n_chars").where("n_merged > 1")


@query(
    "g9_contradictions",
    """SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN count(DISTINCT l_returnflag || l_linestatus) OVER (PARTITION BY l_partkey, q) > 1 THEN 'contradiction_' || substr(sha256(l_partkey || '|' || q), 1, 24) END AS contradiction_group_id
    FROM (SELECT *, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS q FROM lineitem)""",
)
def g9_contradictions(spark, sf_dir):
    """Claims about the same part and quarter that are asserted in different ways."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "concat(year(l_shipdate), '-Q', quarter(l_shipdate)) AS q")
    return conflict.contradictions(lines, ["l_partkey", "q"], ["l_returnflag", "l_linestatus"]).select("l_partkey", "l_orderkey", "l_linenumber", "contradiction_group_id")


@query(
    "g10_newest_relations",
    """WITH u AS (SELECT o_custkey AS k, o_orderkey AS uid, o_orderdate AS ts, o_orderpriority AS kind, o_orderstatus AS s, nullif(o_orderkey % 3, 0) AS c FROM orders),
    n AS (SELECT k, arg_max(uid, struct_pack(a := ts, b := uid)) AS nu, arg_max(kind, struct_pack(a := ts, b := uid)) AS nk, arg_max(s, struct_pack(a := ts, b := uid)) AS ns, max(struct_pack(a := ts, b := uid, c := c)).c AS nc FROM u GROUP BY k HAVING count(*) > 1)
    SELECT nu AS source_uid, uid AS target_uid, CASE WHEN NOT ((ns IN ('F', 'P') AND s = 'O') OR (ns = 'O' AND s IN ('F', 'P'))) THEN 'REINFORCES' WHEN nk IN ('1-URGENT', '2-HIGH') OR (nk = '3-MEDIUM' AND nc IS NOT NULL) THEN 'SUPERSEDES' ELSE 'CONFLICTS_WITH' END AS relation_type
    FROM u JOIN n USING (k) WHERE uid <> nu""",
)
def g10_newest_relations(spark, sf_dir):
    """The newest order of a customer against all older ones."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderkey AS uid", "o_orderdate AS ts", "o_orderpriority AS kind", "o_orderstatus AS s", "nullif(o_orderkey % 3, 0) AS c")
    return conflict.newest_against_older(orders, "k", "ts", "uid", "kind", "s", ["F", "P"], ["O"], ["1-URGENT", "2-HIGH"], ["3-MEDIUM"], "c")


ITEMS = "(1, 10, 'a', 'x,y'), (1, 11, 'a', 'x'), (1, 12, 'a', 'x'), (1, 13, 'b', 'x,y,z'), (1, 14, 'a', 'z,y'), (2, 20, 'a', 'x,y'), (2, 21, 'a', 'y,x,x')"


@query(
    "g27_minimal_items",
    f"""WITH i AS (SELECT o, min(id) AS id, k, list_sort(list_distinct(string_split(r, ','))) AS refs FROM (VALUES {ITEMS}) AS t(o, id, k, r) GROUP BY o, k, list_sort(list_distinct(string_split(r, ','))))
    SELECT o, id, k, array_to_string(refs, ',') AS refs FROM i WHERE NOT EXISTS (SELECT 1 FROM i s WHERE s.o = i.o AND s.k = i.k AND len(s.refs) < len(i.refs) AND list_has_all(i.refs, s.refs))""",
    over=ITEMS,
    key="o",
    n=2,
)
def g27_minimal_items(spark, sf_dir):
    """Ambiguities that no narrower one of the same kind covers."""
    items = dealt(spark, sf_dir, ITEMS, "o, id, k, r", 2).withColumn("refs", F.split("r", ","))
    return conflict.minimal_items(items, "o", "id", "k", "refs").withColumn("refs", F.array_join("refs", ","))


LABELLED_SQL = "SELECT d.doc_id, d.lang, d.n_chars >= 1000 AS predicted, l.quality = 1 AS truth, l.toxic = 1 AS unsupported FROM documents d JOIN labels l USING (doc_id)"


def labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr("doc_id", "lang", "n_chars >= 1000 AS predicted", "quality = 1 AS truth", "toxic = 1 AS unsupported")


METRICS_SQL = f"SELECT lang, count(*) AS n, count(*) FILTER (predicted AND truth) AS true_positives, round(count(*) FILTER (predicted AND truth) / nullif(count(*) FILTER (predicted), 0), 6) AS precision, round(count(*) FILTER (predicted AND truth) / nullif(count(*) FILTER (truth), 0), 6) AS recall FROM ({LABELLED_SQL}) GROUP BY lang"


@query("g11_quality_metrics", METRICS_SQL)
def g11_quality_metrics(spark, sf_dir):
    """Precision and recall of a length rule against labels, by language."""
    return quality.precision_recall(labelled(spark, sf_dir), F.col("predicted"), F.col("truth"), ["lang"])


@query(
    "g11_conditional_accuracy",
    f"SELECT round(count(*) FILTER (unsupported) / count(*), 6) AS unsupported_rate, round(count(*) FILTER (predicted AND NOT unsupported) / nullif(count(*) FILTER (NOT unsupported), 0), 6) AS supported_accuracy, count(*) AS n FROM ({LABELLED_SQL})",
)
def g11_conditional_accuracy(spark, sf_dir):
    """Rates over all labelled rows and over supported ones."""
    return labelled(spark, sf_dir).agg(quality.ratio(F.col("unsupported"), F.lit(True)).alias("unsupported_rate"), quality.ratio(F.col("predicted"), ~F.col("unsupported")).alias("supported_accuracy"), F.count("*").alias("n"))


@query("g12_strata", "SELECT lang, source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, source, quality")
def g12_strata(spark, sf_dir):
    """Labelled documents by stratum."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "source", "quality").agg(F.count("*").alias("n"))


@query(
    "g13_leakage",
    "SELECT sha256(text) AS text_hash, count(DISTINCT source) AS n_partitions, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
)
def g13_leakage(spark, sf_dir):
    """Texts that occur in more than one partition."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "source")
    return quality.leakage(docs, "text_hash", "source")


@query(
    "g14_blockers",
    f"SELECT lang, metric, value, CASE metric WHEN 'precision' THEN 0.9 ELSE 0.8 END AS threshold FROM (UNPIVOT (SELECT lang, precision, recall FROM ({METRICS_SQL})) ON precision, recall INTO NAME metric VALUE value) WHERE value < CASE metric WHEN 'precision' THEN 0.9 ELSE 0.8 END",
)
def g14_blockers(spark, sf_dir):
    """Metrics below their thresholds."""
    return quality.blockers(g11_quality_metrics(spark, sf_dir), {"precision": 0.9, "recall": 0.8}, ["lang"])


@query(
    "g22_release_gate",
    f"""SELECT lang, CASE WHEN len(reasons) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status, array_to_string(reasons, ',') AS reasons FROM
    (SELECT lang, list_filter([CASE WHEN n < 50 THEN 'TOO_FEW' END, CASE WHEN precision < 0.9 THEN 'PRECISION' END, CASE WHEN recall < 0.8 THEN 'RECALL' END], lambda x: x IS NOT NULL) AS reasons FROM ({METRICS_SQL}))""",
)
def g22_release_gate(spark, sf_dir):
    """Release gate of each language with its reasons."""
    status, reasons = quality.gate({"TOO_FEW": F.col("n") < 50, "PRECISION": F.col("precision") < 0.9, "RECALL": F.col("recall") < 0.8})
    return g11_quality_metrics(spark, sf_dir).select("lang", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query(
    "g15_bundle_quality",
    """SELECT count(*) AS item_count, count(*) FILTER (l_returnflag = 'R') AS review_required, count(*) FILTER (l_linestatus = 'F') AS active, round(count(*) FILTER (l_discount >= 0.05) / count(*), 6) AS grounded_ratio, count(DISTINCT l_partkey) AS subjects FROM lineitem""",
)
def g15_bundle_quality(spark, sf_dir):
    """Counts and ratios of a bundle."""
    is_ = F.col
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("item_count"), F.count_if(is_("l_returnflag") == "R").alias("review_required"), F.count_if(is_("l_linestatus") == "F").alias("active"), quality.ratio(is_("l_discount") >= 0.05, F.lit(True)).alias("grounded_ratio"), F.countDistinct("l_partkey").alias("subjects"))


@query("g25_duration_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def g25_duration_percentiles(spark, sf_dir):
    """Median and 95th percentile by type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile(value, 0.5)").alias("p50"), F.expr("percentile(value, 0.95)").alias("p95"), F.count("*").alias("n"))


@query(
    "g23_backlog",
    "SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS dead_letters, CAST(date_diff('second', min(o_orderdate) FILTER (o_orderstatus = 'O'), max(o_orderdate)) AS BIGINT) AS oldest_lag_s FROM orders",
)
def g23_backlog(spark, sf_dir):
    """Pending and dead rows of a queue and the age of the oldest pending one."""
    oldest, newest = "min(o_orderdate) FILTER (WHERE o_orderstatus = 'O')", "max(o_orderdate)"
    return table(spark, sf_dir, "orders").selectExpr("count_if(o_orderstatus = 'O') AS pending", "count_if(o_orderstatus = 'P') AS dead_letters", f"unix_timestamp({newest}) - unix_timestamp({oldest}) AS oldest_lag_s")


@query("g19_mean_confidence", "SELECT l_suppkey, round(avg(CASE WHEN l_linenumber % 2 = 0 THEN l_discount END), 4) AS confidence FROM lineitem GROUP BY l_suppkey")
def g19_mean_confidence(spark, sf_dir):
    """Mean of the known confidences; unknown ones count for nothing."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.expr("l_linenumber % 2 = 0"), F.col("l_discount"))), 4).alias("confidence"))


@query("u2_fact_sets", """SELECT a.conv_id, len(list_intersect(fa, fb)) AS matches, len(list_filter(fa, lambda x: NOT list_contains(fb, x))) AS only_left, len(list_filter(fb, lambda x: NOT list_contains(fa, x))) AS only_right FROM
    (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS fa FROM conversations WHERE turn = 0) a JOIN (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS fb FROM conversations WHERE turn = 1) b USING (conv_id)""")
def u2_fact_sets(spark, sf_dir):
    """Facts that two accounts share and those that only one has."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("f"))
    pairs = turns.where("turn = 0").select("conv_id", F.col("f").alias("fa")).join(turns.where("turn = 1").select("conv_id", F.col("f").alias("fb")), "conv_id")
    size = lambda c: F.size(c).cast("long")
    return pairs.select("conv_id", size(F.array_intersect("fa", "fb")).alias("matches"), size(F.array_except("fa", "fb")).alias("only_left"), size(F.array_except("fb", "fa")).alias("only_right"))
