"""Order-dependent operators, numerals and streams. SQL cannot say most of them; tests/test_functions.py has brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numeric
from factloom.operators import ordered
from factloom.plans.catalog import dealt, query, table
from factloom.plans.intervals import segments
from factloom.streaming import outbox, run


@query("g7_near_merge")
def g7_near_merge(spark, sf_dir):
    """Turns of a conversation merged greedily with the first one they are like."""
    return ordered.merge_near(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("g8_distinct_top_units")
def g8_distinct_top_units(spark, sf_dir):
    """Three longest turns of each conversation that are not alike."""
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return ordered.select_distinct_top(turns, ["conv_id"], "turn", "text", ["n"], 3)


@query("w2_temporal_windows")
def w2_temporal_windows(spark, sf_dir):
    """Overlapping windows over each transcript."""
    return ordered.temporal_windows(segments(spark, sf_dir), "conv_id", "turn", "start_ms", "end_ms", "text", 9000, 15_000, 800)


AMOUNTS = "(1, '营收12.5亿元，同比增长30%'), (2, '一万五千亿和两成'), (3, '无')"
NUMERALS = "(1, '一百五'), (2, '一百零五'), (3, '三千四'), (4, '两万'), (5, '一亿二千万'), (6, 'x'), (7, CAST(NULL AS VARCHAR(3)))"


@query("m1_chinese_numerals", "SELECT * FROM (VALUES (1, 150.0::DOUBLE), (2, 105), (3, 3400), (4, 20000), (5, 120000000), (6, NULL), (7, NULL)) AS t(id, value)", over=NUMERALS)
def m1_chinese_numerals(spark, sf_dir):
    """Values of Chinese numerals."""
    return dealt(spark, sf_dir, NUMERALS.replace("VARCHAR(3)", "STRING"), "id, s").select("id", numeric.chinese_numbers(F.col("s")).alias("value"))


@query("m2_amounts", "SELECT * FROM (VALUES (1, 0, 1250000000.0::DOUBLE, 'CNY'), (1, 1, 30, 'PERCENT'), (2, 0, 1500000000000, 'NUMBER'), (2, 1, 20, 'PERCENT')) AS t(id, ordinal, value, unit)", over=AMOUNTS)
def m2_amounts(spark, sf_dir):
    """Financial numbers with their units."""
    texts = dealt(spark, sf_dir, AMOUNTS, "id, s")
    return texts.select("id", F.posexplode(numeric.amounts_of(F.col("s"))).alias("ordinal", "a")).select("id", "ordinal", "a.value", "a.unit")


@query(
    "q3_stream_deliveries",
    "SELECT event_id % 997 AS outbox_id, CASE WHEN bool_or(event_type <> 'error') THEN 'PUBLISHED' WHEN count(*) > 5 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS status FROM events GROUP BY 1",
)
def q3_stream_deliveries(spark, sf_dir):
    """Final state of outbox rows after a stream of delivery attempts, which land as files of one batch."""
    landed = f"{run.shared_folder(spark)}/landing"
    table(spark, sf_dir, "events").selectExpr("event_id % 997 AS outbox_id", "event_type <> 'error' AS ok").write.parquet(landed)
    attempts = spark.readStream.schema("outbox_id long, ok boolean").parquet(landed)
    changes = run.available_now(outbox.deliveries(attempts), "update")
    return changes.groupBy("outbox_id").agg(F.max_by("status", F.struct(F.expr("status IN ('PUBLISHED', 'DEAD_LETTER')"), "attempts")).alias("status"))
