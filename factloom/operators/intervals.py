"""Interval and segment algebra: unions, gaps, contiguity, overlap and containment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps_closed(start: Column, end: Column, wanted_start: Column, wanted_end: Column) -> Column:
    """Closed intervals with null ends unbounded; an interval without both ends matches nothing."""
    known = start.isNotNull() | end.isNotNull()
    return known & (wanted_start.isNull() | end.isNull() | (end >= wanted_start)) & (wanted_end.isNull() | start.isNull() | (start <= wanted_end))


def overlaps_open(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Strict overlap of (a, b) and (c, d); an unknown bound matches."""
    known = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    return ~known | ((a < d) & (c < b))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """df with `reach` (the furthest end before the row) and `island` (number of the union interval it belongs to)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("reach", F.max(end).over(before))
    fresh = (F.col("reach").isNull() | (F.col(start) > F.col("reach"))).cast("int")
    return out.withColumn("island", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def coverage(df: DataFrame, keys: Sequence[str], start: str, end: str, duration: str) -> DataFrame:
    """Per key: duration, covered, overlap and largest gap, the lead-in and the tail included."""
    clipped = df.withColumn(end, F.least(end, duration))
    marked = islands(clipped, keys, start, end)
    again = F.greatest(F.lit(0), F.least(F.col(end), F.col("reach")) - F.col(start))
    marked = marked.withColumn("__again", F.when(F.col(start) <= F.col("reach"), again).otherwise(0))
    gap = F.col(start) - F.coalesce("reach", F.lit(0))
    marked = marked.withColumn("__gap", F.when(F.col("reach").isNull() | (F.col(start) > F.col("reach")), gap))
    unions = marked.groupBy(*keys, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.max(duration).alias("d"), F.sum("__again").alias("again"), F.max("__gap").alias("gap"))
    out = unions.groupBy(*keys).agg(F.max("d").alias("duration_ms"), F.sum(F.col("e") - F.col("s")).alias("covered_ms"), F.sum("again").alias("overlap_ms"), F.max("gap").alias("inner"), F.max("e").alias("last"))
    return out.withColumn("max_gap_ms", F.greatest("inner", F.col("duration_ms") - F.col("last"))).drop("inner", "last")


def gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, duration: str) -> DataFrame:
    """(keys, gap_start, gap_end): what no interval covers in [0, duration)."""
    cursor = islands(df, keys, start, end)
    inner = cursor.where(F.col(start) > F.coalesce("reach", F.lit(0))).select(*keys, F.coalesce("reach", F.lit(0)).cast("long").alias("gap_start"), F.col(start).cast("long").alias("gap_end"))
    tail = df.groupBy(*keys).agg(F.max(end).cast("long").alias("gap_start"), F.max(duration).cast("long").alias("gap_end")).where("gap_start < gap_end")
    return inner.unionByName(tail)


def contiguous(boundaries: DataFrame, keys: Sequence[str], boundary: str, last: str) -> DataFrame:
    """Segments between boundary points: (keys, segment_index, start_index, end_index), the last one up to `last`."""
    order = Window.partitionBy(*keys).orderBy(boundary)
    points = boundaries.select(*keys, boundary, last).distinct()
    out = points.withColumns({"segment_index": F.row_number().over(order) - 1, "start_index": F.coalesce(F.lag(boundary).over(order) + 1, F.lit(0)), "end_index": F.col(boundary)})
    tail = points.groupBy(*keys).agg(F.count("*").alias("segment_index"), (F.max(boundary) + 1).alias("start_index"), F.max(last).alias("end_index")).where("start_index <= end_index")
    return out.select(*keys, "segment_index", "start_index", "end_index").unionByName(tail)


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: int, pad: int = 0) -> DataFrame:
    """Points inside [start - pad, end + pad] of intervals with the same keys.

    Intervals are dealt to every bucket they touch, so the join is an equi-join on keys and bucket.
    """
    wide = intervals.withColumns({"__lo": F.col(start) - pad, "__hi": F.col(end) + pad})
    dealt = wide.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__lo") / bucket), F.floor(F.col("__hi") / bucket))))
    placed = points.withColumn("__bucket", F.floor(F.col(at) / bucket))
    met = placed.join(dealt, [*keys, "__bucket"]).where((F.col(at) >= F.col("__lo")) & (F.col(at) <= F.col("__hi")))
    return met.drop("__bucket", "__lo", "__hi")


def pack(df: DataFrame, keys: Sequence[str], order: str, start: str, end: str, limit: int) -> DataFrame:
    """(keys, group, first, last, n): greedy packing; a new group starts when it would last longer than `limit`.

    The start of a group depends on where the one before ended, so each key's rows are folded in order; the fold keeps
    one small record for each group. Keys are videos: their rows are bounded by a video's length.
    """
    row = F.struct(F.col(order).alias("o"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    empty = "CAST(array() AS array<struct<s: bigint, e: bigint, first: bigint, last: bigint, n: bigint>>)"
    grown = "concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', acc[size(acc) - 1].s, 'e', x.e, 'first', acc[size(acc) - 1].first, 'last', CAST(x.o AS bigint), 'n', acc[size(acc) - 1].n + 1)))"
    fresh = "concat(acc, array(named_struct('s', x.s, 'e', x.e, 'first', CAST(x.o AS bigint), 'last', CAST(x.o AS bigint), 'n', 1L)))"
    fold = f"aggregate(rows, {empty}, (acc, x) -> IF(size(acc) > 0 AND x.e - acc[size(acc) - 1].s <= {limit}, {grown}, {fresh}))"
    folded = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows")).selectExpr(*keys, f"posexplode({fold}) AS (group, g)")
    return folded.selectExpr(*keys, "group", "g.first AS first_index", "g.last AS last_index", "g.s AS start_ms", "g.e AS end_ms", "g.n AS n_segments")
