"""As-of joins in which every row asks at its own instants, and totals along an order, without a window over a key.

Rows are dealt to tasks by ranges of (key, order), so a hot key is spread over many tasks; their places in the order are
numbered from the sizes of the tasks. On the numbers stands a tree of blocks of FAN neighbours: what a row asks is
answered in its own block or, failing that, by the nearest earlier block that can, found by walking up and down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import written

#: Rows of a block, and blocks of the block above. An array holds this many small structs.
FAN = 256

_TASK = 1 << 33


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows, written, with `at`: their place from 0 in the order of the columns (nulls first), gapless.

    Equal rows get neighbouring places. Nothing is sorted in one task: what is numbered in a window is one row a task.
    """
    held = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    task = F.floor(F.col("__m") / _TASK)
    sizes = held.groupBy(task.alias("__task")).agg(F.count("*").alias("n"))
    starts = sizes.select("__task", (F.sum("n").over(Window.orderBy("__task")) - F.col("n")).alias("__start"))
    return held.withColumn("__task", task).join(F.broadcast(starts), "__task").withColumn("at", F.col("__start") + F.col("__m") - F.col("__task") * _TASK).drop("__m", "__task", "__start")


def upto(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, total: str) -> DataFrame:
    """rows with the places `at` (see placed) and, in `total`, the sum of value over all earlier rows of the same keys.

    Sums run within blocks of a key's neighbours and then over the totals of its blocks, block by block upwards.
    """
    own = placed(rows, [*keys, *order])
    return _running(own, keys, value, total, FAN * FAN)


def _running(rows: DataFrame, keys: Sequence[str], value: str, total: str, width: int) -> DataFrame:
    block = F.floor(F.col("at") / width)
    inner = Window.partitionBy(*keys, "__block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__block", block)
    sums = own.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__earlier"))
    same = F.col("__block") == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = own.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, same)
    return met.withColumn(total, F.col("__earlier") + F.col("__inner")).select(*rows.columns, total)


def _last(items: str, before: Column, known: Column) -> Column:
    """The last item of the array before a place whose clock is not after known, null without one."""
    return F.try_element_at(F.filter(items, lambda x: (x["at"] < before) & (x["r"] <= known)), F.lit(-1))


def asof_each(asks: DataFrame, ledger: DataFrame, keys: Sequence[str], business: str, known: str, effective: str, recorded: str, event_id: str, keep: Sequence[str]) -> DataFrame:
    """asks with, in the columns keep, the ledger's row in force at each one's own instants.

    That is, of the rows with equal keys, effective <= business and recorded <= known, the greatest by (effective,
    recorded, event_id). Asks without such a row, and those with a null key or instant, get nulls; ledger rows with a
    null key or clock are in force never. Rows of asks come as often as they stand.

    One sort of both tables, then joins by (keys, block): an ask meets the blocks it lies in, one at each of log_FAN(n)
    heights, so neither its key's history nor the number of asks at one instant decides what a task holds.
    """
    some = F.struct(*[F.col(k) for k in keys])
    whole = F.lit(True)
    for c in (*keys, effective, recorded):
        whole &= F.col(c).isNotNull()
    kept = F.struct(*keep)
    events = ledger.where(whole).select(some.alias("k"), F.col(effective).alias("t"), F.lit(0).alias("asks"), F.col(recorded).alias("r"), F.col(event_id).alias("e"), kept.alias("kept"), F.lit(None).cast(_struct(asks)).alias("ask"))
    kinds = dict(events.dtypes)
    wanted = asks.select(some.alias("k"), F.col(business).alias("t"), F.lit(1).alias("asks"), F.col(known).alias("r"), F.lit(None).cast(kinds["e"]).alias("e"), F.lit(None).cast(kinds["kept"]).alias("kept"), F.struct(*[F.col(c) for c in asks.columns]).alias("ask"))
    both = written(placed(events.unionByName(wanted), ["k", "t", "asks", "r", "e"]))
    rows = both.agg(F.max("at")).first()[0] or 0
    heights = 1
    while FAN**heights <= rows:
        heights += 1

    level = both.where("asks = 0").select("k", F.lit(0).alias("height"), F.floor(F.col("at") / FAN).alias("block"), F.struct("at", "r", "kept").alias("item"))
    blocks = None
    for height in range(heights):
        made = level.groupBy("k", "height", "block").agg(F.array_sort(F.collect_list("item"), lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1)).alias("items"))
        blocks = made if blocks is None else blocks.unionByName(made)
        earliest = made.select("k", F.lit(height + 1).alias("height"), F.floor(F.col("block") / FAN).alias("above"), F.struct(F.col("block").alias("at"), F.array_min(F.transform("items", lambda x: x["r"])).alias("r"), F.lit(None).cast(kinds["kept"]).alias("kept")).alias("item"))
        level = earliest.withColumnRenamed("above", "block")
    blocks = written(blocks)

    mine = both.where("asks = 1").select("k", "at", F.col("r").alias("until"), F.explode(F.sequence(F.lit(0), F.lit(heights - 1))).alias("height"))
    mine = mine.withColumn("child", F.floor(F.col("at") / F.pow(F.lit(float(FAN)), F.col("height")).cast("long"))).withColumn("block", F.floor(F.col("child") / FAN))
    up = mine.join(blocks, ["k", "height", "block"]).withColumn("found", _last("items", F.col("child"), F.col("until"))).where("found IS NOT NULL")
    found = up.groupBy("at").agg(F.min_by(F.struct("k", "until", "height", "found"), "height").alias("f")).select("at", "f.*")
    for height in range(heights - 1, 0, -1):
        below = found.where(F.col("height") == height).select("at", "k", "until", F.lit(height - 1).alias("height"), F.col("found.at").alias("block"))
        down = below.join(blocks, ["k", "height", "block"]).withColumn("found", _last("items", F.lit(1 << 62), F.col("until")))
        found = found.where(F.col("height") < height).unionByName(down.select("at", "k", "until", "height", "found"))
    answers = found.select("at", F.col("found.kept").alias("kept"))
    return both.where("asks = 1").select("at", "ask").join(answers, "at", "left").select("ask.*", *[F.col(f"kept.{c}").alias(c) for c in keep])


def _struct(df: DataFrame) -> str:
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).schema["s"].dataType.simpleString()
