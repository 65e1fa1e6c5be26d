"""Greedy packing of ordered rows into blocks, as jumps instead of a fold.

Where a block ends, and the next one begins, depends on its start alone. So every row is asked where a block that began
with it would end, in one as-of join over running totals, and the blocks that really occur are those that the first row
reaches over these jumps. The jumps are doubled, so a key with a million blocks takes twenty rounds, and none of its rows
is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.clocks import asof_each, upto
from factloom.sources.shared import written

TOO_LARGE = "SINGLE_ITEM_EXCEEDS_BUDGET"


def reached(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """(node): the starts (node) and all that jumps (node, to; at most one of each node, without cycles) lead to from them.

    Round k adds what lies 2^k jumps away, so rounds grow with the logarithm of the longest path.
    """
    found, jumps = written(starts.select("node").distinct()), written(jumps.select("node", "to"))
    while True:
        more = found.join(jumps, "node").select(F.col("to").alias("node")).distinct()
        more = written(more.join(found, "node", "left_anti"))
        if not more.head(1):
            return found
        found = written(found.unionByName(more))
        jumps = written(jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("__next")), "to").select("node", F.col("__next").alias("to")))


def budget_blocks(items: DataFrame, keys: Sequence[str], order: str, cost: str, budget: int, most_overlap: int = 12) -> DataFrame:
    """(keys, block, first, last, n, total, fault): the rows of each key in blocks whose costs add up to budget at most.

    A block takes rows in order as long as they fit. The next one begins with the last rows of it again: as many as a
    third of its rows, rounded down, and most_overlap at most. A key with a row dearer than the budget has no blocks but one
    row with the fault TOO_LARGE. first and last are values of order; a null cost is nothing; rows of equal order are
    taken as they are placed. Null keys are a key like others.
    """
    price = F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0))
    mine = items.select(F.struct(*keys).alias("key"), F.col(order).alias("order"), price.alias("cost"))
    rows = written(upto(mine, ["key"], ["order"], "cost", "total"))
    spans = rows.groupBy("key").agg(F.min("at").alias("begins"), F.max("at").alias("ends"), F.max(F.col("total") + F.col("cost")).alias("all"), F.max("cost").alias("most"))
    spans = written(spans)
    dear = spans.where(F.col("most") > budget)
    fits = rows.join(dear.select(F.col("key").alias("__dear")), F.col("key").eqNullSafe(F.col("__dear")), "left_anti")
    # where rows end: before each row, and after the last one of a key
    stops = fits.select("key", F.col("total").alias("upto"), F.col("at").alias("end")).unionByName(spans.where(F.col("most") <= budget).select("key", F.col("all").alias("upto"), (F.col("ends") + 1).alias("end")))
    asks = fits.select("key", F.col("at").alias("node"), "total", (F.col("total") + budget).alias("limit"), F.lit(0).alias("now"))
    held = asof_each(asks, stops.withColumn("always", F.lit(0)), ["key"], "limit", "now", "upto", "always", "end", ["upto", "end"]).drop("limit", "now")
    held = held.join(spans.select(F.col("key").alias("__key"), "begins", "ends"), F.col("key").eqNullSafe(F.col("__key"))).drop("__key")
    overlap = F.least(F.lit(most_overlap), F.floor((F.col("end") - F.col("node")) / 3))
    held = written(held.withColumn("to", F.when(F.col("end") <= F.col("ends"), F.col("end") - overlap)))
    blocks = held.join(reached(held.where("node = begins").select("node"), held.where("to IS NOT NULL").select("node", "to")), "node", "left_semi")
    names = fits.select("at", "order")
    blocks = blocks.join(names.select(F.col("at").alias("node"), F.col("order").alias("first")), "node").withColumn("final", F.col("end") - 1).join(names.select(F.col("at").alias("final"), F.col("order").alias("last")), "final")
    numbered = blocks.withColumn("block", F.row_number().over(Window.partitionBy("key").orderBy("node")) - 1)
    out = numbered.select("key.*", "block", "first", "last", (F.col("end") - F.col("node")).alias("n"), (F.col("upto") - F.col("total")).alias("total"), F.lit(None).cast("string").alias("fault"))
    kind = dict(mine.dtypes)["order"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("block", "int"), ("first", kind), ("last", kind), ("n", "long"), ("total", "long"))]
    return out.unionByName(dear.select("key.*", *none, F.lit(TOO_LARGE).alias("fault")))
