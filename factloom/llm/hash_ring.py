"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `vnodes` points on the ring of 64-bit hashes. A key belongs to the first point clockwise; a shard that
is full passes what is left on to the next points clockwise until one has room. Only the number of keys of each arc
(shards x vnodes x SALTS rows at most, whatever the input) reaches the driver, where the overflow is walked arc by arc; a key then
finds its shard from its rank within its arc. With the tight capacities used here (all shards full) the counts of any
two shards differ by one at most, and keys move only along the overflow when a shard is added.

Main path: DataFrame functions only. One pass over the rows to count arcs, one to rank them. Rows of an arc are dealt to
SALTS parts by a hash of their other columns, and ranks go on from part to part, so an id that a third of all rows have
is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL_BITS, SALTS = 14, 64


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    points = spark.range(0, shards * vnodes, 1, 1).selectExpr("xxhash64('shard', id div %d, id %% %d) AS pos" % (vnodes, vnodes), "CAST(id div %d AS INT) AS shard" % vnodes)
    return sorted((r.pos, r.shard) for r in points.collect())


def arc_cells(points: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(cell, first, inner): the hashes with the same leading bits, the points before them, the positions among them."""
    cells, at, width = [], 0, 1 << (64 - CELL_BITS)
    for cell in range(-(1 << (CELL_BITS - 1)), 1 << (CELL_BITS - 1)):
        first = at
        while at < len(points) and points[at][0] < (cell + 1) * width:
            at += 1
        cells.append((cell, first, [p for p, _ in points[first:at]]))
    return cells


def overflow(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from_rank, to_rank, shard, first_slot): where the keys of each arc go, walking clockwise past full shards."""
    room, used, out = list(capacity), [0] * len(capacity), []
    active = [(arc, 0, n) for arc, n in enumerate(counts) if n]
    hop = 0
    while active:
        rest = []
        for arc, start, n in active:
            shard = owners[(arc + hop) % len(owners)]
            take = min(n, room[shard])
            if take:
                out.append((arc, start, start + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if n > take:
                rest.append((arc, start + take, n - take))
        active, hop = rest, hop + 1
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", shards: int = 40, vnodes: int = 64) -> DataFrame:
    """docs with shard and slot (gapless from 0 in each shard).

    Null ids hash like a value of their own; rows with equal ids share an arc and are told apart by their rank: rows are
    ranked by a salt of their other columns (maps aside), then by the hash of the id. Which of several equal rows has
    which rank does not matter.
    An empty table gives no rows. Columns of docs named shard or slot are replaced.
    """
    spark = docs.sparkSession
    points = ring_points(spark, shards, vnodes)
    cells = F.broadcast(spark.createDataFrame(arc_cells(points), "__cell int, __first int, __inner array<bigint>"))

    docs = docs.drop("shard", "slot")
    others = [c for c in docs.columns if c != id_col and "map<" not in docs.schema[c].dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int") if others else F.lit(0)

    def placed(df: DataFrame) -> DataFrame:
        hashed = df.withColumn("__h", F.xxhash64(id_col)).withColumn("__cell", F.expr(f"CAST(shiftright(__h, {64 - CELL_BITS}) AS INT)"))
        arc = f"(__first + size(filter(__inner, p -> p < __h))) % {len(points)}"
        return hashed.join(cells, "__cell").withColumn("__arc", F.expr(arc)).drop("__cell", "__first", "__inner")

    parts = [(r["__arc"], r["__salt"], r["count"]) for r in placed(docs.select(id_col, salt.alias("__salt"))).groupBy("__arc", "__salt").count().collect()]
    counts, before = [0] * len(points), []
    for arc, s, n in sorted(parts):
        before.append((arc, s, counts[arc]))
        counts[arc] += n
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    by_arc: dict[int, list] = {}
    for arc, *flow in overflow(counts, [s for _, s in points], capacity):
        by_arc.setdefault(arc, []).append(tuple(flow))
    flow_type = "array<struct<from_rank: bigint, to_rank: bigint, shard: int, first_slot: bigint>>"
    flows = F.broadcast(spark.createDataFrame(list(by_arc.items()), f"__arc int, __flows {flow_type}"))
    starts = F.broadcast(spark.createDataFrame(before, "__arc int, __salt int, __before bigint"))
    rank = Window.partitionBy("__arc", "__salt").orderBy("__h", id_col, *[c for c in ("size", "text_crc32") if c in docs.columns])
    ranked = placed(docs.withColumn("__salt", salt)).withColumn("__rank", F.row_number().over(rank) - 1)
    ranked = ranked.join(starts, ["__arc", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    flow = F.expr("element_at(filter(__flows, f -> __rank >= f.from_rank AND __rank < f.to_rank), 1)")
    joined = ranked.join(flows, "__arc").withColumn("__flow", flow)
    out = joined.withColumns({"shard": F.col("__flow.shard"), "slot": F.expr("__flow.first_slot + __rank - __flow.from_rank")})
    return out.drop("__arc", "__h", "__salt", "__before", "__rank", "__flows", "__flow")


def op4_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """Shard and slot of every document; counts of shards differ by one at most (law `rows`)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "CAST(coalesce(octet_length(text), 0) + 16 AS BIGINT) AS size", "crc32(CAST(text AS BINARY)) AS text_crc32")
    placed = assign(docs, "doc_id", shards)
    return placed.selectExpr("doc_id", "size", "text_crc32", "'rows' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")
