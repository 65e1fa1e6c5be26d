"""Mixing sources to target weights: packed token blocks drawn by multinomial counts and index permutations.

The words of each source form one stream, packed into blocks of BLOCK words. The slots of the mix are dealt to output
shards; for each shard a multinomial draw says how many slots each source fills, from what its target leaves. The j-th
slot of a source takes the block that a keyed permutation (a Feistel network on the block's index, another for each
pass over the source) gives for j, so no block comes again before all others have come, and a join by block index
tells how often each document's words are taken.

Positions in a stream are prefix sums over hash buckets of a source, so a hot source is spread over all tasks. Only
the totals of sources and the draws (shards x sources numbers; at most MAX_SOURCES sources) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, word_count

BLOCK, BUCKETS, SHARDS, MAX_SOURCES = 128, 256, 64, 10_000


def targets(sizes: list[int], weights: list[float], total: float, most: float = 3.0) -> list[float]:
    """Shares of total by weight, none above `most` times its size; what is cut off is shared again by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    left = float(total)
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if scale * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else scale * weights[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def _round(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A mixing function of 64-bit words (the finaliser of SplitMix64)."""
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each k in [0, n) its place under the permutation named by key: four Feistel rounds, walking cycles into [0, n)."""
    k, n, key = (np.asarray(a, dtype=np.uint64) for a in np.broadcast_arrays(k, n, key))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    half = np.where(np.uint64(1) << (np.uint64(2) * half) < n, half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.copy(), np.arange(len(k))
    while len(todo):
        h, m, q = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for i in range(4):
            left, right = right, left ^ (_round(right, q + np.uint64(i)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def restored(b: int, n: int, key: int) -> int:
    """The k that the permutation named by key puts at b: its rounds backwards, walking the same cycle."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    half += 1 << 2 * half < n
    out = b
    while True:
        left, right = out >> half, out & ((1 << half) - 1)
        for i in reversed(range(4)):
            with np.errstate(over="ignore"):
                turned = int(_round(np.array([left], np.uint64), np.array([key], np.uint64) + np.uint64(i))[0])
            left, right = right ^ (turned & ((1 << half) - 1)), left
        out = left << half | right
        if out < n:
            return out


def keys(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _round(np.asarray(source, np.uint64) * np.uint64(64) + np.asarray(epoch, np.uint64), np.uint64(seed))


def slots_of(source: int, size: int, target: float, block: int, seed: int) -> int:
    """Slots whose words come nearest to the target, whole passes over the source first."""
    n = -(-size // block)
    if not n:
        return 0
    passes = int(target // size)
    rest, last = target - passes * size, size - (n - 1) * block
    if rest <= 0:
        return passes * n
    short = restored(n - 1, n, int(keys(np.array([source]), np.array([passes]), seed)[0]))  # the slot of the last block
    near = range(max(0, int(rest // block) - 1), min(n, int(rest // block) + 3) + 1)
    return passes * n + min(near, key=lambda k: (abs(k * block - (block - last) * (short < k) - rest), k))


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: multinomial draws from what is left, which together use up all slots."""
    left = np.array(slots, dtype=np.int64)
    total, out = int(left.sum()), np.zeros((shards, len(slots)), dtype=np.int64)
    for m in range(shards):
        need, rng = total // shards + (m < total % shards), np.random.default_rng([seed, m])
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[m] += got
            left -= got
            need -= int(got.sum())
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5.0, 2.0, 1.0), most: float = 3.0, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): a row for each row of docs.

    Null and blank texts have size 0 and are never taken. A null source is a source of its own, last in order. Repeated
    rows have places of their own in the stream. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, size), {BUCKETS})")))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = sums.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    totals = sorted(((r.source, r.words) for r in totals), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), most)
    slots = [slots_of(i, n, t, block, seed) for i, (n, t) in enumerate(zip(sizes, wanted, strict=True))]
    names = F.broadcast(spark.createDataFrame([(i, s, n, t) for i, ((s, n), t) in enumerate(zip(totals, wanted, strict=True))], "s int, __source string, source_size long, target double"))

    counts = draw(slots, SHARDS, seed)
    ends = np.cumsum(counts.ravel())
    first = (np.cumsum(counts, axis=0) - counts).ravel()  # the source's slots in earlier shards
    blocks = np.array([max(1, -(-n // block)) for n in sizes] or [1], dtype=np.int64)

    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            g = ids["id"].to_numpy()
            cell = np.searchsorted(ends, g, side="right")
            source = cell % len(blocks)
            j, n = first[cell] + g - np.where(cell > 0, ends[cell - 1], 0), blocks[source]
            with np.errstate(over="ignore"):
                yield pd.DataFrame({"s": source.astype(np.int32), "b": permuted(j % n, n, keys(source, j // n, seed))})

    times = spark.range(sum(slots)).mapInPandas(blocks_of, "s int, b long").groupBy("s", "b").agg(F.count("*").alias("times"))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "before")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = sized.withColumns({"upto": F.sum("size").over(inside), "n": F.row_number().over(inside)})
    laid = laid.join(prefix, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket"))).drop("__source", "__bucket")
    laid = laid.join(names, F.col("source").eqNullSafe(F.col("__source"))).withColumn("start", F.expr("before + upto - size"))
    parts = laid.selectExpr("*", f"explode_outer(IF(size > 0, sequence(start div {block}, (start + size - 1) div {block}), NULL)) AS b")
    words = f"least(start + size, (b + 1) * {block}) - greatest(start, b * {block})"
    taken = parts.join(times, ["s", "b"], "left").groupBy("doc_id", "source", "size", "source_size", "target", "bucket", "n").agg(F.coalesce(F.sum(F.expr(f"({words}) * times")), F.lit(0)).alias("taken"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
