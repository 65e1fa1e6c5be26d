"""Benchmark decontamination by spaced-seed hashing.

A mask selects some of SPAN successive words and ignores the others, so a hit survives substitutions at the ignored
places; several masks with different gaps cover the common patterns. Words of documents and of items are hashed under
each mask and the two tables of hashes are joined. Every diagonal that a hit names is compared word by word, and the
best of all stretches that are long enough and have four in five words equal counts.

Neither side passes through the driver. A Bloom filter of the benchmark's hashes, of a fixed size, keeps documents'
hashes that can match nothing from being shuffled: as a benchmark grows it fills up and more rows move, but none is lost.
Words to compare are joined in blocks of BLOCK, cut to the diagonal before they are shuffled again, so a long document
is never one group. The benchmark's side of the joins is repeated SALTS times, which splits its hot hashes and items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, sieve, sifted, small_batches

#: Fixed masks: six of at most eleven words are compared.
MASKS = ("111111", "1101100101", "1110010011", "11001010011", "10110001101")
MIN_MATCH, MIN_ITEM, MISMATCH = 12, 5, 4
BLOCK, SALTS = 64, 8
#: Words of 64 bits in the filter of the benchmark's hashes: 8 MB whatever the benchmark.
FILTER_WORDS = 1 << 20
TOKEN = re.compile(r"\w+")
_ODD = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Tokens(dict):
    """64-bit hashes of words, kept for reuse up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 1)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = TOKEN.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each position at which the mask fits; hashes of different masks are unlike."""
    n = len(words) - len(mask) + 1
    out = np.full(max(0, n), int(mask, 2), dtype=np.uint64) * _ODD[15]
    if n > 0:
        for o, bit in enumerate(mask):
            if bit == "1":
                out += words[o : o + n] * _ODD[o]
        out ^= out >> np.uint64(29)
    return out


def seeds(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of an item under all masks; one too short for any mask is found by its first words."""
    found = [masked(item, m) for m in MASKS] if len(item) >= min(map(len, MASKS)) else [masked(item[:MIN_ITEM], "1" * MIN_ITEM)]
    return np.concatenate(found), np.concatenate([np.arange(len(h)) for h in found])


def stretch(same: np.ndarray, need: int) -> tuple[int, int, int] | None:
    """(start, end, matched) of the best-scoring stretch (+1 for an equal word, -MISMATCH for another), the longest of equals, of all that have enough equal words and no negative score."""
    equal = np.concatenate(([0], np.cumsum(same)))
    total = equal - MISMATCH * (np.arange(len(equal)) - equal)
    # The last start from which each end has enough equal words; -1 where there is none.
    last = np.searchsorted(equal, equal - need, "right") - 1
    gain = np.where(last >= 0, total - np.minimum.accumulate(total)[last], -1)
    end = len(gain) - 1 - int(gain[::-1].argmax())
    if gain[end] < 0:
        return None
    start = int(total[: last[end] + 1].argmin())
    return start, end, int(equal[end] - equal[start])


def compared(words: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
    """The best stretch of a diagonal, whose words of the document are given; nulls where none meets the rule."""
    out = []
    for w, x, s in zip(words, item, shift, strict=True):
        w, x, at = np.asarray(w), np.asarray(x), max(0, -s)
        found = stretch(w == x[at : at + len(w)], min(MIN_MATCH, len(x)))
        out.append((None,) * 5 if found is None else (s + at + found[0], s + at + found[1], at + found[0], found[2], found[2] / (found[1] - found[0])))
    return pd.DataFrame(out, columns=["doc_start", "doc_end", "item_start", "matched", "identity"]).astype({c: "Int32" for c in ("doc_start", "doc_end", "item_start", "matched")} | {"identity": "Float64"})


def hashed_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    tokens = Tokens()
    for batch in texts:
        yield pd.Series([tokens.of(t).view("<i8") for t in batch], dtype=object)


def item_seeds(items: pd.Series) -> pd.DataFrame:
    found = [seeds(np.asarray(w, np.int64).view("<u8")) for w in items]
    return pd.DataFrame({"h": pd.Series([h.view("<i8") for h, _ in found], dtype=object), "at": pd.Series([at.astype(np.int32) for _, at in found], dtype=object)})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, item_start, matched, identity), positions in words: a row for each pair.

    A document overlaps an item if MIN_MATCH words (or all of a shorter item) are equal in a stretch with four in five
    words equal. Items of fewer than MIN_ITEM words match nothing, nor do null or empty texts. Of rows with the same
    document and item the best is returned, the first in the document of equals; null ids count as one document. Ids of
    both sides may have any type that can be grouped. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(docs)
    hashed, seeds_of = F.pandas_udf(hashed_words, "array<long>"), F.pandas_udf(item_seeds, "h array<long>, at array<int>")
    best_of = F.pandas_udf(compared, "doc_start int, doc_end int, item_start int, matched int, identity double")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    items = cut(items.select("item_id", F.xxhash64("item_id", "text").alias("i"), hashed("text").alias("item")).where(f"size(item) >= {MIN_ITEM}"))
    places = cut(items.select("i", F.size("item").alias("n"), seeds_of("item").alias("s")).select("i", "n", F.explode(F.arrays_zip("s.h", "s.at")).alias("s")).select("i", "n", "s.h", "s.at"))
    bits = np.zeros(filter_words, np.uint64)
    set_bits = places.selectExpr(f"h & {filter_words - 1} AS word", "shiftleft(1L, CAST(shiftrightunsigned(h, 24) & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy().view("<u8")
    masks = (*MASKS, "1" * MIN_ITEM) if items.where(F.size("item") < min(map(len, MASKS))).head(1) else MASKS
    shared = spark.sparkContext.broadcast(bits)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bits = Tokens(), shared.value
        for batch in batches:
            of, hs, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, text in enumerate(batch.column("text")):
                words = tokens.of(text.as_py())
                for mask in masks:
                    h = masked(words, mask)
                    hit = np.nonzero(bits[h & np.uint64(filter_words - 1)] >> (h >> np.uint64(24) & np.uint64(63)) & np.uint64(1))[0]
                    if len(hit):
                        of.append(np.full(len(hit), i))
                        hs.append(h[hit])
                        at.append(hit)
            of, hs, at = np.concatenate(of), np.concatenate(hs).view("<i8"), np.concatenate(at).astype(np.int32)
            for k in range(0, len(of), 100_000):
                rows = pa.array(of[k : k + 100_000])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("d").take(rows), pa.array(hs[k : k + 100_000]), pa.array(at[k : k + 100_000])], names=["doc_id", "d", "h", "pos"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                words = tokens.of(text.as_py()).view("<i8")
                if len(words):
                    n = -(-len(words) // BLOCK)
                    rows, cuts = pa.array(np.full(n, i)), np.minimum(np.arange(n + 1) * BLOCK, len(words)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("d").take(rows), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(cuts, words)], names=["doc_id", "d", "b", "block"])

    # A row is known by its id and a hash of id and text, so repeated ids stay apart and repeated rows are one.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("d"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod("d", F.lit(SALTS)).cast("int")
    hits = rows.mapInArrow(seeded, f"doc_id {kind}, d long, h long, pos int").withColumn("salt", salt).join(salted(places), ["h", "salt"])
    diagonals = cut(hits.select("doc_id", "d", "i", "n", (F.col("pos") - F.col("at")).alias("shift")).distinct())

    blocks = sifted(rows, "d", sieve(diagonals.select("d"))).where("maybe").select("doc_id", "d", "text").mapInArrow(blocked, f"doc_id {kind}, d long, b int, block array<long>").withColumnRenamed("doc_id", "__doc_id")
    wanted = diagonals.withColumn("b", F.explode(F.expr(f"sequence(CAST(greatest(shift, 0) div {BLOCK} AS INT), CAST((shift + n - 1) div {BLOCK} AS INT))")))
    met = wanted.join(blocks, ["d", "b"]).where(F.col("doc_id").eqNullSafe(F.col("__doc_id")))
    piece = f"slice(block, greatest(shift - b * {BLOCK}, 0) + 1, least(shift + n, (b + 1) * {BLOCK}) - greatest(shift, b * {BLOCK}))"
    lines = met.selectExpr("doc_id", "d", "i", "shift", "b", f"{piece} AS piece").groupBy("doc_id", "d", "i", "shift").agg(F.flatten(F.sort_array(F.collect_set(F.struct("b", "piece")))["piece"]).alias("words"))
    found = lines.withColumn("salt", salt).join(salted(items), ["i", "salt"]).select("doc_id", "item_id", best_of("words", "item", "shift").alias("c")).where("c.matched IS NOT NULL").select("doc_id", "item_id", "c.*")
    best = F.max_by(F.struct("doc_start", "doc_end", "item_start", "matched", "identity"), F.struct("matched", -F.col("doc_start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
