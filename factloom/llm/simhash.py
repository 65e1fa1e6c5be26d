"""SimHash near-duplicates, found by meeting in the middle of Hamming balls.

A document's 64-bit fingerprint has a bit set where over half of its shingles' hashes have it. Two fingerprints within
RADIUS = 3 bits have a point between them at most one bit from one and two bits from the other, so both emit the
variants of their ball and meet at that point. Three observations keep the balls small without losing a link:

* Of three differing bits at most one lies in one of the 32-bit halves. That half, with no bit or one bit flipped, is
  the shuffle key of every variant (`side`, `v`); the variants inside the other half are only made for keys at which
  two different fingerprints meet. The parity of the half tells which of the two flips the bit, so one side emits it.
* Inside the other half, of three differing bits two lie in the same quarter: two-bit variants stay within a quarter,
  and only the fingerprint of odd parity makes them.
* Everything that meets at a variant with a centre (one that reached it by at most one flip in its own key) is within
  three bits of that centre. A star to the centre thus links all of them: rows grow with members, never with pairs.

Equal fingerprints are one class from the start, so copies are never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import connected, cut, hot_join, sieve, sifted, small_batches

RADIUS = 3
BLOCK = 65536


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles as a signed 64-bit integer; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        ones += bit_counts(np.array([digest(line[s:e], seed) for s, e in pairs], dtype="<u8"))
    return majority(ones, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes, as a signed 64-bit integer."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a row for each row of docs. Null texts count as empty, whose fingerprint is 0."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, width, seed) for t in batch], dtype="int64")

    small_batches(docs)
    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"))


def links(fps: DataFrame) -> DataFrame:
    """Star edges (fp, centre) among distinct fingerprints; two are connected by edges iff by steps of RADIUS bits or fewer."""
    halves = "stack(2, 0, shiftrightunsigned(fp, 32), fp & 4294967295L, 1, fp & 4294967295L, shiftrightunsigned(fp, 32)) AS (side, half, free)"
    flips = "IF(bit_count(half) % 2 = 0, transform(sequence(0, 31), b -> struct(half ^ shiftleft(1L, b) AS v, false AS native)), array())"
    ball = fps.selectExpr("fp", halves).selectExpr("fp", "side", "free", f"inline(concat(array(struct(half AS v, true AS native)), {flips}))")
    key = Window.partitionBy("side", "v")
    met = ball.withColumn("n", F.count("*").over(key)).withColumn("natives", F.max("native").over(key)).where("n > 1 AND natives")

    one = "transform(sequence(0, 31), b -> struct(free ^ shiftleft(1L, b) AS z, 1 AS r))"
    inner = "flatten(transform(sequence(0, 31), a -> transform(filter(sequence(0, 31), b -> b > a AND b div 16 = a div 16), b -> struct(free ^ shiftleft(1L, a) ^ shiftleft(1L, b) AS z, 2 AS r))))"
    two = f"IF(native AND bit_count(free) % 2 = 1, {inner}, array())"
    variants = met.selectExpr("fp", "side", "v", "native", f"inline(concat(array(struct(free AS z, 0 AS r)), {one}, {two}))")
    hub = Window.partitionBy("side", "v", "z")
    starred = variants.withColumn("centre", F.min(F.when(F.col("native") & (F.col("r") < 2), F.col("fp"))).over(hub))
    return starred.where(f"centre <> fp AND bit_count(fp ^ centre) <= {RADIUS}").select("fp", "centre").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id, n_links): every row of docs with the smallest id reachable by steps of RADIUS bits or fewer.

    n_links counts the star edges of the document's fingerprint. Null ids get a row like any other and never name a
    component unless all of its ids are null. Repeated rows stay repeated; an empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width, seed))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    edges = cut(links(classes.select("fp")))
    roots = connected(edges, "fp", "centre")
    degree = edges.selectExpr("stack(2, fp, centre) AS fp").groupBy("fp").agg(F.count("*").alias("n_links"))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").selectExpr("fp", "n", "least_id", "coalesce(root, fp) AS root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size"))
    of_fp = cut(hot_join(rooted, named, "root", "size").join(degree, "fp", "left").selectExpr("fp", "n", "component_id", "coalesce(n_links, 0L) AS n_links"))
    return hot_join(fps, of_fp, "fp", "n").select("doc_id", "fp", "component_id", "n_links")


# Near duplicates by the similarity of shingle sets. At a similarity of 0.8 the fingerprints of two texts differ in ten
# bits or so, far beyond any ball that can be listed; fingerprints alone find one pair in fifty (see README). So the
# candidates of the balls are joined by those of min-hash bands, and every candidate is verified on its shingles.
BANDS, ROWS = 20, 6
_FACTORS = np.random.default_rng(3).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles, repeats included; of the whole sequence where there are fewer words than width."""
    n = max(1, len(words) - width + 1)
    return np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(n)], dtype="<u8")


def key_of(words: list[bytes]) -> int:
    return int(np.array(xxhash.xxh64_intdigest(b" ".join(words), 5), dtype="<u8").view("<i8"))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sketch(text: str | None, width: int) -> tuple:
    """(key, fp, bands): the text's identity, its SimHash and the hashes of its min-hash bands."""
    words = words_of(text)
    if not words:
        hashes = np.zeros(1, "<u8")
        fp = 0
    else:
        hashes = shingle_hashes(words, width)
        fp = majority(sum(bit_counts(hashes[at : at + BLOCK]) for at in range(0, len(hashes), BLOCK)), len(hashes))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, np.multiply.outer(_FACTORS, hashes[at : at + 1024]).min(axis=1))
    bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]
    return key_of(words), fp, np.array(bands, dtype="<u8").view("<i8")


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets given as sorted distinct 32-bit hashes."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.LongType())
def text_key(texts: pd.Series) -> pd.Series:
    """Identity of a text's lower-cased words (64 bits); all texts without words share one."""
    return pd.Series([key_of(words_of(t)) for t in texts], dtype="int64")


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, key, fp, bands): a row for each row of docs."""

    @F.pandas_udf("key long, fp long, bands array<long>")
    def sketched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([sketch(t, width)[:3] for t in batch], columns=["key", "fp", "bands"])

    small_batches(docs)
    return docs.select(F.col(id_col).alias("doc_id"), sketched(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def shingle_sets(rows: DataFrame, keys: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(key, set) of the wanted keys: sorted 32-bit hashes of the shingles of one text each.

    A sieve of the wanted documents' ids goes to where the texts are, so only their texts (and a few more) are shuffled.
    """

    @F.pandas_udf("key long, set binary")
    def cut_up(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            words = [words_of(t) for t in batch]
            yield pd.DataFrame({"key": [key_of(w) for w in words], "set": [np.unique(shingle_hashes(w, width).astype("<u4")).tobytes() for w in words]})

    wanted = cut(keys.join(classes.select("key", "doc_id"), "key"))
    near = sifted(rows, "doc_id", sieve(wanted.select("doc_id"))).where("maybe")
    listed = near.select("doc_id", cut_up("text").alias("c")).select("doc_id", "c.*").withColumnRenamed("doc_id", "id")
    return cut(listed.join(wanted, (listed["key"] == wanted["key"]) & listed["id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("key", "set").dropDuplicates(["key"]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar enough."""
    sided = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("xb")), "b")
    return sided.where(_similarity("xa", "xb") >= similarity).select(*pairs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(key, doc_id): for each group of near duplicates the one document that stays, by text_key and smallest id.

    Texts of the same lower-cased words are one class from the start. Two classes are linked if their sets of width-word
    shingles have a Jaccard similarity of at least `similarity`; groups are what links connect. Candidates come from the
    SimHash balls and from BANDS min-hash bands. In a band's bucket each class is compared with the bucket's smallest and
    greatest key, which is every pair where there are three classes or fewer. Classes of larger buckets that still hold
    several groups are then compared exactly across groups (see across), so every pair that meets in a bucket is settled.
    Null and blank texts are one class. Null ids come after all others. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _near_duplicates(rows, cut(sketches(rows, "doc_id", "text", width)), similarity, width)


def _near_duplicates(rows: DataFrame, each: DataFrame, similarity: float, width: int) -> DataFrame:
    classes = cut(each.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))

    by_fp = classes.groupBy("fp").agg(F.min("key").alias("first"))
    starred = links(by_fp.select("fp")).join(by_fp, "fp").select(F.col("first").alias("a"), "centre").join(by_fp.select(F.col("fp").alias("centre"), F.col("first").alias("b")), "centre").select("a", "b")
    same = classes.join(by_fp, "fp").selectExpr("key AS a", "first AS b")
    bands = classes.selectExpr("key", "explode(bands) AS value")  # a band's number is in its hash already
    ends = bands.groupBy("value").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low <> high")
    held = cut(bands.join(ends, "value"))
    banded = held.selectExpr("key AS a", "explode(array(low, high)) AS b")
    pairs = cut(starred.unionAll(same).unionAll(banded).where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())

    sets = shingle_sets(rows, pairs.selectExpr("explode(array(a, b)) AS key").distinct(), classes, width)
    roots = connected(verified(pairs, sets, similarity), "a", "b").withColumnRenamed("node", "key")

    # Larger buckets that hold several groups are finished exactly.
    spread = cut(held.where("n > 3").select("key", "value").join(roots, "key", "left").selectExpr("key", "value", "coalesce(root, key) AS g"))
    unfinished = spread.groupBy("value").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("value")
    open_ = spread.join(unfinished, "value", "left_semi").select("key", "g").distinct()
    crossing = cut(across(open_.join(sets, "key"), similarity))
    merged = connected(verified(crossing, sets, similarity), "ga", "gb").withColumnRenamed("node", "g")

    grouped = classes.select("key", "doc_id").join(roots, "key", "left").selectExpr("coalesce(root, key) AS g", "key", "doc_id")
    grouped = grouped.join(merged, "g", "left").selectExpr("coalesce(root, g) AS root", "key", "doc_id")
    first = F.min_by(F.struct("key", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    return grouped.groupBy("root").agg(first.alias("k")).select("k.key", "k.doc_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs that near_duplicates lets stay, each once, with the columns of docs.

    Ids of rows that go (or stand repeated) are put into a sieve. Rows whose id is not in it stay without being moved;
    only the rest, about as much as goes, is shuffled by the text's key and the id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    each = cut(sketches(rows, "doc_id", "text", width))
    kept = cut(_near_duplicates(rows, each, similarity, width).withColumnRenamed("doc_id", "kept"))
    counted = each.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    stays = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("kept"))
    doubtful = counted.join(kept.withColumnRenamed("key", "k"), stays, "left").where("k IS NULL OR n > 1").select("doc_id")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"))
    marked = sifted(packed, "doc_id", cut(sieve(doubtful)))
    keyed = marked.where("maybe").select("row", "doc_id", text_key(F.col(f"row.{text_col}")).alias("key"))
    once = keyed.join(kept.withColumnRenamed("key", "k"), stays, "left_semi").dropDuplicates(["key", "doc_id"])
    return marked.where("NOT maybe").select("row.*").unionByName(once.select("row.*"))


def across(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ga, gb), a < b: every pair of (key, g, set) of different groups g whose sets may be similar enough.

    Prefix filter, which loses nothing: with shingles ordered from rare to common, two sets of n <= m members that are
    similar enough share one of the first n - ceil(2t / (1 + t) n) + 1 of the smaller and m - ceil(t m) + 1 of the
    larger. Only shingles of several groups make pairs. There the largest group is never joined with itself, and the
    other groups' rows are salted, so no shingle is one task.
    """

    @F.pandas_udf("array<long>")
    def members(sets: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int64) for x in sets], dtype=object)

    t = similarity
    listed = sets.select("key", "g", members("set").alias("m")).selectExpr("key", "g", "size(m) AS n", "explode(m) AS shingle")
    counts = listed.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")  # shingles of one set come first of all and meet nothing
    ordered = listed.join(counts, "shingle").groupBy("key", "g", "n").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("s"))
    placed = ordered.selectExpr("key", "g", "n", "posexplode(s) AS (at, x)", "n - size(s) AS alone").selectExpr("key", "g", "n", "x.shingle AS shingle", "at + alone AS at")
    # 1e-9 keeps whole products whole.
    prefix = cut(placed.where(f"at < n - ceil({t} * n - 1e-9) + 1").withColumn("short", F.expr(f"at < n - ceil({2 * t / (1 + t)} * n - 1e-9) + 1")))
    held = prefix.groupBy("shingle", "g").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("g", F.struct("c", "g")).alias("lead"), (F.sum("c") - F.max("c")).alias("others"))
    keyed = prefix.join(held.where("others > 0").selectExpr("shingle", "lead", "1 + others div 500 AS salts"), "shingle")
    few = keyed.where("g <> lead").selectExpr("shingle", "pmod(xxhash64(key), salts) AS salt", "key AS ka", "g AS fa", "n AS na", "at AS pa", "short")
    every = keyed.selectExpr("shingle", "explode(sequence(0L, salts - 1)) AS salt", "g = lead AND short AS first", "key AS kb", "g AS fb", "n AS nb", "at AS pb")
    # Of the two sets the smaller one's shingle has to be in its short prefix.
    smaller = few.where("short").join(every, ["shingle", "salt"]).where("fa <> fb AND (na, ka) < (nb, kb)")
    larger = few.join(every.where("first"), ["shingle", "salt"]).where("fa <> fb AND (na, ka) > (nb, kb)")
    met = smaller.unionByName(larger).where(f"least(na, nb) >= {t} * greatest(na, nb) - 1e-9 AND least(na - pa, nb - pb) >= {t / (1 + t)} * (na + nb) - 1e-9")
    return met.selectExpr("least(ka, kb) AS a", "greatest(ka, kb) AS b", "IF(ka < kb, fa, fb) AS ga", "IF(ka < kb, fb, fa) AS gb").distinct()


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
