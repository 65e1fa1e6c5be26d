"""Phrases whose words stand together more often than chance has it, mined by growing frequent prefixes to the right.

Prefix projection for contiguous patterns: the occurrences of a prefix are pointers into the pieces, each with the
words that follow. Words and then pairs are counted first, so that pointers end before the first pair that cannot be
frequent. Pointers are dealt to tasks by ranges of their words and sorted there: the projected occurrences of a prefix
are then a run of rows, a prefix's extensions are runs within it, and a task walks them depth first with one counter a
word of the phrase. A prefix with more rows than a range spans several tasks; only the phrases open at the ends of a
task are partial, at most ten a task, and are summed afterwards. So no prefix, however frequent, is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import table, written

#: What ends a piece becomes a line feed, a tab a blank, and A-Z small letters: single bytes of UTF-8, so bytes are translated.
_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ\t", b"\n" * 9 + b"abcdefghijklmnopqrstuvwxyz ")

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Of a phrase's occurrences, the hundredths that must lie in one longer candidate for the phrase to be dropped.
INSIDE = 100

#: Bits of a sieve for each hash that it holds, and its size at most (32 MB): beyond, it lets more pass but loses none.
BITS_A_HASH, MOST_BITS = 16, 1 << 28

#: Parts of a language's candidates that are cut to the best before all of them are ranked.
PARTS = 64


def lines(docs: DataFrame) -> DataFrame:
    """(lang, line): the lines of all texts, which no piece crosses; a null lang is `und`, null texts have none.

    Tasks get lines, not texts, in their Arrow batches, so that a batch is small however long the texts are.
    """
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split("text", "\n")).alias("line"))


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a batch of lines in lower case (A-Z only), with the number of the piece and of the line that each is in."""
    text = pa.concat_arrays([batch.column("line")])
    _, offsets, data = text.buffers()
    text = pa.Array.from_buffers(text.type, len(text), [None, offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_CUT))])
    pieces = pc.split_pattern(text, "\n")
    words = pc.split_pattern(pc.list_flatten(pieces), " ")
    found, piece = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
    held = pc.not_equal(found, "").to_numpy(zero_copy_only=False)
    return found.filter(pa.array(held)), piece[held], pc.list_parent_indices(pieces).to_numpy()[piece[held]]


def word_counts(found: DataFrame) -> DataFrame:
    """(lang, phrase, f): how often each language's lines hold each word."""

    def count(batches):
        for b in batches:
            words, _, line = _words(b)
            if len(words):
                coded, langs = words.dictionary_encode(), b.column("lang").dictionary_encode()
                key, n = np.unique(langs.indices.to_numpy()[line].astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // len(coded.dictionary))), coded.dictionary.take(pa.array(key % len(coded.dictionary))), pa.array(n.astype(np.int64))], ["lang", "phrase", "f"])

    return found.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words of an array, each distinct word hashed once."""
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()] if len(coded) else known


def _pairs(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of lines: all words and their lines, hashes of (lang, word) for each word and of (lang, word, next word), and whether the next word is in its piece."""
    words, piece, line = _words(batch)
    alone = _hashes(words) * np.uint64(3) + _hashes(batch.column("lang"))[line]
    both = (alone ^ (alone >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.roll(alone, -1)
    follows = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
    return words, line, alone, both ^ (both >> np.uint64(32)), follows


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those that the sieve was made of."""
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _sieve(hashes: DataFrame, bits_a_hash: int = BITS_A_HASH, most_bits: int = MOST_BITS) -> np.ndarray:
    """Words of 64 bits, a bit set for each hash; their number is a power of two that grows with the hashes up to most_bits."""
    held = hashes.count()
    size = min(most_bits, max(4096, 1 << (bits_a_hash * held).bit_length()))
    rows = hashes.selectExpr(f"shiftright(h & {size - 1}, 6) AS at", "shiftleft(1L, CAST(h & 63 AS INT)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def frequent_pairs(spark: SparkSession, found: DataFrame, words: DataFrame, min_count: int) -> np.ndarray:
    """A sieve of the hashes of all pairs that stand together min_count times or more; words holds the frequent ones (lang, phrase, f)."""

    def word_hashes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_hashes(b.column("phrase")) * np.uint64(3) + _hashes(b.column("lang"))).view(np.int64))], ["h"])

    known = spark.sparkContext.broadcast(_sieve(words.select("lang", "phrase").mapInArrow(word_hashes, "h long")))

    def pair_counts(batches):
        for b in batches:
            _, _, alone, both, follows = _pairs(b)
            if not len(alone):
                continue
            often = _passes(known.value, alone)
            h, n = np.unique(both[follows & often & np.roll(often, -1)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = found.mapInArrow(pair_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return _sieve(written(counted.where(F.col("n") >= min_count).select("h")))


def pointers(spark: SparkSession, found: DataFrame, pairs: np.ndarray, max_words: int) -> DataFrame:
    """(lang, w1 .. w<max_words>, n): each word with what follows it as far as all pairs pass the sieve, equal ones counted."""
    known, names = spark.sparkContext.broadcast(pairs), [f"w{i}" for i in range(1, max_words + 1)]

    def project(batches):
        for b in batches:
            words, line, alone, both, follows = _pairs(b)
            if not len(alone):
                continue
            holds = follows & _passes(known.value, both)
            at = np.flatnonzero(holds)
            columns, goes_on = [b.column("lang").take(pa.array(line[at])), words.take(pa.array(at))], np.ones(len(at), bool)
            for ahead in range(1, max_words):
                last = np.minimum(at + ahead - 1, len(words) - 1)
                goes_on = goes_on & holds[last]
                columns.append(words.take(pa.array(np.minimum(at + ahead, len(words) - 1), mask=~goes_on)))
            yield pa.RecordBatch.from_arrays(columns, ["lang", *names])

    shown = found.mapInArrow(project, ", ".join(f"{c} string" for c in ["lang", *names]))
    return shown.groupBy("lang", *names).agg(F.count("*").alias("n"))


def grown(rows: Iterator[tuple[tuple[str, ...], int]], min_count: int) -> Iterator[tuple[tuple[str, ...], int]]:
    """(prefix, count) of every prefix that sorted (path, count) rows hold min_count times, depth first.

    Prefixes open at the first or at the end of the rows are given whatever their count: other tasks may hold more of
    them. Only the counts of the prefixes of one path are held.
    """
    path, counts, first = (), [], 0

    def closed(upto: int):
        nonlocal first
        while len(counts) > upto:
            depth = len(counts)
            n = counts.pop()
            if counts:
                counts[-1] += n
            if n >= min_count or depth <= first:
                yield path[:depth], n
            first = min(first, depth - 1)

    for row, n in rows:
        shared = 0
        for a, b in zip(path, row, strict=False):
            if a != b:
                break
            shared += 1
        started = bool(path)
        yield from closed(shared)
        path = row
        counts.extend([0] * (len(row) - shared))
        counts[-1] += n
        if not started:
            first = len(row)
    first = len(counts)
    yield from closed(0)


def phrases(spark: SparkSession, found: DataFrame, words: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, size, f): all phrases of 2 to max_words words that pieces hold min_count times or more."""
    names = [f"w{i}" for i in range(1, max_words + 1)]
    projected = pointers(spark, found, frequent_pairs(spark, found, words, min_count), max_words)
    dealt = projected.repartitionByRange("lang", *names).sortWithinPartitions("lang", *names)

    def grow(batches):
        def rows():
            for b in batches:
                for *path, n in zip(*(b.column(c).to_pylist() for c in ["lang", *names, "n"]), strict=True):
                    yield tuple(w for w in path if w is not None), n

        def full(some):
            return pa.RecordBatch.from_pylist([{"lang": p[0], "phrase": " ".join(p[1:]), "size": len(p) - 1, "f": n} for p, n in some], pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())]))

        some = []
        for p, n in grown(rows(), min_count):
            if len(p) > 2:
                some.append((p, n))
            if len(some) == 10_000:
                yield full(some)
                some = []
        yield full(some)

    found = dealt.mapInArrow(grow, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top best-scoring phrases of each language of docs (lang, text).

    n counts a language's words and a the phrase's occurrences; l and r are those of the two parts of its worst cut, and
    score is floor(1000 a n / (l r)) of that cut, of several the one after the fewest words. A phrase is dropped if a
    longer candidate that contains it has `inside` hundredths of its occurrences or more. Ties of score are ranked by a
    (most first) and then by the phrase's bytes. A null lang counts as `und`; null, empty and blank texts hold no words;
    repeated rows count as often as they come; other columns are not read; an empty table gives no rows. Sums that 64
    bits don't hold are decimals of 38 digits.
    """
    spark = docs.sparkSession
    found = lines(docs.select("lang", "text"))
    rare = F.when(F.col("f") >= min_count, F.col("phrase")).alias("phrase")
    counted = written(word_counts(found).groupBy("lang", rare).agg(F.sum("f").alias("f")))
    words, totals = counted.where("phrase IS NOT NULL"), counted.groupBy("lang").agg(F.sum("f").alias("n"))
    mined = written(phrases(spark, found, words, min_count, max_words))
    return best(scored(independent(mined, inside), words.unionByName(mined.select("lang", "phrase", "f")), totals), top)


def independent(mined: DataFrame, inside: int = INSIDE) -> DataFrame:
    """The phrases without those that a longer one contains in `inside` hundredths of their occurrences or more.

    What contains a phrase contains it with one more word first, which is at least as frequent: so longer phrases are
    compared with their two parts of one word less only.
    """
    words = F.split("phrase", " ")
    parts = [F.array_join(F.slice(words, F.lit(start), F.size(words) - 1), " ") for start in (1, 2)]
    held = mined.where("size > 2").select("lang", F.explode(F.array(*parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = F.col("f").cast("decimal(38,0)") * inside
    return mined.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < wide)).drop("longer")


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the worst cut of each candidate; counts (lang, phrase, f) holds all parts."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    cuts = cuts.join(counts.selectExpr("lang", "phrase AS first", "f AS l"), ["lang", "first"]).join(counts.selectExpr("lang", "phrase AS rest", "f AS r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(38, 0)) * a * n) div (CAST(l AS DECIMAL(38, 0)) * r)")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    return worst.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The top rows of each language with their rank; PARTS parts of a language are cut to their own top rows first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_WORDS = r"""SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)"""
OP11_SQL = f"""WITH pieces AS MATERIALIZED ({_WORDS}), starts AS (SELECT lang, words, unnest(range(1, len(words)::BIGINT + 1)) AS i FROM pieces),
    singles AS (SELECT lang, [word] AS w, 1 AS k, count(*) AS f FROM (SELECT lang, unnest(words) AS word FROM pieces) GROUP BY ALL HAVING count(*) >= 100),
    pairs AS (SELECT lang, words[i] AS x, words[i + 1] AS y FROM starts WHERE i < len(words) GROUP BY ALL HAVING count(*) >= 100),
    grams AS (SELECT lang, words[i : i + k - 1] AS w, k FROM starts JOIN pairs USING (lang), (SELECT unnest(range(2, 6)) AS k) WHERE words[i] = x AND words[i + 1] = y AND i + k - 1 <= len(words)),
    f AS MATERIALIZED (FROM singles UNION ALL SELECT lang, w, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
    held AS (SELECT DISTINCT s.lang, s.w FROM f s JOIN f b ON s.lang = b.lang AND b.k > s.k AND 100 * b.f >= 100 * s.f JOIN (SELECT unnest(range(1, 5)) AS p) ON b.w[p : p + s.k - 1] = s.w AND p + s.k - 1 <= b.k),
    cuts AS (SELECT c.lang, c.w, c.f AS a, t.n, x.f AS l, y.f AS r, cut, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
        FROM f c JOIN (SELECT unnest(range(1, 5)) AS cut) ON cut < c.k JOIN totals t ON t.lang = c.lang JOIN f x ON x.lang = c.lang AND x.w = c.w[: cut] JOIN f y ON y.lang = c.lang AND y.w = c.w[cut + 1 :]
        WHERE c.k > 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = c.lang AND h.w = c.w)),
    worst AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM worst
    QUALIFY rank <= 2000"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))
