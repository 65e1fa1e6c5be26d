"""Line dedup by pairwise alignment.

Documents that overlap are found through hashes of rare lines: a line of few words is common anywhere, so it is hashed
together with the lines that follow until MIN_WORDS words are reached. Any common block worth deleting starts such a
window, and every later holder of a window is paired with its first holder, so pairs grow with the windows and never
with the square of a group. The two documents' lines are aligned by patience diff (unique common lines, longest
increasing run, then between them), and blocks of at least MIN_WORDS words are deleted from the later document. Shared
windows that the diff leaves out (moved or repeated passages) are then aligned from where they begin, so none is lost.

Only hashes and word counts of lines are shuffled and aligned; texts are read again once, for the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, hot_join, small_batches

MIN_WORDS = 30
LINES = "content long, hashes array<long>, words array<int>, windows array<long>"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def windows_of(hashes: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(line, end, hash) of every window: a line with words and those that follow it until min_words words are reached."""
    windows, end, total = [], 0, 0
    raw = np.array(hashes, dtype=np.int64).tobytes()
    for i in range(len(hashes)):
        while end < len(hashes) and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        if words[i]:
            windows.append((i, end, signed(xxhash.xxh64_intdigest(raw[8 * i : 8 * end], 10))))
        total -= words[i]
    return windows


def lines_of(text: str | None, min_words: int = MIN_WORDS) -> tuple[int, list[int], list[int], list[int]]:
    """(content, hashes, words, windows): identity of the text; of each line its hash and words; hashes of the windows."""
    lines = [x.strip() for x in (text or "").split("\n")]
    hashes = [signed(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 9)) for x in lines]
    words = [len(x.split()) for x in lines]
    content = signed(xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 11))
    return content, hashes, words, sorted({h for _, _, h in windows_of(hashes, words, min_words)})


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ordered by the first number) whose second numbers increase."""
    tops, piles, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (i, j) with a[i] == b[j], increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        once_a, once_b = Counter(a[i:ie]), Counter(b[j:je])
        place = {x: k for k, x in enumerate(b[j:je], j) if once_b[x] == 1}
        anchors = increasing([(k, place[x]) for k, x in enumerate(a[i:ie], i) if once_a[x] == 1 and x in place])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (ie, je)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Extension:
    """How far two sequences of line hashes agree around a pair of places, by binary search on sums of powers."""

    def __init__(self, a: list[int], b: list[int]):
        n = max(len(a), len(b)) + 1
        with np.errstate(over="ignore"):
            self.power = np.concatenate((np.ones(1, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64))).cumprod(dtype=np.uint64)
            self.sums = [np.concatenate((np.zeros(1, np.uint64), (np.array(x, dtype=np.int64).view(np.uint64) * self.power[: len(x)]).cumsum(dtype=np.uint64))) for x in (a, b)]
        self.lengths = len(a), len(b)

    def agrees(self, i: np.ndarray, ie: np.ndarray, j: np.ndarray, je: np.ndarray) -> np.ndarray:
        a, b = self.sums
        return (a[ie] - a[i]) * self.power[j] == (b[je] - b[j]) * self.power[i]

    def around(self, i: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(before, after): lines that agree before and from places i of the first and j of the later sequence."""
        out = []
        for step, most in ((-1, np.minimum(i, j)), (1, np.minimum(self.lengths[0] - i, self.lengths[1] - j))):
            low, high = np.zeros_like(i), most
            while (low < high).any():
                mid = (low + high + 1) // 2
                at = np.full_like(i, j)
                ok = self.agrees(i - mid, i, at - mid, at) if step < 0 else self.agrees(i, i + mid, at, at + mid)
                low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
            out.append(low)
        return out[0], out[1]


def common_blocks(first: list[int], later: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Lines of the later document in common blocks of at least min_words words.

    Blocks of the patience diff go first. Around every window that both documents hold and that is still left, the
    longest common blocks go too, so no shared window stays, be it moved or repeated.
    """
    gone: set[int] = set()
    run: list[tuple[int, int]] = []
    for i, j in [*patience(first, later), (-9, -9)]:
        if run and (i != run[-1][0] + 1 or j != run[-1][1] + 1):
            if sum(words[x] for _, x in run) >= min_words:
                gone |= {x for _, x in run}
            run = []
        run.append((i, j))
    count = dict(zip(later, words, strict=True))
    places: dict[int, list[int]] = defaultdict(list)
    for i, _, h in windows_of(first, [count.get(x, 0) for x in first], min_words):  # lines that later lacks are in no shared window
        places[h].append(i)
    seeds = [(j, end, h) for j, end, h in windows_of(later, words, min_words) if h in places]
    far = Extension(first, later) if any(not gone.issuperset(range(j, end)) for j, end, _ in seeds) else None
    for j, end, h in seeds:
        if not gone.issuperset(range(j, end)):
            before, after = far.around(np.array(places[h], dtype=np.int64), j)
            gone |= set(range(j - int(before.max()), j + int(after.max())))
    return sorted(gone)


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    @F.pandas_udf(LINES)
    def lines(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([lines_of(t, min_words) for t in batch], columns=["content", "hashes", "words", "windows"])

    small_batches(docs)
    return docs.select(F.col(id_col).alias("doc_id"), lines(F.col(text_col)).alias("l")).select("doc_id", "l.*")


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, content, lines, n_partners): of documents that lose lines, their numbers from 0.

    Documents are ordered by id, then by text; null ids come last. Rows of the same id and text are one document.
    Null and empty texts lose nothing. An empty table gives no rows.
    """

    @F.pandas_udf("array<int>")
    def aligned(first: pd.Series, later: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([common_blocks(list(a), list(b), list(w), min_words) for a, b, w in zip(first, later, words, strict=True)])

    each = cut(line_table(docs, id_col, text_col, min_words).where("size(windows) > 0").dropDuplicates(["doc_id", "content"]))
    order = "struct(doc_id IS NULL AS last, doc_id, content)"
    held = each.selectExpr(f"{order} AS later", "explode(windows) AS window")
    first = held.groupBy("window").agg(F.min("later").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = hot_join(held, first, "window", "n").where("later <> first").select("later", "first").distinct()
    lines = each.selectExpr(f"{order} AS own", "hashes", "words")
    both = pairs.join(lines.selectExpr("own AS later", "hashes AS b", "words"), "later").join(lines.selectExpr("own AS first", "hashes AS a"), "first")
    cuts = both.select("later", aligned("a", "b", "words").alias("gone")).where("size(gone) > 0")
    return cuts.groupBy("later").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("lines"), F.count("*").alias("n_partners")).select("later.doc_id", "later.content", "lines", "n_partners")


def content_of(text: Column) -> Column:
    @F.pandas_udf("long")
    def content(texts: pd.Series) -> pd.Series:
        return pd.Series([lines_of(t)[0] for t in texts], dtype="int64")

    return content(text)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text without deleted lines, n_lines (null text: 0), n_deleted and n_partners. Other columns stay.

    Clashing columns of docs with the names of the added ones are replaced.
    """
    gone = deletions(docs, id_col, text_col, min_words).select(F.col("doc_id").alias("__id"), F.col("content").alias("__gone_of"), F.col("lines").alias("__gone"), F.col("n_partners").alias("__partners"))
    keyed = docs.drop("n_lines", "n_deleted", "n_partners").withColumn("__content", content_of(F.col(text_col)))
    found = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__content") == F.col("__gone_of")), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    out = found.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)),
            "n_deleted": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")),
            "n_partners": F.coalesce("__partners", F.lit(0)),
            text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept),
        }
    )
    return out.drop("__id", "__gone_of", "__gone", "__partners", "__content")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document loses, and the digest of the text that is left."""
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.selectExpr("doc_id", "n_lines", "n_deleted", "n_partners", "CAST(char_length(text) AS BIGINT) AS chars_left", "sha2(coalesce(text, ''), 256) AS text_sha256")
