"""Quality rules learned from labels: an ordered list of threshold conjunctions over statistics of a text.

Sequential covering: a rule grows condition by condition on two thirds of the labelled texts (by information gain), is
cut back on the last third, and what it covers leaves the texts that the next rule learns from. Statistics, histograms
and counts are Spark expressions and aggregates; the driver sees only counts by statistic and bin. The list is applied as
one conditional expression, so scoring a corpus is a projection without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written

BLANK, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: Base rules: fewer words, or more hundredths of the words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3

#: Names of the statistics that conditions may test, all in thousandths of a word (or of a line) rounded down.
FEATURES = ("symbols_per_word", "marks_per_word", "capitals_per_word", "digits_per_word", "chars_per_word", "repeated_share", "duplicate_line_share", "distinct_share")
#: Statistics are cut off here, so that a histogram has at most this many thousandths.
LARGEST = 1000.0

#: Quantiles of a class whose midpoints are thresholds; conditions and rules at most; texts that a rule must cover.
QUANTILES, MAX_CONDITIONS, MAX_RULES, MIN_COVERED = 16, 3, 8, 5
#: Corrected precision ((bad + 1) / (all + 2)) that a rule must have on the texts that prune it, and on those that grew it.
MIN_PRECISION = 0.9


@dataclass(frozen=True)
class Condition:
    """A statistic is at least, or less than, a threshold."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Texts for which all conditions hold are bad; bad and good are those that it covered when it was learnt."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return holds(self.conditions)

    def __str__(self) -> str:
        return f"{' AND '.join(map(str, self.conditions))} ({self.bad} bad, {self.good} good)"


def holds(conditions: tuple[Condition, ...]) -> Column:
    """The conjunction of conditions, true for none."""
    all_of = F.lit(True)
    for c in conditions:
        all_of &= c.column()
    return all_of


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body and its lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in windows that the array holds twice or more.

    Windows are known by 64-bit hashes: a wrong one needs two windows of one text with equal hashes. They are sorted
    with their positions only where two are equal, so time grows with n log n and memory with n.
    """
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[at(i, k) for k in range(window)]))

    def covered(h: Column) -> Column:
        dealt = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        places = let(dealt, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)), lambda x: x["i"])))
        return let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))), F.lit(0), lambda t, n: t + n))

    several = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) >= window, several).otherwise(F.lit(0))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and FEATURES; a null text is empty.

    Columns of docs that bear one of these names are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(value, BLANK), lambda w: w != "")
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.aggregate(w, F.lit(0), lambda t, x: t + F.length(x)).alias("chars"), repeated_words(w).alias("repeated")))
    of_lines = let(lines, lambda l: F.struct(F.size(l).alias("n"), (F.size(l) - F.size(F.array_distinct(l))).alias("duplicate")))  # noqa: E741
    of_text = F.struct((F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).alias("symbols"), *[F.regexp_count(value, F.lit(p)).alias(n) for n, p in (("marks", r"[^\p{L}\p{M}\p{N}\s]"), ("capitals", r"\p{Lu}"), ("digits", r"\p{Nd}"))])

    def share(part: str, of: str) -> Column:
        return F.coalesce(F.least(F.floor(1000 * F.try_divide(F.col(part), F.col(of))) / 1000, F.lit(LARGEST)), F.lit(0.0))

    ratios = zip(FEATURES, (("__t.symbols", "__w.n"), ("__t.marks", "__w.n"), ("__t.capitals", "__w.n"), ("__t.digits", "__w.n"), ("__w.chars", "__w.n"), ("__w.repeated", "__w.n"), ("__l.duplicate", "__l.n"), ("__w.distinct", "__w.n")), strict=True)
    counts = {"n_words": "__w.n", "word_chars": "__w.chars", "n_symbols": "__t.symbols", "n_dup_lines": "__l.duplicate", "n_repeat_words": "__w.repeated"}
    out = docs.withColumns({"__w": of_words, "__l": of_lines, "__t": of_text})
    out = out.withColumns({name: F.col(c).cast("long") for name, c in counts.items()} | {name: share(*r) for name, r in ratios})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__w", "__l", "__t")


def thresholds(labelled: DataFrame, quantiles: int = QUANTILES) -> dict[str, list[float]]:
    """For each statistic the midpoints between neighbouring quantiles of good and of bad texts (exact; extremes included)."""
    at = F.array(*[F.lit(i / quantiles) for i in range(quantiles + 1)])
    ends = labelled.agg(*[F.percentile(F.when(F.col("bad") == bad, F.col(f)), at).alias(f"{f}_{bad}") for f in FEATURES for bad in (True, False)]).first()
    found = {}
    for f in FEATURES:
        values = sorted({v for bad in (True, False) for v in ends[f"{f}_{bad}"] or []})
        found[f] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return found


def binned(labelled: DataFrame, at: dict[str, list[float]]) -> DataFrame:
    """How many labelled texts have the same class, fold and bins of all statistics; a bin is the number of thresholds not above."""

    def bin_of(f: str) -> Column:
        value = F.col(f)
        return F.size(F.filter(F.array(*map(F.lit, at[f])).cast("array<double>"), lambda t: t <= value)).alias(f)

    return labelled.select("bad", "grows", *map(bin_of, FEATURES)).groupBy("bad", "grows", *FEATURES).agg(F.count("*").alias("n"))


def _met(conditions: tuple[tuple[str, bool, int], ...]) -> Column:
    met = F.lit(True)
    for f, at_least, b in conditions:
        met &= F.col(f) >= b if at_least else F.col(f) < b
    return met


def _best(cells: list, bad: int, good: int, min_covered: int) -> tuple[float, tuple[str, bool, int] | None]:
    """The condition of the greatest information gain over bad and good, from counts by (statistic, bin); ties go to the first statistic and the lowest bin."""
    best, chosen = 0.0, None
    before = math.log2(bad / (bad + good))
    for f in FEATURES:
        mine = sorted((r.bin, r.bad, r.good) for r in cells if r.feature == f)
        below_bad = below_good = 0
        for (_, b, g), (upper, _, _) in zip(mine, mine[1:], strict=False):
            below_bad, below_good = below_bad + b, below_good + g
            for at_least, p, n in ((True, bad - below_bad, good - below_good), (False, below_bad, below_good)):
                gain = p * (math.log2(p / (p + n)) - before) if p >= min_covered else 0.0
                if gain > best + 1e-9:
                    best, chosen = gain, (f, at_least, upper)
    return best, chosen


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_covered: int = MIN_COVERED, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list of labelled (bad boolean, grows boolean, FEATURES): rules that tell bad texts, in order.

    No rows, one class only, or no statistic that tells the classes apart give no rule. All labelled rows count.
    """
    at = thresholds(labelled)
    left, rules = written(binned(labelled, at)), []
    counts = [F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good")]
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES])).alias("c")
    while len(rules) < max_rules:
        grown = ()
        while len(grown) < max_conditions:
            cells = left.where("grows").where(_met(grown)).select("bad", "n", cell).groupBy("c.feature", "c.bin").agg(*counts).collect()
            bad, good = (sum(r[k] for r in cells if r.feature == FEATURES[0]) for k in ("bad", "good"))
            if bad < min_covered or good == 0 and grown:
                break
            _, condition = _best(cells, bad, good, min_covered) if good else (0.0, None)
            if condition is None:
                break
            grown = (*grown, condition)
        if not grown:
            break
        starts = [grown[: k + 1] for k in range(len(grown))]
        tallies = left.groupBy("grows").agg(*[F.sum(F.when(_met(s) & (F.col("bad") == bad), F.col("n")).otherwise(0)).alias(f"{bad}_{k}") for k, s in enumerate(starts) for bad in (True, False)]).collect()
        tally = {r.grows: r for r in tallies}

        def precision(k, grows, tally=tally):
            bad, good = (tally[grows][f"{kind}_{k}"] if grows in tally else 0 for kind in (True, False))
            return (bad + 1) / (bad + good + 2)

        kept = max(range(len(starts)), key=lambda k: (precision(k, False), -k))
        if min(precision(kept, False), precision(kept, True)) < min_precision:
            break
        conditions = tuple(Condition(f, at_least, at[f][b - 1]) for f, at_least, b in starts[kept])
        rules.append(Rule(conditions, sum(r[f"True_{kept}"] for r in tallies), sum(r[f"False_{kept}"] for r in tallies)))
        left = left.where(~_met(starts[kept]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Whether a text is kept: the first rule whose conditions hold rejects it, and what none rejects is kept."""
    case = F.lit(True)
    for rule in reversed(rules):
        case = F.when(rule.column(), F.lit(False)).otherwise(case)
    return case


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of stats (see statistics) that pass the base rules and have a label, with their class and fold.

    A document with several labels counts once for each; labels without a quality or a document, and null ids, count not.
    Only numbers are shuffled: texts stay where they are measured.
    """
    of = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("__id"), (F.col("quality") == 0).alias("bad"))
    grows = F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2
    known = stats.where("NOT base_failed").select("doc_id", *FEATURES).join(of, F.col("doc_id") == F.col("__id"))
    return written(known.select("bad", grows.alias("grows"), *FEATURES))


def rated(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with kept: false where a base rule fails, else the list's verdict. Every row is judged by its text alone."""
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the list that its labels teach."""
    stats = written(statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    rules = learn(labelled(stats, table(spark, sf_dir, "labels")))
    return rated(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
