import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, n_words string, bad string, kept string"


def brute(text):
    text = text or ""
    w, n = re.findall(r"[^\x20\x09-\x0D]+", text), 0
    n = len(w)
    seen, covered = Counter(tuple(w[i : i + 3]) for i in range(n - 2)), set()
    for i in range(n - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def odd_texts():
    rng = random.Random(5)
    words = ["ab", "cd", "e", "ß𝒳", "#", "x|y", " ", " ", "<>"]
    made = ["".join(rng.choice(words) + rng.choice(" \t\n\r\x0b\x0c") for _ in range(rng.randrange(0, 90))) for _ in range(80)]
    return [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x", "\n\nl\nl\n l\n", "one two\r\none two\r\n", "word " * 30_000, " ".join(map(str, range(30_000))), *made]


def test_statistics_against_brute_force(spark):
    rows = [(i, t, "n", "b", "k") for i, t in enumerate(odd_texts())]
    got = rules.rated(rules.statistics(spark.createDataFrame(rows, SCHEMA)), [])
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(rows[r.doc_id][1])
        assert r.kept is (not r.base_failed) and r.bad == "b"


def prose(rng, kind):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 200))]
    if kind == "symbols":
        words = [w + rng.choice(["###", "%%", "$"]) for w in words]
    if kind == "shout":
        words = [w.upper() for w in words]
    return " ".join(words)


def corpus(spark, kinds, n=240, seed=1):
    rng = random.Random(seed)
    held = [(i, prose(rng, kinds[i % len(kinds)]), "n", "b", "k") for i in range(n)]
    return spark.createDataFrame(held, SCHEMA), {i: kinds[i % len(kinds)] for i in range(n)}


def test_learns_an_ordered_list(spark):
    """Two kinds of bad texts give two rules, which tell held-out texts of both kinds from clean ones."""
    docs, kind = corpus(spark, ["clean", "symbols", "clean", "shout", "clean"])
    labels = spark.createDataFrame([(i, int(k == "clean"), 0) for i, k in kind.items()] + [(None, 1, 0), (3, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    found = rules.learn(rules.labelled(rules.statistics(docs), labels))
    assert len(found) == 2 and {c.feature for r in found for c in r.conditions} <= {"symbols_per_word", "marks_per_word", "capitals_per_word", "distinct_share", "chars_per_word"}
    assert sum(r.bad for r in found) == 96 and sum(r.good for r in found) == 0 and all(" >= " in str(r) or " < " in str(r) for r in found)
    unseen, kind = corpus(spark, ["shout", "clean", "symbols", "clean"], 80, 2)
    for r in rules.rated(rules.statistics(unseen), found).collect():
        assert r.kept is (kind[r.doc_id] == "clean")


def test_rules_are_one_conditional_expression(spark):
    found = [rules.Rule((rules.Condition("symbols_per_word", True, 0.5), rules.Condition("capitals_per_word", False, 2.0)), 9, 0), rules.Rule((rules.Condition("digits_per_word", True, 1.0),), 9, 0)]
    rows = [(0.6, 1.0, 0.0, False), (0.6, 2.0, 0.0, True), (0.1, 0.0, 1.0, False), (0.1, 0.0, 0.5, True)]
    got = spark.createDataFrame(rows, "symbols_per_word double, capitals_per_word double, digits_per_word double, want boolean").withColumn("kept", rules.verdict(found))
    assert all(r.kept is r.want for r in got.collect())
    assert str(found[0]) == "symbols_per_word >= 0.5 AND capitals_per_word < 2 (9 bad, 0 good)"
    assert "python" not in got._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in range(240)], [(i, 0, 0) for i in range(240)], [(i, i * 7 % 2, 0) for i in range(240)]])
def test_labels_that_teach_nothing(spark, labels):
    docs, _ = corpus(spark, ["clean"])
    assert rules.learn(rules.labelled(rules.statistics(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == []


def test_a_rule_needs_two_conditions(spark):
    """Bad only where both are high: the list has a conjunction."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        rows.append((a > 0.6 and b > 0.6, i % 3 > 0, *(a if f == "digits_per_word" else b if f == "marks_per_word" else 0.5 for f in rules.FEATURES)))
    table = spark.createDataFrame(rows, "bad boolean, grows boolean, " + ", ".join(f"{f} double" for f in rules.FEATURES))
    found = rules.learn(table)
    assert {c.feature for c in found[0].conditions} == {"digits_per_word", "marks_per_word"}
    judged = table.select("bad", rules.verdict(found).alias("kept")).groupBy((F.col("bad") != F.col("kept")).alias("right")).count()
    assert {r.right: r["count"] for r in judged.collect()}[True] > 860


def test_no_python_in_the_plan(spark, tmp_path):
    docs, _ = corpus(spark, ["clean"], 5)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = rules.op13_quality_rules(spark, str(tmp_path))
    plan = got._jdf.queryExecution().toString() + rules.statistics(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and len(got.collect()) == 5
