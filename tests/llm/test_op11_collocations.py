import random
import re
from collections import Counter

import pytest

from factloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n string, phrase string"


def brute(rows, min_count, max_words, inside, top):
    """All contiguous phrases counted one by one; the rest by the definitions."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= min_count}
    out = []
    for (lang, p), a in candidates.items():
        if any(o == lang and len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in candidates.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranks, found = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            found.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def texts(seed, count=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "tout", "à", "fait", "\x01x", "x\x00y", "ß", "€uro", "𝒳", "New", "york"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", "  ", ". ", "\n", "!?", ";"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None, "und", ""]), "n", "p") for i in range(count)]
    rows += [(900, None, "en", "n", "p"), (901, "", "en", "n", "p"), (None, " \t ", "de", "n", "p"), (902, "once upon a time " * 3000, "de", "n", "p")]
    return rows + [(903, "New York city. New York city", "en", "n", "p")] * 7


@pytest.mark.parametrize("min_count,max_words,inside,top", [(3, 5, 100, 2000), (5, 3, 60, 2000), (2, 5, 100, 9)])
def test_against_brute_force(spark, min_count, max_words, inside, top):
    rows = texts(min_count)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), min_count, max_words, inside, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, min_count, max_words, inside, top)


def test_a_hot_prefix_spans_tasks(spark):
    """One word begins nearly all pairs and one passage is a third of all rows; no task gets them all."""
    rows = [(i, f"the w{i % 60} the w{i % 7} so", "en", "n", "p") for i in range(1500)] + [(9, "a common passage of six words", "en", "n", "p")] * 700
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, collocations.collocations(docs, 20).collect())) == brute(rows, 20, 5, 100, 2000)


def test_rows_cut_anywhere_give_the_same_counts():
    rng = random.Random(4)
    rows = sorted(Counter(tuple(rng.choice("ab") for _ in range(rng.randrange(2, 6))) for _ in range(400)).items())
    want = Counter()
    for path, n in rows:
        for k in range(1, len(path) + 1):
            want[path[:k]] += n
    for cut in range(0, len(rows) + 1, 3):
        got = Counter()
        for part in (rows[:cut], rows[cut:]):
            for path, n in collocations.grown(iter(part), 30):
                got[path] += n
        assert {p: n for p, n in got.items() if n >= 30} == {p: n for p, n in want.items() if n >= 30}
        assert len(list(collocations.grown(iter(rows[:cut]), 10**6))) <= 10


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    found = collocations.scored(spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, f long"), spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 5)], "lang string, phrase string, f long"), spark.createDataFrame([("en", 10**15)], "lang string, n long")).first()
    assert found.score == 1000 * big * 10**15 // ((big + 1) * (big + 5))


def test_sieve_loses_nothing(spark):
    import numpy as np

    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = collocations._sieve(spark.createDataFrame([(int(h),) for h in hashes], "h long"))
    assert collocations._passes(bits, hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    assert collocations._passes(bits, others.view(np.uint64)).mean() < 0.1
    full = collocations._sieve(spark.createDataFrame([(int(h),) for h in hashes], "h long"), most_bits=64)
    assert len(full) == 1 and collocations._passes(full, hashes.view(np.uint64)).all()


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
