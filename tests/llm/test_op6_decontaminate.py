import random
from itertools import combinations

import pytest

from factloom.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string, item_id string, matched string", "item_id long, text string, doc_id string"


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n)]


def brute(doc, item):
    """Words equal in the best stretch over all diagonals, or None."""
    d, w = dc.TOKEN.findall((doc or "").lower()), dc.TOKEN.findall((item or "").lower())
    best = 0
    for shift in range(-len(w), len(d) + 1) if len(w) >= dc.MIN_ITEM else []:
        gain = matched = 0
        top = (0, 0)
        for i in range(max(0, shift), min(len(d), shift + len(w))):
            same = d[i] == w[i - shift]
            gain, matched = gain + (1 if same else -dc.MISMATCH), matched + same
            if gain < 0:
                gain = matched = 0
            top = max(top, (gain, matched))
        if top[1] >= min(dc.MIN_MATCH, len(w)):
            best = max(best, top[1])
    return best or None


@pytest.mark.parametrize("filter_words", [dc.FILTER_WORDS, 1])
def test_planted_passages(spark, filter_words):
    """Also with a filter so small that it is full and lets every hash pass."""
    r = random.Random(4)
    items = [(k, " ".join(words(r, r.randint(5, 40))), "x") for k in range(25)] + [(90, None, "x"), (91, "", "x"), (92, "too short item", "x")]
    docs = []
    for i in range(60):
        body = words(r, r.randint(0, 120))
        if i % 2:
            planted = items[r.randrange(25)][1].split()
            for at in range(6 + i % 3, len(planted), 8):  # substitutions
                planted[at] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() + ",***" for w in planted]
        docs.append((i, " ".join(body), "x", "y"))
    docs += [(100, None, "x", "y"), (101, "", "x", "y"), (102, " ".join(words(r, 30_000)) + " " + items[3][1], "x", "y"), (None, items[4][1], "x", "y"), (7, docs[7][1], "x", "y")]
    got = {(h.doc_id, h.item_id): h.matched for h in dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), filter_words=filter_words).collect()}
    want = {(d, k): m for d, t, _, _ in docs if d != 102 for k, x, _ in items if (m := brute(t, x))} | {(102, 3): len(items[3][1].split())}
    assert got == want and len(got) > 20


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f", "", "")], DOCS), spark.createDataFrame([(1, "a b c d e", "")], ITEMS)
    assert dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.contaminated(docs, items.limit(0)).count() == 0
    assert [(h.doc_start, h.doc_end, h.matched) for h in dc.contaminated(docs, items).collect()] == [(0, 5, 5)]


def by_rule(doc, item):
    """Whether any stretch of any diagonal has enough equal words and four in five words equal, over all stretches."""
    need = min(dc.MIN_MATCH, len(item))
    for shift in range(-len(item), len(doc) + 1):
        same = [doc[i] == item[i - shift] for i in range(max(0, shift), min(len(doc), shift + len(item)))]
        if any(sum(same[i:j]) >= need and 5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + need, len(same) + 1)):
            return True
    return False


def test_every_stretch_that_meets_the_rule(spark):
    r = random.Random(8)
    item = words(r, 30)
    # Blocks of six or more, which the first mask hits; the fourth is a stretch behind a higher-scoring short one.
    patterns = ["1" * 7 + "00" + "1" * 7, "1" * 11 + "000" + "1" * 11, "1" * 11 + "0" * 8 + "1" * 6 + "0" + "1" * 4, "1" * 9 + "0" * 7 + "111111" + "00" + "111111"]
    patterns += ["".join("1" * r.randint(6, 9) + "0" * r.randint(1, 3) for _ in range(4))[: r.randint(14, 30)] for _ in range(300)]
    docs = [words(r, 5) + [w if e == "1" else f"x{i}" for i, (w, e) in enumerate(zip(item, equal))] + words(r, 5) for equal in patterns]
    rows = [(k, " ".join(d), "x", "y") for k, d in enumerate(docs)]
    hits = {h.doc_id: h for h in dc.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, " ".join(item), "x")], ITEMS)).collect()}
    for k, doc in enumerate(docs):
        assert (k in hits) == by_rule(doc, item), patterns[k]
    for k, h in hits.items():
        assert h.matched == sum(a == b for a, b in zip(docs[k][h.doc_start : h.doc_end], item[h.item_start :])) >= dc.MIN_MATCH and h.identity >= 0.8
    assert {0, 1, 3} <= hits.keys() and 2 not in hits


def test_long_items_and_other_ids(spark):
    """Items longer than a block, a text full of one passage, ids that are texts, repeated rows and items."""
    r = random.Random(9)
    long, short = words(r, 40 * dc.BLOCK), words(r, 20)
    docs = [("a", " ".join(words(r, 70) + long + words(r, 3)), "", ""), ("b", " ".join(short * 300), "", ""), ("b", " ".join(words(r, 9) + short), "", ""), (None, " ".join(long[100:900]), "", "")]
    docs = spark.createDataFrame(docs + docs[:1], "doc_id string, text string, item_id string, matched string")
    items = spark.createDataFrame([("x", " ".join(long), ""), ("x", " ".join(long), ""), ("y", " ".join(short), "")], "item_id string, text string, doc_id string")
    got = {(h.doc_id, h.item_id): (h.doc_start, h.doc_end, h.item_start, h.matched) for h in dc.contaminated(docs, items).collect()}
    assert got == {("a", "x"): (70, 70 + len(long), 0, len(long)), ("b", "y"): (0, 20, 0, 20), (None, "x"): (0, 800, 100, 800)}


def test_no_pattern_escapes_the_masks():
    hit = lambda p, m: any(all(p[s + i] for i, bit in enumerate(m) if bit == "1") for s in range(len(p) - len(m) + 1))
    for n in range(12, 16):
        for changed in combinations(range(1, n - 1), n - 12):
            p = [i not in changed for i in range(n)]
            assert any(hit(p, m) for m in dc.MASKS), p
