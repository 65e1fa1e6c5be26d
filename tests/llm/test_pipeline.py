import random
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from factloom.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return ["".join(r.choice("abcdefghijk") for _ in range(r.randint(3, 7))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_ids(rows):
    """Smallest id of each group connected by similarities of 0.8 or more, over all pairs."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = [shingles(t) for _, t, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    out = {}
    for i, (d, _, _) in enumerate(rows):
        out[find(i)] = min(out.get(find(i), d), d)
    return sorted(out.values())


def corpus(r):
    rows = [(i, " ".join(words(r, r.randint(1, 200))), f"s{i % 3}") for i in range(60)]
    for i in range(60, 160):
        w = rows[r.randrange(len(rows))][1].split()
        for _ in range(r.randint(0, 1 + len(w) // 30)):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), f"s{i % 3}"))
    return rows


def test_one_document_of_each_group_stays(spark):
    rows = corpus(random.Random(9))
    r = random.Random(10)
    big = words(r, 300)
    for i in range(200, 320):  # one large group of near copies
        w = list(big)
        w[r.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w), "s0"))
    got = cp.deduplicated(spark, table(spark, rows), "").collect()
    assert sorted(x.doc_id for x in got) == kept_ids(rows)
    assert {x.doc_id: x.text for x in got} == {d: t for d, t, _ in rows if d in {x.doc_id for x in got}}


def test_dedup_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "s"), (3, " \n", "s"), (None, "some words here", "s"), (5, "Some  words here", "s"), (6, "x", "s"), (6, "x", "s"), (None, "alone", "s"), (7, "long " * 50_000, "s")]
    got = cp.deduplicated(spark, table(spark, rows), "").collect()
    assert Counter(x.doc_id for x in got) == Counter([1, 5, 6, None, 7])
    assert cp.deduplicated(spark, table(spark, rows).limit(0), "").count() == 0


def test_language_stage_keeps_what_has_letters(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "123 ??", "s"), (4, "ein Wort", "s"), (5, "x", None)]
    assert sorted(x.doc_id for x in cp.identified(spark, table(spark, rows), "").collect()) == [4, 5]


def test_mix_stage_copies(spark):
    rows = [(i, "w " * (20 + i % 50), f"s{i % 5}") for i in range(300)] + [(400, None, "s1"), (401, "", None)]
    df = table(spark, rows)
    taken = {x.doc_id: x.taken / x["size"] for x in mixing.mix(df).collect() if x["size"]}
    got = Counter(x.doc_id for x in cp.mixed(spark, df, "").collect())
    assert set(got) <= set(taken) and all(int(taken[d]) <= got[d] <= int(taken[d]) + 1 for d in taken)
    assert all(got[d] == taken[d] for d in taken if taken[d] == int(taken[d]))


def test_whole_run(spark, tmp_path):
    r = random.Random(12)
    rows = corpus(r)
    item = " ".join(words(r, 25))
    rows += [(500, "some text before " + item, "s1"), (501, "!!! 12", "s1"), (502, None, "s1")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    kept = set(kept_ids([x for x in rows if x[0] < 500]))
    assert {x.doc_id for x in got} <= kept and len({x.doc_id for x in got}) > 0.5 * len(kept)
    sizes = Counter(x.shard for x in got)
    assert len(sizes) == min(40, len(got)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(x.shard, x.slot) for x in got}) == len(got)


def test_key_ignores_case_and_space_only():
    key = lambda t: simhash.key_of(simhash.words_of(t))
    assert key("A b\nc") == key("a B  C") != key("ab c") and key(None) == key(" ")


def test_buckets_of_hundreds_are_finished_exactly(spark, monkeypatch):
    # One band of one row puts nearly all of these in one bucket, in which next ones are seldom the alike ones.
    monkeypatch.setattr(simhash, "sketch", lambda t, width, real=simhash.sketch: (*real(t, width)[:2], np.full(simhash.BANDS, 7), bytes(2 * simhash.BANDS * simhash.ROWS)))
    r = random.Random(21)
    base, rows = words(r, 120), []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(120), 9):  # about half of the shingles change
            w[at] = f"own{i}x{at}"
        rows.append((2 * i, " ".join(w), "s0"))
        for k in range(i % 3):  # copies within 0.8
            w = rows[-1][1].split()
            w[r.randrange(120)] = f"edit{i}x{k}"
            rows.append((1000 + 2 * i + k, " ".join(w), "s1"))
    got = [x.doc_id for x in simhash.near_duplicates(table(spark, rows)).collect()]
    assert sorted(got) == kept_ids(rows) and len(got) < len(rows)
