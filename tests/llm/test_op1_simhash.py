import random

import numpy as np

from factloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute(rows):
    fps = [simhash.fingerprint(t) for _, t in rows]
    n, label = len(rows), list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.components(df).collect()), key=str)


def test_fingerprint_by_hand():
    import xxhash

    text = "A b\tc D b c D"
    words = ["a", "b", "c", "d", "b", "c", "d"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2.5)
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("one two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\x0b") == 0
    assert simhash.fingerprint(" ") != 0  # not white space here


def test_components_of_texts(spark):
    r = random.Random(1)
    base = " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(400))
    rows = [(i, base + f" tail{i}") for i in range(40, 60)]
    rows += [(7, base), (6, base), (6, base), (None, base), (9, None), (8, ""), (1, "word"), (None, "alone here"), (3, "x" * 200_000)]
    assert near(spark, rows) == brute(rows)


def test_links_against_all_pairs(spark):
    r = random.Random(2)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    edges = [(e.fp, e.centre) for e in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    label = {x: x for x in signed}

    def groups(pairs):
        label = {x: x for x in signed}

        def find(i):
            while label[i] != i:
                i = label[i]
            return i

        for a, b in pairs:
            label[find(a)] = find(b)
        out = {}
        for x in signed:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    true = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert label and groups(edges) == groups(true)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in edges)


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], SCHEMA)).count() == 0
