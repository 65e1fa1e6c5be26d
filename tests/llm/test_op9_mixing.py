import math
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken string"


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 0, 1000, 50], [5, 2, 1, 5], 1060)
    assert got[0] == 30 and got[1] == 0 and got[3] == 150 and math.isclose(sum(got), 1060)
    assert mixing.targets([], [], 0) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000])
def test_permutations(n):
    a, b = (mixing.permuted(np.arange(n), np.full(n, n), mixing.keys(np.full(n, 3), np.full(n, e), 7)) for e in (0, 1))
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 17 or list(a) != list(b)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000, 3 << 20])
def test_permutations_backwards(n):
    key = int(mixing.keys(np.array([3]), np.array([2]), 7)[0])
    for k in {0, n // 3, n // 2, n - 1}:
        b = int(mixing.permuted(np.array([k]), np.array([n]), np.array([key], np.uint64))[0])
        assert mixing.restored(b, n, key) == k


def test_draws_use_up_all_slots():
    slots = [1000, 3, 0, 250]
    got = mixing.draw(slots, 16, 5)
    assert got.sum(axis=0).tolist() == slots and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    assert (got == mixing.draw(slots, 16, 5)).all()


def brute(rows, block, seed):
    """Lay the streams out word by word, draw the slots one by one."""
    streams = defaultdict(list)
    for r in rows:
        streams[r.source].append(r)
    order = sorted(streams, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in streams[s]) for s in order]
    wanted = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], sum(sizes))
    out = {}
    for i, s in enumerate(order):
        stream = [(r.doc_id, r["size"]) for r in sorted(streams[s], key=lambda r: (r.bucket, r.doc_id is not None, r.doc_id or 0, r["size"])) for _ in range(r["size"])]
        n, taken = -(-len(stream) // block), defaultdict(int)
        for j in range(mixing.slots_of(i, len(stream), wanted[i], block, seed)):
            b = int(mixing.permuted(np.array([j % n]), np.array([n]), mixing.keys(np.array([i]), np.array([j // n]), seed))[0])
            for key in stream[b * block : (b + 1) * block]:
                taken[key] += 1
        for key in {(r.doc_id, r["size"]) for r in streams[s]}:
            out[s, *key] = (taken[key], round(wanted[i], 6), sizes[i])
    return out


def test_mix_against_brute_force(spark):
    rows = [(i, "w " * (i * 37 % 90), f"s{i % 4}" if i % 4 else None, "a", "b") for i in range(150)]
    rows += [(200, None, "s1", "a", "b"), (201, " \n ", "lonely", "a", "b"), (None, "x y z", "s2", "a", "b"), (202, "long\t" * 20_000, "s3", "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows)
    placed = df.selectExpr("doc_id", "source", "CAST(coalesce(regexp_count(text, '[^ \\\\t\\\\n]+'), 0) AS BIGINT) AS size").selectExpr("*", f"pmod(xxhash64(doc_id, size), {mixing.BUCKETS}) AS bucket").collect()
    want = brute(placed, 16, 7)
    assert {(r.source, r.doc_id, r["size"]): (r.taken, round(r.target, 6), r.source_size) for r in got} == want
    assert all(r.taken <= 3 * r["size"] for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 16
    assert sorted(map(str, mixing.mix(df, block=16).collect())) == sorted(map(str, got))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "", "")] * 50, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == 50 and abs(sum(r.taken for r in got) - got[0].target) <= 64
    assert mixing.mix(df.limit(0)).count() == 0
