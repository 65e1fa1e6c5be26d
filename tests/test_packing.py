"""Blocks under a budget against a plain loop."""

import random

import pytest

from factloom.operators import clocks, packing


def brute(rows, budget, most_overlap):
    out, keys = [], {}
    for k, o, c in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        keys.setdefault(k, []).append((o, max(0, c or 0)))
    for k, items in keys.items():
        if max(c for _, c in items) > budget:
            out.append((k, None, None, None, None, None, packing.TOO_LARGE))
            continue
        start, block = 0, 0
        while True:
            end = start
            while end < len(items) and sum(c for _, c in items[start : end + 1]) <= budget:
                end += 1
            out.append((k, block, items[start][0], items[end - 1][0], end - start, sum(c for _, c in items[start:end]), None))
            if end == len(items):
                break
            start, block = end - min(most_overlap, (end - start) // 3), block + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,fan,budget", [(1, 4, 20), (2, 256, 50), (3, 8, 300)])
def test_against_a_loop(spark, monkeypatch, seed, fan, budget):
    monkeypatch.setattr(clocks, "FAN", fan)
    rng = random.Random(seed)
    rows = [(k, o, rng.choice([None, 0, *range(1, 21)])) for k, n in ((None, 30), (1, 200), (2, 1), (3, 17)) for o in range(n)] + [(4, 0, 5), (4, 1, 301)]
    rng.shuffle(rows)
    got = packing.budget_blocks(spark.createDataFrame(rows, "k long, o long, c long"), ["k"], "o", "c", budget, 5)
    assert got.columns == ["k", "block", "first", "last", "n", "total", "fault"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, budget, 5)


def test_one_long_key(spark):
    """A key of a hundred thousand rows and some ten thousand blocks."""
    rows = spark.range(100_000).selectExpr("1 AS k", "id AS o", "1 + pmod(xxhash64(id), 9) AS c")
    plain = [(1, r.o, r.c) for r in rows.collect()]
    got = packing.budget_blocks(rows, ["k"], "o", "c", 60)
    starts, ends = zip(*sorted((r["first"], r["last"]) for r in got.collect()), strict=True)
    costs = [c for _, _, c in sorted(plain, key=lambda r: r[1])]
    at, want = 0, []
    while True:
        end, total = at, 0
        while end < len(costs) and total + costs[end] <= 60:
            total, end = total + costs[end], end + 1
        want.append((at, end - 1))
        if end == len(costs):
            break
        at = end - min(12, (end - at) // 3)
    assert list(zip(starts, ends, strict=True)) == want and len(want) > 9000


def test_no_rows(spark):
    assert packing.budget_blocks(spark.createDataFrame([], "k long, o long, c long"), ["k"], "o", "c", 9).collect() == []
