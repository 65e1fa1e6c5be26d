"""As-of joins at each row's own clocks, ancestry walks and conditional appends against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import clocks, replay


def answer(ledger, k, business, known):
    seen = [(t, r, e, v) for kk, t, r, e, v in ledger if None not in (k, business, known, t, r) and kk == k and t <= business and r <= known]
    return max(seen)[2:] if seen else (None, None)


@pytest.mark.parametrize("fan,keys", [(3, [1]), (4, [1, 1, 1, 2, 3, None]), (256, list(range(40)))])
def test_asof_each(spark, monkeypatch, fan, keys):
    """One hot key over many blocks, ties on both clocks, nulls anywhere, repeated asks."""
    monkeypatch.setattr(clocks, "FAN", fan)
    rng = random.Random(fan)
    ledger = [(rng.choice(keys), rng.choice([None, *range(50)]), rng.choice([None, *range(70)]), i, f"v{i}") for i in range(400)]
    asks = [(i, rng.choice([*keys, 99]), rng.choice([None, *range(-3, 60)]), rng.choice([None, *range(-3, 80)])) for i in range(250)]
    asks += asks[:5]
    got = clocks.asof_each(spark.createDataFrame(asks, "id long, k long, b long, n long"), spark.createDataFrame(ledger, "k long, t long, r long, e long, v string").repartition(3), ["k"], "b", "n", "t", "r", "e", ["e", "v"]).collect()
    assert sorted((r.id, str(r.e), str(r.v)) for r in got) == sorted((i, *map(str, answer(ledger, k, b, n))) for i, k, b, n in asks)


def test_asof_each_without_rows(spark):
    none = spark.createDataFrame([], "k long, t long, r long, e long")
    asks = spark.createDataFrame([(1, 5, 6)], "k long, b long, n long")
    assert [tuple(r) for r in clocks.asof_each(asks, none, ["k"], "b", "n", "t", "r", "e", ["e"]).collect()] == [(1, 5, 6, None)]
    assert clocks.asof_each(asks.limit(0), none, ["k"], "b", "n", "t", "r", "e", ["e"]).collect() == []


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(clocks, "FAN", 3)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.randrange(40), i, rng.randrange(9)) for i in range(300)]
    totals, want = defaultdict(int), {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        want[i], totals[k] = totals[k], totals[k] + v
    got = clocks.upto(spark.createDataFrame(rows, "k long, o long, i long, v long"), ["k"], ["o", "i"], "v", "total").collect()
    assert {r.i: r.total for r in got} == want and sorted(r["at"] for r in got) == list(range(300))


def walk(held, root):
    """Depth first with colours, all faults gathered."""
    if root not in held:
        return None, {(root, replay.MISSING, root, None)}
    reached, todo, missing = {root}, [root], set()
    while todo:
        node = todo.pop()
        for parent in held[node]:
            if parent not in held:
                missing.add((root, replay.MISSING, node, parent))
            elif parent not in reached:
                reached.add(parent)
                todo.append(parent)
    settled = set()
    while more := {n for n in reached - settled if all(p in settled or p not in held for p in held[n])}:
        settled |= more
    return reached, missing | ({(root, replay.CYCLE, min(reached - settled), None)} if reached - settled else set())


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestry(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, i + 1, i + 1, rng.randrange(60)]), rng.choice([None, None, i + 2, 1000 + i if i % 9 == 0 else None])) for i in range(60)]
    rows += [(100, 100, None), (101, 102, None), (102, 101, None), (103, None, 102), (None, 3, 4), (104, 105, 105), (105, None, None)]
    held = {i: {p for p in (a, b) if p is not None} for i, a, b in rows if i is not None}
    wanted = [0, 5, 5, 17, 59, 100, 103, 104, 777, None]
    reached, faults = replay.ancestry(spark.createDataFrame([(w,) for w in wanted], "w long"), spark.createDataFrame(rows, "id long, parent long, supersedes long"), "id", ["parent", "supersedes"])
    want = {w: walk(held, w) for w in wanted if w is not None}
    assert sorted(map(tuple, reached.collect())) == sorted((w, n) for w, (r, _) in want.items() for n in r or ())
    assert sorted(map(tuple, faults.collect()), key=repr) == sorted({f for _, fs in want.values() for f in fs}, key=repr)


def test_ancestry_of_nothing(spark):
    reached, faults = replay.ancestry(spark.createDataFrame([], "w long"), spark.createDataFrame([], "id long, parent long"), "id", ["parent"])
    assert reached.collect() == [] and faults.collect() == []


def appended(stored, batch):
    """One event after the other, as a repository would."""
    chains = defaultdict(list)
    for k, h, _, logical in stored:
        chains[k].append((h, logical))
    out = []
    for k, seq, h, p, logical, right in sorted(batch, key=lambda b: (b[1], b[2])):
        if k is None or h != right:
            out.append((seq, replay.WRONG_HASH))
        elif logical in {i for _, i in chains[k]}:
            out.append((seq, replay.REPEATED))
        elif not chains[k] or chains[k][-1][0] == p:
            chains[k].append((h, logical))
            out.append((seq, replay.APPENDED))
        else:
            out.append((seq, replay.FORKED))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_appends(spark, seed):
    """Chains that a batch extends out of order, twice, with forks, forged hashes and equal identities at other places."""
    rng = random.Random(seed)
    stored = [(k, f"{k}-{i}", f"{k}-{i - 1}" if i else None, f"L{i}") for k in range(3) for i in range(k * 2)]
    batch = []
    for k in [0, 1, 2, None]:
        chain = [f"{k}-{i}" for i in range((k or 0) * 2 - 1, (k or 0) * 2 + 12)]
        events = [(k, chain[i + 1], chain[i], f"L{rng.choice([20 + i, 20 + i, 20 + i, 21, 1])}") for i in range(12)]
        events += [(k, f"{k}-x{i}", rng.choice(chain), f"X{rng.randrange(4)}") for i in range(6)]
        late = rng.sample(events, 8)
        if seed % 2:
            rng.shuffle(events)
        batch += [(e[0], e[1], e[2], e[3], "forged" if rng.random() < 0.1 else e[1]) for e in events + late]
    batch = [(k, i, h, p, logical, right) for i, (k, h, p, logical, right) in enumerate(batch)]
    got = replay.append(spark.createDataFrame(stored, "k long, h string, p string, l string"), spark.createDataFrame(batch, "k long, seq long, h string, p string, l string, own string"), "k", "seq", "h", "p", "l", F.col("own"))
    assert sorted((r.seq, r.verdict) for r in got.collect()) == appended(stored, batch)


def test_a_long_chain_takes_few_rounds(spark):
    batch = [(1, i, f"h{i}", f"h{i - 1}", f"l{i}", f"h{i}") for i in range(700)]
    got = replay.append(spark.createDataFrame([(1, "h-1", None, "l-1")], "k long, h string, p string, l string"), spark.createDataFrame(batch, "k long, seq long, h string, p string, l string, own string"), "k", "seq", "h", "p", "l", F.col("own"))
    assert got.where("verdict = 'APPENDED'").count() == 700


def test_ancestry_looks_parents_up_once(spark):
    """However long a path is, snapshots are not read again in each round."""
    read, n = spark.sparkContext.accumulator(0), 12

    @F.udf("long")
    def seen(x):
        read.add(1)
        return x

    held = spark.range(n, numPartitions=1).select(seen("id").alias("id"), (F.col("id") - 1).alias("parent"))
    reached, faults = replay.ancestry(spark.sql(f"SELECT {n - 1}L AS id"), held, "id", ["parent"])
    assert reached.count() == n
    assert [tuple(r) for r in faults.collect()] == [(n - 1, replay.MISSING, 0, -1)]
    assert read.value <= 8 * n
