"""Task runs over streams with timers and restarts, and effects under a fence."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.streaming import tasks

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def stream_of(spark, folder, batches, restart_after=None):
    """Outcomes of the batches, one file and one micro-batch each; the query is stopped and started anew where asked."""
    out, rows = f"{folder}/out", []
    for n, batch in enumerate(batches):
        spark.createDataFrame([(t, s, at(sec), a, o, k, ttl, g) for t, s, sec, a, o, k, ttl, g in batch], tasks.REQUEST).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if n + 1 not in (restart_after, len(batches)):
            continue
        stream = spark.readStream.schema(tasks.REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = tasks.task_runs(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        query.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()
    for r in spark.read.schema(tasks.OUTCOME + ", batch long").parquet(out).collect():
        rows.append((r.task_id, r.seq, (r.at - START).total_seconds(), r.action, r.outcome, r.state, r.owner, r.token, r.attempt))
    return sorted(rows, key=lambda r: (r[0], r[2], r[1] is not None, r[1] or 0))


def test_leases_expire_renew_and_fence_over_a_restart(spark, tmp_path):
    batches = [
        [(1, 1, 0, "acquire", "a", None, 60, None), (2, 2, 0, "acquire", "a", None, 600, None), (1, 3, 50, "renew", "a", 1, 60, None), (1, 4, 55, "acquire", "b", None, 60, None)],
        [(2, 5, 2000, "transition", "a", 1, None, "PAUSED"), (3, 6, 2000, "acquire", "c", None, 10_000, None)],
        [(1, 7, 2100, "renew", "a", 1, 60, None), (1, 8, 2101, "acquire", "b", None, 60, None), (1, 9, 2102, "checkpoint", "a", 1, None, None), (1, 10, 2103, "transition", "b", 2, None, "SUCCEEDED"), (1, 11, 2104, "acquire", "c", None, 60, None)],
    ]
    got = stream_of(spark, tmp_path, batches, restart_after=2)
    assert [(r[0], r[1], r[3], r[4], r[6], r[7]) for r in got] == [
        (1, 1, "acquire", "OK", "a", 1), (1, 3, "renew", "OK", "a", 1), (1, 4, "acquire", "HELD", "a", 1),
        (1, None, "expire", "OK", "a", 1),  # by the timer: task 1 is not heard of in the second batch
        (1, 7, "renew", "EXPIRED", "a", 1), (1, 8, "acquire", "OK", "b", 2), (1, 9, "checkpoint", "STALE", "b", 2), (1, 10, "transition", "OK", None, 2), (1, 11, "acquire", "TERMINAL", None, 2),
        (2, 2, "acquire", "OK", "a", 1), (2, None, "expire", "OK", "a", 1), (2, 5, "transition", "EXPIRED", "a", 1),
        (3, 6, "acquire", "OK", "c", 1),
    ]
    assert [r[2] for r in got if r[3] == "expire"] == [110, 600] and got[7][5] == "SUCCEEDED"


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_do_not_matter(spark, tmp_path, seed):
    """Any cut into batches, restarts included, gives what one batch gives."""
    rng = random.Random(seed)
    rows, seconds = [], 0
    for i in range(60):
        seconds += rng.randrange(400)
        action = rng.choice(["acquire", "acquire", "renew", "renew", "checkpoint", "transition", "transition", "release", *tasks.OPERATOR, "nonsense"])
        rows.append((rng.randrange(3), i, seconds, action, rng.choice("ab"), rng.randrange(1, 4), rng.choice([100, 900, None]), rng.choice(["RUNNING", "PAUSED", "RETRYING", "FAILED", None])))
    rows.append((9, 99, seconds + 5000, "acquire", "z", None, 1, None))
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    assert stream_of(spark, tmp_path / "many", parts, restart_after=2) == stream_of(spark, tmp_path / "one", [rows])


def test_instants_are_whole_and_unnumbered_requests_come_first(spark, tmp_path):
    """Thousandths of a second are kept, and of requests of one instant those without a number come first."""
    odd = 123
    rows = [(1, 1, odd / 1000, "acquire", "a", None, 60, None), (1, 3, 60 + odd / 1000, "acquire", "b", None, 60, None), (1, None, 60 + odd / 1000, "renew", "a", 1, 60, None), (2, 4, 500, "acquire", "c'\"\\,[", 2**60 + 1, 9999, None)]
    got = stream_of(spark, tmp_path, [rows])
    assert [r[3:5] for r in got if r[0] == 1 and r[3] != "expire"] == [("acquire", "OK"), ("renew", "EXPIRED"), ("acquire", "OK")]
    assert [r[2] for r in got if r[0] == 1 and r[3] == "expire"][0] == 60 + odd / 1000
    assert [r[6] for r in got if r[0] == 2] == ["c'\"\\,["]


def test_transitions():
    held = ("RUNNING", "a", 3, 10_000, 0)
    for state in ("PENDING", "RUNNING", "RETRYING", "PAUSED", "FAILED", "SUCCEEDED", "INVALIDATED"):
        for target in ("PENDING", "RUNNING", "RETRYING", "PAUSED", "FAILED", "SUCCEEDED", "INVALIDATED"):
            outcome, after = tasks.decide((state, *held[1:]), ("transition", "a", 3, None, target), 5000)
            legal = target in {"RUNNING": "SUCCEEDED FAILED PAUSED RETRYING", "RETRYING": "RUNNING FAILED", "PAUSED": "RUNNING INVALIDATED"}.get(state, "").split()
            assert outcome == ("OK" if legal else "ILLEGAL") and after[0] == (target if legal else state)
            if legal and target in ("SUCCEEDED", "FAILED"):
                assert after[1] is None and after[2] == 3 and after[3] is None
    assert tasks.decide(held, ("renew", "a", 3, 5, None), 10_000) == ("EXPIRED", held)
    assert tasks.decide(held, ("acquire", "b", None, 5, None), 10_000) == ("OK", ("RUNNING", "b", 4, 15_000, 0))
    assert tasks.decide(held, ("invalidate", None, None, None, None), 0) == ("OK", ("INVALIDATED", None, 3, None, 0))


EFFECT = "task_id long, effect_key string, kind string, payload string, owner string, token long, seq long, at timestamp"


def sent(spark, rows):
    return spark.createDataFrame([(t, k, kind, p, o, n, s, at(s)) for t, k, kind, p, o, n, s in rows], EFFECT)


def test_effects_happen_once(spark, tmp_path):
    """A replayed batch, a stale worker and a batch number that skips leave one row an effect."""
    fence = {"owner": "a", "token": 1}
    fences = lambda s: s.createDataFrame([(1, fence["owner"], fence["token"], at(1000)), (2, "a", 1, at(3))], "task_id long, owner string, token long, until timestamp")
    write = tasks.effect_sink(str(tmp_path / "t"), fences)
    first = sent(spark, [(1, "x", "index", "p", "a", 1, 1), (1, "x", "index", "p", "a", 1, 1), (1, "x", "index", "p", "a", 1, 2), (1, "x", "index", "q", "a", 1, 3), (2, "y", "index", None, "a", 1, 2), (2, "z", "index", "p", "a", 1, 3), (1, "w", "index", "p", "b", 9, 4), (3, "v", "index", "p", "a", 1, 4)])
    write(first, 0)
    write(first, 0)
    fence.update(owner="b", token=2)
    second = sent(spark, [(1, "x", "index", "p", "b", 2, 10), (1, "u", "index", "p", "a", 1, 11), (1, "u", "notify", "p", "b", 2, 12), (1, "u", "index", "p", "b", 2, 13)])
    for _ in range(2):
        write(second, 7)
    ledger = spark.read.parquet(str(tmp_path / "t/ledger"))
    assert ledger.count() == 3 == ledger.select("effect_id").distinct().count()
    verdicts = spark.read.parquet(str(tmp_path / "t/verdicts")).select("batch", "seq", "effect_key", "verdict")
    assert sorted(map(tuple, verdicts.collect())) == [
        (0, 1, "x", "DONE"), (0, 2, "x", "AGAIN"), (0, 2, "y", "DONE"), (0, 3, "x", "CONFLICT"), (0, 3, "z", "STALE"), (0, 4, "v", "STALE"), (0, 4, "w", "STALE"),
        (7, 10, "x", "AGAIN"), (7, 11, "u", "STALE"), (7, 12, "u", "DONE"), (7, 13, "u", "CONFLICT"),
    ]
    assert ledger.where(F.col("token") == 2).count() == 1
