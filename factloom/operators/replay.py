"""Replay of history: projections at each snapshot's own clocks, ancestry walks, and conditional appends to hash chains.

Faults are rows with a code, not exceptions, so one run tells every fault of every snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.clocks import asof_each, placed
from factloom.operators.packing import reached
from factloom.sources.shared import written

CLOCK_MISSING, HISTORY_INVALID, HISTORY_INCOMPLETE = "REPLAY_HISTORICAL_CLOCK_MISSING", "REPLAY_HISTORICAL_LINEAGE_INVALID", "REPLAY_HISTORICAL_LINEAGE_INCOMPLETE"
CYCLE, MISSING = "REPLAY_LINEAGE_CYCLE", "REPLAY_LINEAGE_REFERENCE_MISSING"


def project_each(claims: DataFrame, events: DataFrame, key: str, business: str, known: str, effective: str, recorded: str, event_id: str, keep: Sequence[str], faults: DataFrame) -> DataFrame:
    """claims with the event in force at each one's own clocks (columns keep) and `verdict`, OK or the first code that holds.

    A clock is missing; the claim's history is invalid; it is marked incomplete, or no event of it is in force. faults
    (key, invalid, incomplete) has one row at most for a key. Where the verdict isn't OK the kept columns are null.
    """
    seen = asof_each(claims, events.withColumn("__seen", F.lit(True)), [key], business, known, effective, recorded, event_id, [*keep, "__seen"])
    marks = faults.select(F.col(key).alias("__key"), F.col("invalid").alias("__invalid"), F.col("incomplete").alias("__incomplete"))
    judged = seen.join(marks, F.col(key) == F.col("__key"), "left")
    verdict = F.when(F.col(business).isNull() | F.col(known).isNull(), CLOCK_MISSING).when(F.col("__invalid"), HISTORY_INVALID).when(F.coalesce("__incomplete", F.lit(False)) | F.col("__seen").isNull(), HISTORY_INCOMPLETE).otherwise("OK")
    judged = judged.withColumn("verdict", verdict)
    return judged.select(*claims.columns, "verdict", *[F.when(F.col("verdict") == "OK", F.col(c)).alias(c) for c in keep])


def fold_each(claims: DataFrame, events: DataFrame, key: str, business: str, known: str, effective: str, recorded: str, event_id: str, field: str, value: str, claim_id: str) -> DataFrame:
    """(claim_id, field, value): the payload that each claim's events give at its own clocks, a field's last event winning.

    Every claim asks once for each field that its key's events ever set, so rows grow with the fields, not with events.
    """
    fields = events.select(F.col(key).alias("__key"), field).distinct()
    asks = claims.select(claim_id, key, business, known).join(fields, F.col(key) == F.col("__key")).drop("__key")
    return asof_each(asks, events, [key, field], business, known, effective, recorded, event_id, [value]).where(F.col(value).isNotNull()).select(claim_id, field, value)


def ancestry(wanted: DataFrame, snapshots: DataFrame, snapshot: str, parents: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables of the wanted snapshots (one column): (root, snapshot) all that each can reach, itself included, and its faults.

    Faults are (root, code, snapshot, parent): a reachable snapshot whose parent doesn't exist (MISSING), and the
    smallest reachable one that lies on a cycle or leads to it (CYCLE, without parent). parents are the columns that name
    a parent, null for none; equal ones count once. A wanted snapshot that doesn't exist is a fault of its own, without parent.

    A frontier of (root, snapshot) pairs moves along the edges until nothing new is found, so work is linear in the edges
    reached and the rounds are the longest path. Cycles are what remains when snapshots without unsettled parents are
    taken off one layer after the other, over the snapshots reached, whichever root reached them.
    """
    parent = F.explode(F.array_distinct(F.array(*[F.col(c) for c in parents])))
    known = snapshots.select(F.col(snapshot).alias("snapshot")).where("snapshot IS NOT NULL").distinct()
    edges = snapshots.select(F.col(snapshot).alias("child"), parent.alias("parent")).where("parent IS NOT NULL").distinct()
    edges = written(edges.join(known, F.col("parent") == F.col("snapshot"), "left").select("child", "parent", F.col("snapshot").isNotNull().alias("there")))
    roots = wanted.select(F.col(wanted.columns[0]).alias("root")).where("root IS NOT NULL").distinct()
    frontier = written(roots.join(known, F.col("root") == F.col("snapshot"), "left").select("root", "snapshot"))
    absent = frontier.where("snapshot IS NULL").selectExpr("root", f"'{MISSING}' AS code", "root AS snapshot", "snapshot AS parent")
    frontier = frontier.where("snapshot IS NOT NULL")
    reached, lost = frontier, []
    while True:
        steps = written(frontier.join(edges, F.col("snapshot") == F.col("child")).select("root", "child", "parent", "there"))
        lost.append(steps.where("NOT there").selectExpr("root", f"'{MISSING}' AS code", "child AS snapshot", "parent"))
        frontier = written(steps.where("there").selectExpr("root", "parent AS snapshot").distinct().join(reached, ["root", "snapshot"], "left_anti"))
        if not frontier.head(1):
            break
        reached = reached.unionByName(frontier)
    reached = written(reached)
    for found in lost:
        absent = absent.unionByName(found)
    unsettled = written(reached.select("snapshot").distinct())
    inner = written(edges.where("there").join(unsettled.select(F.col("snapshot").alias("child")), "child", "left_semi").join(unsettled.select(F.col("snapshot").alias("parent")), "parent", "left_semi").select("child", "parent"))
    while True:
        waiting = inner.select(F.col("child").alias("parent")).distinct()
        if not inner.join(waiting, "parent", "left_anti").head(1):
            break
        inner = written(inner.join(waiting, "parent", "left_semi").select("child", "parent"))
    stuck = reached.join(inner.selectExpr("child AS snapshot").distinct(), "snapshot", "left_semi").groupBy("root").agg(F.min("snapshot").alias("snapshot"))
    cycles = stuck.select("root", F.lit(CYCLE).alias("code"), "snapshot", F.lit(None).cast(dict(absent.dtypes)["parent"]).alias("parent"))
    return reached, absent.unionByName(cycles).distinct()


APPENDED, REPEATED, FORKED, WRONG_HASH = "APPENDED", "REPEATED", "FORKED", "WRONG_HASH"


def append(stored: DataFrame, batch: DataFrame, key: str, seq: str, event_hash: str, previous_hash: str, logical: str, right_hash: Column) -> DataFrame:
    """batch with `verdict`: what appending its events in order of seq to their keys' chains comes to.

    WRONG_HASH: event_hash isn't right_hash (a column of batch's), or the key is null. REPEATED: an event with the same logical identity is
    stored or was appended before. APPENDED: previous_hash is the hash of the chain's end at that moment, or the chain is
    empty and it is null or not (an empty chain takes any first event). FORKED: all others. stored (key, event_hash,
    previous_hash, logical) holds sound chains: one end each. Events of equal seq are taken in order of their hashes; an event's place in that order stands for it.

    Which event extends an end is known without a walk: the first one after it that names it. So the appended events are
    those that a key's end reaches over such links, found by doubling the links, in log2(batch) rounds; no key's batch is
    in one task. An appended event that repeats one appended before is struck out, and the links are made again, until
    none is left; every round settles one more event of each key at least.
    """
    cols = batch.columns
    right = (F.col(key).isNotNull() & F.coalesce(F.col(event_hash) == right_hash, F.lit(False))).alias("__right")
    rows = placed(batch.select(F.struct(*cols).alias("__row"), right), [f"__row.`{seq}`", f"__row.`{event_hash}`"])
    rows = rows.select("__row.*", "__right", F.col("at").alias("__order"))
    ends = stored.select(key, F.col(event_hash).alias("__end")).join(stored.select(F.col(key).alias("__k"), F.col(previous_hash).alias("__p")), (F.col(key) == F.col("__k")) & (F.col("__end") == F.col("__p")), "left_anti")
    held = stored.select(F.col(key).alias("__k"), F.col(logical).alias("__l")).distinct()
    known = rows.where("__right").join(held, (F.col(key) == F.col("__k")) & (F.col(logical) == F.col("__l")), "left_semi").select("__order")
    fresh = written(rows.where("__right").join(known, "__order", "left_anti").select(F.col(key).alias("k"), "__order", F.col(event_hash).alias("h"), F.col(previous_hash).alias("p"), F.col(logical).alias("l")))
    ends = written(ends.select(F.col(key).alias("k"), F.col("__end").alias("h")))
    struck = fresh.select("__order").limit(0)
    while True:
        appended = written(_reached(fresh.join(struck, "__order", "left_anti"), ends))
        first = appended.groupBy("k", "l").agg(F.min("__order").alias("first"))
        again = appended.join(first, ["k", "l"]).where(F.col("__order") > F.col("first")).groupBy("k").agg(F.min("__order").alias("__order"))
        again = written(again.select("__order"))
        if not again.head(1):
            break
        struck = struck.unionByName(again)
    first = appended.groupBy(F.col("k").alias("__k"), F.col("l").alias("__l")).agg(F.min("__order").alias("__first"))
    judged = rows.join(known.withColumn("__known", F.lit(True)), "__order", "left").join(appended.select("__order", F.lit(True).alias("__appended")), "__order", "left")
    judged = judged.join(first, (F.col(key) == F.col("__k")) & (F.col(logical) == F.col("__l")), "left")
    verdict = F.when(~F.col("__right"), WRONG_HASH).when(F.col("__known"), REPEATED).when(F.col("__appended"), APPENDED).when(F.col("__first") < F.col("__order"), REPEATED).otherwise(FORKED)
    return judged.select(*cols, verdict.alias("verdict"))


def _reached(events: DataFrame, ends: DataFrame) -> DataFrame:
    """The events (k, __order, h, p, l) that a chain's end reaches; an end is stored, or the first event of a key without one."""
    begins = events.join(ends.select("k").distinct(), "k", "left_anti").groupBy("k").agg(F.min("__order").alias("__order")).select("__order")
    after = ends.select("k", F.col("h").alias("p"), F.lit(None).cast(dict(events.dtypes)["__order"]).alias("from"))
    after = after.unionByName(events.select("k", F.col("h").alias("p"), F.col("__order").alias("from")))
    links = events.select("k", "p", F.col("__order").alias("to")).join(after, ["k", "p"]).where("from IS NULL OR from < to")
    nexts = links.groupBy("from", "k", "p").agg(F.min("to").alias("to"))
    base = nexts.where("from IS NULL").select(F.col("to").alias("__order")).unionByName(begins)
    jumps = nexts.where("from IS NOT NULL").select(F.col("from").alias("node"), "to")
    return events.join(reached(base.select(F.col("__order").alias("node")), jumps), F.col("__order") == F.col("node"), "left_semi")
