"""Task runs as a stream: leases that expire by timers, fencing tokens, legal transitions; and effects that happen once.

State is kept by task in the stream's checkpoint (RocksDB), so a restarted stream goes on with the leases it knew. Time is
the requests' own: a lease runs out when the watermark passes its end, whether or not its task is heard of again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.sources.shared import exists, written

# fixed values: states, transitions and what operators may ask for
TRANSITIONS = {
    "RUNNING": {"SUCCEEDED", "FAILED", "PAUSED", "RETRYING"},
    "RETRYING": {"RUNNING", "FAILED"},
    "PAUSED": {"RUNNING", "INVALIDATED"},
}
TERMINAL = {"SUCCEEDED", "INVALIDATED"}
RELEASED = {"SUCCEEDED", "FAILED"}
OPERATOR = {"pause": "PAUSED", "resume": "RUNNING", "retry": "RETRYING", "invalidate": "INVALIDATED", "rebuild": "RETRYING"}

#: What a request must hold: `at` is the instant it was made; ttl_s the length of a lease that it asks for; target a state.
REQUEST = "task_id long, seq long, at timestamp, action string, owner string, token long, ttl_s long, target string"
#: What comes back for each request, and once for each lease that runs out (action `expire`, seq null, at its end).
OUTCOME = "task_id long, seq long, at timestamp, action string, outcome string, state string, owner string, token long, attempt int"
_STATE = "state string, owner string, token long, until_ms long, attempt int, reported boolean"


def decide(held: tuple, request: tuple, now_ms: int) -> tuple[str, tuple]:
    """(outcome, state after it) of one request to a task run held as (state, owner, token, until_ms, attempt).

    Outcomes: OK, TERMINAL (a lease of a finished run), HELD (by another worker), STALE (wrong owner or token), EXPIRED
    (the lease has run out), ILLEGAL (no such transition) and UNKNOWN (no such action). Only OK changes the run. A lease
    runs until its end, exclusive.
    """
    state, owner, token, until, attempt = held
    action, asking, given, ttl_s, target = request
    if action == "acquire":
        if state in TERMINAL:
            return "TERMINAL", held
        if owner is not None and until is not None and until > now_ms and owner != asking:
            return "HELD", held
        return "OK", ("RUNNING", asking, token + 1, now_ms + 1000 * (ttl_s or 0), attempt)
    if action in OPERATOR:
        keeps = action not in ("invalidate", "rebuild")
        return "OK", (OPERATOR[action], owner if keeps else None, token, until if keeps else None, attempt + (action == "rebuild"))
    if action not in ("renew", "release", "transition", "checkpoint"):
        return "UNKNOWN", held
    if owner is None or owner != asking or token != given:
        return "STALE", held
    if until is None or until <= now_ms:
        return "EXPIRED", held
    if action == "renew":
        return "OK", (state, owner, token, now_ms + 1000 * (ttl_s or 0), attempt)
    if action == "release":
        return "OK", (state, None, token, None, attempt)
    if action == "checkpoint":
        return "OK", held
    if target not in TRANSITIONS.get(state, ()):
        return "ILLEGAL", held
    done = target in RELEASED
    return "OK", (target, None if done else owner, token, None if done else until, attempt + (target == "RETRYING"))


#: A request as the processor is given it, in the order in which a batch's requests are taken, and what it gives back of each
#: outcome; `us` are microseconds. Both are JSON in one column, since each column of each key costs as much as many requests.
_ASKED = "to_json(struct(unix_micros(at) AS us, seq, action, owner, token, ttl_s, target), map('ignoreNullFields', 'false')) AS asked"
_GIVEN = "array<struct<task_id: long, seq: long, us: long, action: string, outcome: string, state: string, owner: string, token: long, attempt: int>>"
#: Outcomes of a key that are one row on their way back.
_TOGETHER = 10_000


class TaskRuns(StatefulProcessor):
    """One task run a key: a batch's requests in order of (at, seq), and a timer at the end of the lease that it then holds.

    A lease that has run out stays in the state, so that its owner is told EXPIRED, not STALE. That it has is reported once:
    by the next request, if that comes after its end, else by the timer. A key's requests of one batch are sorted in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _STATE)

    def _outcomes(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        for n in range(0, len(rows), _TOGETHER):
            yield pd.DataFrame({"given": [json.dumps(rows[n : n + _TOGETHER])]})

    def _outcome(self, key, seq, us, action, outcome, held) -> dict:
        state, owner, token, _, attempt = held
        return {"task_id": key[0], "seq": seq, "us": us, "action": action, "outcome": outcome, "state": state, "owner": owner, "token": token, "attempt": attempt}

    def _expired(self, key, held) -> dict:
        return self._outcome(key, None, held[3] * 1000, "expire", "OK", held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *held, reported = self.run.get() or ("PENDING", None, 0, None, 0, False)
        held, timer, out = tuple(held), None if reported else held[3], []
        asked = [tuple(r.values()) for batch in rows for r in json.loads(f"[{','.join(batch['asked'])}]")]
        for us, seq, *request in sorted(asked, key=lambda r: (r[0], r[1] is not None, r[1])):
            now = us // 1000
            if held[3] is not None and held[3] <= now and not reported:
                reported = True
                out.append(self._expired(key, held))
            before = held[3]
            outcome, held = decide(held, tuple(request), now)
            reported = reported and held[3] == before
            out.append(self._outcome(key, seq, us, request[0], outcome, held))
        self.run.update((*held, reported))
        wanted = None if reported else held[3]
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        yield from self._outcomes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *held, reported = self.run.get()
        if not reported and held[3] == expiredTimerInfo.getExpiryTimeInMs():
            self.run.update((*held, True))
            yield from self._outcomes([self._expired(key, tuple(held))])

    def close(self) -> None:
        pass


def task_runs(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """OUTCOME rows of a stream of REQUEST rows.

    Requests of one batch are taken in order of (at, seq); a batch's state follows on the one before. A request that is
    later than the watermark allows is still answered, by its own instant. Requests without a task or an instant are dropped.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = requests.where("task_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    found = known.selectExpr("task_id", "at", _ASKED).groupBy("task_id").transformWithStateInPandas(TaskRuns(), "given string", "append", "EventTime")
    return found.select(F.inline(F.from_json("given", _GIVEN))).selectExpr("task_id", "seq", "timestamp_micros(us) AS at", "action", "outcome", "state", "owner", "token", "attempt")


#: Verdicts on effects.
DONE, AGAIN, STALE, CONFLICT = "DONE", "AGAIN", "STALE", "CONFLICT"


def effect_id(task: str = "task_id", effect_key: str = "effect_key"):
    return F.concat(F.lit("eff_"), F.sha2(F.concat_ws("|", F.col(task).cast("string"), F.col(effect_key)), 256))


def judge_effects(effects: DataFrame, fences: DataFrame, ledger: DataFrame) -> DataFrame:
    """effects (task_id, effect_key, kind, payload, owner, token, seq) with effect_id, payload_hash and verdict.

    STALE: the task's fence (task_id, owner, token, until; one row a task) isn't the effect's owner and token, or had run
    out by the effect's instant `at`. CONFLICT: its effect_id is bound to another kind or payload, in the ledger or by an earlier
    effect that isn't stale. AGAIN: it is bound to the same. DONE: it is the first of its id, by (seq, at, payload hash).
    """
    held = fences.select(F.col("task_id").alias("__task"), F.col("owner").alias("__owner"), F.col("token").alias("__token"), F.col("until").alias("__until"))
    rows = effects.withColumns({"effect_id": effect_id(), "payload_hash": F.sha2("payload", 256)})
    rows = rows.join(held, F.col("task_id") == F.col("__task"), "left")
    fresh = F.coalesce((F.col("owner") == F.col("__owner")) & (F.col("token") == F.col("__token")) & (F.col("at") < F.col("__until")), F.lit(False))
    bound = F.struct(F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("payload_hash", F.lit("")).alias("payload_hash"))
    rows = rows.withColumns({"__fresh": fresh, "__bound": bound, "__order": F.struct("seq", "at", "payload_hash")}).drop("__task", "__owner", "__token", "__until")
    first = rows.where("__fresh").groupBy(F.col("effect_id").alias("__id")).agg(F.min_by("__bound", "__order").alias("__first"), F.min("__order").alias("__first_order"))
    old = ledger.select(F.col("effect_id").alias("__old"), F.struct(F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("payload_hash", F.lit("")).alias("payload_hash")).alias("__was"))
    rows = rows.join(first, F.col("effect_id") == F.col("__id"), "left").join(old, F.col("effect_id") == F.col("__old"), "left")
    known = F.coalesce("__was", "__first")
    verdict = F.when(~F.col("__fresh"), STALE).when(F.col("__bound") != known, CONFLICT).when(F.col("__old").isNotNull() | (F.col("__order") > F.col("__first_order")), AGAIN).otherwise(DONE)
    return rows.select(*effects.columns, "effect_id", "payload_hash", verdict.alias("verdict"))


def effect_sink(path: str, fences: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the ledger of effects below path, each effect once, and the verdict on every one sent.

    A batch is judged against what earlier batches wrote (folders batch=<number> below it), never against its own folder, and
    replaces that: a batch that is replayed after a loss gives the same rows. Only DONE effects are in the ledger. fences gives
    the present fences at the time the batch is judged.
    """
    schema = "effect_id string, kind string, payload_hash string, token long"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # any number below, not just the one before: batch numbers need not follow each other
        folders = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/ledger").parquet(f"{path}/ledger") if exists(spark, f"{path}/ledger") else spark.createDataFrame([], f"{schema}, batch long")
        judged = written(judge_effects(batch.dropDuplicates(), fences(spark), folders.where(F.col("batch") < number)))
        judged.where(F.col("verdict") == DONE).select("effect_id", "kind", "payload_hash", "token").write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
        judged.write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")

    return write
