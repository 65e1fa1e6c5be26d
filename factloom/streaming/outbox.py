"""Outbox delivery and task leases as streams.

State is kept by key in the stream's checkpoint, so a lost executor replays from there; sinks are keyed and therefore
idempotent. Late knowledge is never dropped: the ledger needs no watermark, and only the optional event-time windows
use one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.decisions import OUTBOX_DELAYS

DELIVERY = "outbox_id long, attempts int, status string, retry_in_s int"


def deliveries(attempts: DataFrame) -> DataFrame:
    """(outbox_id, attempts, status, retry_in_s): state after each batch of delivery attempts (outbox_id, ok).

    A success publishes for good; each failure waits longer; past the last delay the row is a dead letter.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, status = state.get if state.exists else (0, "PENDING")
        for batch in batches:
            for ok in batch["ok"]:
                if status in ("PUBLISHED", "DEAD_LETTER"):
                    continue
                failed += not ok
                status = "PUBLISHED" if ok else "RETRY" if failed <= len(OUTBOX_DELAYS) else "DEAD_LETTER"
        state.update((failed, status))
        wait = OUTBOX_DELAYS[failed - 1] if status == "RETRY" else None
        yield pd.DataFrame({"outbox_id": [key[0]], "attempts": [failed], "status": [status], "retry_in_s": pd.array([wait], dtype="Int32")})

    return attempts.groupBy("outbox_id").applyInPandasWithState(step, DELIVERY, "failed int, status string", "update", GroupStateTimeout.NoTimeout)


LEASE = "task_id long, owner string, token long, accepted boolean"


def leases(requests: DataFrame) -> DataFrame:
    """(task_id, owner, token, accepted): lease requests (task_id, owner, at, seconds) decided in order of `at`.

    A lease is granted if there is none, it has run out, or its owner renews it; a new owner gets the next fencing token.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, token, until = state.get if state.exists else ("", 0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "owner"]).itertuples(index=False):
            free = row.at >= until
            accepted = free or row.owner == owner
            if accepted:
                token += row.owner != owner or free
                owner, until = row.owner, int(row.at + row.seconds)
            out.append((key[0], row.owner, token, bool(accepted)))
        state.update((owner, token, until))
        yield pd.DataFrame(out, columns=["task_id", "owner", "token", "accepted"])

    return requests.groupBy("task_id").applyInPandasWithState(step, LEASE, "owner string, token long, until long", "append", GroupStateTimeout.NoTimeout)


def upsert_by_key(path: str, key: str, order: str):
    """A foreachBatch function that keeps, at path, the greatest row by `order` of each key.

    Every batch writes a new version beside the old one and then moves the pointer, so a replayed batch gives the same table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = f"{path}/version={epoch}"
        earlier = f"{path}/version={epoch - 1}"
        rows = batch
        if epoch > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(earlier))
        columns = batch.columns
        best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, *[c for c in columns if c not in (key, order)])).alias("r"))
        best.select("r.*").write.mode("overwrite").parquet(at)

    return write


def activity(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by type in event-time windows; an extension, and the one place with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
