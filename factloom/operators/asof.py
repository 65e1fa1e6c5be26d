"""As-of operators: which row held at given instants on one or several clocks.

All of them are one aggregate over a struct order (partial aggregation before the shuffle), never a window that sorts
a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(business_from: str, known_from: str, available_from: str, business: Column, known: Column, available: Column, business_to: str | None = None, known_to: str | None = None) -> Column:
    """Whether a row is visible on the three clocks: beginnings inclusive, ends exclusive; unknown availability is invisible."""
    ok = (F.col(known_from) <= known) & (F.col(available_from) <= available) & (F.col(business_from).isNull() | (F.col(business_from) <= business))
    if business_to:
        ok &= F.col(business_to).isNull() | (business < F.col(business_to))
    if known_to:
        ok &= F.col(known_to).isNull() | (known < F.col(known_to))
    return F.coalesce(ok, F.lit(False))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Of each key the values of the row that is greatest in the given order."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("__best"))
    return best.select(*keys, "__best.*")


def bitemporal_asof(ledger: DataFrame, keys: Sequence[str], effective: str, recorded: str, event_id: str, keep: Sequence[str], business: Column, known: Column) -> DataFrame:
    """The event in force per key, as of a business instant and as known at another."""
    seen = ledger.where((F.col(effective) <= business) & (F.col(recorded) <= known))
    return latest(seen, keys, [effective, recorded, event_id], keep)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, lookback: int, keep: Sequence[str], tie: str) -> DataFrame:
    """left with the latest right row of the same keys at most `lookback` days before; unmatched left rows get nulls.

    Right rows are hashed by keys and a bucket of lookback+1 days, so the join is an equi-join and a right row meets left rows
    of two buckets only. Columns of right in `keep` must not clash with left's.
    """
    width = lookback + 1
    bucket = F.floor(F.datediff(F.col(right_date), F.lit("1970-01-01").cast("date")) / width)
    held = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.explode(F.array(bucket, bucket + 1)).alias("__bucket"), F.col(right_date).alias("__at"), F.struct(*keep).alias("__kept"), F.col(tie).alias("__tie"))
    mine = left.withColumn("__row", F.monotonically_increasing_id()).withColumn("__bucket", F.floor(F.datediff(F.col(left_date), F.lit("1970-01-01").cast("date")) / width))
    same = (mine["__bucket"] == held["__bucket"]) & (F.col("__at") <= F.col(left_date)) & (F.datediff(F.col(left_date), F.col("__at")) <= lookback)
    for k in keys:
        same &= mine[k] == held[f"__{k}"]
    met = mine.join(held.drop(), same, "left")
    best = met.groupBy("__row", *left.columns).agg(F.max_by("__kept", F.struct("__at", "__tie")).alias("__best"))
    return best.select(*left.columns, "__best.*")


def newest_heads(rows: DataFrame, source: str, order: Sequence[str], keep: Sequence[str], verified: Column | None = None) -> DataFrame:
    """Monotonic heads: the newest row of each source and, where given, the newest verified one."""
    best = [F.max_by(F.struct(*keep), F.struct(*order)).alias("head")]
    if verified is not None:
        best.append(F.max_by(F.when(verified, F.struct(*keep)), F.when(verified, F.struct(*order))).alias("verified_head"))
    return rows.groupBy(source).agg(*best)


def fold_payload(events: DataFrame, key: str, field: str, value: str, ordinal: str) -> DataFrame:
    """Per key and payload field the value that the last event in chain order sets."""
    return events.groupBy(key, field).agg(F.max_by(value, ordinal).alias(value))
