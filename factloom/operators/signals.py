"""Signal projections and their validation; transcript selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = ("order", "position", "leverage", "trade_authorization")


def signal_id(snapshot: Column, claim: Column, occurrence: Column) -> Column:
    return F.concat(F.lit("signal-"), F.substring(F.sha2(F.concat_ws(":", snapshot, claim, occurrence), 256), 1, 32))


def binding_range(binding: Column) -> tuple[Column, Column]:
    """Public start and end of a temporal binding: exact ends, else the outer bounds; none for other kinds."""
    pick = lambda a, b: F.coalesce(binding[a], binding[b])
    kind = F.upper(binding["value_type"])
    start = F.when(kind == "DATE", pick("start_date", "earliest_start_date"))
    return start, F.when(kind == "DATE", pick("end_date", "latest_end_date"))


def project(units: DataFrame, snapshot: str, claim: str, occurrence: str, segment: str, lifecycle: str) -> DataFrame:
    """units with signal_id and reason: MISSING_LINEAGE where any part of the lineage is absent, and then no id."""
    whole = F.lit(True)
    for c in (snapshot, claim, occurrence, segment, lifecycle):
        whole = whole & F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    made = signal_id(F.col(snapshot).cast("string"), F.col(claim).cast("string"), F.col(occurrence).cast("string"))
    return units.withColumns({"signal_id": F.when(whole, made), "reason": F.when(~whole, "MISSING_LINEAGE")})


def trading_fields(payload: Column, forbidden: Sequence[str] = FORBIDDEN) -> Column:
    """Keys of a JSON payload that a content signal must not carry."""
    return F.array_sort(F.array_intersect(F.json_object_keys(payload), F.array(*map(F.lit, forbidden))))


def select_transcript(candidates: DataFrame, video: str, source: str, candidate: str, passed: str) -> DataFrame:
    """(video, candidate): the first passing candidate by authority (official, automatic, ASR), then id; null without one."""
    rank = F.when(F.col(source) == "OFFICIAL_SUBTITLE", 0).when(F.col(source) == "AUTO_SUBTITLE", 1).when(F.col(source) == "ASR", 2)
    return candidates.groupBy(video).agg(F.min(F.when(F.col(passed) & rank.isNotNull(), F.struct(rank.alias("r"), F.col(candidate).alias("c")))).alias("b")).select(video, F.col("b.c").alias(candidate))


def advance(old: DataFrame, new: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """(key, status): registry states after new ones; a state may move on in `order` but never back."""
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    a, b = old.select(key, F.col(status).alias("__a")), new.select(key, F.col(status).alias("__b"))
    both = a.join(b, key, "full")
    return both.select(key, F.when(F.col("__a").isNull() | (place(F.col("__b")) > place(F.col("__a"))), F.coalesce("__b", "__a")).otherwise(F.col("__a")).alias(status))
