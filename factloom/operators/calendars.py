"""References to calendars: sessions of exchanges counted backwards and forwards, fiscal periods by label.

A calendar is a table of dates with versions, each of which became available at an instant. What a reference resolves to is
what the version said that was known as of the reference, never a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.clocks import asof_each

RESOLVED, NOT_FOUND, VIOLATION, OUT_OF_RANGE = "RESOLVED", "REFERENCE_NOT_FOUND", "REFERENCE_AS_OF_VIOLATION", "OUT_OF_RANGE"


def _versioned(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """refs (calendar_id, as_of) with the newest version of their calendar that was available, and whether any version exists."""
    ledger = versions.select("calendar_id", "version", "available_at").distinct().withColumn("__known", F.lit(0))
    held = asof_each(refs.withColumn("__now", F.lit(0)), ledger, ["calendar_id"], "as_of", "__now", "available_at", "__known", "version", ["version", "available_at"]).drop("__now")
    known = versions.select(F.col("calendar_id").alias("__id"), F.lit(True).alias("__exists")).distinct()
    return held.join(known, F.col("calendar_id") == F.col("__id"), "left").drop("__id")


def _status(found: Column) -> Column:
    return F.when(F.col("version").isNull() & F.col("__exists"), VIOLATION).when(F.col("version").isNull(), NOT_FOUND).when(found, RESOLVED).otherwise(OUT_OF_RANGE)


def numbered(sessions: DataFrame) -> DataFrame:
    """sessions (calendar_id, version, available_at, session_date) with `number`, from 1 within a calendar's version.

    A version has a few hundred sessions a year, so its window is small. Repeated sessions count once, null dates not.
    """
    days = sessions.where("session_date IS NOT NULL").select("calendar_id", "version", "available_at", "session_date").distinct()
    return days.withColumn("number", F.row_number().over(Window.partitionBy("calendar_id", "version").orderBy("session_date")))


def resolve_sessions(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """refs (calendar_id, as_of, offset) with version, available_at, base_date, target_date and status.

    base_date is the last session on or before as_of's day, target_date the one `offset` sessions after it (before it where
    offset is negative): session numbers make that an addition and an equi-join, however far it is. NOT_FOUND: no such
    calendar. VIOLATION: all its versions became available after as_of. OUT_OF_RANGE: the version has no such session. Null as_of or
    offset never resolve: nothing was available at an unknown instant, and no session is an unknown number away.
    """
    days = numbered(sessions)
    held = _versioned(refs, days)
    on = held.withColumns({"__day": F.to_date("as_of"), "__now": F.lit(0)})
    ledger = days.select("calendar_id", "version", "session_date", "number").withColumns({"__known": F.lit(0), "base_date": F.col("session_date")})
    based = asof_each(on, ledger, ["calendar_id", "version"], "__day", "__now", "session_date", "__known", "number", ["base_date", "number"])
    targets = days.select(F.col("calendar_id").alias("__c"), F.col("version").alias("__v"), F.col("number").alias("__n"), F.col("session_date").alias("target_date"))
    met = based.join(targets, (F.col("calendar_id") == F.col("__c")) & (F.col("version") == F.col("__v")) & (F.col("number") + F.col("offset") == F.col("__n")), "left")
    return met.select(*refs.columns, "version", "available_at", "base_date", "target_date", _status(F.col("target_date").isNotNull()).alias("status"))


def resolve_periods(refs: DataFrame, periods: DataFrame) -> DataFrame:
    """refs (calendar_id, as_of, period_label) with version, available_at, start_date, end_date and status (see resolve_sessions).

    periods (calendar_id, version, available_at, period_label, start_date, end_date) has one row a label and version.
    """
    held = _versioned(refs, periods)
    named = periods.select(F.col("calendar_id").alias("__c"), F.col("version").alias("__v"), F.col("period_label").alias("__l"), "start_date", "end_date")
    met = held.join(named, (F.col("calendar_id") == F.col("__c")) & (F.col("version") == F.col("__v")) & (F.col("period_label") == F.col("__l")), "left")
    return met.select(*refs.columns, "version", "available_at", "start_date", "end_date", _status(F.col("start_date").isNotNull()).alias("status"))
