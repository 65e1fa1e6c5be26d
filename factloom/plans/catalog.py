"""Where queries register themselves: name, function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "j7_bitemporal_asof"


def query(name: str, sql: str | None = None, over: str | None = None, key: str = "id", n: int | None = None):
    """Register a query; without sql it has no oracle and is tested by a fixture instead.

    over names the phrases that the query deals over events (see dealt); sql then gives the rows of each phrase, by its number in
    key. n is the number of phrases where they have several rows.
    """

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if over is None else f"SELECT e.event_id AS {key}, o.* EXCLUDE ({key}) FROM events e JOIN ({sql}) o ON o.{key} = CAST(e.props::JSON->>'k' AS BIGINT) % {n or tuples(over)} + 1"
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """A small literal table; the same VALUES text stands in the oracle."""
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({columns})")


def tuples(values: str) -> int:
    """How many rows a VALUES text has."""
    plain, depth, n = re.sub(r"'(?:[^']|'')*'", "", values), 0, 0
    for c in plain:
        n += c == "(" and depth == 0
        depth += (c == "(") - (c == ")")
    return n


def dealt(spark: SparkSession, sf_dir: str, values: str, columns: str, n: int | None = None) -> DataFrame:
    """The rows of events as statements: each event says the phrase (VALUES rows, numbered from 1 in the first column) that its k names.

    The tables hold no text in the language of these rules, so a dimension of phrases, broadcast, stands for it; the first column
    becomes the event's id, and work grows with the events.
    """
    key, *others = [c.strip() for c in columns.split(",")]
    phrases = rows(spark, values, columns)
    number = (F.get_json_object("props", "$.k").cast("long") % (n or tuples(values)) + 1).alias("__number")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("__event"), number)
    return events.join(F.broadcast(phrases), F.col("__number") == F.col(key)).select(F.col("__event").alias(key), *others)
