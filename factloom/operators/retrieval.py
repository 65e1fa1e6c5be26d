"""Retrieval: filters before limits, hydration that keeps rank, fallback fill, exact vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, text: str | None, columns: Sequence[str], **equal) -> DataFrame:
    """Rows where any column contains the text in any case (% and _ are wildcards) and every given value is equal; empty filters do not filter."""
    for name, value in equal.items():
        if value:
            df = df.where(F.col(name) == value)
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        df = df.where(hit)
    return df


def ranked(df: DataFrame, score: Column, tie: str, limit: int) -> DataFrame:
    """The best rows with their rank from 1; equal scores by the tie column. A limit is the feature here, so one task sorts `limit` rows."""
    best = df.withColumn("__score", score).orderBy(F.desc("__score"), tie).limit(limit)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("__score")).alias("s"), F.col(tie).alias("t"), F.struct(*df.columns).alias("r")))).alias("l"))
    return listed.select(F.posexplode("l").alias("rank", "x")).select("x.r.*", (F.col("rank") + 1).alias("rank"))


def hydrate(candidates: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the candidates with the candidates' rank; candidates that are gone are left out."""
    return candidates.select(key, "rank").join(rows, key)


def filled(first: DataFrame, fallback: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Hits, then fallback rows that are not among them, up to the limit."""
    both = first.withColumn("source", F.lit(0)).unionByName(fallback.join(first.select(key), key, "left_anti").withColumn("source", F.lit(1)))
    return both.orderBy("source", order, key).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str, limit: int) -> DataFrame:
    """(id, score): the rows nearest to one query vector by cosine. query has exactly one row, whose size is one vector's."""
    one = query.select(F.col(vector_col).alias("__q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(one)).select(id_col, cosine(F.col(vector_col), F.col("__q")).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def one_edit(rows: DataFrame, keys: Sequence[str], name: str, other: str) -> DataFrame:
    """(keys, name, other): names of the same keys that differ in one character at most, each with itself too, in both orders.

    Such names are equal, or are once a character is left out of one or both. So every distinct name is dealt by itself and by what
    it is without each of its characters, and only names that share one of these are compared: rows grow with names, not with pairs.
    """
    names = rows.where(F.col(name).isNotNull()).select(*keys, name).distinct()
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substr(F.col(name), F.lit(1), i - 1), F.substr(F.col(name), i + 1)))
    dealt = names.withColumn("__short", F.explode(F.array_distinct(F.concat(F.array(name), without))))
    pairs = dealt.join(dealt.withColumnRenamed(name, other), [*keys, "__short"]).select(*keys, name, other).distinct()
    return pairs.where(F.levenshtein(name, other, 1) >= 0)
