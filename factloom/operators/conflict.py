"""Conflict detection and resolution, corroboration, and duplicates.

Groups are aggregated, never gathered whole: counts of distinct values, extremes, and the top two confidences. Only
columns that the caller asks for travel.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days from year 1 to 1970, so that windows are those of the proleptic ordinal.
ORDINAL = 719163


def window_key(day: Column, days: int = 30) -> Column:
    """Absolute windows of `days` days; facts without a time share one."""
    return F.coalesce(F.concat(F.lit("window-"), F.floor((F.unix_date(day) + ORDINAL) / days).cast("string")), F.lit("no-time"))


#: Parts into which detect's callers deal what one task of a scan reads: a task then holds a fraction of a split's claims.
PARTS = 8


def detect(claims: DataFrame, keys: Sequence[str], value: str, ids: str, parts: int | None = None) -> DataFrame:
    """Groups in which a value is disputed: (keys, n_claims, n_values, first_id).

    Most groups are small, so counting before the shuffle saves few rows and holds all of a split's. With parts claims are dealt
    by their keys first, to parts tasks or as many as shuffles have, if those are more.
    """
    if parts is not None:
        least = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        claims = claims.select(*keys, value, ids).repartition(max(parts, least), *keys)
    groups = claims.groupBy(*keys).agg(F.count("*").alias("n_claims"), F.countDistinct(value).alias("n_values"), F.min(ids).alias("first_id"))
    return groups.where("n_values > 1")


def auto_resolve(claims: DataFrame, keys: Sequence[str], ids: str, value: str, confidence: str, verified: str, lead: float = 0.1) -> DataFrame:
    """(keys, resolution_status, resolution_policy, preferred_claim_id) of every disputed group.

    A sole verified claim wins; else the most confident one if it leads the next by `lead`; else the dispute stays open.
    Ties of confidence go to the smallest id.
    """
    top = Window.partitionBy(*keys).orderBy(F.desc(confidence), ids)
    ranked = claims.withColumn("__rank", F.row_number().over(top))
    groups = ranked.groupBy(*keys).agg(
        F.countDistinct(value).alias("n"),
        F.count_if(F.col(verified)).alias("n_verified"),
        F.min(F.when(F.col(verified), F.col(ids))).alias("verified_id"),
        F.max(F.when(F.col("__rank") == 1, F.struct(ids, confidence))).alias("best"),
        F.max(F.when(F.col("__rank") == 2, F.col(confidence))).alias("next"),
    ).where("n > 1")
    clear = F.round(F.col(f"best.{confidence}") - F.col("next"), 9) >= lead
    policy = F.when(F.col("n_verified") == 1, "EXTERNAL_VERIFICATION_WINS").when(clear, "HIGHER_SOURCE_CONFIDENCE").otherwise("MANUAL_REVIEW")
    out = groups.withColumn("resolution_policy", policy)
    return out.select(
        *keys,
        F.when(F.col("resolution_policy") == "MANUAL_REVIEW", "OPEN").otherwise("AUTO_RESOLVED").alias("resolution_status"),
        "resolution_policy",
        F.when(F.col("n_verified") == 1, F.col("verified_id")).when(clear, F.col(f"best.{ids}")).alias("preferred_claim_id"),
    )


def corroboration(units: DataFrame, keys: Sequence[str], source: str, sentiment: str, supported: str) -> DataFrame:
    """Attention, consensus and disagreement per key; `supported` rows speak, all rows draw attention."""
    says = lambda s: F.count_if(F.col(supported) & (F.col(sentiment) == s))
    got = units.groupBy(*keys).agg(says("BULLISH").alias("up"), says("BEARISH").alias("down"), F.count_if(supported).alias("spoken"), F.countDistinct(F.when(F.col(supported), F.col(source))).alias("independent_source_count"), F.count("*").alias("n"))
    spoken = F.greatest(F.col("spoken"), F.lit(1))
    return got.where("independent_source_count > 0").select(
        *keys,
        F.greatest("up", "down").alias("corroborating_count"),
        F.least("up", "down").alias("contradicting_count"),
        "independent_source_count",
        F.round(F.col("n") / F.greatest("independent_source_count", F.lit(1)), 6).alias("attention_score"),
        F.round((F.col("up") - F.col("down")) / spoken, 6).alias("consensus_score"),
        F.round(F.least("up", "down") / spoken, 6).alias("disagreement_score"),
    )


def contradictions(claims: DataFrame, keys: Sequence[str], assertion: Sequence[str]) -> DataFrame:
    """claims with contradiction_group_id where the same key is asserted in more than one way, else null.

    Ways differ if the least and the greatest of them do, so groups shrink before the shuffle. Null keys are keys.
    """
    way = F.struct(*assertion)
    ways = claims.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(way).alias("__least"), F.max(way).alias("__most"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    name = F.concat(F.lit("contradiction_"), F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 24))
    named = claims.join(ways, same).withColumn("contradiction_group_id", F.when(~F.col("__least").eqNullSafe(F.col("__most")), name))
    return named.drop("__least", "__most", *[f"__{k}" for k in keys])


def newest_against_older(units: DataFrame, key: str, at: str, uid: str, kind: str, sentiment: str, positive: Sequence[str], negative: Sequence[str], supersede: Sequence[str], conditional: Sequence[str], condition: str) -> DataFrame:
    """(source_uid, target_uid, relation_type): the newest unit of each key against every older one.

    The newest is one aggregate row per key, joined back, so a large key is never sorted in one task.
    """
    order = F.struct(F.col(at).isNotNull(), F.col(at), F.col(uid))
    newest = units.groupBy(key).agg(F.max_by(F.struct(F.col(uid).alias("u"), F.col(kind).alias("k"), F.col(sentiment).alias("s"), F.col(condition).alias("c")), order).alias("n"), F.count("*").alias("size")).where("size > 1")
    pairs = units.join(newest, key).where(F.col(uid) != F.col("n.u"))
    against = (F.col("n.s").isin(*positive) & F.col(sentiment).isin(*negative)) | (F.col("n.s").isin(*negative) & F.col(sentiment).isin(*positive))
    final = F.col("n.k").isin(*supersede) | (F.col("n.k").isin(*conditional) & F.col("n.c").isNotNull())
    relation = F.when(~against, "REINFORCES").when(final, "SUPERSEDES").otherwise("CONFLICTS_WITH")
    return pairs.select(F.col("n.u").alias("source_uid"), F.col(uid).alias("target_uid"), relation.alias("relation_type"))


def merge_exact(units: DataFrame, key: Column, order: str, evidence: str, confidence: str) -> DataFrame:
    """One row per key: the first by order, the union of evidence, the greatest confidence."""
    keyed = units.withColumn("merge_key", key)
    return keyed.groupBy("merge_key").agg(F.min(order).alias("first_id"), F.array_sort(F.collect_set(evidence)).alias("evidence"), F.max(confidence).alias("confidence"), F.count("*").alias("n_merged"))


def minimal_items(items: DataFrame, owner: str, item: str, kind: str, refs: str) -> DataFrame:
    """Items whose references no other item of the same owner and kind has a strict subset of, repeats dropped (first id stays)."""
    once = items.withColumn("__refs", F.array_sort(F.array_distinct(refs))).groupBy(owner, kind, "__refs").agg(F.min(item).alias(item))
    small = once.select(F.col(owner).alias("__o"), F.col(kind).alias("__k"), F.col("__refs").alias("__small"))
    inside = (F.col(owner) == F.col("__o")) & (F.col(kind) == F.col("__k")) & (F.size("__small") < F.size("__refs")) & (F.size(F.array_except("__small", "__refs")) == 0)
    return once.join(small, inside, "left_anti").select(owner, item, kind, F.col("__refs").alias(refs))
