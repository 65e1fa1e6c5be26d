"""Content-addressed identity and lineage: canonical hashes, roots over slots, hash chains, ancestor walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import written


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept. Strings, integers and booleans only: doubles have no canonical text here."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_id(prefix: str, length: int | None = None, **fields: Column) -> Column:
    digest = F.sha2(canonical_json(**fields), 256)
    return F.concat(F.lit(prefix), digest if length is None else F.substring(digest, 1, length))


def root_hash(slots: DataFrame, owner: str, slot: str, artifact: str) -> DataFrame:
    """(owner, root): the hash of the slot to artifact map in slot order."""
    pairs = F.array_sort(F.collect_list(F.struct(slot, artifact)))
    return slots.groupBy(owner).agg(F.sha2(F.to_json(F.map_from_entries(pairs)), 256).alias("root_hash"))


def chain(events: DataFrame, keys: Sequence[str], order: str, payload: Column) -> DataFrame:
    """events with event_hash and previous_hash: each hash covers the event's payload, its order and the payload before it."""
    seq = Window.partitionBy(*keys).orderBy(order)
    own = F.sha2(F.concat_ws("|", payload, F.col(order).cast("string")), 256)
    linked = events.withColumn("__own", own).withColumn("previous_hash", F.lag("__own").over(seq))
    return linked.withColumnRenamed("__own", "event_hash")


def chain_faults(events: DataFrame, key: str, event_hash: str, previous_hash: str) -> DataFrame:
    """(key, forks, broken, heads): successors of the same event, links to no event, and events without a predecessor.

    A valid chain has one head, no fork and no broken link.
    """
    links = events.select(key, F.col(previous_hash).alias("__prev"))
    forks = links.where("__prev IS NOT NULL").groupBy(key, "__prev").agg((F.count("*") - 1).alias("f")).groupBy(key).agg(F.sum("f").alias("forks"))
    hashes = events.select(F.col(key).alias("__k"), F.col(event_hash).alias("__h"))
    dangling = links.where("__prev IS NOT NULL").join(hashes, (F.col(key) == F.col("__k")) & (F.col("__prev") == F.col("__h")), "left_anti").groupBy(key).agg(F.count("*").alias("broken"))
    heads = links.groupBy(key).agg(F.count_if(F.col("__prev").isNull()).alias("heads"))
    return heads.join(forks, key, "left").join(dangling, key, "left").select(key, F.coalesce("forks", F.lit(0)).alias("forks"), F.coalesce("broken", F.lit(0)).alias("broken"), "heads")


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor): the transitive closure of child to parent edges by path doubling; it ends on cycles too.

    Each round joins the closure with itself, so a chain of length n takes log2(n) rounds; the closure of a long chain is large. For
    the ancestry of a few nodes see replay.ancestry.
    """
    closure = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct())
    known = closure.count()
    while True:
        further = closure.join(closure.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__next")), "ancestor").select("node", F.col("__next").alias("ancestor"))
        closure = written(closure.unionByName(further).distinct())
        size = closure.count()
        if size == known:
            return closure
        known = size


def missing_parents(edges: DataFrame, nodes: DataFrame, child: str, parent: str, node: str) -> DataFrame:
    """Edges whose parent does not exist."""
    return edges.join(nodes.select(F.col(node).alias("__n")), F.col(parent) == F.col("__n"), "left_anti").select(child, parent)


def compare_slots(left: DataFrame, right: DataFrame, slot: str, value: str) -> DataFrame:
    """(slot, outcome): MATCH or DIFFERENT, a missing side being different."""
    a, b = left.select(slot, F.col(value).alias("__a")), right.select(slot, F.col(value).alias("__b"))
    return a.join(b, slot, "full").select(slot, F.when(F.col("__a").eqNullSafe(F.col("__b")), "MATCH").otherwise("DIFFERENT").alias("outcome"))


def valid_prefix(steps: DataFrame, keys: Sequence[str], order: str, ok: Column) -> DataFrame:
    """The last step up to which all steps are valid: where a run may resume."""
    upto = F.bool_and(ok).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("__ok", upto).groupBy(*keys).agg(F.max(F.when(F.col("__ok"), F.col(order))).alias("resume_after"))
