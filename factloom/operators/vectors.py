"""A vector index of inverted lists: deterministic point ids, upserts that rewrite only the lists they touch, and probes.

Vectors are unit length, so cosine is a product. Lists are the cells of centres that k-means finds on a bounded sample; every
vector of the table is indexed. A search meets only the lists nearest to its vector: it is approximate, and its recall is measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from factloom.sources.shared import exists, written

# fixed value: the namespace of URLs in name-based UUIDs
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Vectors that the centres are fitted on at most, and their number.
SAMPLE, LISTS = 50_000, 32
#: Lists that a search meets, and neighbours that it gives.
PROBES, TOP = 22, 10
#: Points, and queries, of a list that meet in one task: 32 MB of 64 entries each.
BLOCK = 65_536

POINT = "point_id string, vec_id long, vector array<double>, payload string, effect_key string"


def point_id(key: Column) -> Column:
    """The name-based UUID (version 5) of a key's text in NAMESPACE."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(key.cast("string"), "UTF-8")))
    part = lambda start, n: F.substring(digest, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def unit(vector: Column) -> Column:
    """The vector in unit length; null where it has none (null, empty, zero, or an entry that is null or not finite)."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda t, x: t + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(doubles, lambda x: x / norm))


def points(rows: DataFrame, key: str, vector: str, payload: Column, effect_key: Column) -> DataFrame:
    """POINT rows of a table; rows without a usable vector or key give none. Of repeated keys one stays, that of the greatest payload."""
    made = rows.select(point_id(F.col(key)).alias("point_id"), F.col(key).cast("long").alias("vec_id"), unit(F.col(vector)).alias("vector"), payload.cast("string").alias("payload"), effect_key.cast("string").alias("effect_key"))
    best = made.where("vector IS NOT NULL AND vec_id IS NOT NULL").groupBy("point_id").agg(F.max_by(F.struct("vec_id", "vector", "payload", "effect_key"), F.struct("payload", "vector")).alias("p"))
    return best.select("point_id", "p.*")


def centres(made: DataFrame, lists: int = LISTS, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres (at most lists x dimension) from the sample of points that come first by a hash of their id."""
    some = made.orderBy(F.xxhash64("point_id"), "point_id").limit(sample).select(array_to_vector("vector").alias("features"))
    found = KMeans(k=lists, seed=seed, maxIter=20).fit(written(some.select("features")) if some.head(1) else some)
    c = np.array(found.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def nearest(rows: DataFrame, vector: str, cells: np.ndarray, n: int) -> DataFrame:
    """rows, once for each of the n cells nearest to their vector, with its number `list`; ties go to the smaller number."""
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def place(batches):
        for b in batches:
            if not len(b):
                continue
            v = b.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            order = np.argsort(-(v @ held.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            again = pa.array(np.repeat(np.arange(len(b)), order.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in b.columns), pa.array(order.ravel())], [*b.schema.names, "list"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("list", IntegerType())]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The points of the index with their lists."""
    return spark.read.schema(f"{POINT}, list int").parquet(path).where("point_id IS NOT NULL")


def upsert(made: DataFrame, path: str, cells: np.ndarray) -> None:
    """Put points into the index at path, each in the list of its nearest centre, in place of those with the same id.

    Rewritten are only the lists that get points or lose them; what they held is staged in the shared folder first, so the same
    upsert may be repeated after a loss. A list that loses all its points keeps one empty row, which read leaves out.
    """
    spark = made.sparkSession
    new = written(nearest(made, "vector", cells, 1))
    out = new
    if exists(spark, path):
        old = read(spark, path)
        ids = new.select("point_id")
        touched = written(new.select("list").union(old.join(ids, "point_id", "left_semi").select("list")).distinct())
        kept = old.join(F.broadcast(touched), "list", "left_semi").join(ids, "point_id", "left_anti")
        empty = touched.select(*[F.lit(None).cast(t).alias(c) for c, t in new.dtypes if c != "list"], "list")
        out = written(new.unionByName(kept).unionByName(empty))
    out.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(path)


def search(index: DataFrame, queries: DataFrame, cells: np.ndarray, probes: int = PROBES, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): of the points in the lists nearest to each query (query_id, vector), the top by cosine.

    Ties go to the smaller vec_id. With as many probes as lists it is exact. Lists and their queries are cut into blocks of BLOCK
    rows, so none is whole in a task; a block's queries meet its points in products of matrices and leave it with their top alone.
    """
    asked = nearest(queries.select("query_id", unit(F.col("vector")).alias("wanted")).where("wanted IS NOT NULL"), "wanted", cells, probes)
    blocks = lambda rows: max(1, -(-(rows.groupBy("list").count().agg(F.max("count")).first()[0] or 0) // BLOCK))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    points, asks = blocks(index), blocks(asked)
    left = index.select("list", "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(points)).alias("block"), F.explode(upto(asks)).alias("part"))
    right = asked.select("list", "query_id", "wanted", F.explode(upto(points)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(asks)).alias("part"))
    kind = dict(right.dtypes)["query_id"]

    def best(mine: pa.Table, their: pa.Table) -> pa.Table:
        ids, asking, held = mine["vec_id"].to_numpy(), their["query_id"].combine_chunks(), [([], [], [])]
        if len(ids) and len(asking):
            v, q = (t[c].combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t, c in ((mine, "vector"), (their, "wanted")))
            held = [(first + rows, ids[found], scores) for first in range(0, len(q), 64) for rows, found, scores in [_best(v, ids, q[first : first + 64], top)]]
        rows, found, scores = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.table({"query_id": asking.take(pa.array(rows.astype(np.int64))), "vec_id": pa.array(found.astype(np.int64)), "score": pa.array(scores.astype(np.float64))})

    keys = ["list", "block", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query_id {kind}, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _best(v: np.ndarray, ids: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score) of the top of every row of q; ties go to the smaller id.

    The product of the matrices only tells who may be among the top. Their scores are added up entry by entry, so that equal
    vectors get equal ones wherever they stand.
    """
    near = q @ v.T
    if len(v) > top:
        rows, found = np.nonzero(near >= np.partition(near, len(v) - top, axis=1)[:, len(v) - top, None] - 1e-9)
    else:
        rows, found = (i.ravel() for i in np.indices(near.shape))
    scores = np.zeros(len(rows))
    for d in range(v.shape[1]):
        scores += v[found, d] * q[rows, d]
    order = np.lexsort((ids[found], -scores, rows))
    rows, found, scores = rows[order], found[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < top], found[place < top], scores[place < top]
