"""Whitening of embeddings: MLlib's distributed SVD of the centred rows gives the directions of greatest variance.

Vectors become integers first, so sums and squared deviations are exact whatever the order in which rows come; only the
decomposition and the projection are in floating point. To the driver go a vector's sums, the decomposition of a matrix
of dimension x dimension and the covariance of the components: all sized by the dimension, none by the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from factloom.llm.common import table

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Entries of this size or more are no embedding's; a row that holds one is dropped like one with an infinite entry.
LARGEST = float(1 << 40)
#: Directions whose variance is under this share of the greatest one are rounding errors and no components.
LEAST_SHARE = 1e-10
EXACT = "decimal(38,0)"


@dataclass
class Fit:
    """n and the sums of the integer vectors, unit directions as columns with their variances, and the total variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    total: float


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the usable rows with their vectors as integers floor(SCALE c) + SHIFT.

    Dropped are rows whose vector is null, empty, or holds a null, NaN, infinite entry or one of LARGEST or more. One
    covariance needs one dimension: it is the most frequent one (of several, the greatest), and rows of others are dropped.
    """
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    usable = rows.where(F.coalesce(sound & (F.size(vector) > 0), F.lit(False))).select(key, F.transform(vector, lambda c: F.try_add(F.floor(c.cast("double") * SCALE), F.lit(SHIFT))).alias("x"))
    sizes = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return usable.where(F.size("x") == (sizes[0].d if sizes else 0))


def deviations(x: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """x with the array of n x - S, exact."""
    total = F.array(*[F.lit(str(s)).cast(EXACT) for s in sums])
    return x.withColumn("off", F.zip_with("x", total, lambda a, s: (a.cast(EXACT) * F.lit(n).cast("decimal(19,0)") - s).cast(EXACT)))


def squared(off: str = "off"):
    """The exact sum of squares of an array of deviations, null where 38 digits don't hold it."""
    return F.aggregate(off, F.lit(0).cast(EXACT), lambda total, o: F.try_add(total, F.try_multiply(o, o)).cast(EXACT))


def centred(x: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """The array x - S / n of each row as doubles, from the exact deviation and one division."""
    return deviations(x, n, sums).withColumn("c", F.transform("off", lambda o: o.cast("double") / F.lit(float(n))))


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The decomposition of all rows of x, None without rows or variance.

    computeSVD is asked for all directions, which makes it decompose the Gramian by LAPACK to double precision instead
    of iterating to a tolerance. Its singular values are those of the centred rows: their squares over n are variances.
    """
    held = sorted(x.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("v").cast(EXACT)).alias("s")).collect())
    if not held:
        return None
    n, sums = held[0].n, [int(r.s) for r in held]
    total = deviations(x, n, sums).agg(F.sum(F.aggregate("off", F.lit(0.0), lambda t, o: t + o.cast("double") * o.cast("double")))).first()[0] / n**3
    if total == 0:
        return None
    rows = MLUtils.convertVectorColumnsFromML(centred(x, n, sums).select(array_to_vector("c").alias("v")), "v")
    found = RowMatrix(rows, n, len(sums)).computeSVD(len(sums), computeU=False)
    variances = found.s.toArray() ** 2 / n
    kept = min(components, int((variances > LEAST_SHARE * variances[0]).sum()))
    return Fit(n, sums, found.V.toArray()[:, :kept], variances[:kept], total)


def whitened(x: DataFrame, by: Fit) -> DataFrame:
    """The rows of x with their deviation and the array w of whitened components."""
    turn = by.directions / np.sqrt(by.variances)
    off = centred(x, by.n, by.sums).select(*[c for c in x.columns if c != "x"], squared().try_cast("long").alias("deviation"), "c")

    def project(batches):
        for b in batches:
            w = b.column("c").flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(turn)) @ turn
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), turn.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), lists], [*b.schema.names[:-1], "w"])

    return off.mapInArrow(project, StructType([*off.schema.fields[:-1], StructField("w", ArrayType(DoubleType()))]))


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of w (centred, divisor n) minus the identity."""

    def summed(value, name):
        def add(batches):
            for b in batches:
                if len(b):
                    got = value(b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(b), components)).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got))), pa.array(got)], ["at", name])

        got = rows.select("w").mapInArrow(add, f"at long, {name} double").groupBy("at").agg(F.sum(name).alias(name)).collect()
        return np.array([r[name] for r in sorted(got)]) / n

    mean = summed(lambda w: w.sum(axis=0), "mean")
    off = summed(lambda w: (w - mean).T @ (w - mean), "cov").reshape(components, components)
    return float(np.abs(off - np.eye(components)).max())


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable row (see integers) and component.

    Fewer components come where the data have fewer directions of variance; none, and so no row, where all vectors are
    equal, where there is one row, or none. Repeated rows and null keys count and come as often as they stand. A
    deviation that 64 bits don't hold is null. Other columns are not read.
    """
    x = integers(rows.select(F.col(key), F.col(vector)), vector, key)
    by = fit(x, components)
    kind = rows.schema[key].dataType
    if by is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = whitened(x, by)
    error = identity_error(out, by.n, len(by.variances))
    share = F.array(*[F.lit(float(e / by.total)) for e in by.variances])
    each = out.select(key, "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(key, (F.col("at") + 1).cast("int").alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on their first eight whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))
