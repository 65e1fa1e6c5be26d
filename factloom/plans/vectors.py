"""Queries over a vector index of `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import vectors
from factloom.plans.catalog import query, table
from factloom.sources.shared import folder

_HEX = f"sha1(unhex('{vectors.NAMESPACE}') || encode(CAST(vec_id AS VARCHAR)))"


def made(spark, sf_dir):
    return vectors.points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.concat(F.lit("label-"), "label"), F.lit("load-1"))


@query(
    "s16_index_points",
    f"""SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS point_id, vec_id,
    'label-' || label AS payload, CASE WHEN label = 0 THEN 'load-2' ELSE 'load-1' END AS effect_key FROM (SELECT *, {_HEX} AS h FROM embeddings)""",
)
def s16_index_points(spark, sf_dir):
    """What the index holds after all vectors were put in and those of one label once more."""
    all_points, path = made(spark, sf_dir), folder(spark, "index")
    cells = vectors.centres(all_points)
    vectors.upsert(all_points, path, cells)
    vectors.upsert(all_points.where("payload = 'label-0'").withColumn("effect_key", F.lit("load-2")), path, cells)
    return vectors.read(spark, path).select("point_id", "vec_id", "payload", "effect_key")


@query("s16_vector_search")
def s16_vector_search(spark, sf_dir):
    """Ten neighbours of every vector whose id divides by 20, among all vectors, from the index."""
    all_points, path = made(spark, sf_dir), folder(spark, "index")
    cells = vectors.centres(all_points)
    vectors.upsert(all_points, path, cells)
    asked = all_points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return vectors.search(vectors.read(spark, path), asked, cells)
