"""The vector index: ids, upserts that move points between lists, recall against brute force."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import vectors

SCHEMA = "id long, v array<float>, p string"


def table(spark, rows):
    return vectors.points(spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], p) for i, v, p in rows], SCHEMA), "id", "v", F.col("p"), F.lit("e"))


def test_point_ids(spark):
    got = spark.createDataFrame([("1",), ("ku_ä",), ("",)], "k string").select("k", vectors.point_id(F.col("k")).alias("id"))
    assert all(r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, r.k)) for r in got.collect())


def test_unusable_vectors_and_repeated_keys(spark):
    got = table(spark, [(1, [3, 4], "a"), (1, [1, 0], "b"), (2, None, "x"), (3, [], "x"), (4, [0, 0], "x"), (5, [1, None], "x"), (6, [float("nan"), 1], "x"), (7, [float("inf"), 1], "x"), (None, [1, 1], "x")]).collect()
    assert [(r.vec_id, r.vector, r.payload) for r in got] == [(1, [1.0, 0.0], "b")]


def test_upserts(spark, tmp_path):
    """Points move from list to list, a list runs empty, and a repeated upsert changes nothing."""
    path, cells = str(tmp_path / "index"), np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    held = lambda: sorted((r.vec_id, r.payload, r.list) for r in vectors.read(spark, path).collect())
    vectors.upsert(table(spark, [(1, [1, 0], "a"), (2, [1, 0.1], "a"), (3, [0, 1], "a"), (4, [-1, 0], "a")]), path, cells)
    assert held() == [(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, "a", 2)]
    change = table(spark, [(4, [0, 1], "b"), (2, [1, 0], "b"), (5, [0, 1], "b")])
    for _ in range(2):
        vectors.upsert(change, path, cells)
        assert held() == [(1, "a", 0), (2, "b", 0), (3, "a", 1), (4, "b", 1), (5, "b", 1)]
    vectors.upsert(table(spark, [(4, [-1, 0], "c")]), path, cells)
    assert held() == [(1, "a", 0), (2, "b", 0), (3, "a", 1), (4, "c", 2), (5, "b", 1)]


def test_search(spark, tmp_path):
    """Exact with all lists; nine in ten neighbours and more with the usual probes, of vectors without any clusters."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    made, path = table(spark, [(i, x, "p") for i, x in enumerate(v)]), str(tmp_path / "index")
    cells = vectors.centres(made)
    vectors.upsert(made, path, cells)
    asked = made.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    best = {i: list(np.lexsort((np.arange(1500), -(v @ v[i])))[:10]) for i in range(0, 1500, 20)}
    for probes, least in ((len(cells), 0.999), (vectors.PROBES, 0.9)):
        got = {}
        for r in vectors.search(vectors.read(spark, path), asked, cells, probes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got.keys() == best.keys() and all(g[0] == q and len(g) == 10 for q, g in got.items())
        assert np.mean([len(set(got[q]) & set(best[q])) / 10 for q in best]) >= least


def test_search_in_small_blocks(spark, tmp_path, monkeypatch):
    """Blocks of few rows give what one block gives, and many equal vectors go by their ids."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 8))
    v[40:140] = v[7]
    made, path = table(spark, [(i, x, "p") for i, x in enumerate(v)]), str(tmp_path / "index")
    cells = vectors.centres(made, 3)
    vectors.upsert(made, path, cells)
    asked = made.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = []
    for block in (65_536, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got.append(sorted(map(tuple, vectors.search(vectors.read(spark, path), asked, cells, 3).collect())))
    assert got[0] == got[1] and len(got[0]) == 150
    assert [r[2] for r in got[0] if r[0] == 60] == [7, *range(40, 49)]
