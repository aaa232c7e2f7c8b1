"""Searches and joins by cells against all pairs, on random and on clustered vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightframe.operators import similarity as V
from lightframe.operators import vectors as X


def vectors(kind: str, n: int = 600, d: int = 16) -> np.ndarray:
    g = np.random.default_rng(5)
    if kind == "random":
        x = g.normal(size=(n, d))
    else:
        x = g.normal(size=(12, d))[g.integers(0, 12, n)] * 5 + g.normal(size=(n, d)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "copies":
        x[: n // 3] = x[7]
    return x


def frame(spark, x, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_joins_match_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(V, "CHUNK_ROWS", 50)
    monkeypatch.setattr(V, "STREAM_ROWS", 200)
    x = vectors(kind)
    odd = [(9001, None), (9002, [1.0, 2.0]), (9003, [None] * 16), (9004, [float("nan")] * 16), (None, [1.0] * 16)]
    df = frame(spark, x, odd)
    s = x @ x.T
    least = 0.6
    got = {(r["a"], r["b"]): r["score"] for r in V.similar_pairs(df, least=least).collect()}
    want = {(int(i), int(j)): s[i, j] for i, j in zip(*np.nonzero(s >= least), strict=True) if i < j}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    mates = {r["a"]: r["b"] for r in V.best_mates(df, found=least).collect()}
    np.fill_diagonal(s, -np.inf)
    best = {i: int(np.flatnonzero(s[i] > s[i].max() - 1e-12)[0]) for i in range(len(x)) if s[i].max() > least}
    assert mates == best
    assert {(r["a"], r["b"]) for r in X.loose_mates(df, found=least).collect()} == {(i, j) for i, j in best.items() if i < j and best.get(j) == i}


def test_cells_are_skipped(spark):
    """On clustered vectors most cells can't hold a partner, and a search reads few of them."""
    x = vectors("clustered", n=2000)
    placed, cells = V._in_cells(frame(spark, x), "vec_id", "embedding")
    assert len(cells.centroids) == 45 and int(cells.rows.sum()) == 2000
    asked = V.probes(placed, cells, 0.8).count()
    assert asked < 0.4 * 2000 * len(cells.centroids)
    q = x[:40]
    index = V.VectorIndex("", cells, "bigint")
    assert index.plan(q, 20, 0.5).sum() < 0.15 * q.shape[0] * len(cells.centroids)
    assert (cells.bounds(q) < 0.5).mean() > 0.5


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_index_finds_what_a_scan_finds(spark, kind, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    x = vectors(kind) * (1 + np.arange(600)[:, None] % 3)  # not of length one
    df = frame(spark, x, [(9001, None), (9002, [1.0])])
    V.VectorIndex.write(df, f"file://{tmp_path}/index")
    index = V.VectorIndex.read(spark, f"file://{tmp_path}/index")
    asked = df.where("vec_id % 15 = 0")
    for k, least in ((7, -5.0), (400, 0.3), (1000, -100.0)):
        got = sorted(tuple(r) for r in index.search(asked, k=k, least=least).collect())
        want = sorted(tuple(r) for r in X.search_all(df.where("vec_id < 9000"), asked, k=k, least=least).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert index.search(asked.limit(0)).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert V.similar_pairs(df, least=0.5).count() == 0 and V.best_mates(df, found=0.5).count() == 0
    assert X.merge_suggestions(spark.createDataFrame([], "id long, named boolean, n long, centroid array<double>"), spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(ValueError):
        V.VectorIndex.write(df, "file:///tmp/none")
    far = frame(spark, vectors("random", 50)).withColumn("score", F.lit(1))
    assert V.similar_pairs(far, least=2.0).count() == 0


def test_rows_meet_strips_not_cells(spark, monkeypatch):
    """Where nothing can be skipped a row is copied once a strip, of bounded rows; a large cell has several strips."""
    x = vectors("random", n=2000)
    placed, cells = V._in_cells(frame(spark, x), "vec_id", "embedding")
    order, begins = V._strips(cells)
    assert len(cells.centroids) == 45 and len(begins) == 1
    assert V._asked(placed, cells, -2.0, order, begins).count() == 2000
    monkeypatch.setattr(V, "CHUNK_ROWS", 30)
    order, begins = V._strips(cells)
    rows = cells.rows[order]
    for strip, begin in enumerate(begins):
        later = begins[begins > begin]
        held = rows[begin : later[0] if len(later) else len(rows)].sum()
        assert held <= 30 * max(1, (begins == begin).sum()), strip
    assert V._asked(placed, cells, -2.0, order, begins).groupBy("key").count().where(f"count != {len(begins)}").count() == 0


@pytest.mark.parametrize("other", [False, True])
def test_search_all_is_a_scan(spark, monkeypatch, other):
    """Strips of queries and streams of rows give the best by product, ties by key, in exact sums."""
    for name, n in (("QUERY_ROWS", 16), ("STREAM_ROWS", 150), ("PIECE_ROWS", 32), ("HELD_SCORES", 100)):
        monkeypatch.setattr(X, name, n)
    x = vectors("copies")
    df = frame(spark, x, [(9001, None), (9002, [1.0, 2.0]), (9003, [None] * 16), (9004, [float("nan")] * 16)])
    got = X.search_all(df, df.where("vec_id % 15 = 0 or vec_id = 9002"), k=9, least=0.1, other=other)
    a, b = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), df
    pairs = a.where("query_id % 15 = 0 or query_id = 9002").crossJoin(b).where("query_id != vec_id" if other else "true")
    pairs = pairs.select("query_id", "vec_id", X.dot(F.col("embedding"), F.col("q")).alias("score")).where("score >= 0.1")
    want = X.top_per_key(pairs, "query_id", k=9, order=[F.col("score").desc(), F.col("vec_id")]).select("query_id", "vec_id", "score")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()
