"""Vectors of several lengths, and graphs in files, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from steadfield.llm import hnsw


def test_vectors_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 150)
    monkeypatch.setattr(hnsw, "GROUP_SHARDS", 2)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(4)
    rows = {i: rng.standard_normal(dim) * (1000.0 if i % 9 == 0 else 1.0) for i, dim in enumerate(rng.choice([3, 8, 8, 8, 12], 1200))}
    rows[2000] = rng.standard_normal(5)  # the only one of its length
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, v array<double>").repartition(3)
    queries = df.filter((F.col("vec_id") % 20 == 0)).withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in sorted(hnsw.nearest(df, queries).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    hit = total = 0
    for q, v in rows.items():
        if q % 20 == 0:
            near = sorted(((-float(v @ w), i) for i, w in rows.items() if len(w) == len(v) and i != q))[:20]
            assert len(got.get(q, [])) == len(near)
            hit += len({i for _, i in near} & {i for i, _ in got.get(q, [])})
            total += len(near)
            assert all(abs(s - float(v @ rows[i])) <= 1e-9 * max(1, abs(s)) for i, s in got.get(q, []))
    assert hit >= 0.97 * total
    assert 2000 not in got


def test_recall_of_a_full_shard():
    """Unit vectors without any order: one shard as full as shards are."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((hnsw.SHARD_ROWS, 64))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    unit = v / np.sqrt((v * v).sum(axis=1)).max()
    points = np.concatenate((unit, np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))[:, None]), axis=1).astype(np.float32)
    asked = v[::80] / np.sqrt((v[::80] ** 2).sum(axis=1))[:, None]
    found, _ = hnsw.Graph.build(points).search(np.concatenate((asked, np.zeros((len(asked), 1))), axis=1).astype(np.float32), hnsw.SEARCH_BEAM)
    score = asked @ v.T
    hit = sum(len(set(np.argsort(-s)[:20].tolist()) & set(f.tolist())) for s, f in zip(score, found))
    assert hit >= 0.92 * 20 * len(asked), hit / 20 / len(asked)
