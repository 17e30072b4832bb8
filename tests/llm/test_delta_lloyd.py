"""Delta Lloyd against plain Lloyd in Python and SQL."""

import glob
import hashlib
import os

import duckdb
import numpy as np

from huescope.llm import delta_lloyd, queries

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int, owner string"


def plain(rows, k, rounds, dimensions, scale=1024, seed=3):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    for n in range(rounds + 1):
        owner = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, o) in zip(kept, owner, strict=True) if o == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    of = lambda j: sum(d for d, o in owner if o == j)
    return sorted(((i, o, d, of(o), sum(d for d, _ in owner), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(kept, owner, strict=True)), key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_query_against_sql_and_plain_rounds(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = queries.QUERIES["op11_centroid_clustering"](spark, SF)
    rel = con.sql(queries.sql()["op11_centroid_clustering"])
    assert rel.columns == frame.columns
    rows = got(frame)
    assert rows == sorted(rel.fetchall(), key=repr)
    assert rows == plain([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], 8, 10, 64)


def test_rounds_that_change_few_centroids(spark, monkeypatch):
    """Owners, sums and centroids as by plain rounds while some centroids stand still and others move."""
    rng = np.random.default_rng(7)
    spots = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.01, 60), (5, 0.01, 60), (20, 2.0, 80))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(spots)]
    seen, own = [], delta_lloyd._assign
    monkeypatch.setattr(delta_lloyd, "_assign", lambda c, changed: seen.append(int(changed.sum())) or own(c, changed))
    frame = spark.createDataFrame([(i, v, 0, "") for i, v in rows], ROWS)
    for rounds in (0, 1, 4, 10):
        assert got(delta_lloyd.cluster_digests(frame, k=6, rounds=rounds, dimensions=3)) == plain(rows, 6, rounds, 3)
    assert any(0 < n < 6 for n in seen)


def test_odd_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, None), (2, []), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, good), (7, good), (7, [9.0, 9.0]), (None, [1.0, 1.0]), (8, [3e38, -3e38]), (9, [-0.0004, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], ROWS)
    out = got(delta_lloyd.cluster_digests(frame, k=3, dimensions=2))
    assert sorted((r[0] is None, r[0] or 0) for r in out) == [(False, 7), (False, 7), (False, 7), (False, 8), (False, 9), (True, 0)]
    usual = [(i, v) for i, v in rows if i != 8]
    assert got(delta_lloyd.cluster_digests(frame.filter("vec_id is null or vec_id != 8"), k=3, dimensions=2)) == plain(usual, 3, 10, 2)
    assert got(delta_lloyd.cluster_digests(frame.filter("vec_id = 9"), k=3, dimensions=2)) == plain([(9, [-0.0004, 0.0])], 3, 10, 2)
    assert delta_lloyd.cluster_digests(frame.limit(0)).collect() == []
