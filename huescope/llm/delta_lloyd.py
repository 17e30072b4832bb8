"""Centroid clustering by delta Lloyd: owners and sums are kept from round to round, and only what moved is counted again.

Vectors are integers, so sums, means and distances are exact. What is kept between rounds is each vector's owner and its squared distance to it, in a
written table, and each cluster's sum and count (k numbers of each component, on the driver). A round compares a vector with the centroids
that changed in the last round; a vector whose own centroid changed is compared with all, as the distance that is kept no
longer holds. A vector that changes hands is a transfer: its components with a minus from the old cluster and a plus to the new one. Transfers are summed
in tasks before a row a cluster is shuffled, and added to the kept sums; a centroid is the componentwise floor of sum by count, and one
without vectors stays. Rounds end early once no centroid changes, which changes nothing after. Each round is one pass over the table, without a shuffle of vectors;
the table before is deleted, so two are on disk at most.

Starts: the k vectors of smallest sha256 of "seed:vec_id", in that order. Ties: vectors of equal vec_id by their components, a vector at the same distance of two
centroids goes to the smaller number. Left out: vectors that are null, of another length, or hold a null, NaN or infinite component. Fewer than k vectors make as many
clusters. Components beyond what lets squared distances fit a long (some 2**27 at 64 components) are held to that bound, sums of distances to 2**63 - 1. A null vec_id is
a row like others and never a start before those that have one; repeated rows are rows of their own; columns other than vec_id and embedding are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, table

K, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
_MOST = 2**63 - 1


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the sound vectors' components as floor(scale * component)."""
    e = F.col("embedding")
    bound = math.isqrt(_MOST // dimensions) // 2
    sound = (F.size(e) == dimensions) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(e, lambda v: F.floor(F.greatest(F.lit(float(-bound)), F.least(F.lit(float(bound)), v.cast("double") * scale))).cast("int"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _assign(centroids: np.ndarray, changed: np.ndarray):
    """Each vector's owner and distance, from those it had (owner -1: none yet) and the centroids that changed."""
    k = len(centroids)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            was, distance = batch.column("owner").to_numpy(), batch.column("distance").to_numpy()
            anew = (was < 0) | changed[was]
            owner, best = np.where(anew, k, was), np.where(anew, _MOST, distance)
            for c in range(k):
                at = np.arange(len(x)) if changed[c] else np.flatnonzero(anew)
                away = x[at] - centroids[c]
                d = np.einsum("ij,ij->i", away, away)
                nearer = (d < best[at]) | ((d == best[at]) & (c < owner[at]))
                owner[at[nearer]], best[at[nearer]] = c, d[nearer]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(owner, pa.int32()), pa.array(best, pa.int64()), pa.array(was, pa.int32())], ["vec_id", "x", "owner", "distance", "was"])

    return run


def transfers(state: DataFrame, dimensions: int) -> DataFrame:
    """(cluster, n, sums): signed numbers and component sums of the vectors that changed hands, a row a cluster."""
    sides = F.array(F.struct(F.col("owner").alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")))
    moved = state.filter("owner != was").select("x", F.explode(sides).alias("side")).filter("side.cluster >= 0").select("x", "side.*")
    sums = [F.sum(F.col("x")[i].cast("long") * F.col("sign")).alias(f"s{i}") for i in range(dimensions)]
    return moved.groupBy("cluster").agg(F.sum("sign").alias("n"), *sums).select("cluster", "n", F.array(*[f"s{i}" for i in range(dimensions)]).alias("sums"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(rows: vec_id, x, owner, distance; the centroids they were assigned to)."""
    schema = "vec_id long, x array<int>, owner int, distance long, was int"
    none = F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was")
    state = table(integers(vectors, dimensions, scale).select("vec_id", "x", *none), "vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = state.select("x", first.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in starts], np.int64).reshape(len(starts), dimensions)
    sums, counts = [[0] * dimensions for _ in starts], [0] * len(starts)
    changed = np.ones(len(starts), bool)
    for n in range(rounds + 1 if len(starts) else 0):
        before, state = state, table(state.mapInArrow(_assign(centroids, changed), schema), "owners")
        drop(before)
        if n == rounds:
            break
        for r in transfers(state, dimensions).collect():  # k rows at most
            counts[r.cluster] += r.n
            sums[r.cluster] = [a + b for a, b in zip(sums[r.cluster], r.sums, strict=True)]
        means = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(len(starts))], np.int64)
        changed = (means != centroids).any(1)
        centroids = means
        if not changed.any():
            break
    return state, centroids


def cluster_digests(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each sound vector; how: as of cluster()."""
    state, centroids = cluster(vectors, **how)
    totals = {r.owner: int(r.t) for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("t")).collect()}  # k rows at most
    whole = min(_MOST, sum(totals.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    known = [(c, min(_MOST, t), whole, digest(c)) for c, t in totals.items() if c >= 0]
    clusters = state.sparkSession.createDataFrame(known, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(clusters), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """Plain Lloyd rounds, one after the other."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        away = f"CAST(list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))) AS BIGINT)"
        steps.append(f"a{n} AS MATERIALIZED (SELECT * FROM (SELECT v.r, v.vec_id, v.x, k.c, {away} AS d FROM v CROSS JOIN c{n} k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN (SELECT c, list({mean} ORDER BY i) AS x FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{n} CROSS JOIN range(1, {dimensions + 1}) t(i) GROUP BY c, i) GROUP BY c) m USING (c))")
    last = f"SELECT a.vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"
    return "WITH " + ",\n".join(steps) + "\n" + last
