"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

Vectors of equal label and components are one class, so copies are never paired. Rotations are learned on a sample
of at most SAMPLE classes (the least by hash): principal directions, then alternating between the nearest binary code
and the best rotation, which balances the bits. Several rotations from different starts give as many bits
as the tables need. A table is a run of bits; its length is the logarithm of the number of classes, so buckets stay
small at any size, and the number of tables follows from it: two vectors at the threshold differ in a bit with
probability angle/pi, the angle being that of the coded vectors (centred, and within the principal directions), which is wider than the threshold's where vectors
have a common direction; it is taken from vectors of the sample and others made at the threshold from them, so that on average they share no table
with probability MISS. If centring would take more than MOST_TABLES tables, vectors are coded as they are, should that take fewer. All vectors are indexed. Tables go
in runs of RUN; within one, two classes are compared in the first table that they share only, hence once, by cosine in double precision on the vectors themselves.

Left alone (n_links 0, component_id = vec_id, kept): vectors that are null, empty or zero or hold a null, NaN or infinite
component, and those without label. Vectors of different lengths are not compared. A null vec_id
is a row of its own; repeated rows are copies. Columns other than the three are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import table

COSINE, SAMPLE, MISS, ROUNDS = 0.93, 20_000, 0.01, 30
MOST_TABLES, RUN, PROBES = 500, 32, 2_000


def principal(x: np.ndarray) -> np.ndarray:
    """The directions of the greatest variance, 64 at most, as columns."""
    values, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, np.argsort(values)[::-1][:64]]


def rotations(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 10, mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): codes are the signs of (unit vector - mean) @ directions, `bits` of them; another point can be given as the mean."""
    mean = x.mean(0) if mean is None else mean
    x = x - mean
    main = principal(x)
    v = x @ main
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((v.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(main @ r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def agreement(x: np.ndarray, mean: np.ndarray, cosine: float, seed: int = 11) -> np.ndarray:
    """(2, n): the probabilities that a bit is equal for vectors of x and others at the threshold, off in directions in which x varies and in any ones."""
    main, rng = principal(x - mean), np.random.default_rng(seed)
    own = x[:PROBES]
    off = np.stack([x[rng.integers(len(x), size=len(own))] - x[rng.integers(len(x), size=len(own))], rng.standard_normal(own.shape)])
    off -= (off * own).sum(2, keepdims=True) * own
    off /= np.maximum(np.linalg.norm(off, axis=2, keepdims=True), 1e-12)
    a, b = (own - mean) @ main, (cosine * own + math.sqrt(max(0.0, 1 - cosine * cosine)) * off - mean) @ main
    angle = (a * b).sum(2) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=2), 1e-12)
    return 1 - np.arccos(np.clip(angle, -1, 1)) / math.pi


def plan(n: int, cosine: float, miss: float = MISS, same: np.ndarray | None = None) -> tuple[int, int]:
    """(bits of a table, tables) for n vectors; same: how likely bits agree at the threshold (agreement()), if not as by its angle."""
    length = min(60, max(8, math.ceil(math.log2(max(n, 2)))))
    by_angle = np.full((1, 1), 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi)
    met = np.minimum((by_angle if same is None else np.minimum(same, by_angle)) ** length, 1 - 1e-9)
    missed = lambda tables: np.exp(tables * np.log1p(-met)).mean(1).max()
    low, high = 0, 1
    while missed(high) > miss * (1 + 1e-9) and high < 1 << 40:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > miss * (1 + 1e-9) else (low, mid)
    return length, high


def _unit(batch_column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a list column, with zeros up to width."""
    if not len(batch_column):
        return np.zeros((0, width))
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(batch_column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _codes(mean: np.ndarray, directions: np.ndarray, length: int):
    weights = (np.uint64(1) << np.arange(length, dtype=np.uint64))[None, None, :]
    size = max(1, (1 << 22) // directions.shape[1])

    def run(batches):
        for batch in batches:
            x = _unit(batch.column("vec"), len(mean)) - mean
            key = np.zeros((len(x), directions.shape[1] // length), np.int64)
            for a in range(0, len(x), size):
                bit = x[a : a + size] @ directions >= 0
                key[a : a + size] = (bit.reshape(len(bit), key.shape[1], length) * weights).sum(2, dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * key.shape[1]), pa.array(key.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("d"), lists], ["node", "label", "d", "keys"])

    return run


def _close(cosine: float):
    def run(batches):
        for batch in batches:
            width = int(np.diff(batch.column("x").offsets.to_numpy()).max(initial=1))
            dot = (_unit(batch.column("x"), width) * _unit(batch.column("y"), width)).sum(1)
            ok = pa.array(dot >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return run


def close_pairs(classes: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, miss: float = MISS) -> DataFrame:
    """(a, b), a < b: pairs of nodes of equal label with cosine or more. classes: node, label, d (length), vec."""
    n = classes.count()
    if n < 2:
        return classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    width = classes.agg(F.max("d")).first()[0]
    fit = classes.select("vec").orderBy(F.xxhash64("vec")).limit(sample).toArrow().column("vec").combine_chunks()
    unit = _unit(fit, width)
    mean = unit.mean(0)
    length, tables = plan(n, cosine, miss, agreement(unit, mean, cosine))
    if tables > MOST_TABLES:
        _, other = plan(n, cosine, miss, agreement(unit, 0 * mean, cosine))
        mean, tables = (0 * mean, other) if other < tables else (mean, tables)
    mean, directions = rotations(unit, length * tables, mean=mean)
    kind = classes.schema["label"].dataType.simpleString()
    coded = table(classes.select("node", "label", "d", "vec").mapInArrow(_codes(mean, directions, length), f"node long, label {kind}, d int, keys array<long>"), "codes")
    runs = F.array(*[F.slice("keys", i + 1, RUN) for i in range(0, tables, RUN)])
    coded = coded.select("node", "label", "d", F.posexplode(runs).alias("run", "keys"))
    x = coded.select("node", "label", "d", "run", "keys", F.posexplode("keys").alias("place", "key"))
    y = x.select(F.col("node").alias("other"), "label", "d", "run", F.col("keys").alias("others"), "place", "key")
    first = F.array_position(F.zip_with("keys", "others", lambda p, q: p == q), True) == F.col("place") + 1
    met = x.join(y, ["label", "d", "run", "place", "key"]).filter("node < other").filter(first).select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = table(met.distinct() if tables > RUN else met, "pairs")
    vec = classes.select(F.col("node").alias("a"), F.col("vec").alias("x"))
    met = pairs.join(vec, "a").join(vec.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")
    return met.mapInArrow(_close(cosine), "a long, b long")


def near_embeddings(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    sound = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.col("label")).alias("label"), e.alias("vec"))
    same = rows.filter("label is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = table(same.withColumns({"node": F.monotonically_increasing_id(), "d": F.size("vec")}), "vectors")
    links = table(close_pairs(classes, cosine, sample, miss), "links")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    copies = classes.select(F.col("node").alias("other"), "copies")
    degree = both.join(copies, "other").groupBy("node").agg(F.sum("copies").alias("links"))
    rooted = classes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(ids, "root").join(degree, "node", "left").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(known, ["label", "vec"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
