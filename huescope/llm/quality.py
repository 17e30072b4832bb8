"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens are runs of letters, digits and bytes beyond ASCII, and runs of other visible ASCII; a text's n-grams (one and two
tokens; a token after itself counts as such, whichever it is; the forms of two neighbours - letters or marks, begun and
ended in a capital or not) fall in BUCKETS buckets. The raw model counts those of all documents, the target model those of documents labelled
good; labels are a bounded sample: at most SAMPLE of each quality, the least by hash, every other one to fit the
target and the rest to calibrate. A document's log weight is the mean of log(target / raw) over its n-grams times SCALE: what a
text of SCALE such n-grams would weigh, so long and short texts are compared alike. Divided by a temperature (1 unless the caller names
another) it is the log of the odds to be drawn: the higher, the more the draw decides. The caller may name k; else it is the number of documents whose weight is at least the
calibrated threshold, the one at which the held-back labels show the least sum of error rates; the k greatest sums of log weight and Gumbel
noise stay. The noise is a hash of doc_id and text: reruns agree. The k-th greatest is found by histograms of counts, not by a sort.

Nulls: a null or empty text weighs 0, as much as one that tells nothing; null doc_ids have no label; labels that are null are
left out, contradicting ones count as bad. Rows that tie with the k-th all stay (repeated rows do), so equal rows are
treated alike. Without labels of both kinds nothing is rejected, and an empty table gives no rows. Very long texts are weighed whole. Other columns, whatever
their names, are carried along or left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, whole_row
from .spans import SPACE, chunks, lean, mix, span_hashes

BUCKETS, SAMPLE, SCALE, SMOOTH = 10_000, 20_000, 100.0, 1.0
_KIND = np.full(256, 2, np.uint8)  # 0 white space and controls, 1 letters, 2 marks
_KIND[[b for b in range(256) if b > 127 or chr(b).isalnum()]] = 1
_KIND[SPACE] = 0
_KIND[:32] = 0
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams and the rows they are of."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edge = np.flatnonzero(change)
    starts, ends = edge[:-1], edge[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    h = span_hashes(data, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    pair = row[1:] == row[:-1]
    first, second = h[:-1][pair], h[1:][pair]
    two = np.where(first == second, _AGAIN, mix(first * np.uint64(3) + second, 5))
    form = kind[starts] * 4 + _UPPER[data[starts]] * 2 + _UPPER[data[ends - 1]]
    forms = mix(form[:-1][pair].astype(np.uint64) * np.uint64(16) + form[1:][pair], 6)
    after = row[1:][pair]
    return (np.concatenate([h, two, forms]) % np.uint64(buckets)).astype(np.int64), np.concatenate([row, after, after])


def _count(buckets: int):
    @lean
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = batch.column("fit").to_numpy(zero_copy_only=False) == 1
            for a, b, data, offsets in chunks(batch.column("text")):
                found, row = ngrams(data, offsets, buckets)
                total[0] += np.bincount(found, minlength=buckets)
                total[1] += np.bincount(found[good[a:b][row]], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "target"])

    return run


def weights(ratio: np.ndarray, column: pa.Array) -> np.ndarray:
    """The log weight of each text."""
    out = np.zeros(len(column))
    for a, b, data, offsets in chunks(column):
        found, row = ngrams(data, offsets, len(ratio))
        n = np.bincount(row, minlength=b - a)
        out[a:b] = np.bincount(row, ratio[found], minlength=b - a) / np.maximum(n, 1) * SCALE
    return out


def gumbel(seeds: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise from 64-bit seeds."""
    u = ((mix(seeds.view(np.uint64), 77) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _keys(w: np.ndarray, seeds: np.ndarray, temperature: float) -> np.ndarray:
    return w / temperature + gumbel(seeds)


def _score(ratio: np.ndarray, temperature: float):
    @lean
    def run(batches):
        for batch in batches:
            w = weights(ratio, batch.column("text"))
            key = _keys(w, batch.column("seed").to_numpy(), temperature)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), pa.array(w), pa.array(key)], ["doc_id", "held", "score", "key"])

    return run


def _choose(ratio: np.ndarray, least: float, temperature: float):
    @lean
    def run(batches):
        for batch in batches:
            rows = batch.column("row")
            key = _keys(weights(ratio, rows.field("text")), batch.column("seed").to_numpy(), temperature)
            yield pa.RecordBatch.from_struct_array(rows).filter(pa.array(key >= least))

    return run


def kth_greatest(df: DataFrame, value: str, k: int) -> float:
    """The k-th greatest value, exactly, by narrowing histograms."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    while lo < hi:
        width = (hi - lo) / 1000
        if width == 0.0:
            width = 5e-324
        place = F.floor((F.col(value) - F.lit(lo)) / F.lit(width))
        inside = df.filter((F.col(value) >= F.lit(lo)) & (F.col(value) <= F.lit(hi)))
        for r in inside.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).orderBy(F.desc("p")).collect():
            if k <= r["n"]:
                lo, hi = r["a"], r["b"]
                break
            k -= r["n"]
    return lo


def _seed():
    return F.xxhash64("doc_id", "text")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, k: int | None = None, temperature: float = 1.0):
    """(scored: doc_id, held, score, key; log ratios; the k-th greatest key). k: None for the calibrated number; 0 keeps nothing, more than there are rows all."""
    if temperature <= 0 or (k is not None and k < 0):
        raise ValueError("the temperature must be above 0, k not below 0")
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    order = F.xxhash64("doc_id")
    some = known.filter("q = 1").orderBy(order).limit(sample).union(known.filter("q = 0").orderBy(order).limit(sample))  # bounded by the parameter
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    some = some.select(F.col("doc_id").alias("_id"), F.when(half, F.col("q")).alias("fit"), F.when(~half, F.col("q")).alias("held"))
    texts = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left")
    counted = texts.select("text", F.coalesce("fit", F.lit(0)).cast("int").alias("fit")).mapInArrow(_count(buckets), "bucket long, raw long, target long")
    counts = np.zeros((2, buckets))
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # buckets at most
        counts[:, r["bucket"]] = r["raw"], r["target"]
    model = np.log(counts + SMOOTH) - np.log(counts.sum(1, keepdims=True) + SMOOTH * buckets)
    ratio = model[1] - model[0] if counts[1].any() else np.zeros(buckets)
    scored = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("held").cast("int").alias("held"), _seed().alias("seed"))
    scored = table(scored.mapInArrow(_score(ratio, temperature), "doc_id long, held int, score double, key double"), "scored")
    if k is None:
        k = scored.filter(F.col("score") >= F.lit(_threshold(scored) if counts[1].any() else -math.inf)).count()
    elif k:
        k = min(k, scored.count())
    return scored, ratio, kth_greatest(scored, "key", k) if k else math.inf


def _threshold(scored: DataFrame) -> float:
    """The log weight at which the held-back labels show the least sum of error rates; without such of both kinds none is too small."""
    binned = scored.filter("held is not null").groupBy(F.round("score", 1).alias("s")).agg(F.sum(1 - F.col("held")).alias("bad"), F.sum("held").alias("good"))
    rows = sorted((r["s"], r["bad"], r["good"]) for r in binned.collect())  # weights lie within SCALE times the log of the counts
    bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
    threshold = -math.inf
    if bad and good:
        passed, lost, best = bad, 0, math.inf
        for i, (s, x, y) in enumerate(rows):
            error = passed / bad + lost / good  # rows from s on stay
            if error < best - 1e-12:
                best, threshold = error, (s + rows[i - 1][0]) / 2 if i else -math.inf
            passed, lost = passed - x, lost + y
    return threshold


def judge(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0) -> DataFrame:
    """doc_id, score (log weight), key (with Gumbel noise), kept: a row for each row of docs."""
    scored, _, least = fit(docs, labels, k=k, temperature=temperature)
    return scored.select("doc_id", "score", "key", (F.col("key") >= F.lit(least)).alias("kept"))


def choose(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0) -> DataFrame:
    """The rows of docs that judge() keeps, in one more pass over the texts, without a shuffle."""
    _, ratio, least = fit(docs, labels, k=k, temperature=temperature)
    return docs.select(whole_row(docs), _seed().alias("seed")).mapInArrow(_choose(ratio, least, temperature), docs.schema)
