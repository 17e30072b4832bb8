"""k-means of all images at once: rounds over a table (image, k) of centroids and blocks of the images' colours.

Colours are (ref, image_id, rank, c, cnt, colours): an image's or, where ref, those of the gap statistic's reference; `colours` is how many the image has.
Images of more than BLOCK colours are cut into blocks once. A round joins the blocks with the centroids of each (image, k) that still moves; tasks sum up each
cluster's channels by block, the sums of an image's blocks are added after one shuffle, and their rounded means are the next centroids, in a written table.
What no longer changes leaves. A last pass finds the medoids and errors. Where one block is all of an image, nothing from elsewhere is needed, so its task
goes through all rounds of all its k side by side. No row is larger than a block and its centroids.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, spaces
from ..sources.tables import dealt, drop, written

BLOCK, BESIDE = 4096, 1 << 22  # colours a block; distances of an image's k that go side by side
KEYS = ["ref", "image_id"]
_ALL = 1 << 30
_SUMS = "array<struct<w:bigint,x:bigint,y:bigint,z:bigint>>"
_STATS = "array<struct<w:bigint,e:double,best:struct<d:double,rank:int,c:int>>>"
_FITS = "ref boolean, image_id long, k int, error double, centroids array<struct<c:int,cnt:bigint>>"


def seeds(colours: Column, most: Column, space: str) -> Column:
    """Of an array of colours the first `most` that are each at least epsilon from those before, as an array."""
    far = lambda kept, c: F.forall(kept, lambda s: spaces.distance(c, s, space) >= spaces.of(space).epsilon)
    return F.aggregate(colours, F.array().cast("array<int>"), lambda kept, c: F.when((F.size(kept) < most) & far(kept, c), F.concat(kept, F.array(c))).otherwise(kept))


def blocks(colours: DataFrame, *more: str) -> DataFrame:
    """(ref, image_id, block, c, cnt, *more): arrays of at most BLOCK colours, by rank."""
    at = F.floor((F.col("rank") - 1) / BLOCK).cast("int")
    fields = ["c", "cnt", *more]
    rows = colours.groupBy(*KEYS, at.alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("v"))
    return rows.select(*KEYS, "block", *[F.col(f"v.{x}").alias(x) for x in fields])


def structs(columns: list[pa.Array], names: list[str], sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays(columns, names))


def _means(weighed: np.ndarray, mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, 4) weights and channel sums of rows of these, whole numbers, and the packed means; without weight 0."""
    sums = np.stack([np.bincount(mine, w, k) for w in weighed], 1).astype(np.int64)
    w = sums[:, :1]
    return sums, arrays.pack(np.where(w > 0, np.floor(sums[:, 1:] / np.maximum(w, 1) + 0.499999999), 0))


def _step(measure: arrays.Measure):
    """Each block's sums by cluster."""

    def run(batches):
        for batch in batches:
            out, sizes = [], []
            for i in range(batch.num_rows):
                c, cnt, now = (batch.column(x)[i].values.to_numpy() for x in ("c", "cnt", "now"))
                weighed = np.stack([cnt, *(arrays.channels(c) * cnt[:, None]).T])
                out.append(_means(weighed, arrays.nearest(c, now, measure)[0], len(now))[0])
                sizes.append(len(now))
            flat = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
            columns = [*(batch.column(x) for x in (*KEYS, "k", "now", "left")), structs([pa.array(flat[:, j]) for j in range(4)], list("wxyz"), sizes)]
            yield pa.RecordBatch.from_arrays(columns, [*KEYS, "k", "prev", "left", "sums"])

    return run


def _rounds(c: np.ndarray, cnt: np.ndarray, starts: list[np.ndarray], measure: arrays.Measure, rounds: int, room: arrays.Room):
    """Lloyd's rounds from several starts side by side, on colours that are a whole image: for each its last centroids, and the place of each colour in those before.

    A round follows from the centroids alone: where a run comes to centroids that it has had, all further ones repeat, so it goes through the last of them only.
    """
    near = arrays.Nearest(c, measure, room)
    weighed = np.tile(np.stack([cnt, *(arrays.channels(c) * cnt[:, None]).T]).astype(float), len(starts))
    runs, sizes = np.arange(len(starts)), np.array([len(s) for s in starts])
    now, left = np.concatenate(starts).astype(np.int64), np.full(len(starts), rounds)
    had: list[dict[bytes, int]] = [{} for _ in starts]
    out: list = [None] * len(starts)
    while len(runs):
        first = np.cumsum(sizes) - sizes
        mine = near.places(now, sizes)
        used = now
        now = np.where(np.repeat(left > 0, sizes), _means(weighed[:, : mine.size], mine.ravel(), len(now))[1], used)
        left = left - 1
        moved = np.logical_or.reduceat(now != used, first)
        for j in np.flatnonzero(moved & (left > 0)):
            before = had[runs[j]].setdefault(now[first[j] : first[j] + sizes[j]].tobytes(), int(left[j]))
            if before > left[j]:
                left[j] %= before - left[j]
        still = moved & (left > 0)
        for j in np.flatnonzero(~still):
            out[runs[j]] = now[first[j] : first[j] + sizes[j]], mine[j] - first[j]
        if not still.all():
            stay = np.repeat(still, sizes)
            near.keep(stay)
            runs, now, left, sizes = runs[still], now[stay], left[still], sizes[still]
    return out


def _medoids(c: np.ndarray, cnt: np.ndarray, now: np.ndarray, mine: np.ndarray, measure: arrays.Measure) -> tuple[float, dict[int, int]]:
    """The mean squared distance to the means, and the medoids with their clusters' counts, as as_map() has them."""
    own = arrays.apart(c, now[mine], measure)
    w, e = (np.bincount(mine, x, len(now)).tolist() for x in (cnt, own * own * cnt))
    best, order = now.copy(), np.argsort(own, kind="stable")[::-1]
    best[mine[order]] = c[order]  # of a cluster's members the nearest is written last, ties by rank
    whole = sum(w)
    return sum(e) / whole if whole > 0 else float("nan"), {m: int(n) for m, n in zip(best.tolist(), w, strict=True)}


def _alone(measure: arrays.Measure, epsilon: float, rounds: int):
    """All of k-means for images of one block: seeds, rounds, medoids and errors, for each of ks."""

    def image(c: np.ndarray, cnt: np.ndarray, ks: list[int], room: arrays.Room) -> list[tuple[float, dict[int, int]]]:
        found = arrays.seeds(c, _ALL if min(ks) <= 0 else max(ks), measure, epsilon)
        sizes = [len(found) if k <= 0 else min(k, len(found)) for k in ks]
        fitted, todo = {}, sorted(set(sizes))
        while todo:
            some = [todo.pop(0)]
            while todo and (sum(some) + todo[0]) * len(c) <= BESIDE:
                some.append(todo.pop(0))
            for n, (now, mine) in zip(some, _rounds(c, cnt, [found[:n] for n in some], measure, rounds, room), strict=True):
                fitted[n] = _medoids(c, cnt, now, mine, measure)
        return [fitted[n] for n in sizes]

    def run(batches):
        room = arrays.Room()
        for batch in batches:
            at, ks, errors, sizes, cs, cnts = [], [], [], [], [], []
            for i in range(batch.num_rows):
                c, cnt, asked = (batch.column(x)[i].values.to_numpy() for x in ("c", "cnt", "ks"))
                for k, (error, pairs) in zip(asked.tolist(), image(c.astype(np.int64), cnt, asked.tolist(), room), strict=True):
                    at.append(i)
                    ks.append(k)
                    errors.append(error)
                    sizes.append(len(pairs))
                    cs += pairs.keys()
                    cnts += pairs.values()
            keys = [batch.column(x).take(pa.array(at, pa.int64())) for x in KEYS]
            held = structs([pa.array(cs, pa.int32()), pa.array(cnts, pa.int64())], ["c", "cnt"], sizes)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(ks, pa.int32()), pa.array(errors, pa.float64()), held], [*KEYS, "k", "error", "centroids"])

    return run


def _last(measure: arrays.Measure):
    """Of each block and cluster: weight, squared error, and the member nearest to the mean, ties by rank."""

    def run(batches):
        for batch in batches:
            out, best, sizes = [], [], []
            for i, block in enumerate(batch.column("block").to_pylist()):
                c, cnt, prev, now = (batch.column(x)[i].values.to_numpy() for x in ("c", "cnt", "prev", "now"))
                mine = arrays.nearest(c, prev, measure)[0]
                own = arrays.apart(c, now[mine], measure)
                sums, first = np.zeros((len(now), 2)), np.full(len(now), -1)
                np.add.at(sums, mine, np.stack([cnt, own * own * cnt], 1))
                order = np.lexsort((own, mine))  # stable: by rank within
                lead = order[np.append(True, np.diff(mine[order]) != 0)]
                first[mine[lead]] = lead
                out.append(sums)
                sizes.append(len(now))
                best += [None if f < 0 else {"d": own[f], "rank": block * BLOCK + f + 1, "c": c[f]} for f in first.tolist()]
            flat = np.concatenate(out) if out else np.zeros((0, 2))
            kind = pa.struct([("d", pa.float64()), ("rank", pa.int32()), ("c", pa.int32())])
            stats = structs([pa.array(flat[:, 0].astype(np.int64)), pa.array(flat[:, 1]), pa.array(best, kind)], ["w", "e", "best"], sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (*KEYS, "k")), stats], [*KEYS, "k", "stats"])

    return run


def _added(lists: str, add) -> Column:
    """An array of arrays folded element by element."""
    return F.aggregate(F.slice(lists, 2, _ALL), F.element_at(lists, 1), lambda a, b: F.zip_with(a, b, add))


def _mean(t: Column) -> Column:
    whole = lambda x: spaces.nearest_int(F.try_divide(x, t["w"]))
    return F.when(t["w"] == 0, 0).otherwise(spaces.pack(whole(t["x"]), whole(t["y"]), whole(t["z"])))


def as_map(pairs: Column) -> Column:
    """An array of (c, cnt) as one of distinct c: the place is the first one's, the count the last one's."""
    again = lambda kept, x: F.transform(kept, lambda y: F.when(y["c"] == x["c"], x).otherwise(y))
    empty = F.array().cast("array<struct<c:int,cnt:bigint>>")
    return F.aggregate(pairs, empty, lambda kept, x: F.when(F.exists(kept, lambda y: y["c"] == x["c"]), again(kept, x)).otherwise(F.concat(kept, F.array(x))))


def fits(colours: DataFrame, wanted: DataFrame, space: str, rounds: int = 100) -> DataFrame:
    """(ref, image_id, k, error, centroids: array of (c, cnt)) for each (ref, image_id, k) wanted; k = 0: as many as colours that aren't alike. colours: a written table, or of such.

    Centroids are medoids with their clusters' counts, in the clusters' order; a cluster without members has its mean, one
    without weight the mean 0; a later cluster of the same medoid takes over its place's count. error: mean squared distance to the rounded means.
    """
    own = spaces.of(space)
    large, small = colours.filter(F.col("colours") > BLOCK), colours.filter(F.col("colours") <= BLOCK)
    asked = wanted.groupBy(*KEYS).agg(F.collect_set("k").alias("ks"))
    found = blocks(dealt(small, *KEYS)).join(asked, KEYS).select(*KEYS, "c", "cnt", "ks").mapInArrow(_alone(own.measure, own.epsilon, rounds), _FITS)
    if large.isEmpty():
        return written(found, "fits")
    more, tables = _in_rounds(large, wanted, space, rounds)
    out = written(found.unionByName(more), "fits")
    drop(*tables)
    return out


def _in_rounds(colours: DataFrame, wanted: DataFrame, space: str, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """fits() of images of more than one block, and the tables that it reads."""
    held = written(blocks(colours), "blocks")
    ordered = colours.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "c")))["c"].alias("all"))
    asked = wanted.groupBy(*KEYS).agg(F.collect_set("k").alias("ks"), F.max(F.when(F.col("k") == 0, _ALL).otherwise(F.col("k"))).alias("most"))
    found = ordered.join(asked, KEYS).select(*KEYS, "ks", seeds(F.col("all"), F.col("most"), space).alias("found"))
    first = F.slice("found", 1, F.when(F.col("k") == 0, _ALL).otherwise(F.col("k")))
    state = found.withColumn("k", F.explode("ks")).select(*KEYS, "k", first.alias("prev"), first.alias("now"), F.lit(rounds).alias("left"))
    moving, done = written(state, "centroids"), []
    start = moving
    columns = [*KEYS, "k", "prev", "now", "left"]
    for _ in range(rounds):
        step = moving.join(held, KEYS).select(*KEYS, "k", "c", "cnt", "now", (F.col("left") - 1).alias("left"))
        sums = step.mapInArrow(_step(spaces.of(space).measure), f"ref boolean, image_id long, k int, prev array<int>, left int, sums {_SUMS}")
        sums = sums.groupBy(*KEYS, "k").agg(F.first("prev").alias("prev"), F.min("left").alias("left"), F.collect_list("sums").alias("parts"))
        more = lambda a, b: F.struct(*[(a[x] + b[x]).alias(x) for x in "wxyz"])
        after = sums.withColumn("now", F.transform(_added("parts", more), _mean)).select(*columns)
        after = written(after.withColumn("still", (F.col("left") > 0) & (F.col("prev") != F.col("now"))), "centroids")
        done.append(after)
        moving = after.filter("still").select(*columns)
        if moving.isEmpty():
            break
    settled = [t.filter("not still").select(*columns) for t in done] or [moving]
    ended = functools.reduce(DataFrame.union, settled)
    last = ended.join(held, KEYS).select(*KEYS, "k", "block", "c", "cnt", "prev", "now")
    stats = last.mapInArrow(_last(spaces.of(space).measure), f"ref boolean, image_id long, k int, stats {_STATS}").groupBy(*KEYS, "k").agg(F.collect_list("stats").alias("parts"))
    both = lambda a, b: F.struct((a["w"] + b["w"]).alias("w"), (a["e"] + b["e"]).alias("e"), F.least(a["best"], b["best"]).alias("best"))
    stats = stats.withColumn("s", _added("parts", both)).join(ended.select(*KEYS, "k", "now"), [*KEYS, "k"])
    pairs = F.zip_with("s", "now", lambda t, m: F.struct(F.coalesce(t["best"]["c"], m).alias("c"), t["w"].alias("cnt")))
    total = lambda x: F.aggregate("s", F.lit(0).cast("double"), lambda a, t: a + t[x])
    error = F.when(total("w") > 0, total("e") / total("w")).otherwise(F.lit(float("nan")))
    return stats.select(*KEYS, "k", error.alias("error"), as_map(pairs).alias("centroids")), [held, start, *done]
