"""What makes k-means and saliency of very many images fast leaves their results as they are."""

import dataclasses

import numpy as np
import plain_clusters as plain
import pytest
from pyspark.sql import functions as F

from huescope.functions import arrays, spaces
from huescope.operators import clusters, kmeans
from huescope.operators import pixels as px

ONES = np.array([65536, 256, 1])


@pytest.mark.parametrize("space", ["rgb", "oklab", "lab"])
def test_nearest_of_many_runs(space):
    """Kept distances, whole numbers and places in their lowest bits against plain minima, with many ties, centroids that move and runs that leave."""
    rng, measure, room, ties = np.random.default_rng(3), spaces.of(space).measure, arrays.Room(), 0
    for top in (6, 40, 256):
        colours = rng.permutation(np.unique(rng.integers(0, top, (300, 3)) @ ONES))
        sizes = np.array([1, 3, 7, 12, 20])
        cents, near = rng.integers(0, top, (sizes.sum(), 3)) @ ONES, arrays.Nearest(colours, measure, room)
        for turn in range(5):
            got, a = near.places(cents, sizes), 0
            for j, n in enumerate(sizes):
                d = measure.between(measure.fields(colours)[:, None], measure.fields(cents[a : a + n])[None])
                assert (d.argmin(1) + a == got[j]).all()
                ties, a = ties + ((d == d.min(1)[:, None]).sum(1) > 1).sum(), a + n
            if turn == 2:
                kept = np.array([True, False, True, True, False])
                stay = np.repeat(kept, sizes)
                near.keep(stay)
                cents, sizes = cents[stay], sizes[kept]
            cents = cents.copy()
            cents[rng.integers(0, len(cents), 3)] = rng.integers(0, top, (3, 3)) @ ONES
    assert ties > 20


def test_rounds_that_go_in_circles():
    """CIEDE2000 and means of channels often never settle: a circle's end is known after one turn of it (before, all rounds were gone through)."""
    rng, calls, circles = np.random.default_rng(2), [0], 0
    measure = spaces.of("lab").measure
    counted = dataclasses.replace(measure, between=lambda x, y: calls.__setitem__(0, calls[0] + 1) or measure.between(x, y))
    for _ in range(12):
        colours = rng.integers(0, 256, (200, 3)) @ ONES
        colours[::3] |= -65536  # as an axis below 0 makes them: far apart by sign, but alike by bytes, of which means are
        colours = rng.permutation(np.unique(colours))
        counts = rng.integers(1, 4, len(colours))
        start = arrays.seeds(colours, 8, measure, 7.0)
        states, bytes_ = [start], arrays.channels(colours)
        for _ in range(130):
            mine = arrays.nearest(colours, states[-1], measure)[0]
            weight = np.bincount(mine, counts, len(start))[:, None]
            sums = np.stack([np.bincount(mine, bytes_[:, i] * counts, len(start)) for i in range(3)], 1)
            states.append(arrays.pack(np.where(weight > 0, np.floor(sums / np.maximum(weight, 1) + 0.499999999), 0)))
        for rounds in (1, 7, 40, 99, 100, 130):
            (now, mine), *none = kmeans._rounds(colours, counts, [start], measure, rounds, arrays.Room())
            end = next((i for i in range(rounds) if (states[i] == states[i + 1]).all()), rounds - 1)
            assert not none and (now == states[end + 1]).all() and (mine == arrays.nearest(colours, states[end], measure)[0]).all()
        calls[0] = 0
        kmeans._rounds(colours, counts, [start], counted, 1_000_000, arrays.Room())
        assert calls[0] < 5000
        circles += bool((states[-1] != states[-2]).any())
    assert circles


def test_seeds_in_blocks():
    rng = np.random.default_rng(7)
    colours = rng.permutation(np.unique(rng.integers(0, 1 << 24, 400)))
    for space in ("rgb", "oklab", "lab"):
        for k in (1, 5, 40, 300):
            assert arrays.seeds(colours, k, spaces.of(space).measure, spaces.EPSILON[space]).tolist() == plain.seeds(colours, k, space).tolist()


def test_every_k_of_an_image_in_one_pass(spark, monkeypatch):
    """Images of one block go through k-means in one job that writes one table, whatever rounds and k are asked for (two tables and one more a sixteen rounds before); k beyond the seeds are one run."""
    rng, rows = np.random.default_rng(6), []
    for i in range(3):
        colours = rng.permutation(np.unique(rng.integers(0, 1 << 24, 60)))
        rows += [(False, i, int(c), n + 1, int(rng.integers(1, 9)), len(colours)) for n, c in enumerate(colours)]
    table = spark.createDataFrame(rows, "ref boolean, image_id long, c int, rank int, cnt long, colours int")
    wanted = table.filter("rank = 1").select("ref", "image_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 5, 30, 58, 59)])).alias("k"))
    written = []
    monkeypatch.setattr(kmeans, "written", lambda df, name, f=kmeans.written: written.append(name) or f(df, name))
    got = {(r.image_id, r.k): ({x.c: x.cnt for x in r.centroids}, r.error) for r in kmeans.fits(table, wanted, "lab", 100).collect()}
    assert written == ["fits"] and len(got) == 18
    for (i, k), (cents, error) in got.items():
        own = [r for r in rows if r[1] == i]
        want = plain.kmeans(np.array([r[2] for r in own]), np.array([r[4] for r in own]), k, "lab")
        assert cents == want[0] and error == pytest.approx(want[1])


def test_saliency_of_tiles_over_batches(spark):
    """Tiles that begin and end anywhere in batches, and greys made of packed colours, as by whole tiles and by columns."""
    rng, rows = np.random.default_rng(5), []
    for i, (h, w) in enumerate([(3, 4), (1, 1), (5, 5), (9, 2), (16, 16), (2, 3)]):
        rows += [(i, w, h, n, int(n % w), int(n // w), *(int(x) for x in v)) for n, v in enumerate(rng.integers(0, 256, (h * w, 3)))]
    pixels = spark.createDataFrame(rows, "image_id long, w int, h int, idx int, x int, y int, r int, g int, b int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for space in ("rgb", "oklab", "lab"):
        packed = px.packed(pixels, space)
        assert sorted(map(tuple, packed.select("r", "g", "b", "c").collect())) == sorted(map(tuple, pixels.select("r", "g", "b", spaces.to_packed(*(F.col(x) for x in "rgb"), space)).collect()))
        want = sorted(map(tuple, px.saliency(px.grey(packed, space)).collect()))
        for n in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            try:
                assert sorted(map(tuple, px.saliency(packed, space=space).collect())) == want
            finally:
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted(map(tuple, px.saliency(px.grey(packed, space), side=2).collect())) == sorted(map(tuple, px.saliency(packed, side=2, space=space).collect()))


def test_clamp_over_blocks(spark, monkeypatch):
    """An image of several blocks finds its common colours and the nearest of them in any of these."""
    rng = np.random.default_rng(4)
    colours = list(dict.fromkeys((rng.integers(90, 110, (60, 3)) @ ONES).tolist()))
    counts = sorted(rng.integers(0, 30, len(colours)).tolist(), reverse=True)
    cents = dict(zip([*colours[::5], colours[0] + 1, colours[3] + 257], range(1, 99), strict=False))
    table = spark.createDataFrame([(1, c, i + 1, n, sum(counts)) for i, (c, n) in enumerate(zip(colours, counts, strict=True))], "image_id long, c int, rank int, cnt long, total long")
    few = spark.createDataFrame([(1, list(cents.items()))], "image_id long, cents array<struct<c:int,cnt:long>>")
    monkeypatch.setattr(kmeans, "BLOCK", 7)
    for percent in (0.5, 3.0, 90.0):
        want = plain.clamp(cents, np.array(colours), np.array(counts), sum(counts), percent, "rgb")
        assert [tuple(x) for x in clusters.clamp(few, table, percent, "rgb").first().cents] == list(want.items())
