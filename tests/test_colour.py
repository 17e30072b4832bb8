"""The colour engine against its SQL, hand-made images and invariants."""

import glob
import math
import os

import duckdb
import numpy as np
import plain_clusters as plain
import pytest

import __spark_entry__ as entry
from huescope.functions import arrays, names, spaces
from huescope.operators import clusters, kmeans, regions
from huescope.operators import pixels as px
from huescope.plans import queries
from huescope.sources.images import pixels_of

SF = "/root/testdata/sf0.001"
CHECKED = ("contours", "text_region_pixels", "kmeans_k", "strategy_gap", "merge_groups", "role_names", "elbow_slope", "third_pick", "clamp_nearest", "text_segments", "opening", "distance_lab", "nearest_css_name", "pixels_trim", "pack_oklab", "unpack_oklab", "saliency_mask", "hist_weighted", "centroid_update", "border_tally", "sobel", "scramble", "top_colors")


def value(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(value(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(value(r[i]) for i in at) for r in rel.fetchall())


def image(spark, rows, image_id=1):
    a = np.array(rows, np.uint8)
    df = spark.createDataFrame([(image_id, a.shape[1], a.shape[0], 3, bytearray(a.tobytes()))], "image_id long, width int, height int, channels int, data binary")
    return pixels_of(df)


def test_source_orders_channels_and_skips_what_it_cannot_read(spark):
    rows = [(1, 1, 1, 3, "bgr", bytearray([1, 2, 3])), (2, 1, 1, 4, "rgb", bytearray([9, 8, 7, 0])), (3, 1, 1, 1, "rgb", bytearray([5])), (4, 1, 1, 3, "rgb", None)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, channels int, colour_order string, data binary")
    assert sorted((r.image_id, r.r, r.g, r.b) for r in pixels_of(df).collect()) == [(1, 3, 2, 1), (2, 9, 8, 7), (3, 5, 5, 5)]


def test_flat_and_single_pixel_images(spark):
    for rows in ([[[7, 7, 7]]], [[[200, 10, 10]] * 4] * 4):
        own = px.packed(image(spark, rows))
        assert {r.sal for r in px.saliency(px.grey(own)).collect()} == {0}
        out = clusters.extract_colors(image(spark, rows)).collect()
        ends = plain.to_rgb(np.array([spaces.BLACK["oklab"], spaces.WHITE["oklab"]]), "oklab")  # as the packed bytes give them back
        assert len(out) == 1 and out[0].inner in ends.tolist()


def test_blob_is_salient(spark):
    rows = np.zeros((8, 8, 3), np.uint8)
    rows[2:4, 2:4] = 255
    sal = {(r.idx // 8, r.idx % 8) for r in px.saliency(px.grey(px.packed(image(spark, rows)))).filter("sal = 1").collect()}
    assert {(2, 2), (3, 3)} <= sal and (7, 7) not in sal


def plain_saliency(v):
    """The pyramid and each pixel's difference to it, a cell at a time, by flat index."""
    h, w = v.shape
    levels = [v.ravel().tolist()]
    for k in range(1, min(w, h).bit_length()):
        pw, nw, nh, before = w >> (k - 1), w >> k, h >> k, levels[-1]
        levels.append([round((before[2 * y * pw + 2 * x] + before[2 * y * pw + 2 * x + 1] + before[(2 * y + 1) * pw + 2 * x] + before[(2 * y + 1) * pw + 2 * x + 1]) / 4) for y in range(nh) for x in range(nw)])
    d = []
    for i, own in enumerate(levels[0]):
        cells = [(k, (i // w >> k) * (w >> k) + (i % w >> k)) for k in range(1, len(levels))]
        total = sum(abs(own - levels[k][c]) for k, c in cells if c < len(levels[k]))
        d.append(min(255, round(total / max(1, len(cells)))))
    return levels, [(x, int(2 * x > max(d))) for x in d]


def test_pyramid_and_saliency_by_tiles(spark):
    """Images of many tiles, of one, and of a single row or column, with sizes that halve evenly and that don't, as by plain loops."""
    rng, images = np.random.default_rng(5), {}
    for i, (h, w) in enumerate([(16, 16), (37, 23), (23, 37), (40, 67), (33, 8), (1, 9), (9, 1), (3, 3), (64, 31), (5, 70)]):
        images[i] = rng.integers(0, 256, (h, w))
    rows = [(i, v.shape[1], v.shape[0], n, int(x), n) for i, v in images.items() for n, x in enumerate(v.ravel())]
    greys = spark.createDataFrame(rows, "image_id long, w int, h int, idx int, v int, c int").repartition(5)
    want = {i: plain_saliency(v) for i, v in images.items()}
    levels = sorted((i, k, n, x) for i, (found, _) in want.items() for k, level in enumerate(found) for n, x in enumerate(level))
    sal = sorted((i, n, *x, n) for i, (_, found) in want.items() for n, x in enumerate(found))
    for side in (4, 8, px.SIDE):
        assert sorted(tuple(r) for r in px.pyramid(greys, side).collect()) == levels
        assert sorted((r.image_id, r.idx, r.d, r.sal, r.c) for r in px.saliency(greys, side).collect()) == sal
    nothing = greys.filter("w < 0")
    assert px.pyramid(nothing, 4).count() == px.saliency(nothing, 4).count() == 0


def test_greys_pack_and_come_back(spark):
    grey = spark.createDataFrame([(i, i, i) for i in range(256)], "r int, g int, b int").withColumn("c", spaces.pack_oklab(*(spaces.F.col(x) for x in "rgb")))
    rows = grey.withColumn("back", spaces.unpack_oklab(spaces.F.col("c"))).collect()
    assert {r.c & 0xFFFF for r in rows} == {127 * 256 + 127}
    assert [int(x) for x in plain.to_rgb(np.array([r.c for r in rows]), "oklab")] == [r.back for r in rows]


def same(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def plain_records(spark, pixels, o):
    table = clusters.colour_table(pixels, o).toPandas()
    ks = range(o.min_k, o.max_k + 1)
    even = {t: [plain.kmeans(*plain.uniform_reference(int(t)), k, o.space, o.rounds)[1] for k in ks] for t in (table["total"].unique() if o.strategy == "gap" else ())}
    return {i: plain.summary(t, o, even.get(t["total"].iloc[0]))[1] for i, t in table.groupby("image_id")}


def records(frame):
    out = {r.image_id: r.asDict(True) for r in frame.collect()}
    for r in out.values():
        r.pop("image_id")
        for k in ("outer_colors", "inner_colors", "centroids"):
            r[k] = [(x["rgb"], x["cnt"]) for x in r[k]]
    return out


@pytest.mark.parametrize(
    "o,block",
    [
        (clusters.Options(), 200),
        (clusters.Options(space="lab", strategy="constant", k=8), 4096),
        (clusters.Options(strategy="gap", min_k=2, max_k=6, clamp=0.5), 50),
        (clusters.Options(space="rgb", strategy="constant", k=0, clamp=None), 4096),
        (clusters.Options(strategy="constant", k=20, rounds=2, clamp=1.0), 100),
    ],
)
def test_all_images_at_once_equal_one_by_one(spark, monkeypatch, o, block):
    """Rounds over blocks, folds and roles against the plain summary of each image; small blocks make every image take part in shuffled rounds."""
    monkeypatch.setattr(kmeans, "BLOCK", block)
    pixels = entry.plans.whole(spark, SF).filter("image_id < 5")
    got, want = records(clusters.extract_colors(pixels, o)), plain_records(spark, pixels, o)
    assert got.keys() == want.keys()
    for i in want:
        assert same({k: v for k, v in want[i].items()}, got[i]), i


def test_queries_of_whole_records_equal_the_plain_ones(spark):
    gap = clusters.Options(strategy="gap", min_k=4, max_k=20, clamp=0.005)  # the options of the published tests
    got = records(queries.QUERIES["extract_colors_gap"](spark, SF))
    want = plain_records(spark, entry.plans.whole(spark, SF), gap)
    assert got.keys() == want.keys() and all(same(want[i], got[i]) for i in want)
    for r in got.values():
        assert sorted(r["outer_colors"] + r["inner_colors"]) == sorted(r["centroids"])


def test_seeds_and_slope(spark):
    rng = np.random.default_rng(1)
    colours = np.unique(rng.integers(0, 1 << 24, 300)).tolist()
    df = spark.createDataFrame([(colours, k) for k in (1, 5, 40)], "c array<int>, k int")
    for space in ("rgb", "oklab"):
        for r in df.select("k", kmeans.seeds(spaces.F.col("c"), spaces.F.col("k"), space).alias("s")).collect():
            assert r.s == plain.seeds(np.array(colours), r.k, space).tolist()
    points = [[(1, 3.0), (2, 2.0), (3, 1.0)], [(1, 5.0)], [(k, float(100 if k == 4 else 9 - k)) for k in range(1, 9)], [(2, 1.0), (2, 4.0)]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, p array<struct<k:int,error:double>>")
    got = {r.i: r.s for r in df.select("i", clusters.slope(spaces.F.col("p")).alias("s")).collect()}
    assert got == {i: plain.slope([k for k, _ in p], [e for _, e in p]) for i, p in enumerate(points)}


def test_elbow_choice(spark):
    cases = [(1, []), (3, [(1, 9.0), (2, 4.0)]), (300, [(1, 90.0), (2, 40.0), (3, 20.0), (4, 12.0), (50, 1.0), (100, 0.5)]), (60, [(1, 9.0), (2, 8.0), (3, 7.5), (4, 7.0), (50, 1.0)]), (300, [(k, 5.0) for k in (1, 2, 3, 4, 50, 100)])]
    df = spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(cases)], "i int, n int, e array<struct<k:int,error:double>>")
    got = {r.i: r.k for r in df.select("i", clusters.elbow_k(spaces.F.col("e"), spaces.F.col("n"), (1, 2, 3, 4), (50, 100)).alias("k")).collect()}
    assert got == {i: plain.elbow_k(lambda k, e=dict(e): e[k], n, (1, 2, 3, 4), (50, 100)) for i, (n, e) in enumerate(cases)}


@pytest.mark.parametrize("pool", ["often", "all"])
def test_clamp_and_merge_in_order(spark, pool):
    """Moves onto centroids that stay, onto each other, and groups that join, as the plain folds do them."""
    rng = np.random.default_rng(4)
    colours = (rng.integers(90, 110, (40, 3)) @ np.array([65536, 256, 1])).tolist()
    colours = list(dict.fromkeys(colours))
    counts = rng.integers(0, 30, len(colours)).tolist()
    total, percent = sum(counts), 3.0 if pool == "often" else 90.0
    cents = dict(zip(colours[::3] + [colours[0] + 1, colours[3] + 257], rng.integers(1, 50, len(colours[::3]) + 2).tolist(), strict=True))
    table = spark.createDataFrame([(1, c, i + 1, n, total) for i, (c, n) in enumerate(zip(colours, counts, strict=True))], "image_id long, c int, rank int, cnt long, total long")
    few = spark.createDataFrame([(1, list(cents.items()))], "image_id long, cents array<struct<c:int,cnt:long>>")
    moved = clusters.clamp(few, table, percent, "rgb")
    want = plain.clamp(cents, np.array(colours), np.array(counts), total, percent, "rgb")
    assert [tuple(x) for x in moved.first().cents] == list(want.items())
    joined = moved.select(clusters.merged(spaces.F.col("cents"), "rgb").alias("m")).first().m
    assert [tuple(x) for x in joined] == list(plain.merge(want, "rgb").items()) and len(joined) < len(want)


def test_roles_are_of_the_image(spark):
    r = clusters.extract_colors(entry.plans.whole(spark, SF)).first()
    own = {c.rgb for c in r.centroids}
    assert {r.outer, r.inner, r.third, r.accent} <= own and len(r.outer_colors) + len(r.inner_colors) == len(r.centroids)


def test_nearest_names(spark):
    df = spark.createDataFrame([(0x000000,), (0xFF0001,), (0x00FFFF,), (None,)], "c int")
    assert {r.c: r.name for r in names.nearest(df, "c").collect()} == {0: "black", 0xFF0001: "red", 0x00FFFF: "aqua", None: None}


def test_ciede2000_published_pairs(spark):
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)]
    for p, q, want in pairs:
        lit = lambda v: [spaces.F.lit(x) for x in v]
        got = spark.range(1).select(names.ciede2000(lit(p), lit(q)).alias("d")).first().d
        assert abs(got - want) < 1e-4


def test_contours_and_segments(spark):
    rows = np.full((10, 64, 3), 255, np.uint8)
    rows[4, 10:14] = 0
    grey = regions.luma(image(spark, rows))
    edge = grey.withColumn("v", regions.F.when(regions.F.col("v") == 0, 255).otherwise(0))
    assert [(r.n, r.x1, r.y1, r.x2, r.y2) for r in regions.contours(edge).collect()] == [(3, 11, 4, 13, 4)]
    rows = np.full((2, 64, 3), 255, np.uint8)
    rows[1, [10, 12, 14]] = 0  # text-like: neither colour lasts
    rows[0, 20:24] = 0  # a solid stroke is no text
    binary = regions.luma(image(spark, rows)).withColumn("v", regions.F.when(regions.F.col("v") > 127, 255).otherwise(0))
    assert [(r.y, r.x1, r.x2) for r in regions.text_segments(binary).collect()] == [(1, 10, 16)]


def test_contour_points(spark):
    rows = np.full((6, 9, 3), 255, np.uint8)
    rows[1, 1:4] = rows[2, 4] = rows[4, 6:8] = rows[5, 0] = 0
    edge = regions.luma(image(spark, rows)).withColumn("v", regions.F.when(regions.F.col("v") == 0, 255).otherwise(0))
    got = sorted((r.contour_id, r.ord, r.x, r.y) for r in regions.contour_points(edge).collect())
    assert got == [(0, 0, 2, 1), (0, 1, 3, 1), (0, 2, 4, 2), (1, 0, 7, 4)]


def test_contours_over_islands_equal_one_fill(spark):
    """Islands filled by themselves, numbered together, against a flood fill of the whole image."""
    rng = np.random.default_rng(8)
    masks = {1: rng.random((30, 40)) < 0.08, 2: rng.random((12, 50)) < 0.3, 3: np.zeros((5, 5), bool)}
    masks[1][10:12] = masks[1][:, 20] = False
    rows, want = [], []
    for i, m in masks.items():
        rows += [(i, int(x), int(y), 255 if m[y, x] else 0) for y, x in np.ndindex(m.shape)]
        left, contour = {(int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)}, 0
        for start in sorted(left):
            if start in left:
                left.discard(start)
                todo, n = [start], 0
                while todo:
                    y, x = todo.pop()
                    for p in [(y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x), (y - 1, x - 1), (y + 1, x - 1), (y - 1, x + 1), (y + 1, x + 1)]:
                        if p in left:
                            left.discard(p)
                            todo.append(p)
                            want.append((i, contour, n, p[1], p[0]))
                            n += 1
                contour += n > 0
    got = regions.contour_points(spark.createDataFrame(rows, "image_id long, x int, y int, v int")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({w[:2] for w in want}) > 10


def test_text_regions_over_islands_equal_whole_images(spark):
    rng = np.random.default_rng(9)
    rows, want = [], []
    for i, h in ((1, 320), (2, 64), (3, 700)):
        lines: dict = {}
        for y in range(0, 60):
            x = int(rng.integers(0, 30))
            while x < 120 and y % 17:
                end = x + int(rng.integers(1, 25))
                lines.setdefault(y, []).append((x, y, end, y))
                rows.append((i, h, y, x, end))
                x = end + 1 + int(rng.integers(0, 40))
        gap = 6 * h // 640
        for y in range(h - gap):
            for w in range(y + 1, y + gap + 1):
                stay = []
                for a in lines.get(y, []):
                    others = lines.get(w, [])
                    b = next((b for b in others if a[0] <= b[2] and b[0] <= a[2]), None)
                    if b is None:
                        stay.append(a)
                    else:
                        others.remove(b)
                        others.append((min(a[0], b[0]), a[1], max(a[2], b[2]), b[3]))
                lines[y] = stay
        want += [(i, n, *s, (s[2] - s[0] + 1) * (s[3] - s[1] + 1)) for n, s in enumerate(s for y in sorted(lines) for s in lines[y])]
    got = regions.text_regions(spark.createDataFrame(rows, "image_id long, h int, y int, x1 int, x2 int")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < len(rows)


def test_contours_and_names_are_whole(spark):
    d = "/root/testdata/sf0.001"
    assert queries.QUERIES["contours"](spark, d).columns == ["image_id", "contour_id", "ord", "x", "y"]
    named = queries.QUERIES["nearest_css_name"](spark, d)
    colours = queries.px.histogram(queries.trimmed(spark, d, "rgb"))
    assert named.count() == colours.count() > colours.filter("rank <= 3").count()


@pytest.mark.parametrize("w", [20, 64, 640])
def test_text_segments_against_a_scan(spark, w):
    """Runs against a scan pixel by pixel with its counters."""
    rng = np.random.default_rng(w)
    rows = np.where(rng.random((6, w, 1)) < 0.15, 0, 255).repeat(3, 2)
    rows[1, 3 : w // 2] = 0
    rows[2] = rng.integers(0, 2, (w // 4, 1)).repeat(4, 0)[:, [0, 0, 0]] * 255
    rows[4] = 0
    want = []
    for y in range(6):
        start, length, white, black = -1, 0, 0, 0
        for x in range(w):
            if rows[y, x, 0] and start >= 0:
                white, black = white + 1, 0
            if not rows[y, x, 0]:
                black, white = black + 1, 0
                start = x if start < 0 else start
            if white > 13 * w / 640 or black > 10 * w / 640 or x == w - 1:
                if length >= 30 * w / 640:
                    want.append((y, start, start + length))
                start, length, white, black = -1, 0, 0, 0
            if start >= 0:
                length += 1
    binary = regions.luma(image(spark, rows))
    assert sorted((r.y, r.x1, r.x2) for r in regions.text_segments(binary).collect()) == sorted(want)
    assert want or w == 20


def test_text_regions_join_lines(spark):
    rows = [(1, 320, 10, 0, 20), (1, 320, 11, 15, 30), (1, 320, 13, 5, 8), (1, 320, 20, 0, 3), (1, 320, 11, 40, 50)]
    df = spark.createDataFrame(rows, "image_id long, h int, y int, x1 int, x2 int")
    got = [(r.x1, r.y1, r.x2, r.y2, r.area) for r in regions.text_regions(df).orderBy("ord").collect()]
    assert got == [(40, 11, 50, 11, 11), (0, 10, 30, 13, 124), (0, 20, 3, 20, 4)]
    pixels = spark.createDataFrame([(1, 0, 0, 10, 1, 2, 3), (1, 1, 31, 12, 1, 2, 3), (1, 2, 45, 11, 1, 2, 3)], "image_id long, idx int, x int, y int, r int, g int, b int")
    assert sorted(r.idx for r in regions.crop_regions(pixels, regions.text_regions(df)).collect()) == [0, 2]


@pytest.mark.parametrize("space", ["rgb", "oklab", "lab"])
def test_numpy_spaces_equal_columns(spark, space):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(int(x) for x in v) for v in rng.integers(0, 256, (200, 3))], "r int, g int, b int")
    c = spaces.to_packed(*(spaces.F.col(x) for x in "rgb"), space)
    rows = df.select(c.alias("c")).select("c", *[f(spaces.F.col("c"), space).alias(n) for n, f in (("light", spaces.lightness), ("chroma", spaces.chroma), ("rgb", spaces.to_rgb))], spaces.distance(spaces.F.col("c"), spaces.F.lit(spaces.WHITE[space]), space).alias("d")).collect()
    packed = np.array([r.c for r in rows])
    assert np.allclose(plain.lightness(packed, space), [r.light for r in rows]) and np.allclose(plain.chroma(packed, space), [r.chroma for r in rows])
    assert (plain.to_rgb(packed, space) == [r.rgb for r in rows]).all()
    assert np.allclose(arrays.nearest(packed, np.array([spaces.WHITE[space]]), spaces.of(space).measure)[1], [r.d for r in rows])
    assert np.allclose(arrays.apart(packed, np.full(len(packed), spaces.WHITE[space]), spaces.of(space).measure), [r.d for r in rows])
    ends = spark.range(1).select(*[spaces.to_packed(*(spaces.F.lit(v),) * 3, space) for v in (0, 255)]).first()
    assert tuple(ends) == (spaces.BLACK[space], spaces.WHITE[space])


def test_spaces_and_strategies_of_a_users_own(spark, monkeypatch):
    """Grey levels as a space, with its own contrast, and the square root of the colours as k."""
    grey = spaces.Space(
        "grey", lambda r, g, b: spaces.luma(r, g, b), lambda c: c * 65793, lambda p, q: spaces.F.abs(p - q).cast("double"),
        arrays.Measure(lambda c: np.asarray(c, float)[..., None], lambda x, y: np.abs(x - y)[..., 0]), 3.0,
        lambda c: c / 2.55, lambda c: spaces.F.lit(0.0), lambda p, q: spaces.F.abs(p - q) / 2.55, 0, 255,
    )
    monkeypatch.setattr(spaces, "SPACES", dict(spaces.SPACES))
    monkeypatch.setattr(clusters, "STRATEGIES", dict(clusters.STRATEGIES))
    spaces.register(grey)
    clusters.register_strategy("root", lambda table, o: clusters.with_k(table, spaces.F.ceil(spaces.F.sqrt("colours")), o))
    rows = np.zeros((24, 24, 3), np.uint8)
    rows[6:12, 6:18], rows[15:20, 4:20], rows[:3] = 250, 120, 7
    r = clusters.extract_colors(image(spark, rows), clusters.Options(space="grey", strategy="root", clamp=None)).first()
    assert r.outer in (0, 7 * 65793) and r.inner == 250 * 65793 and len(r.centroids) == 2
    assert abs(r.contrasts.outer_inner - abs(250 - r.outer // 65793) / 2.55) < 1e-9
    for bad in (clusters.Options(space="none"), clusters.Options(strategy="none")):
        with pytest.raises(ValueError, match="known"):
            clusters.extract_colors(image(spark, rows), bad)
