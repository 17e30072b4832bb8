"""Image files written and read, standard conversions, and walks of contrast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_clusters import contrast

from huescope.functions import conversions, spaces
from huescope.sources import images, png


def rows(spark, shapes):
    rng = np.random.default_rng(2)
    own = [(i, w, h, n, bytearray(rng.integers(0, 256, w * h * n, dtype=np.uint8).tobytes())) for i, (w, h, n) in enumerate(shapes, 1)]
    return own, spark.createDataFrame([*own, (90, 2, 2, 3, None), (91, 2, 2, 2, bytearray(8))], "image_id long, width int, height int, channels int, data binary")


def test_png_files_come_back(spark, tmp_path):
    own, frame = rows(spark, [(1, 1, 3), (7, 5, 3), (5, 7, 1), (3, 2, 4), (64, 40, 3)])
    path = f"file://{tmp_path}/out"
    png.write_images(frame.repartition(3), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted(f"{i}.png" for i, *_ in own)
    back = images.read_images(spark, path).withColumn("image_id", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long"))
    order = lambda df: sorted(map(tuple, images.pixels_of(df).collect()))
    assert order(back) == order(frame)
    assert sorted(r.length for r in images.read_raw(spark, path).collect()) == sorted((tmp_path / "out" / f"{i}.png").stat().st_size for i, *_ in own)


def test_images_of_inverts_pixels_of(spark):
    own, frame = rows(spark, [(4, 3, 3), (1, 9, 3)])
    got = {r.image_id: (r.width, r.height, r.channels, bytes(r.data)) for r in png.images_of(images.pixels_of(frame)).collect()}
    assert got == {i: (w, h, n, bytes(d)) for i, w, h, n, d in own}
    with pytest.raises(ValueError):
        png.encode(2, 2, 3, b"short")


def test_conversions_there_and_back(spark):
    rng = np.random.default_rng(3)
    values = rng.uniform(-0.3, 1.2, (60, 3)).tolist() + [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [0.5, 0.5, 0.5]]
    df = spark.createDataFrame([(v,) for v in values], "c array<double>")
    of = lambda name: [F.col(name)[i] for i in range(3)]
    for target in conversions.CHAIN[1:]:
        there = df.withColumn("t", conversions.convert(of("c"), "rgb", target))
        for r in there.withColumn("back", conversions.convert(of("t"), target, "rgb")).collect():
            # the published matrices and their inverses agree to about seven digits; near-greys lose their hue
            assert np.allclose(r.back, r.c, atol=2e-4), (target, r)
    white = df.filter("c[0] = 1").select(conversions.convert(of("c"), "rgb", "oklch").alias("t")).first().t
    assert abs(white[0] - 1) < 1e-6 and white[1] < 1e-3 and white[2] is None


def test_contrast_walks_by_plain_steps(spark):
    rng = np.random.default_rng(4)
    colours = [(int(r) << 16 | int(g) << 8 | int(b), int(k)) for (r, g, b), k in zip(rng.integers(0, 206, (30, 3)), rng.integers(0, 1 << 24, 30), strict=True)]
    df = spark.createDataFrame(colours, "c int, g int")
    ask = df.select("c", "g", *[spaces.increase_contrast(F.col("c"), F.col("g"), F.lit(t), F.lit(45.0), "oklab", fore).alias(n) for n, t, fore in (("up", spaces.WHITE["oklab"], True), ("down", 0, False))])
    pair = lambda a, b: float(contrast(np.array([a]), np.array([b]), "oklab")[0])

    def plain(of, ground, towards, fore):
        a, b = (of >> 8 & 255) / 1.275 - 100, (of & 255) / 1.275 - 100
        light, chroma = (of >> 16) / 2.06, (0 if abs(a) < 7.5e-5 and abs(b) < 7.5e-5 else np.hypot(a, b)) / 1.5
        hue, k, out = np.arctan2(b, a), 0, of
        while k < 45:
            light += 1 if (towards >> 16) > (ground >> 16) else -1
            chroma -= 0.01
            if light <= 0 or light >= 100:
                break
            axes = [int(np.floor((chroma * f(hue) + 100) * 1.275 + 0.5)) for f in (np.cos, np.sin)]
            out = int(light * 2.06) << 16 | axes[0] << 8 | axes[1]
            k = pair(ground, out) if fore else pair(out, ground)
        return out

    got = ask.collect()
    assert any(r.up != r.c for r in got)
    for r in got:
        assert (r.up, r.down) == (plain(r.c, r.g, spaces.WHITE["oklab"], True), plain(r.c, r.g, 0, False))
    dark = spark.createDataFrame([(0x000001,), (0x010000,), (0xFFFFFF,)], "c int").select("c", spaces.increase_contrast(F.col("c"), F.lit(0), F.lit(0xFFFFFF), F.lit(5.0), "rgb").alias("m"))
    assert {r.c: r.m for r in dark.collect()}[0xFFFFFF] == 0xFFFFFF
