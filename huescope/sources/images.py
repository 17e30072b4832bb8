"""Images as rows of pixels: (image_id, w, h, idx, x, y, r, g, b), idx row-major from 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 20
_ROWS = 1 << 18


def _explode(batches):
    for batch in batches:
        for image, w, h, n, order, data in zip(*(batch.column(c).to_pylist() for c in ("image_id", "width", "height", "channels", "colour_order", "data")), strict=True):
            if data is None or n not in (1, 3, 4):
                continue
            raw = np.frombuffer(data, np.uint8)[: w * h * n].reshape(-1, n)
            rgb = raw[:, [0, 0, 0]] if n == 1 else raw[:, [2, 1, 0]] if order == "bgr" else raw[:, :3]
            for a in range(0, len(rgb), _ROWS):
                part = rgb[a : a + _ROWS].astype(np.int32)
                idx = np.arange(a, a + len(part), dtype=np.int32)
                cols = [np.full(len(part), image, np.int64), np.full(len(part), w, np.int32), np.full(len(part), h, np.int32), idx, idx % w, idx // w, *part.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["image_id", "w", "h", "idx", "x", "y", "r", "g", "b"])


def pixels_of(images: DataFrame) -> DataFrame:
    """The pixels of images (image_id, width, height, channels, data: interleaved bytes; colour_order "bgr" or "rgb", if there).

    Alpha is left out, one grey channel stands for three, other channel counts and null data give no pixels. Each image is
    exploded where it lies, in parts of bounded size; nothing is shuffled.
    """
    order = F.col("colour_order") if "colour_order" in images.columns else F.lit("rgb")
    parts = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("channels").cast("int").alias("channels"), order.alias("colour_order"), "data")
    return parts.mapInArrow(_explode, "image_id long, w int, h int, idx int, x int, y int, r int, g int, b int")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """images() of encoded files by Spark's image source, which decodes to blue, green, red; image_id is a hash of the origin."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return i.select(F.xxhash64("origin").alias("image_id"), "origin", "width", "height", F.col("nChannels").alias("channels"), F.lit("bgr").alias("colour_order"), "data")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content): files as they are, undecoded."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def derived_pixels(spark: SparkSession, sf_dir: str, key: str = "l_suppkey", width: int = SIDE, structured: bool = False) -> DataFrame:
    """An image for each value of `key`, an expression, from all its lineitems: colours are quantity, discount and tax.

    Rows are `width` pixels wide; what the last one lacks is taken from the row above. structured: pixels in the order of their luma, which makes flat areas and edges.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    level = lambda c, by: F.round(F.col(c) * by).cast("int")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    luma = F.floor(level("l_quantity", 5) * 0.299 + level("l_discount", 2500) * 0.587 + level("l_tax", 3000) * 0.114)
    over = Window.partitionBy(F.expr(key)).orderBy(*([luma] if structured else []), *order)
    n, at, w = F.count("*").over(Window.partitionBy(F.expr(key))), F.row_number().over(over) - 1, F.lit(width)
    rows = items.select(F.expr(key).cast("long").alias("image_id"), at.alias("at"), n.cast("int").alias("n"), level("l_quantity", 5).alias("r"), level("l_discount", 2500).alias("g"), level("l_tax", 3000).alias("b"))
    rows = rows.withColumn("h", F.floor((F.col("n") + w - 1) / w).cast("int"))
    again = (F.col("at") + w >= F.col("n")) & (F.col("at") + w < F.col("h") * w)
    rows = rows.withColumn("idx", F.explode(F.when(again, F.array("at", F.col("at") + w)).otherwise(F.array("at"))))
    return rows.select("image_id", w.alias("w"), "h", "idx", (F.col("idx") % w).alias("x"), F.floor(F.col("idx") / w).cast("int").alias("y"), "r", "g", "b")
