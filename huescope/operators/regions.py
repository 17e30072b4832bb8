"""Region operators on pixels: thresholds, morphology and edges as windows, contours and text runs within an image."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spaces


def luma(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", spaces.luma(F.col("r"), F.col("g"), F.col("b")))


def global_threshold(greys: DataFrame) -> DataFrame:
    """(image_id, w, h, idx, x, y, v): 255 above 127, else 0; inverted where white is the majority."""
    share = greys.groupBy("image_id").agg(F.avg((F.col("v") > 127).cast("int")).alias("white"))
    on = (F.col("v") > 127) != (F.col("white") > 0.5)
    return greys.join(share, "image_id").select("image_id", "w", "h", "idx", "x", "y", F.when(on, 255).otherwise(0).alias("v"))


def _box(greys: DataFrame, reach: int, **aggregates) -> DataFrame:
    """Sums or extremes over squares, by rows and then columns."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-reach, reach)
    column = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-reach, reach)
    for name, (function, source) in aggregates.items():
        greys = greys.withColumn(name, function(source).over(row)).withColumn(name, function(name).over(column))
    return greys


def adaptive_threshold(greys: DataFrame, reach: int = 7, less: float = 10.0) -> DataFrame:
    """255 where v passes the clipped mean of its square less 10."""
    boxed = _box(greys.withColumn("one", F.lit(1)), reach, s=(F.sum, "v"), n=(F.sum, "one"))
    return boxed.select("image_id", "w", "h", "idx", "x", "y", F.when(F.col("v") > F.col("s") / F.col("n") - less, 255).otherwise(0).alias("v"))


def _morph(binary: DataFrame, function) -> DataFrame:
    boxed = _box(binary, 2, m=(function, "v"))
    inside = F.col("x").between(2, F.col("w") - 3) & F.col("y").between(2, F.col("h") - 3)
    return boxed.select("image_id", "w", "h", "idx", "x", "y", F.when(inside, F.col("m")).otherwise(0).alias("v"))


def erosion(binary: DataFrame) -> DataFrame:
    """Least of 5 by 5; a border of two pixels is 0."""
    return _morph(binary, F.min)


def dilation(binary: DataFrame) -> DataFrame:
    return _morph(binary, F.max)


def opening(binary: DataFrame) -> DataFrame:
    return dilation(erosion(binary))


def closing(binary: DataFrame) -> DataFrame:
    return erosion(dilation(binary))


def sobel(binary: DataFrame, least: float = 128.0) -> DataFrame:
    """255 where the gradient's magnitude passes 128; the border is 0."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    left, right = F.lag("v").over(row), F.lead("v").over(row)
    sides = binary.withColumns({"across": right - left, "along": left + 2 * F.col("v") + right})
    gx = F.lag("across").over(column) + 2 * F.col("across") + F.lead("across").over(column)
    gy = F.lead("along").over(column) - F.lag("along").over(column)
    edged = sides.withColumns({"gx": gx, "gy": gy})
    strong = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) > least
    return edged.select("image_id", "w", "h", "idx", "x", "y", F.when(F.coalesce(strong, F.lit(False)), 255).otherwise(0).alias("v"))


def text_edges(pixels: DataFrame) -> DataFrame:
    """Edges of text-like regions: grey, adaptive threshold, opening, closing, Sobel."""
    return sobel(closing(opening(adaptive_threshold(luma(pixels)))))


def islands(rows: DataFrame, low: str, high: str, apart: Column, by: list[str], name: str) -> DataFrame:
    """rows with `name`, the number of their island within `by`: a row whose [low, high] begins more than `apart` after all before it ended begins one."""
    order = Window.partitionBy(*by).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(low) - before > apart), 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def _fill(t: pd.DataFrame) -> pd.DataFrame:
    """The flood fills of an island's pixels: first (x, y), ord, x, y."""
    left, out = set(zip(t["y"].tolist(), t["x"].tolist(), strict=True)), []
    for start in sorted(left):
        if start in left:
            left.discard(start)
            todo, n = [start], 0
            while todo:
                y, x = todo.pop()
                for p in [(y + j, x + i) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))]:
                    if p in left:
                        left.discard(p)
                        todo.append(p)
                        out.append((t["image_id"].iloc[0], *start, n, p[1], p[0]))
                        n += 1
    return pd.DataFrame(out, columns=["image_id", "first_y", "first_x", "ord", "x", "y"])


def contour_points(edges: DataFrame) -> DataFrame:
    """(image_id, contour_id, ord, x, y): 8-connected edge pixels in the order in which a flood fill from their first in raster order, left out itself, finds them.

    An image's pixels are first cut into islands, which no empty row or column divides, by rows, columns and rows again: windows only. An island is a task's group, and
    contours are numbered by their first pixels afterwards.
    """
    one, image = F.lit(1), ["image_id"]
    cut = islands(edges.filter("v = 255").select("image_id", "x", "y"), "y", "y", one, image, "a")
    cut = islands(cut, "x", "x", one, [*image, "a"], "b")
    cut = islands(cut, "y", "y", one, [*image, "a", "b"], "c")
    found = cut.groupBy("image_id", "a", "b", "c").applyInPandas(_fill, "image_id long, first_y int, first_x int, ord int, x int, y int")
    number = F.dense_rank().over(Window.partitionBy("image_id").orderBy("first_y", "first_x")) - 1
    return found.select("image_id", number.alias("contour_id"), "ord", "x", "y")


def contours(edges: DataFrame) -> DataFrame:
    """(image_id, contour_id, n, x1, y1, x2, y2): the numbers and boxes of contour_points()."""
    box = [F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")]
    return contour_points(edges).groupBy("image_id", "contour_id").agg(F.count("*").cast("int").alias("n"), *box)


def text_segments(binary: DataFrame) -> DataFrame:
    """(image_id, h, y, x1, x2): runs of each row that start at black and are closed by too much white or black or the row's end, if they are long enough.

    A run is closed by more than 10 w / 640 black pixels in a row, more than 13 w / 640 white ones or the last pixel, and the closing pixel opens none. So in a stretch of
    black every m-th pixel closes, m being that number and one, and what is open after it stays so for p - 1 white pixels: no state is carried, windows do.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    m, p, black = F.floor(10 * F.col("w") / 640) + 1, F.floor(13 * F.col("w") / 640) + 1, F.col("v") == 0
    own = binary.select("image_id", "w", "h", "y", "x", "v")
    own = own.withColumn("left", F.coalesce(F.max(F.when(~black, F.col("x"))).over(before), F.lit(-1)))  # the last white pixel before
    own = own.withColumn("k", F.when(black, F.col("x") - F.col("left") - 1))  # places in its stretch of black
    own = own.withColumn("b", F.max(F.when(black, F.struct("x", "k"))).over(before))  # the last black pixel before
    open_ = F.coalesce((F.col("b.k") + 1) % m != 0, F.lit(False))  # whether it left a run open
    white = F.col("x") - F.coalesce(F.col("b.x"), F.lit(-1))
    starts = black & (F.col("k") % m == 0) & ~((F.col("k") == 0) & open_ & (white - 1 < p))
    closes = F.when(black, ((F.col("k") + 1) % m == 0) | (F.col("x") == F.col("w") - 1)).otherwise(open_ & ((white == p) | (white < p) & (F.col("x") == F.col("w") - 1)))
    found = own.withColumns({"start": F.max(F.when(starts, F.col("x"))).over(row.rowsBetween(Window.unboundedPreceding, 0)), "closes": closes})
    return found.filter("closes").filter((F.col("x") - F.col("start")) * 640 >= 30 * F.col("w")).select("image_id", "h", "y", F.col("start").alias("x1"), F.col("x").alias("x2"))


def _joined(t: pd.DataFrame) -> pd.DataFrame:
    """An island's segments after merging; path: the order in their line, originals by x, then what was merged, by the line and order it came from."""
    lines: dict[int, list[tuple]] = {}
    for y, x1, x2 in sorted(zip(t["y"].tolist(), t["x1"].tolist(), t["x2"].tolist(), strict=True)):
        lines.setdefault(y, []).append((x1, y, x2, y, [0, x1]))
    h = int(t["h"].iloc[0])
    gap = 6 * h // 640
    for y in sorted(y for y in range(int(t["y"].min()), int(t["y"].max()) + 1) if y < h - gap):
        for w in range(y + 1, y + gap + 1):
            stay, others = [], lines.get(w, [])
            for a in lines.get(y, []):
                at = next((j for j, b in enumerate(others) if a[0] <= b[2] and b[0] <= a[2]), None)
                if at is None:
                    stay.append(a)
                else:
                    b = others.pop(at)
                    others.append((min(a[0], b[0]), a[1], max(a[2], b[2]), b[3], [1, y, *a[4]]))
            lines[y] = stay
    rows = [(t["image_id"].iloc[0], y, *s) for y in lines for s in lines[y]]
    return pd.DataFrame(rows, columns=["image_id", "line", "x1", "y1", "x2", "y2", "path"])


def text_regions(segments: DataFrame) -> DataFrame:
    """(image_id, ord, x1, y1, x2, y2, area): segments (image_id, h, y, x1, x2) joined over lines less than 6 h / 640 apart where they overlap.

    A line's segments, in order, meet those of each following line; one that meets another takes its extent and moves to that line's end, in its place. What is joined never grows
    beyond its island, which more empty lines or any empty column divide from others; an island is a task's group.
    """
    gap, image = F.floor(F.col("h") * 6 / 640), ["image_id"]
    cut = islands(segments.select("image_id", "h", "y", "x1", "x2"), "y", "y", gap, image, "a")
    cut = islands(cut, "x1", "x2", F.lit(0), [*image, "a"], "b")
    cut = islands(cut, "y", "y", gap, [*image, "a", "b"], "c")
    found = cut.groupBy("image_id", "a", "b", "c").applyInPandas(_joined, "image_id long, line int, x1 int, y1 int, x2 int, y2 int, path array<int>")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("line", "path")) - 1
    area = ((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)).cast("long")
    return found.select("image_id", place.alias("ord"), "x1", "y1", "x2", "y2", area.alias("area"))


def crop_regions(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """(image_id, idx, x, y, r, g, b): the pixels inside any of the regions; all others are dark and left out."""
    box = regions.select("image_id", F.explode(F.sequence("y1", "y2")).alias("y"), "x1", "x2")
    met = pixels.join(box, ["image_id", "y"]).filter("x between x1 and x2")
    return met.select("image_id", "idx", "x", "y", "r", "g", "b").distinct()


def crop_contours(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, idx, x, y, r, g, b): the pixels that are points of a contour."""
    return pixels.join(points.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi").select("image_id", "idx", "x", "y", "r", "g", "b")


def otsu(greys: DataFrame) -> DataFrame:
    """(image_id, threshold): the level that splits the image's 256-bin histogram with the greatest variance between the parts, the first of ties."""
    hist = greys.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id").orderBy("v")
    whole = Window.partitionBy("image_id")
    cum = hist.withColumns({"n0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("v")).over(w), "n_all": F.sum("n").over(whole), "s_all": F.sum(F.col("n") * F.col("v")).over(whole)})
    n1 = F.col("n_all") - F.col("n0")
    between = F.when(n1 == 0, 0.0).otherwise(F.pow(F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s_all") - F.col("s0"), n1), F.lit(2)) * F.col("n0") * n1)
    best = cum.withColumn("between", F.round(between, 3)).groupBy("image_id").agg(F.min(F.struct(-F.col("between"), "v")).alias("m"))
    return best.select("image_id", F.col("m.v").alias("threshold"))


def scramble(pixels: DataFrame) -> DataFrame:
    """Pixels between half and all of 0.9 of the circle are reflected through the image's middle by index; later sources win, unwritten ones are 0."""
    dx, dy = F.col("x") - F.col("w") / 2, F.col("idx") / F.col("w") - F.col("h") / 2
    away, most = F.sqrt(dx * dx + dy * dy), F.greatest("w", "h") / 2 * 0.9
    n = F.col("w") * F.col("h")
    to = F.when((away <= most) & (away > most / 2), n - F.col("idx")).otherwise(F.col("idx"))
    moved = pixels.withColumn("to", to).filter(F.col("to") < n).groupBy("image_id", "to").agg(F.max(F.struct("idx", "r", "g", "b")).alias("m"))
    grid = pixels.select("image_id", F.col("idx").alias("to"))
    out = grid.join(moved, ["image_id", "to"], "left")
    return out.select("image_id", F.col("to").alias("idx"), *[F.coalesce(F.col(f"m.{c}"), F.lit(0)).alias(c) for c in "rgb"])


def mask_preview(pixels: DataFrame) -> DataFrame:
    """Pixels beyond 0.95 or within 0.70 of the circle; others are 0."""
    dx, dy = F.col("x") - F.col("w") / 2, F.col("idx") / F.col("w") - F.col("h") / 2
    away, most = F.sqrt(dx * dx + dy * dy), F.greatest("w", "h") / 2
    keep = (away > most * 0.95) | (away < most * 0.70)
    return pixels.select("image_id", "idx", *[F.when(keep, F.col(c)).otherwise(0).alias(c) for c in "rgb"])


def saliency_overlay(pixels: DataFrame, saliency_map: DataFrame) -> DataFrame:
    """(image_id, idx, r, g, b, a): the salient pixels, others transparent black."""
    met = pixels.join(saliency_map.select("image_id", "idx", "sal"), ["image_id", "idx"])
    return met.select("image_id", "idx", *[(F.col(c) * F.col("sal")).alias(c) for c in "rgb"], (F.col("sal") * 255).alias("a"))
