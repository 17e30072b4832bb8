"""Operators on pixels (image_id, w, h, idx, x, y, ...): projections, grouped sums, joins and windows, and a pyramid over tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spaces
from ..sources.tables import dealt, drop, written


def trim(pixels: DataFrame, percent: float = 2.5) -> DataFrame:
    """Without a border of so many percent, re-indexed to the new size."""
    at = lambda side, p: F.floor(F.col(side) * F.lit(p) + 0.5).cast("int")
    low, high = percent / 100, 1 - percent / 100
    x0, x1, y0, y1 = at("w", low), at("w", high), at("h", low), at("h", high)
    inside = pixels.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    rest = [c for c in pixels.columns if c not in ("image_id", "w", "h", "idx", "x", "y")]
    x, y = F.col("x") - x0, F.col("y") - y0
    return inside.select("image_id", (x1 - x0).alias("w"), (y1 - y0).alias("h"), (y * (x1 - x0) + x).cast("int").alias("idx"), x.alias("x"), y.alias("y"), *rest)


def packed(pixels: DataFrame, space: str = "oklab") -> DataFrame:
    """With c, the packed colour."""
    return spaces.with_packed(pixels, space)


def grey(pixels: DataFrame, space: str = "oklab") -> DataFrame:
    """With v, the distance to black as a byte."""
    return pixels.withColumn("v", spaces.clamped_byte(spaces.distance(F.col("c"), F.lit(spaces.of(space).black), space)))


SIDE = 512  # pixels along a tile, a power of two, so that the 2 by 2 cells of all levels up to the tile's own lie within it
_TILE = ["image_id", "ty", "tx"]


def _tiles(greys: DataFrame, side: int, *carried: str) -> DataFrame:
    y, x = (F.expr(e).cast("int") for e in (f"(idx div w) div {side}", f"(idx % w) div {side}"))
    return greys.select("image_id", "w", "h", "idx", "v", *carried, y.alias("ty"), x.alias("tx"))


def _halvings(v: np.ndarray, levels: int) -> list[np.ndarray]:
    """An image, or a tile of one, and its halvings by means of 2 by 2, halves to even; a row or column without a partner is left out."""
    out = [v]
    for _ in range(levels):
        h, w = v.shape[0] // 2, v.shape[1] // 2
        v = np.rint(v[: 2 * h, : 2 * w].reshape(h, 2, w, 2).sum((1, 3)) / 4).astype(np.int32)
        out.append(v)
    return out


class _Tile:
    """The pixels of one tile as an array, with the halvings that it holds whole."""

    def __init__(self, t: pd.DataFrame | dict[str, np.ndarray], side: int):
        self.image, self.w, self.h, self.ty, self.tx = (int(np.asarray(t[c])[0]) for c in ("image_id", "w", "h", "ty", "tx"))
        self.levels, self.alone = min(self.w, self.h).bit_length() - 1, max(self.w, self.h) <= side
        self.inner = min(self.levels, side.bit_length() - 1)
        self.y0, self.x0 = self.ty * side, self.tx * side
        self.y, self.x = np.divmod(np.asarray(t["idx"]), self.w)
        v = np.zeros((min(side, self.h - self.y0), min(side, self.w - self.x0)), np.int32)
        v[self.y - self.y0, self.x - self.x0] = np.asarray(t["v"])
        self.halvings = _halvings(v, self.inner)

    def cells(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and values of a level's cells, counted within the whole image."""
        v = self.halvings[level]
        row, col = np.divmod(np.arange(v.size), max(v.shape[1], 1))
        return row + (self.y0 >> level), col + (self.x0 >> level), v.ravel()

    def differences(self, edges: dict, above: dict) -> np.ndarray:
        """Each pixel's mean difference to the coarser levels. edges: by level, the first column's cells one row below each of the tile's; above: by level, the one cell about the tile."""
        v = self.halvings[0]
        total = np.zeros(v.shape)
        for k in range(1, self.inner + 1):
            cells = self.halvings[k]
            row, col = np.arange(v.shape[0]) >> k, np.arange(v.shape[1]) >> k
            a, b = np.count_nonzero(row < cells.shape[0]), np.count_nonzero(col < cells.shape[1])
            total[:a, :b] += np.abs(v[:a, :b] - cells[row[:a, None], col[None, :b]])
            if b < v.shape[1]:
                first = cells[1:, 0] if self.alone else edges.get(k, np.zeros(0, np.int32))
                a = np.count_nonzero(row < len(first))
                total[:a, b:] += np.abs(v[:a, b:] - first[row[:a], None])
        for value in above.values():
            total += np.abs(v - value)
        return np.clip(np.rint(total / max(self.levels, 1)), 0, 255).astype(np.int32)


def _shared_cells(greys: DataFrame, side: int) -> DataFrame:
    """(image_id, w, h, level, row, col, v): the cells of large images that other tiles need: first columns, and tiles as cells of the level that is their own size."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(t, side)
        out = [pd.DataFrame({"level": np.zeros(0, np.int32), "row": 0, "col": 0, "v": 0})]
        for k in range(1, tile.inner + 1):
            row, col, v = tile.cells(k)
            kept = (col == 0) | (1 << k == side)
            out.append(pd.DataFrame({"level": k, "row": row[kept], "col": col[kept], "v": v[kept]}))
        return pd.concat(out).assign(image_id=tile.image, w=tile.w, h=tile.h)

    return _tiles(greys, side).groupBy(_TILE).applyInPandas(one, "image_id long, w int, h int, level int, row int, col int, v int")


def _coarser(cells: DataFrame, side: int, by_tile: bool) -> DataFrame:
    """The levels above a tile's, from tiles as cells: an image has side * side times fewer of these than pixels (8,192 of the 2**31 that idx can count), so it is one group.

    by_tile: (image_id, ty, tx, level, row, v), the cell that each tile's pixels meet; else (image_id, level, pidx, v).
    """
    n = side.bit_length() - 1

    def one(t: pd.DataFrame) -> pd.DataFrame:
        w, h, image = int(t["w"].iloc[0]), int(t["h"].iloc[0]), t["image_id"].iloc[0]
        v = np.zeros((h >> n, w >> n), np.int32)
        v[t["row"].to_numpy(), t["col"].to_numpy()] = t["v"].to_numpy()
        ty, tx = (i.ravel() for i in np.indices((-(-h // side), -(-w // side))))
        out = []
        for k, coarse in enumerate(_halvings(v, min(w, h).bit_length() - 1 - n)[1:], 1):
            if by_tile:
                at = (ty >> k) * coarse.shape[1] + (tx >> k)
                there = at < coarse.size
                out.append(pd.DataFrame({"ty": ty[there], "tx": tx[there], "level": n + k, "row": 0, "v": coarse.ravel()[at[there]]}))
            else:
                out.append(pd.DataFrame({"level": n + k, "pidx": np.arange(coarse.size), "v": coarse.ravel()}))
        return pd.concat(out).assign(image_id=image)

    kinds = "image_id long, ty int, tx int, level int, row int, v int" if by_tile else "image_id long, level int, pidx int, v int"
    return cells.filter((F.col("level") == n) & (F.least("w", "h") >= 2 * side)).groupBy("image_id").applyInPandas(one, kinds)


def pyramid(greys: DataFrame, side: int = SIDE) -> DataFrame:
    """(image_id, level, pidx, v): floor(log2(min(w, h))) levels above the image itself, level 0.

    A level needs the rounded one before it, so a plan of grouped sums has a shuffle for each. Tiles of side by side pixels hold that many levels whole
    and are dealt to tasks by themselves; what lies above is made of tiles as cells.
    """

    def one(t: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(t, side)
        out = []
        for k in range(tile.inner + 1):
            row, col, v = tile.cells(k)
            out.append(pd.DataFrame({"image_id": tile.image, "level": k, "pidx": row * (tile.w >> k) + col, "v": v}))
        return pd.concat(out)

    within = _tiles(greys, side).groupBy(_TILE).applyInPandas(one, "image_id long, level int, pidx int, v int")
    return within.unionByName(_coarser(_shared_cells(greys.filter(F.least("w", "h") >= 2 * side), side), side, by_tile=False))


def _met_elsewhere(large: DataFrame, cells: DataFrame, side: int) -> DataFrame:
    """(image_id, ty, tx, level, row, v): what the tiles of large images need from others; level 0 is the image's greatest difference."""
    n = side.bit_length() - 1
    below = (F.col("row") - 1).alias("row")
    ty = F.expr(f"shiftright(row - 1, {n} - level)").alias("ty")
    tx = F.expr(f"(w - 1) div {side}").cast("int").alias("tx")
    edges = cells.filter("col = 0 and row > 0 and w % shiftleft(1, level) > 0").select("image_id", ty, tx, "level", below, "v")
    met = edges.unionByName(_coarser(cells, side, by_tile=True))

    def greatest(t: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(t, side)
        return pd.DataFrame({"image_id": [tile.image], "ty": tile.ty, "tx": tile.tx, "v": tile.differences(*_parts(others, side)).max()})

    tops = _tiles(large, side).groupBy(_TILE).cogroup(met.groupBy(_TILE)).applyInPandas(greatest, "image_id long, ty int, tx int, v int")
    top = F.max("v").over(Window.partitionBy("image_id"))  # a row a tile
    zero = F.lit(0)
    return met.unionByName(tops.select(*_TILE, zero.alias("level"), zero.alias("row"), top.alias("v")))


def _parts(others: pd.DataFrame, side: int) -> tuple[dict, dict]:
    """What _met_elsewhere gave one tile, as edges and above of _Tile.differences."""
    n = side.bit_length() - 1
    inner = others[(others["level"] > 0) & (others["level"] <= n)].sort_values(["level", "row"])
    outer = others[others["level"] > n]
    return {k: g["v"].to_numpy() for k, g in inner.groupby("level")}, dict(zip(outer["level"], outer["v"]))


def _by_tile(one, columns: list[str], finish):
    """A mapInArrow function over rows that are sorted by tile: one(rows of a tile as arrays, completed by finish(rows of a batch)) gives arrays by name. A partition has many tiles, so that none of
    them costs a stream, a frame and a conversion of its own; no more than a tile and a batch is held.
    """

    def joined(pieces: list[dict]) -> dict:
        return pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = finish({c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns})
            keys = np.stack([rows[c] for c in _TILE])
            if held and any(held[-1][c][-1] != k for c, k in zip(_TILE, keys[:, 0], strict=True)):
                yield pa.RecordBatch.from_pydict(one(joined(held)))
                held = []
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            parts = [{c: x[a:b] for c, x in rows.items()} for a, b in zip(edges, edges[1:])]
            held.append(parts[0])
            if len(parts) > 1:
                done = [one(joined(held)), *map(one, parts[1:-1])]
                held = [parts[-1]]
                yield pa.RecordBatch.from_pydict(joined(done))
        if held:
            yield pa.RecordBatch.from_pydict(one(joined(held)))

    return run


def saliency(greys: DataFrame, side: int = SIDE, space: str | None = None) -> DataFrame:
    """(image_id, idx, d, sal): d is the mean difference to the coarser levels, sal 1 where 2 d passes the image's greatest d.

    A pixel meets a level by flat index, which on widths that don't halve evenly is a cell of the next row; cells that a
    level lacks count as no difference. Images of one row or column have d 0. A column c is carried along; with a space, v need not be there and is made of it, as by grey().

    An image within side by side pixels is one tile and needs no other. Of larger ones a job first writes the cells that tiles need of each other; where
    there are none, tiles are all there is, and else each meets its own of these.
    """
    carried = ["c"] if "c" in greys.columns else []
    ready = "v" in greys.columns

    def judged(t: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(t, side)
        d = tile.differences(*_parts(others, side))
        top = d.max() if others.empty else others["v"][others["level"] == 0].iloc[0]
        d = d[tile.y - tile.y0, tile.x - tile.x0]
        return pd.DataFrame({"image_id": t["image_id"], "idx": t["idx"], "d": d, "sal": (2 * d > top).astype(np.int32), "c": t["c"] if carried else 0, "w": t["w"], "h": t["h"]})

    def alone(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        tile = _Tile(t, side)
        d = tile.differences({}, {})
        sal = (2 * d > d.max()).astype(np.int32)
        at = tile.y - tile.y0, tile.x - tile.x0
        return {"image_id": t["image_id"], "idx": t["idx"], "d": d[at], "sal": sal[at], "c": t["c"] if carried else np.zeros(len(at[0]), np.int32), "w": t["w"], "h": t["h"]}

    kinds = "image_id long, idx int, d int, sal int, c int, w int, h int"
    large = greys.filter(F.greatest("w", "h") > side)
    cells = written(_shared_cells(large if ready else grey(large, space), side), "cells")
    if cells.isEmpty():
        drop(cells)
        measure, black = (None, 0) if ready else (spaces.of(space).measure, spaces.of(space).black)

        def finish(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            if ready:
                return rows
            d = measure.between(measure.fields(rows["c"]), measure.fields(np.array([black])))
            return rows | {"v": np.clip(np.rint(np.nan_to_num(d)), 0, 255).astype(np.int32)}

        y, x = (F.expr(e).cast("int") for e in (f"(idx div w) div {side}", f"(idx % w) div {side}"))
        columns = ["image_id", "w", "h", "idx", *(["v"] if ready else []), *carried, "ty", "tx"]
        tiles = dealt(greys.select(*columns[:-2], y.alias("ty"), x.alias("tx")), *_TILE).sortWithinPartitions(*_TILE)
        out = tiles.mapInArrow(_by_tile(alone, columns, finish), kinds)
    else:
        whole = greys if ready else grey(greys, space)
        out = _tiles(whole, side, *carried).groupBy(_TILE).cogroup(_met_elsewhere(large if ready else grey(large, space), cells, side).groupBy(_TILE)).applyInPandas(judged, kinds)
    return out.select("image_id", "idx", "d", "sal", *(["c", "w", "h"] if carried else []))


def weighted(n: str, s: str, weight: float):
    """Counts of colours with salient pixels counting weight more, scaled back to the image's pixels."""
    image = Window.partitionBy("image_id")
    total, salient = F.sum(n).over(image), F.sum(s).over(image)
    return F.floor((F.col(n) + F.col(s) * F.lit(weight)) / (total + salient * F.lit(weight)) * total + 0.5)


def histogram(pixels: DataFrame, saliency_map: DataFrame | None = None, weight: float = 2.0) -> DataFrame:
    """(image_id, c, cnt, first_idx, rank): pixels a colour, salient ones counting weight more, scaled back to the pixels' number.

    rank is by count, ties by first appearance.
    """
    if saliency_map is not None and "c" in saliency_map.columns:
        raw = saliency_map.groupBy("image_id", "c").agg(F.count("*").alias("n"), F.sum("sal").alias("s"), F.min("idx").alias("first_idx"))
        hist = raw.select("image_id", "c", weighted("n", "s", weight).alias("cnt"), "first_idx")
    elif saliency_map is None:
        hist = pixels.groupBy("image_id", "c").agg(F.count("*").alias("cnt"), F.min("idx").alias("first_idx"))
    else:
        met = pixels.join(saliency_map.select("image_id", "idx", "sal"), ["image_id", "idx"])
        raw = met.groupBy("image_id", "c").agg(F.count("*").alias("n"), F.sum("sal").alias("s"), F.min("idx").alias("first_idx"))
        hist = raw.select("image_id", "c", weighted("n", "s", weight).alias("cnt"), "first_idx")
    by_rank = Window.partitionBy("image_id").orderBy(F.desc("cnt"), "first_idx")
    return hist.withColumn("rank", F.row_number().over(by_rank))


def ring(pixels: DataFrame) -> DataFrame:
    """The pixels outside 0.95 of the circle about the image; y counts with its fraction of a row."""
    return pixels.filter(on_ring(F.col("idx"), F.col("w"), F.col("h")))


def on_ring(idx, w, h):
    dx, dy = idx % w - w / 2, idx / w - h / 2
    return F.sqrt(dx * dx + dy * dy) > F.greatest(w, h) / 2 * 0.95


def assign(colours: DataFrame, centroids: DataFrame, space: str = "oklab") -> DataFrame:
    """colours (image_id, c, ...) with ord and cent, the nearest of the image's centroids (image_id, ord, cent), and its distance d, ties to the first.

    Centroids are few an image: they meet the colours as one array, and each row keeps its least.
    """
    few = centroids.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "cent"))).alias("_cents"))
    met = colours.join(few, "image_id")
    least = F.array_min(F.transform("_cents", lambda x: F.struct(spaces.distance(F.col("c"), x["cent"], space).alias("d"), x["ord"].alias("ord"), x["cent"].alias("cent"))))
    return met.select(*colours.columns, least.alias("_m")).select(*colours.columns, F.col("_m.ord").alias("ord"), F.col("_m.cent").alias("cent"), F.col("_m.d").alias("d"))


def top_centroids(hist: DataFrame, k: int = 8) -> DataFrame:
    """(image_id, ord, cent, cnt): the k most frequent colours as centroids."""
    return hist.filter(F.col("rank") <= k).select("image_id", F.col("rank").alias("ord"), F.col("c").alias("cent"), "cnt")


def centroid_means(assigned: DataFrame) -> DataFrame:
    """(image_id, ord, mean, wsum): the packed channel means of each cluster, weighted by cnt; weight 0 gives 0."""
    w = F.sum("cnt")
    means = [F.when(w == 0, 0).otherwise(spaces.nearest_int(F.try_divide(F.sum(x * F.col("cnt")), w))) for x in spaces.channels(F.col("c"))]
    return assigned.groupBy("image_id", "ord").agg(spaces.pack(*means).alias("mean"), w.alias("wsum"))


def outer_colour(table: DataFrame, centroids: DataFrame, space: str = "oklab") -> DataFrame:
    """(image_id, outer): the centroid nearest to most of the ring's pixels, ties to the one met first. table: colours with ring_n, ring_first."""
    tally = table.filter("ring_n > 0").select("image_id", "c", F.col("ring_n").alias("n"), F.col("ring_first").alias("first"))
    zones = assign(tally, centroids, space).groupBy("image_id", "cent").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return zones.groupBy("image_id").agg(F.min(F.struct(-F.col("n"), "first", "cent")).alias("m")).select("image_id", F.col("m.cent").alias("outer"))


def saliency_share(table: DataFrame, centroids: DataFrame, space: str = "oklab") -> DataFrame:
    """(image_id, cent, delta, first): ((share of the salient pixels) - (share of the pixels) + 100) / 2; none without salient pixels. table: colours with s, first, total."""
    near = assign(table.select("image_id", "c", "s", "first", "total"), centroids, space).groupBy("image_id", "cent").agg(F.sum("s").alias("s"), F.min("first").alias("first"), F.first("total").alias("total"))
    all_s = F.sum("s").over(Window.partitionBy("image_id"))
    out = near.withColumn("all_s", all_s).filter("all_s > 0").join(centroids.select("image_id", "cent", "cnt"), ["image_id", "cent"])
    delta = (F.col("s") / F.col("all_s") - F.col("cnt") / F.col("total") + 100) / 2
    return out.select("image_id", "cent", delta.alias("delta"), "first")


def near_duplicates(centroids: DataFrame, space: str = "oklab") -> DataFrame:
    """(image_id, a, b, d): pairs of an image's centroids, in their order, that are nearer than the space's epsilon."""
    a = centroids.select("image_id", F.col("ord").alias("a"), F.col("cent").alias("p"))
    b = centroids.select("image_id", F.col("ord").alias("b"), F.col("cent").alias("q"))
    return a.join(b, "image_id").filter("a < b").withColumn("d", spaces.distance(F.col("p"), F.col("q"), space)).filter(F.col("d") < spaces.of(space).epsilon).select("image_id", "a", "b", "d")
