"""The summary of images' colours: choice of k, clamping, merging and roles, for all images at once.

Pixels become a table of colours (a row an image and colour); k-means runs in rounds over all images (kmeans.py), the strategies choose k by
expressions over the errors, and what follows folds an image's few centroids in their order, as arrays in one row an image. All ties go to the earlier row; nothing is random.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, spaces
from ..sources.tables import dealt, drop, written
from . import kmeans
from . import pixels as px


@dataclass(frozen=True)
class Options:
    """strategy: constant (k), elbow (start, end), gap (min_k .. max_k) or one of register_strategy(); space: one of spaces.register(); clamp: percent, or None for none."""

    space: str = "oklab"
    strategy: str = "elbow"
    k: int = 10
    start: tuple[int, ...] = (1, 2, 3, 4)
    end: tuple[int, ...] = (50, 100)
    min_k: int = 1
    max_k: int = 10
    clamp: float | None = 0.005
    saliency_weight: float = 2.0
    trim_percent: float = 2.5
    min_contrast: float = 22.0
    rounds: int = 100


C = F.col
_ALL = 1 << 30
_PAIRS = "array<struct<c:int,cnt:bigint>>"


def colour_table(pixels: DataFrame, o: Options) -> DataFrame:
    """(ref, image_id, c, cnt, rank, n, s, first, ring_n, ring_first, total, colours) of trimmed pixels: all that follows needs no pixels.

    Pixels are dealt by image once, for the saliency; all else is one grouped sum and windows over the same partitions. ref is false.
    """
    return _colour_table(px.packed(px.trim(pixels, o.trim_percent), o.space), o)


def _colour_table(packed: DataFrame, o: Options) -> DataFrame:
    sal = px.saliency(packed, space=o.space)
    rim = px.on_ring(C("idx"), C("w"), C("h"))
    raw = sal.groupBy("image_id", "c").agg(F.count("*").alias("n"), F.sum("sal").alias("s"), F.min("idx").alias("first"), F.count_if(rim).alias("ring_n"), F.min(F.when(rim, C("idx"))).alias("ring_first"))
    image = Window.partitionBy("image_id")
    out = raw.withColumns({"cnt": px.weighted("n", "s", o.saliency_weight), "total": F.sum("n").over(image), "colours": F.count("*").over(image).cast("int"), "ref": F.lit(False)})
    return out.withColumn("rank", F.row_number().over(image.orderBy(F.desc("cnt"), "first")))


def written_colours(pixels: DataFrame, o: Options) -> DataFrame:
    """colour_table() as a written table. The packed pixels are written before it, so that the look for large images doesn't derive them once more."""
    packed = written(px.packed(px.trim(pixels, o.trim_percent), o.space).select("image_id", "w", "h", "idx", "c"), "packed")
    table = written(_colour_table(packed, o), "colours")
    drop(packed)
    return table


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def slope(points: Column) -> Column:
    """Least-squares slope of an array of (k, error); errors beyond 1.5 interquartile ranges are left out of the sums, but counted."""
    ordered, n = F.array_sort(F.transform(points, lambda p: p["error"])), F.size(points)
    at = lambda place: F.element_at(ordered, (F.floor(place) + 1).cast("int"))

    def line(q: Column) -> Column:
        reach = (q["high"] - q["low"]) * 1.5
        kept = F.filter(points, lambda p: p["error"].between(q["low"] - reach, q["high"] + reach))
        sx, sy = _sum(kept, lambda p: p["k"]), _sum(kept, lambda p: p["error"])
        below = n * _sum(kept, lambda p: p["k"] * p["k"]) - sx * sx
        return F.when((n >= 2) & (below != 0), (n * _sum(kept, lambda p: p["k"] * p["error"]) - sx * sy) / below).otherwise(F.lit(0.0))

    return F.when(n == 0, F.lit(0.0)).otherwise(F.transform(F.array(F.struct(at(n / 4).alias("low"), at(n * 3 / 4).alias("high"))), line)[0])


def elbow_k(errors: Column, n: Column, start: tuple[int, ...], end: tuple[int, ...]) -> Column:
    """k where the lines through the first and the last errors meet; n colours, errors: array of (k, error) by k. 0 stands for all colours that aren't alike.

    Few colours: all of them, at most max(start). Lines that meet below 0 give 1.
    """
    of = lambda ks: F.filter(errors, lambda p: p["k"].isin(*ks)) if ks else F.filter(errors, lambda p: F.lit(False))
    whole = F.array(F.struct(n.cast("int").alias("k"), F.lit(0.0).alias("error")))
    early, late = of(start), F.when(n > 2 * end[-1], F.concat(of(end), whole)).otherwise(of(end)) if end else of(end)

    def meet(v: Column) -> Column:
        s, e, a, b = slope(v["early"]), slope(v["late"]), F.get(v["early"], F.lit(0)), F.get(v["late"], F.lit(0))
        k = lambda t: F.least(n.cast("long"), F.ceil((b["error"] - t["e"] * b["k"] - a["error"] + t["s"] * a["k"]) / (t["s"] - t["e"])))
        cross = lambda t: F.when((t["s"] == t["e"]) | F.isnan(t["s"]) | F.isnan(t["e"]), F.lit(1)).otherwise(F.when(k(t) >= 0, k(t)).otherwise(1)).cast("int")
        lines = F.transform(F.array(F.struct(s.alias("s"), e.alias("e"))), cross)[0]
        return F.when((F.size(v["early"]) == 0) | (F.size(v["late"]) == 0), F.least(n, F.lit(max((1, *start)))).cast("int")).otherwise(lines)

    return F.when(n == 1, F.lit(1)).otherwise(F.transform(F.array(F.struct(early.alias("early"), late.alias("late"))), meet)[0])


def uniform_reference(sizes: DataFrame) -> DataFrame:
    """The gap statistic's reference for each number of pixels (image_id), as rows like a colour table's with ref true: an evenly spread list, read two by two."""
    n = C("image_id")
    flat = lambda j: F.when(j < n, F.floor(j * (F.lit(float(0xFFFFFF)) / n) + 0.5)).when(j == n, 1).otherwise(0)
    rows = sizes.select(n, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return rows.select(F.lit(True).alias("ref"), n, (C("i") + 1).cast("int").alias("rank"), flat(C("i") * 2).cast("int").alias("c"), flat(C("i") * 2 + 1).cast("long").alias("cnt"), n.cast("int").alias("colours"))


def _colours(table: DataFrame) -> DataFrame:
    return table.select("ref", "image_id", "rank", "c", "cnt", "colours")


def _images(table: DataFrame) -> DataFrame:
    return table.filter("rank = 1").select("ref", "image_id", "colours", "total")


def _each(ks) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")


def _cents(fitted: DataFrame) -> DataFrame:
    return fitted.select("image_id", C("centroids").alias("cents"))


def with_k(table: DataFrame, k: Column, o: Options) -> DataFrame:
    """(image_id, cents) by k-means with k, an expression over colours and total, for each image."""
    return _cents(kmeans.fits(_colours(table), _images(table).select("ref", "image_id", k.cast("int").alias("k")), o.space, o.rounds))


def _constant(table: DataFrame, o: Options) -> DataFrame:
    return with_k(table, F.lit(o.k), o)


def _elbow(table: DataFrame, o: Options) -> DataFrame:
    colours, images = _colours(table), _images(table)
    probes = kmeans.fits(colours, images.select("ref", "image_id", "colours", _each(sorted({*o.start, *o.end}))).filter("k < colours"), o.space, o.rounds)
    errors = probes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "error"))).alias("errors"))
    chosen = images.join(errors, "image_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<struct<k:int,error:double>>")))
    chosen = written(chosen.select("ref", "image_id", elbow_k(C("errors"), C("colours"), o.start, o.end).alias("k")), "chosen")
    known = probes.join(chosen, ["ref", "image_id", "k"], "left_semi")
    rest = kmeans.fits(colours, chosen.join(probes, ["ref", "image_id", "k"], "left_anti"), o.space, o.rounds)
    return _cents(known.unionByName(rest))


def _gap(table: DataFrame, o: Options) -> DataFrame:
    images = _images(table)
    sizes = written(uniform_reference(images.select(C("total").alias("image_id")).distinct()), "references")
    wanted = images.select("ref", "image_id").union(sizes.select("ref", "image_id").distinct()).select("*", _each(range(o.min_k, o.max_k + 1)))
    fitted = kmeans.fits(_colours(table).unionByName(sizes), wanted, o.space, o.rounds)
    even = fitted.filter("ref").select(C("image_id").alias("total"), "k", C("error").alias("even"))
    own = fitted.filter("not ref").join(images.select("image_id", "total"), "image_id").join(even, ["total", "k"])
    gap = F.when(C("error") == 0, float("inf")).when(C("even") > 0, F.ln("even") - F.ln("error")).otherwise(float("-inf"))
    best = own.groupBy("image_id").agg(F.min(F.struct((-gap).alias("gap"), C("k"), C("centroids"))).alias("m"))
    return best.select("image_id", C("m.centroids").alias("cents"))


Strategy = Callable[[DataFrame, Options], DataFrame]
STRATEGIES: dict[str, Strategy] = {"constant": _constant, "elbow": _elbow, "gap": _gap}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Make a strategy known by a name, for Options: a function of a written colour table (see colour_table) and the options to (image_id, cents), a row an image; with_k() helps."""
    STRATEGIES[name] = strategy


def choice(table: DataFrame, o: Options) -> DataFrame:
    """(image_id, cents: array of (c, cnt)): each image's centroids by the chosen strategy, over a written colour table."""
    if o.strategy not in STRATEGIES:
        raise ValueError(f"no strategy {o.strategy}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[o.strategy](table, o)


def _held(table: DataFrame, cents: DataFrame, *fields: Column | str) -> DataFrame:
    """(image_id, total, v: fields of at most BLOCK colours in any order, near: the colours of the image's centroids)."""
    block = F.floor((C("rank") - 1) / kmeans.BLOCK).cast("int")
    rows = dealt(table, "image_id").groupBy("image_id", block.alias("block")).agg(F.collect_list(F.struct(*fields)).alias("v"), F.first("total").alias("total"))
    return rows.join(cents.select("image_id", F.transform("cents", lambda x: x["c"]).alias("near")), "image_id").select("image_id", "total", "v", "near")


def _missing(measure: arrays.Measure, percent: float):
    """Of each block and centroid: whether it is a common colour there, and else, of the common colours or where there are none of all, the nearest one."""

    def run(batches):
        for batch in batches:
            out, at = [], []
            for i, total in enumerate(batch.column("total").to_pylist()):
                v, near = batch.column("v")[i].values, batch.column("near")[i].values.to_numpy()
                rank, c, cnt = (v.field(x).to_numpy() for x in ("rank", "c", "cnt"))
                often = cnt / total >= percent / 100
                there = np.isin(near, c[often & (cnt > 0)])
                pool = np.flatnonzero(often) if often.any() else np.arange(len(c))
                pool, lost = pool[np.argsort(rank[pool])], np.flatnonzero(~there)
                rows = np.zeros((6, len(near)))
                rows[0], rows[1], rows[2] = np.arange(len(near)), there, not often.any()
                if len(lost):
                    first, d = arrays.nearest(near[lost], c[pool], measure)
                    rows[3:, lost] = d, rank[pool[first]], c[pool[first]]
                out.append(rows)
                at += [i] * len(near)
            ord_, there, rare, d, rank, c = np.concatenate(out, 1) if out else np.zeros((6, 0))
            columns = [pa.array(ord_, pa.int32(), safe=False), pa.array(there > 0), pa.array(rare > 0), pa.array(d), pa.array(rank.astype(np.int32)), pa.array(c.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(at, pa.int64())), *columns], ["image_id", "i", "there", "rare", "d", "rank", "c"])

    return run


def clamp(cents: DataFrame, table: DataFrame, percent: float, space: str) -> DataFrame:
    """cents (image_id, cents) moved to colours of the image with a share of at least `percent`; one that is its own nearest stays."""
    told = _held(table, cents, "rank", "c", "cnt").mapInArrow(_missing(spaces.of(space).measure, percent), "image_id long, i int, there boolean, rare boolean, d double, rank int, c int")
    near = told.groupBy("image_id", "i").agg(F.max("there").alias("there"), F.min(F.struct("rare", "d", "rank", "c")).alias("m")).filter("not there").select("image_id", "i", C("m.c").alias("near"))
    moves = near.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "near"))).alias("moves"))

    def moved(kept: Column, x: Column) -> Column:
        own = F.filter(kept, lambda y: y["c"] == x["c"])[0]["cnt"]
        rest = F.filter(kept, lambda y: y["c"] != x["c"])
        more = F.transform(rest, lambda y: F.when(y["c"] == x["near"], F.struct(y["c"].alias("c"), (y["cnt"] + own).alias("cnt"))).otherwise(y))
        new = F.concat(rest, F.array(F.struct(x["near"].alias("c"), own.alias("cnt"))))
        return F.when(x["near"].isNull() | (x["near"] == x["c"]), kept).otherwise(F.when(F.exists(rest, lambda y: y["c"] == x["near"]), more).otherwise(new))

    to = F.transform("cents", lambda x, i: F.struct(x["c"].alias("c"), F.try_element_at("moves", i).alias("near")))
    return cents.join(moves, "image_id", "left").select("image_id", F.aggregate(F.coalesce(to, F.array().cast("array<struct<c:int,near:int>>")), C("cents"), moved).alias("cents"))


def merged(cents: Column, space: str) -> Column:
    """An array of (c, cnt) where colours within epsilon of each other are one, the most frequent, last in order. A pair that meets groups joins these but isn't added itself."""
    alike = lambda a: lambda b: spaces.distance(a["c"], b["c"], space) < spaces.of(space).epsilon
    pairs = F.flatten(F.transform(cents, lambda a, i: F.transform(F.filter(F.slice(cents, i + 2, _ALL), alike(a)), lambda b: F.struct(a["c"].alias("a"), b["c"].alias("b")))))

    def joined(groups: Column, p: Column) -> Column:
        meets = lambda g: F.array_contains(g, p["a"]) | F.array_contains(g, p["b"])
        met = F.filter(groups, meets)
        one = F.when(F.size(met) > 0, F.array_distinct(F.flatten(met))).otherwise(F.array(p["a"], p["b"]))
        return F.concat(F.filter(groups, lambda g: ~meets(g)), F.array(one))

    groups = F.aggregate(pairs, F.array().cast("array<array<int>>"), joined)

    def one(kept: Column, g: Column) -> Column:
        members = F.filter(F.transform(g, lambda c: F.filter(kept, lambda y: y["c"] == c)[0]), lambda y: y.isNotNull())
        n = F.aggregate(members, F.lit(0).cast("long"), lambda a, y: a + y["cnt"])
        top = F.aggregate(F.slice(members, 2, _ALL), members[0], lambda a, y: F.when(y["cnt"] > a["cnt"], y).otherwise(a))
        key = F.when(top["cnt"] > 0, top["c"]).otherwise(0)
        now = F.struct(key.alias("c"), n.alias("cnt"))
        rest = F.filter(kept, lambda y: ~F.array_contains(g, y["c"]))
        there = F.transform(rest, lambda y: F.when(y["c"] == key, now).otherwise(y))
        return F.when(F.size(members) == 0, kept).otherwise(F.when(F.exists(rest, lambda y: y["c"] == key), there).otherwise(F.concat(rest, F.array(now))))

    return F.aggregate(groups, cents, one)


def contrast(p: Column, q: Column, space: str) -> Column:
    """The contrast of two centroids (structs with c, y and light), as spaces.contrast() has it; the order matters."""
    known = {"light": lambda: F.abs(p["light"] - q["light"]), "luminance": lambda: spaces.contrast_of_luminances(p["y"], q["y"])}
    return known.get(spaces.of(space).contrast_of, lambda: spaces.contrast(p["c"], q["c"], space))()


#: A centroid's fields.
_KIND = "struct<ord:int,c:int,cnt:bigint,rgb:int,light:double,chroma:double,y:double,s:bigint,first:int,rim:bigint,rim_first:int>"


def _measured(rows: DataFrame, space: str) -> DataFrame:
    """rows (c) with rgb, light, chroma and y, APCA's luminance."""
    rgb = rows.withColumns({"rgb": spaces.to_rgb(C("c"), space).cast("int"), "light": spaces.lightness(C("c"), space), "chroma": spaces.chroma(C("c"), space)})
    return rgb.withColumn("y", spaces.luminance(C("rgb")))


def _tallied(measure: arrays.Measure):
    """Of each block of colours what is nearest to each of near, a row for each that is nearest to any."""

    def run(batches):
        room = arrays.Room()
        for batch in batches:
            at, out = [], []
            for i in range(batch.num_rows):
                v, near = batch.column("v")[i].values, batch.column("near")[i].values.to_numpy()
                c, s, first, ring_n, ring_first = (v.field(x).to_numpy() for x in ("c", "s", "first", "ring_n", "ring_first"))
                mine = arrays.Nearest(c, measure, room).places(near.astype(np.int64), np.array([len(near)]))[0]
                least = np.full((2, len(near)), _ALL)
                np.minimum.at(least[0], mine, first)
                np.minimum.at(least[1], mine, ring_first)
                ords = np.flatnonzero(np.bincount(mine, minlength=len(near)))
                out.append(np.stack([ords, *(np.bincount(mine, x, len(near))[ords] for x in (s, ring_n)), *least[:, ords]]).astype(np.int64))
                at += [i] * len(ords)
            ords, s, rim, first, rim_first = np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64)
            keys = [batch.column(x).take(pa.array(at, pa.int64())) for x in ("image_id", "total")]
            sums = [pa.array(ords, pa.int32()), pa.array(s), pa.array(first, pa.int32()), pa.array(rim), pa.array(rim_first, pa.int32())]
            yield pa.RecordBatch.from_arrays([*keys, *sums], ["image_id", "total", "ord", "s", "first", "rim", "rim_first"])

    return run


def zones(cents: DataFrame, table: DataFrame, space: str) -> DataFrame:
    """(image_id, total, all_s, zones: array of centroids as _KIND): what of each image is nearest to each of its centroids; first is null where nothing is.

    Every array ends with three that are not of the image: black, white and the packed colour 0, with ord -3 .. -1.
    """
    held = _held(table, cents, "c", "s", "first", "ring_n", F.coalesce("ring_first", F.lit(_ALL)).alias("ring_first"))
    parts = held.mapInArrow(_tallied(spaces.of(space).measure), "image_id long, total long, ord int, s long, first int, rim long, rim_first int")
    own = parts.groupBy("image_id", "ord").agg(F.sum("s").alias("s"), F.min("first").alias("first"), F.sum("rim").alias("rim"), F.min("rim_first").alias("rim_first"), F.first("total").alias("total"))
    own = own.withColumn("rim_first", F.when(C("rim") > 0, C("rim_first")))
    ends = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(0).cast("long").alias("cnt")) for c in (spaces.of(space).black, spaces.of(space).white, 0)])
    one = cents.select("image_id", F.size("cents").alias("m"), F.posexplode(F.concat("cents", ends)).alias("i", "x"))
    one = _measured(one.select("image_id", F.when(C("i") < C("m"), C("i")).otherwise(C("i") - C("m") - 3).alias("ord"), "x.c", "x.cnt"), space)
    fields = F.struct(*[f.split(":")[0] for f in _KIND[7:-1].split(",")])
    held = one.join(own, ["image_id", "ord"], "left").groupBy("image_id").agg(F.max("total").alias("total"), F.sum("s").alias("all_s"), F.array_sort(F.collect_list(fields)).alias("v"))
    return held.select("image_id", "total", "all_s", F.slice("v", 4, _ALL).alias("zones"), C("v")[0].alias("black"), C("v")[1].alias("white"), C("v")[2].alias("zero"))


def roles(zoned: DataFrame, o: Options) -> DataFrame:
    """zoned with outer, inner, third and accent as centroids, and zones as the choice leaves them, with outside (of the outer pool), a row an image."""
    ratio = lambda p, q: contrast(p, q, o.space)
    pick = lambda values, keep, *order: F.array_min(F.transform(F.filter(values, keep), lambda x: F.struct(*[f(x).alias(f"_{n}") for n, f in enumerate(order)], x.alias("x"))))["x"]
    at = zoned.withColumn("outer", F.coalesce(pick("zones", lambda x: x["rim"] > 0, lambda x: -x["rim"], lambda x: x["rim_first"]), C("zero")))
    share = lambda x: F.when((C("all_s") > 0) & x["first"].isNotNull(), (x["s"] / C("all_s") - x["cnt"] / C("total") + 100) / 2)
    told = F.transform("zones", lambda x: F.struct(share(x).alias("delta"), ratio(C("outer"), x).alias("k"), x.alias("x")))
    at = at.withColumn("told", told)
    far = lambda t: t["k"] >= o.min_contrast
    salient = pick("told", lambda t: far(t) & t["delta"].isNotNull(), lambda t: -t["delta"], lambda t: t["x"]["first"])["x"]
    plain = pick("told", lambda t: far(t) & (t["x"]["c"] != C("outer.c")), lambda t: -t["k"], lambda t: t["x"]["ord"])["x"]
    end = F.when(ratio(C("outer"), C("white")) > ratio(C("outer"), C("black")), C("white")).otherwise(C("black"))
    at = at.withColumns({"found": F.coalesce(salient, plain), "end": end}).withColumn("inner", F.coalesce("found", "end"))

    def put(zones: Column, x: Column, cnt) -> Column:
        """zones with cnt(the count there, 0 if none) for x's colour, in its place or at the end."""
        new = x.withField("cnt", cnt(F.lit(0).cast("long"))).withField("ord", F.size(zones))
        there = F.transform(zones, lambda y: F.when(y["c"] == x["c"], y.withField("cnt", cnt(y["cnt"]))).otherwise(y))
        return F.when(F.exists(zones, lambda y: y["c"] == x["c"]), there).otherwise(F.concat(zones, F.array(new)))

    at = at.withColumn("zones", F.when(C("found").isNull(), put(C("zones"), C("inner"), lambda n: F.lit(1).cast("long"))).otherwise(C("zones")))
    at = at.withColumn("zones", F.when(C("found").isNull(), put(C("zones"), C("outer"), lambda n: n - 1)).otherwise(C("zones")))
    f = F.when(C("inner.light") > C("outer.light"), 0.8).otherwise(1.2)
    outside = lambda x: F.abs(x["light"] - C("inner.light")) * f > F.abs(x["light"] - C("outer.light"))
    at = at.withColumn("zones", F.transform("zones", lambda x: x.withField("outside", outside(x))))
    free = lambda x: (x["c"] != C("outer.c")) & (x["c"] != C("inner.c")) & (x["cnt"] / C("total") >= 0.01)
    height = lambda x: F.when(C("outer.light") > C("inner.light"), 100 - x["light"]).otherwise(x["light"])
    delta = lambda x: F.coalesce(share(x), F.lit(0.0))
    telling = lambda x: x["chroma"] * spaces.distance(x["c"], C("inner.c"), o.space) * x["cnt"] / C("total") * 100 * F.pow(height(x), F.lit(4.0)) * F.pow(delta(x) + 1, F.lit(3.0))
    top = lambda keep, value: pick(F.transform(F.filter("zones", keep), lambda x: F.struct(value(x).alias("v"), x.alias("x"))), lambda t: t["v"] > 0, lambda t: -t["v"], lambda t: t["x"]["ord"])["x"]
    bare = lambda x: x.dropFields("outside")
    at = at.withColumn("accent", F.coalesce(bare(top(lambda x: ~x["outside"] & free(x) & (ratio(C("outer"), x) >= 9), telling)), C("inner")))
    apart = lambda x: F.least(ratio(x, C("inner")), ratio(x, C("accent"))) * x["cnt"] / C("total") * 100
    return at.withColumn("third", F.coalesce(bare(top(lambda x: x["outside"] & free(x), apart)), C("outer")))


def record(picked: DataFrame, space: str) -> DataFrame:
    """A row an image: roles, pools and centroids as RGB ints, contrasts and lightnesses."""
    names = ("outer", "inner", "third", "accent")
    counted = lambda keep: F.transform(F.filter("zones", keep), lambda x: F.struct(x["rgb"].alias("rgb"), x["cnt"].alias("cnt")))
    pairs = [contrast(C(a), C(b), space).alias(f"{a}_{b}") for a, b in (("outer", "inner"), ("outer", "accent"), ("third", "inner"), ("third", "accent"))]
    pools = [counted(lambda x: x["outside"]).alias("outer_colors"), counted(lambda x: ~x["outside"]).alias("inner_colors"), counted(lambda x: F.lit(True)).alias("centroids")]
    return picked.select("image_id", *[C(f"{n}.rgb").alias(n) for n in names], *pools, F.struct(*pairs).alias("contrasts"), F.struct(*[C(f"{n}.light").alias(n) for n in names]).alias("lightnesses"))


def chosen_centroids(table: DataFrame, o: Options, clamped: bool = True, merge: bool = True) -> DataFrame:
    """(image_id, cents: array of (c, cnt)): the strategy's centroids over a written colour table, clamped and merged if asked for."""
    cents = choice(table, o)
    if clamped and o.clamp is not None:
        cents = clamp(cents, table, o.clamp, o.space)
    return dealt(cents).select("image_id", merged(C("cents"), o.space).alias("cents")) if merge else cents


def extract_colors(pixels: DataFrame, o: Options = Options()) -> DataFrame:
    """A row an image: its roles, pools and centroids as RGB ints."""
    table = written_colours(pixels, o)
    cents = written(chosen_centroids(table, o), "cents")
    zoned = written(dealt(zones(cents, table, o.space)), "zones")  # in many files, so that many tasks read them
    return record(roles(zoned, o), o.space)


def fits(pixels: DataFrame, ks: tuple[int, ...], o: Options = Options()) -> DataFrame:
    """(image_id, k, wcss, ord, c, cnt): k-means of each image's weighted histogram, a row a centroid."""
    table = written_colours(pixels, o)
    wanted = table.filter("rank = 1").select("ref", "image_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    fitted = kmeans.fits(table.select("ref", "image_id", "rank", "c", "cnt", "colours"), wanted, o.space, o.rounds)
    return fitted.select("image_id", "k", C("error").alias("wcss"), F.posexplode("centroids").alias("ord", "x")).select("image_id", "k", "wcss", "ord", "x.c", "x.cnt")


def chosen(pixels: DataFrame, o: Options, clamped: bool = False, merged: bool = False) -> DataFrame:
    """(image_id, ord, c, cnt): the strategy's centroids, clamped and merged if asked for."""
    cents = chosen_centroids(written_colours(pixels, o), o, clamped, merged)
    return cents.select("image_id", F.posexplode("cents").alias("ord", "x")).select("image_id", "ord", "x.c", "x.cnt")
