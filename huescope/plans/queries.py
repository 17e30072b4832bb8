"""The registered queries of the colour engine: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import conversions, names, spaces
from ..operators import clusters, kmeans, regions
from ..operators import pixels as px
from ..sources.images import derived_pixels, pixels_of, read_images
from ..sources.png import images_of, write_images
from ..sources.tables import scratch, written

C = F.col
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def whole(spark: SparkSession, d: str) -> DataFrame:
    return derived_pixels(spark, d)


def smooth(spark: SparkSession, d: str) -> DataFrame:
    """The same images with their pixels in the order of their luma: flat areas with an edge between."""
    return derived_pixels(spark, d, structured=True)


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Larger images, an image for sixteen suppliers, wide enough for runs of text."""
    return derived_pixels(spark, d, "l_suppkey div 16", 64)


def trimmed(spark: SparkSession, d: str, space: str = "oklab") -> DataFrame:
    return px.packed(px.trim(whole(spark, d)), space)


def salient(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = trimmed(spark, d)
    return own, px.saliency(px.grey(own))


def centroids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the colour table, written once, with salient colours weighing more; its eight most frequent colours as centroids)."""
    table = written(clusters.colour_table(whole(spark, d), clusters.Options()), "colours")
    return table, px.top_centroids(table)


def r6(c):
    return F.round(c, 6)


@query
def pixels_trim(spark, d):
    return px.trim(whole(spark, d))


@query
def pack_rgb(spark, d):
    return trimmed(spark, d, "rgb").select("image_id", "idx", "c")


@query
def pack_oklab(spark, d):
    return trimmed(spark, d).select("image_id", "idx", "c")


@query
def pack_lab(spark, d):
    return trimmed(spark, d, "lab").select("image_id", "idx", "c")


@query
def unpack_lab(spark, d):
    return trimmed(spark, d, "lab").select("image_id", "idx", spaces.unpack_lab(C("c")).alias("rgb"))


@query
def unpack_oklab(spark, d):
    return trimmed(spark, d).select("image_id", "idx", spaces.unpack_oklab(C("c")).alias("rgb"))


def _measure(name, space, of):
    digits = 3 if (name, space) == ("lightness", "rgb") else 6  # of millions

    def run(spark, d):
        return trimmed(spark, d, space).select("image_id", "idx", F.round(of(space), digits).alias("value"))

    QUERIES[f"{name}_{space}"] = run


for _space in ("rgb", "oklab", "lab"):
    _measure("distance", _space, lambda s: spaces.distance(C("c"), spaces.to_packed(F.lit(200), F.lit(100), F.lit(50), s), s))
    _measure("lightness", _space, lambda s: spaces.lightness(C("c"), s))
    _measure("chroma", _space, lambda s: spaces.chroma(C("c"), s))
    _measure("contrast", _space, lambda s: spaces.contrast(F.lit(spaces.BLACK[s]), C("c"), s))


@query
def conv_oklch(spark, d):
    lab = trimmed(spark, d).withColumn("lab", spaces.lab_of(C("r"), C("g"), C("b")))
    chroma, hue = F.sqrt(C("lab")[1] * C("lab")[1] + C("lab")[2] * C("lab")[2]), F.pmod(F.degrees(F.atan2(C("lab")[2], C("lab")[1])), F.lit(360.0))
    return lab.select("image_id", "idx", r6(chroma).alias("chroma"), F.when(chroma > 1e-6, F.round(hue, 3)).alias("hue"))


@query
def standard_oklch(spark, d):
    """Lightness, chroma and hue of each colour by the standard conversions, and the RGB that they give back."""
    colours = trimmed(spark, d, "rgb").groupBy("image_id", "c").agg(F.count("*").alias("n"))
    there = colours.withColumn("lch", conversions.convert(conversions.bytes_to_unit(C("c")), "rgb", "oklch"))
    back = conversions.unit_to_bytes(conversions.convert([C("lch")[i] for i in range(3)], "oklch", "rgb"))
    return there.select("image_id", "c", "n", r6(C("lch")[0]).alias("lightness"), r6(C("lch")[1]).alias("chroma"), F.round(C("lch")[2], 3).alias("hue"), back.alias("back"))


@query
def standard_xyz(spark, d):
    """Linear light and tristimulus values of each colour, from its oklab values."""
    colours = trimmed(spark, d, "rgb").select("image_id", "c").distinct()
    lab = conversions.convert(conversions.bytes_to_unit(C("c")), "rgb", "oklab")
    both = colours.withColumn("lab", lab).withColumn("xyz", conversions.convert([C("lab")[i] for i in range(3)], "oklab", "xyz"))
    both = both.withColumn("linear", conversions.convert([C("xyz")[i] for i in range(3)], "xyz", "linear"))
    return both.select("image_id", "c", *[r6(C(n)[i]).alias(f"{n}{i}") for n in ("lab", "xyz", "linear") for i in range(3)])


def _contrasted(name, space, desired):
    def run(spark, d):
        """Each of the eight most frequent colours read on the first, moved towards white until the contrast is enough."""
        cents = px.top_centroids(px.histogram(trimmed(spark, d, space)))
        first = cents.filter("ord = 1").select("image_id", C("cent").alias("ground"))
        white = F.lit(spaces.WHITE[space])
        return cents.join(first, "image_id").select("image_id", "ord", "cent", spaces.increase_contrast(C("cent"), C("ground"), white, F.lit(desired), space).alias("moved"))

    QUERIES[name] = run


_contrasted("increase_contrast_rgb", "rgb", 40.0)
_contrasted("increase_contrast_oklab", "oklab", 40.0)


@query
def grayscale_distance(spark, d):
    return px.grey(trimmed(spark, d)).select("image_id", "idx", "v")


@query
def grayscale_luma(spark, d):
    return regions.luma(whole(spark, d)).select("image_id", "idx", "v")


@query
def pyramid_all(spark, d):
    return px.pyramid(px.grey(trimmed(spark, d)))


@query
def saliency_mask(spark, d):
    return salient(spark, d)[1].select("image_id", "idx", "d", "sal")


@query
def hist_unweighted(spark, d):
    return px.histogram(trimmed(spark, d)).select("image_id", "c", "cnt", "first_idx")


@query
def hist_weighted(spark, d):
    return px.histogram(*salient(spark, d)).select("image_id", "c", "cnt", "first_idx")


@query
def hist_rank(spark, d):
    return px.histogram(*salient(spark, d)).select("image_id", "c", "rank")


@query
def distinct_colors(spark, d):
    return trimmed(spark, d).groupBy("image_id").agg(F.count_distinct("c").alias("n"))


@query
def top_colors(spark, d):
    """The five most frequent colours of each image, as hex."""
    rgb = px.histogram(trimmed(spark, d, "rgb")).filter("rank <= 5")
    return rgb.select("image_id", "rank", spaces.hex_string(C("c")).alias("hex"), "cnt")


def _assigned(spark, d):
    table, cents = centroids(spark, d)
    return px.assign(table.select("image_id", "c", "cnt"), cents)


@query
def nearest_seed_assign(spark, d):
    return _assigned(spark, d).select("image_id", "c", "cnt", "ord", r6(C("d")).alias("d"))


@query
def centroid_update(spark, d):
    return px.centroid_means(_assigned(spark, d))


@query
def wcss_step(spark, d):
    return _assigned(spark, d).groupBy("image_id").agg(r6(F.sum(C("d") * C("d") * C("cnt")) / F.sum("cnt")).alias("wcss"))


@query
def near_duplicate_pairs(spark, d):
    return px.near_duplicates(centroids(spark, d)[1]).withColumn("d", r6(C("d")))


@query
def border_ring(spark, d):
    return px.ring(trimmed(spark, d)).select("image_id", "idx", "c")


@query
def border_tally(spark, d):
    return px.outer_colour(*centroids(spark, d))


@query
def saliency_share(spark, d):
    return px.saliency_share(*centroids(spark, d)).withColumn("delta", r6(C("delta")))


def _picks(spark, d):
    """A row for each image and fixed centroid: ord, cent, and outer, inner, pool, accent, third of the image.

    One table of colours is enough: each colour goes to its nearest centroid once, and all choices are windows over an image's few centroids.
    """
    table, cents = centroids(spark, d)
    near = px.assign(table, cents)
    own = near.groupBy("image_id", "ord", "cent").agg(
        F.sum("cnt").alias("weight"), F.max(F.when(C("c") == C("cent"), C("cnt"))).alias("cnt"), F.sum("s").alias("s"), F.min("first").alias("first"),
        F.sum("ring_n").alias("rim"), F.min("ring_first").alias("rim_first"), F.first("total").alias("total"),
    )
    image, light = Window.partitionBy("image_id"), lambda c: spaces.lightness(C(c), "oklab")
    contrast = lambda a, b: spaces.contrast_of_luminances(C(f"{a}.y"), C(f"{b}.y"))
    least = lambda when, *order: F.min(F.when(when, F.struct(*order, C("me").alias("me")))).over(image)["me"]
    own = own.withColumn("me", F.struct("cent", spaces.luminance(spaces.unpack_oklab(C("cent"))).alias("y")))
    own = own.withColumns({"_outer": least(C("rim") > 0, -C("rim"), C("rim_first")), "all_s": F.sum("s").over(image)}).filter("_outer is not null").withColumn("outer", C("_outer.cent"))
    delta = F.when(C("all_s") > 0, (C("s") / C("all_s") - C("cnt") / C("total") + 100) / 2)
    own = own.withColumns({"delta": delta, "k": contrast("_outer", "me")})
    ends = [F.struct(F.lit(x).alias("cent"), spaces.luminance(spaces.unpack_oklab(F.lit(x))).alias("y")) for x in (spaces.WHITE["oklab"], spaces.BLACK["oklab"])]
    own = own.withColumns({"_white": ends[0], "_black": ends[1]})
    last = F.when(contrast("_outer", "_white") > contrast("_outer", "_black"), C("_white")).otherwise(C("_black"))
    far = C("k") >= 22
    own = own.withColumn("_inner", F.coalesce(least(far & C("delta").isNotNull(), -C("delta"), C("first")), least(far & (C("cent") != C("outer")), -C("k"), C("ord")), last)).withColumn("inner", C("_inner.cent"))
    f = F.when(light("inner") > light("outer"), 0.8).otherwise(1.2)
    outside = F.abs(light("cent") - light("inner")) * f > F.abs(light("cent") - light("outer"))
    part = C("weight") / C("total")
    free = (C("cent") != C("outer")) & (C("cent") != C("inner")) & (part >= 0.01)
    own = own.withColumns({"pool": F.when(outside, "outer").otherwise("inner"), "part": part, "free": free})
    height = F.when(light("outer") > light("inner"), 100 - light("cent")).otherwise(light("cent"))
    telling = spaces.chroma(C("cent"), "oklab") * spaces.distance(C("cent"), C("inner"), "oklab") * C("part") * 100 * F.pow(height, F.lit(4)) * F.pow(F.coalesce("delta", F.lit(0.0)) + 1, F.lit(3))
    own = own.withColumn("telling", F.when(C("free") & (C("pool") == "inner") & (C("k") >= 9), telling))
    own = own.withColumn("_accent", F.coalesce(least(C("telling") > 0, -C("telling"), C("ord")), C("_inner"))).withColumn("accent", C("_accent.cent"))
    apart = F.least(contrast("me", "_inner"), contrast("me", "_accent")) * C("part") * 100
    own = own.withColumn("apart", F.when(C("free") & (C("pool") == "outer"), apart))
    return own.withColumn("third", F.coalesce(least(C("apart") > 0, -C("apart"), C("ord")), C("_outer"))["cent"])


def _by_image(name, *columns):
    QUERIES[name] = lambda spark, d: _picks(spark, d).filter("ord = 1").select("image_id", *columns)


_by_image("foreground_pick", "outer", "inner")
_by_image("accent_pick", "outer", "inner", "accent")
_by_image("third_pick", "third")


@query
def pool_split(spark, d):
    return _picks(spark, d).select("image_id", "cent", "pool")


@query
def seed_colours(spark, d):
    """The first six colours by rank that are not alike."""
    own = px.histogram(*salient(spark, d)).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "c")))["c"].alias("all"))
    return own.select("image_id", F.posexplode(kmeans.seeds(C("all"), F.lit(6), "oklab")).alias("ord", "c")).select("image_id", (C("ord") + 1).alias("ord"), "c")


@query
def clamp_nearest(spark, d):
    """The centroids of one update, moved to the image's colours of at least 0.3 percent."""
    table, cents = centroids(spark, d)
    means = px.centroid_means(px.assign(table.select("image_id", "c", "cnt"), cents)).groupBy("image_id", C("mean").alias("c")).agg(F.sum("wsum").alias("cnt"))
    arrays = means.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("c", "cnt"))).alias("cents"))
    return clusters.clamp(arrays, table, 0.3, "oklab").select("image_id", F.explode("cents").alias("x")).select("image_id", "x.c", C("x.cnt").alias("n"))


def _errors(spark, d):
    """(image_id, k, wcss) of the first k of eight fixed centroids."""
    table, cents = centroids(spark, d)
    met = table.select("image_id", "c", "cnt").join(cents.select("image_id", "ord", "cent"), "image_id")
    upto = Window.partitionBy("image_id", "c").orderBy("ord")
    near = met.withColumn("d", F.min(spaces.distance(C("c"), C("cent"), "oklab")).over(upto))
    return near.groupBy("image_id", C("ord").alias("k")).agg((F.sum(C("d") * C("d") * C("cnt")) / F.sum("cnt")).alias("wcss"))


@query
def iqr_outliers(spark, d):
    """Which errors lie within 1.5 interquartile ranges."""
    every = F.array_sort(F.collect_list("wcss").over(Window.partitionBy("image_id")))
    ranged = _errors(spark, d).withColumn("all", every)
    n = F.size("all")
    at = lambda x: F.element_at("all", (F.floor(x) + 1).cast("int"))
    q = ranged.withColumns({"q1": at(n / 4), "q3": at(3 * n / 4)})
    reach = (C("q3") - C("q1")) * 1.5
    return q.select("image_id", "k", r6(C("wcss")).alias("wcss"), C("wcss").between(C("q1") - reach, C("q3") + reach).alias("kept"))


@query
def elbow_slope(spark, d):
    """The slope of the line through the errors of k = 1 .. 8."""
    points = _errors(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", C("wcss").alias("error")))).alias("points"))
    return points.select("image_id", r6(clusters.slope(C("points"))).alias("slope"))


@query
def otsu(spark, d):
    return regions.otsu(px.grey(trimmed(spark, d)))


def _binary(spark, d):
    return regions.adaptive_threshold(regions.luma(smooth(spark, d)))


def _shape(name, f):
    QUERIES[name] = lambda spark, d: f(spark, d).select("image_id", "idx", "v")


_shape("global_threshold", lambda s, d: regions.global_threshold(regions.luma(whole(s, d))))
_shape("adaptive_threshold", lambda s, d: regions.adaptive_threshold(regions.luma(whole(s, d))))
_shape("erosion", lambda s, d: regions.erosion(_binary(s, d)))
_shape("dilation", lambda s, d: regions.dilation(_binary(s, d)))
_shape("opening", lambda s, d: regions.opening(_binary(s, d)))
_shape("closing", lambda s, d: regions.closing(_binary(s, d)))
_shape("sobel", lambda s, d: regions.sobel(_binary(s, d)))


@query
def mask_preview(spark, d):
    return regions.mask_preview(whole(spark, d))


@query
def saliency_overlay(spark, d):
    own, sal = salient(spark, d)
    return regions.saliency_overlay(own, sal)


@query
def scramble(spark, d):
    return regions.scramble(whole(spark, d))


@query
def uniform_reference(spark, d):
    """The gap statistic's reference for each size of trimmed images, by place."""
    sizes = px.trim(whole(spark, d)).groupBy("image_id").agg(F.count("*").alias("total")).select(C("total").alias("image_id")).distinct()
    return clusters.uniform_reference(sizes).select(C("image_id").alias("total"), (C("rank") - 1).alias("id"), "c", "cnt")


@query
def nearest_css_name(spark, d):
    rgb = px.histogram(trimmed(spark, d, "rgb")).select("image_id", "rank", "c")
    return names.nearest(rgb, "c").select("image_id", "rank", "c", "name")


def _fitted(name, options, **how):
    QUERIES[name] = lambda spark, d: clusters.chosen(whole(spark, d), options, **how)


_fitted("strategy_constant", clusters.Options(strategy="constant", k=6))
_fitted("strategy_elbow", clusters.Options(strategy="elbow"))
_fitted("strategy_gap", clusters.Options(strategy="gap", min_k=1, max_k=10))
_fitted("clamp_full", clusters.Options(strategy="constant", k=8), clamped=True)
_fitted("merge_groups", clusters.Options(strategy="constant", k=8), clamped=True, merged=True)


@query
def kmeans_k(spark, d):
    """k-means of all images to the end, a row a centroid."""
    return clusters.fits(whole(spark, d), (2, 4, 8)).withColumn("wcss", r6(C("wcss")))


@query
def extract_colors(spark, d):
    """The four roles, pools and centroids of each image: the whole engine."""
    return clusters.extract_colors(whole(spark, d))


@query
def extract_json(spark, d):
    """The result record as JSON, centroids by count."""
    out = clusters.extract_colors(whole(spark, d))
    ordered = F.array_sort("centroids", lambda a, b: (b["cnt"] - a["cnt"]).cast("int"))
    return out.withColumn("centroids", ordered).select("image_id", F.to_json(F.struct(*[c for c in out.columns if c != "image_id"])).alias("record"))


@query
def summary(spark, d):
    """The roles as hex strings, their four contrasts and four lightnesses."""
    out, roles = clusters.extract_colors(whole(spark, d)), ("outer", "inner", "third", "accent")
    near = lambda c: F.floor(C(c) + 0.5).cast("int")
    pairs = [near(f"contrasts.{c}").alias(f"contrast_{c}") for c in ("outer_inner", "outer_accent", "third_inner", "third_accent")]
    return out.select("image_id", *[spaces.hex_string(C(c)).alias(c) for c in roles], *pairs, *[near(f"lightnesses.{c}").alias(f"lightness_{c}") for c in roles])


QUERIES["extract_colors_rgb"] = lambda spark, d: clusters.extract_colors(whole(spark, d), clusters.Options(space="rgb"))
QUERIES["extract_colors_lab"] = lambda spark, d: clusters.extract_colors(whole(spark, d), clusters.Options(space="lab", strategy="constant", k=8))
QUERIES["extract_colors_gap"] = lambda spark, d: clusters.extract_colors(whole(spark, d), clusters.Options(strategy="gap", min_k=4, max_k=20, clamp=0.005))


@query
def role_names(spark, d):
    """The roles by their nearest colour keywords."""
    out = clusters.extract_colors(whole(spark, d)).select("image_id", F.explode(F.create_map(*[x for c in ("outer", "inner", "third", "accent") for x in (F.lit(c), C(c))])).alias("role", "rgb"))
    return names.nearest(out, "rgb").select("image_id", "role", "rgb", "name")


def _segments(spark, d):
    return regions.text_segments(regions.global_threshold(regions.luma(pages(spark, d))))


@query
def text_segments(spark, d):
    return _segments(spark, d).drop("h")


@query
def text_regions(spark, d):
    """Runs of text joined over neighbouring lines, with their areas."""
    return regions.text_regions(_segments(spark, d))


@query
def text_region_pixels(spark, d):
    """The pixels of the text regions."""
    return regions.crop_regions(pages(spark, d), regions.text_regions(_segments(spark, d)))


@query
def contours(spark, d):
    return regions.contour_points(regions.text_edges(smooth(spark, d)))


@query
def contour_pixels(spark, d):
    """The pixels on the contours."""
    pixels = smooth(spark, d)
    edges = written(regions.text_edges(pixels), "edges")
    return regions.crop_contours(pixels, regions.contour_points(edges))


@query
def png_round_trip(spark, d):
    """All images written as PNG files and read back as pixels by Spark's image source."""
    path = scratch(spark, "png")
    write_images(images_of(whole(spark, d)), path)
    found = read_images(spark, path).withColumn("image_id", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long"))
    return pixels_of(found).select("image_id", "w", "h", "idx", "r", "g", "b")
