"""Colour spaces as Column expressions over packed colours (one int, 8 bits a channel); no Python runs per row.

`rgb` packs the bytes themselves, `oklab` lightness and the two opponent axes scaled to bytes. Bytes enter the gamma curve
unscaled and without its linear toe, so numbers are those of the summary's own space, not of standard OKLab. `lab` packs CIE Lab the same
way; its numbers outgrow their bytes, so packed colours are ints whose fields overlap, negative ones among them, as int arithmetic makes them. Nulls stay null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Linear sRGB to XYZ (D65), XYZ to LMS, LMS to Lab, and their published inverses.
M1 = ((0.41239079926595934, 0.357584339383878, 0.1804807884018343), (0.21263900587151027, 0.715168678767756, 0.07219231536073371), (0.01933081871559182, 0.11919477979462598, 0.9505321522496607))
M2 = ((0.8190224379967030, 0.3619062600528904, -0.1288737815209879), (0.0329836539323885, 0.9292868615863434, 0.0361446663506424), (0.0481771893596242, 0.2642395317527308, 0.6335478284694309))
M3 = ((0.2104542683093140, 0.7936177747023054, -0.0040720430116193), (1.9779985324311684, -2.4285922420485799, 0.4505937096174110), (0.0259040424655478, 0.7827717124575296, -0.8086757549230774))
M3_INVERSE = ((1.0, 0.3963377773761749, 0.2158037573099136), (1.0, -0.1055613458156586, -0.0638541728258133), (1.0, -0.0894841775298119, -1.2914855480194092))
M2_INVERSE = ((1.2268798758459243, -0.5578149944602171, 0.2813910456659647), (-0.0405757452148008, 1.1122868032803170, -0.0717110580655164), (-0.0763729366746601, -0.4214933324022432, 1.5869240198367816))
M1_INVERSE = ((3.2409699419045226, -1.537383177570094, -0.4986107602930034), (-0.9692436362808796, 1.8759675015077202, 0.04155505740717559), (0.05563007969699366, -0.20397695888897652, 1.0569715142428786))
#: Distance under which two colours count as alike, by space.
EPSILON = {"rgb": 20.0, "oklab": 8.0, "lab": 7.0}
#: White of Lab by chromaticity, and the bounds of its curve.
LAB_WHITE = (0.3457 / 0.3585, 1.0, (1.0 - 0.3457 - 0.3585) / 0.3585)
LAB_LOW, LAB_SLOPE = 216 / 24389, 24389 / 27


def _lab_of_grey(byte: int) -> int:
    """lab of a grey, by plain ints and floats (see pack_lab)."""
    v = ((byte + 0.055) / 1.055) ** 2.4
    t = [sum(w * v for w in row) / white for row, white in zip(M1, LAB_WHITE, strict=True)]
    f = [x ** (1 / 3) if x > LAB_LOW else (LAB_SLOPE * x + 16) / 116 for x in t]
    fields = ((116 * f[1] - 16) * 2.55, (500 * (f[0] - f[1]) + 125) * 1.02, (200 * (f[1] - f[2]) + 125) * 1.02)
    n = [int(x + 0.5) if x > 0 else -int(0.5 - x) for x in fields]
    whole = (n[0] << 16 | n[1] << 8 | n[2]) & 0xFFFFFFFF
    return whole - (1 << 32) if whole >> 31 else whole


BLACK = {"rgb": 0, "oklab": 127 * 256 + 127, "lab": _lab_of_grey(0)}
WHITE = {"rgb": 0xFFFFFF, "oklab": (206 << 16) | (127 << 8) | 127, "lab": _lab_of_grey(255)}


def nearest_int(v: Column) -> Column:
    """The nearest integer, halves up; the tie guard keeps greys, which lie on a half, on one side in all engines."""
    return F.floor(v + F.lit(0.499999999))


def clamped_byte(v: Column) -> Column:
    """0 .. 255, halves to even, NaN to 0."""
    return F.when(F.isnan(v), 0).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v)))).cast("int")


def channels(c: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(c, 16).bitwiseAND(255), F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255)


def pack(x: Column, y: Column, z: Column) -> Column:
    return (F.shiftleft(x.cast("int"), 16)).bitwiseOR(F.shiftleft(y.cast("int"), 8)).bitwiseOR(z.cast("int"))


def _times(m, v):
    return [sum((F.lit(w) * x for w, x in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in m]


def _bound(values: list[Column], make) -> Column:
    """make(values) with the values computed once, however often they are used."""
    return F.transform(F.array(F.array(*values)), lambda a: make([a[i] for i in range(len(values))]))[0]


def linear(v: Column) -> Column:
    return F.pow((v + F.lit(0.055)) / F.lit(1.055), F.lit(2.4))


def _staged(values: list[Column], stages) -> Column:
    """The one value of the last stage; a stage makes Columns of those before it, each computed once."""
    if len(stages) == 1:
        return stages[0](values)[0]
    return _bound(stages[0](values), lambda v: _staged(v, stages[1:]))


def _linear_bytes(v: list[Column]) -> list[Column]:
    return [linear(x.cast("double")) for x in v]


OKLAB_STAGES = (
    _linear_bytes,
    lambda v: [F.cbrt(x) for x in _times(M2, _times(M1, v))],
    lambda u: _times(M3, u),
    lambda v: [pack(nearest_int(v[0] * 2.55), nearest_int((v[1] + 100) * 1.275), nearest_int((v[2] + 100) * 1.275))],
)


def lab_of(r: Column, g: Column, b: Column) -> Column:
    """The three coordinates, unscaled, as an array."""
    return _staged([r, g, b], (*OKLAB_STAGES[:2], lambda u: [F.array(*OKLAB_STAGES[2](u))]))


def pack_oklab(r: Column, g: Column, b: Column) -> Column:
    return _staged([r, g, b], OKLAB_STAGES)


def unpack_oklab(c: Column) -> Column:
    """The packed RGB of a packed oklab colour; what the gamut lacks is clamped, negative light is 0."""
    light, a, b = channels(c)
    start = [light / 2.55, a / 1.275 - 100, b / 1.275 - 100]
    cubes = lambda v: [F.pow(x, F.lit(3.0)) for x in _times(M3_INVERSE, v)]
    byte = lambda x: F.when(x < 0, 0.0).otherwise(F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
    whole = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), nearest_int(byte(x)).cast("int")))
    return _bound(start, lambda v: _bound(_times(M1_INVERSE, _times(M2_INVERSE, cubes(v))), lambda u: pack(*[whole(x) for x in u])))


def _lab_curves(v: list[Column]) -> list[Column]:
    curve = lambda t: F.when(t > LAB_LOW, F.cbrt(t)).otherwise((t * LAB_SLOPE + 16) / 116)
    return [curve(t) for t in v]


def _lab_fields_of(f: list[Column]) -> list[Column]:
    whole = lambda v: F.floor(v + 0.5).cast("int")
    light, first, second = whole((f[1] * 116 - 16) * 2.55), whole(((f[0] - f[1]) * 500 + 125) * 1.02), whole(((f[1] - f[2]) * 200 + 125) * 1.02)
    return [F.shiftleft(light, 16).bitwiseOR(F.shiftleft(first, 8)).bitwiseOR(second)]


LAB_STAGES = (_linear_bytes, lambda v: [t / w for t, w in zip(_times(M1, v), LAB_WHITE, strict=True)], _lab_curves, _lab_fields_of)


def pack_lab(r: Column, g: Column, b: Column) -> Column:
    return _staged([r, g, b], LAB_STAGES)


def lab_fields(c: Column) -> tuple[Column, Column, Column]:
    """Lightness (signed) and the two axes as bytes of a packed lab colour."""
    return F.shiftright(c, 16), F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255)


def unpack_lab(c: Column) -> Column:
    light, a, b = lab_fields(c)

    def back(v):
        light, a, b = v
        f1 = (light + 16) / 116
        f0, f2 = a / 500 + f1, f1 - b / 200
        cube = lambda f: F.when(f > 24 / 116, f * f * f).otherwise((f * 116 - 16) / LAB_SLOPE)
        return _bound([cube(f0) * LAB_WHITE[0], F.when(light > 8, f1 * f1 * f1).otherwise(light / LAB_SLOPE) * LAB_WHITE[1], cube(f2) * LAB_WHITE[2]], lambda t: _bound(_times(M1_INVERSE, t), lambda u: pack(*[byte(x) for x in u])))

    # a negative base has no root: such a byte is 0
    byte = lambda x: F.when(x < 0, 0).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055 + 0.5))).cast("int"))
    return _bound([light / 2.55, a / 1.02 - 125, b / 1.02 - 125], back)


def ciede2000(p: list[Column], q: list[Column]) -> Column:
    """The CIEDE2000 difference of two Lab colours, by the published formula."""
    deg, rad = F.degrees, F.radians
    (l1, a1, b1), (l2, a2, b2) = p, q
    c7 = F.pow((F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2, F.lit(7.0))
    stretch = 1.5 - F.sqrt(c7 / (c7 + 25.0**7)) / 2

    def second(v):
        l1, a1, b1, l2, a2, b2 = v
        c1, c2 = F.sqrt(a1 * a1 + b1 * b1), F.sqrt(a2 * a2 + b2 * b2)
        hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(deg(F.atan2(b, a)), F.lit(360.0)))
        return _bound([l1, l2, c1, c2, hue(a1, b1), hue(a2, b2)], third)

    def third(v):
        l1, l2, c1, c2, h1, h2 = v
        turn, grey = h2 - h1, c1 * c2 == 0
        dh = F.when(grey, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
        both = h1 + h2
        mean = F.when(grey, both).when(F.abs(turn) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2)
        return _bound([(l1 + l2) / 2, (c1 + c2) / 2, mean, l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(rad(dh) / 2)], last)

    def last(v):
        light, c, h, dl, dc, dh = v
        t = 1 - 0.17 * F.cos(rad(h - 30)) + 0.24 * F.cos(rad(2 * h)) + 0.32 * F.cos(rad(3 * h + 6)) - 0.20 * F.cos(rad(4 * h - 63))
        off = F.pow(light - 50, F.lit(2.0))
        x, y, z = dl / (1 + 0.015 * off / F.sqrt(off + 20)), dc / (1 + 0.045 * c), dh / (1 + 0.015 * c * t)
        m7 = F.pow(c, F.lit(7.0))
        turn = -F.sin(rad(60 * F.exp(-F.pow((h - 275) / 25, F.lit(2.0))))) * 2 * F.sqrt(m7 / (m7 + 25.0**7))
        return F.sqrt(F.greatest(F.lit(0.0), x * x + y * y + z * z + turn * y * z))

    return _bound([l1, a1 * stretch, b1, l2, a2 * stretch, b2], second)


def euclidean(p: Column, q: Column, weights: tuple[float, float, float]) -> Column:
    d = [(x - y) * F.lit(s) for x, y, s in zip(channels(p), channels(q), weights, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _chroma_of(a: Column, b: Column) -> Column:
    grey = (F.abs(a) < 7.5e-5) & (F.abs(b) < 7.5e-5)
    return F.when(grey, 0.0).otherwise(F.sqrt(a * a + b * b)) / 1.5


def luminance(rgb: Column) -> Column:
    """APCA's luminance of a packed RGB colour, softened near black."""
    weight = (0.2126729, 0.7151522, 0.0721750)
    y = sum((F.lit(w) * F.pow(x / 255, F.lit(2.4)) for w, x in zip(weight, channels(rgb), strict=True)), F.lit(0.0))
    return _bound([y], lambda v: F.when(v[0] < 0.022, v[0] + F.pow(F.greatest(F.lit(0.022) - v[0], F.lit(0.0)), F.lit(1.414))).otherwise(v[0]))


def contrast_of_luminances(t: Column, g: Column) -> Column:
    """APCA contrast of text and ground, negative polarity over 1.08, positive over 1.06; the order matters."""
    dark = 1.14 * (F.pow(g, F.lit(0.56)) - F.pow(t, F.lit(0.57)))
    light = 1.14 * (F.pow(g, F.lit(0.65)) - F.pow(t, F.lit(0.62)))
    raw = F.when(F.abs(g - t) < 0.0005, 0.0).when(g > t, dark).otherwise(light)

    def cut(v):
        return F.when(F.abs(v[0]) < 0.1, 0.0).when(v[0] > 0, (v[0] - 0.027) * 100 / 1.06).otherwise((v[0] + 0.027) * -100 / 1.08)

    return _bound([raw], cut)


def contrast_of_rgb(text: Column, ground: Column) -> Column:
    """APCA contrast of packed RGB colours."""
    return _bound([luminance(text), luminance(ground)], lambda v: contrast_of_luminances(v[0], v[1]))


def _walk(start: list[Column], step, contrast_at, desired: Column, of: Column, most: int) -> Column:
    """The last colour of a walk of at most `most` steps from `start`, which ends once the contrast is reached or step() gives no colour; `of` if the first gives none."""
    zero = F.struct(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(start)], of.cast("int").alias("c"), F.lit(0.0).alias("k"), F.lit(False).alias("end"))

    def on(s: Column, _: Column) -> Column:
        def told(n: Column) -> Column:  # n: the next values, and the colour, null beyond the range
            values = [n[f"v{i}"] for i in range(len(start))]
            moved = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)], n["c"].alias("c"), contrast_at(n["c"]).alias("k"), F.lit(False).alias("end"))
            return F.when(n["c"].isNull(), s.withField("end", F.lit(True))).otherwise(moved)

        values, c = step([s[f"v{i}"] for i in range(len(start))])
        new = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)], c.alias("c"))
        return F.when(s["end"] | (s["k"] >= desired), s).otherwise(F.transform(F.array(new), told)[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, on)["c"]


def _brighter(of: Column, against: Column, towards: Column, desired: Column, at) -> Column:
    """rgb: the luminance goes by 0.01 within 0 .. 1 while the other two tristimulus values stay."""
    lighter = lightness(towards, "rgb") > lightness(against, "rgb")
    xyz = _times(M1, [linear(v.cast("double")) for v in channels(of)])
    byte = lambda v: F.when(v < 0, 0).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055 + 0.5)))).cast("int")

    def step(v: list[Column]) -> tuple[list[Column], Column]:
        y = v[1] + F.when(lighter, 0.01).otherwise(-0.01)
        c = _bound(_times(M1_INVERSE, [v[0], y, v[2]]), lambda u: pack(*[byte(x) for x in u]))
        return [v[0], y, v[2]], F.when((y > 0) & (y < 1), c)

    return _walk(xyz, step, at, desired, of, 101)


def _further(of: Column, against: Column, towards: Column, desired: Column, at) -> Column:
    """oklab: lightness goes by 1 within 0 .. 100 and chroma by -0.01 at a fixed hue; greys get the packed axes 0."""
    lighter = lightness(towards, "oklab") > lightness(against, "oklab")
    a, b = (x / 1.275 - 100 for x in channels(of)[1:])
    hue = F.when((F.abs(a) >= 0.0002) | (F.abs(b) >= 0.0002), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))

    def step(v: list[Column]) -> tuple[list[Column], Column]:
        light, c = v[0] + F.when(lighter, 1.0).otherwise(-1.0), v[1] - 0.01
        axis = lambda f: F.coalesce(F.floor((c * f(F.radians(hue)) + 100) * 1.275 + 0.5).cast("int"), F.lit(0))
        return [light, c], F.when((light > 0) & (light < 100), pack((light * 2.06).cast("int"), axis(F.cos), axis(F.sin)))

    return _walk([lightness(of, "oklab"), chroma(of, "oklab")], step, at, desired, of, 101)


@dataclass(frozen=True)
class Space:
    """A colour space over packed ints: Column functions, and `measure`, the numpy twin of `distance` for tasks on blocks of colours.

    contrast_of says what `contrast` depends on, so that it can be had from what is known of a colour: "luminance" (APCA of the RGB), "light" (the
    difference of lightnesses), or None, for the packed colours themselves. walk, if there is one, increases contrast (see increase_contrast). stages, if there are any, are the steps of `pack`
    for with_packed(): each makes Columns of the list of those before it, the first of red, green and blue, the last the packed colour alone.
    """

    name: str
    pack: Callable[[Column, Column, Column], Column]
    to_rgb: Callable[[Column], Column]
    distance: Callable[[Column, Column], Column]
    measure: arrays.Measure
    epsilon: float
    lightness: Callable[[Column], Column]
    chroma: Callable[[Column], Column]
    contrast: Callable[[Column, Column], Column]
    black: int
    white: int
    contrast_of: str | None = None
    walk: Callable[..., Column] | None = None
    stages: tuple[Callable[[list[Column]], list[Column]], ...] = ()


SPACES: dict[str, Space] = {}


def register(space: Space) -> Space:
    """Make a space known by its name, to Options and all functions here; a name that is there already is replaced."""
    SPACES[space.name] = space
    return space


def of(name: str) -> Space:
    if name not in SPACES:
        raise ValueError(f"no colour space {name}; known: {', '.join(SPACES)}")
    return SPACES[name]


_OKLAB = (1 / 2.55, 2.35 / 1.275, 2.35 / 1.275)
register(Space("rgb", pack, lambda c: c, lambda p, q: euclidean(p, q, (1.0, 1.0, 1.0)), arrays.scaled((1.0, 1.0, 1.0), (1, 1, 1)), EPSILON["rgb"],
    lambda c: _times(M1, [linear(x.cast("double")) for x in channels(c)])[1] * 100, lambda c: _chroma_of(*[lab_of(*channels(c))[i] for i in (1, 2)]),
    contrast_of_rgb, BLACK["rgb"], WHITE["rgb"], "luminance", _brighter))
register(Space("oklab", pack_oklab, unpack_oklab, lambda p, q: euclidean(p, q, _OKLAB), arrays.scaled(_OKLAB, (100, 2209, 2209)), EPSILON["oklab"],
    lambda c: F.shiftright(c, 16) / 2.06, lambda c: _chroma_of(*[x / 1.275 - 100 for x in channels(c)[1:]]),
    lambda p, q: contrast_of_rgb(unpack_oklab(p), unpack_oklab(q)), BLACK["oklab"], WHITE["oklab"], "luminance", _further, OKLAB_STAGES))
register(Space("lab", pack_lab, unpack_lab, lambda p, q: ciede2000(*[[x.cast("double") for x in lab_fields(c)] for c in (p, q)]), arrays.CIEDE2000, EPSILON["lab"],
    lambda c: F.shiftright(c, 16) / 2.55, lambda c: _chroma_of(*[x / 1.02 - 125 for x in channels(c)[1:]]),
    lambda p, q: F.abs(F.shiftright(p, 16) - F.shiftright(q, 16)) / 2.55, BLACK["lab"], WHITE["lab"], "light", stages=LAB_STAGES))


def to_packed(r: Column, g: Column, b: Column, space: str) -> Column:
    return of(space).pack(r, g, b)


def with_packed(pixels: DataFrame, space: str) -> DataFrame:
    """pixels (r, g, b, ...) with c, the packed colour; a projection for each of the space's stages, as Spark compiles these and not the lambdas that stand for them in one Column."""
    own, values, passing = of(space), [F.col(x) for x in "rgb"], []
    if not own.stages:
        return pixels.withColumn("c", own.pack(*values))
    for n, stage in enumerate(own.stages[:-1]):
        made = {f"_{n}_{i}": v for i, v in enumerate(stage(values))}
        pixels, values, passing = pixels.withColumns(made), [F.col(x) for x in made], [*passing, *made]
    return pixels.withColumn("c", own.stages[-1](values)[0]).drop(*passing)


def to_rgb(c: Column, space: str) -> Column:
    return of(space).to_rgb(c)


def distance(p: Column, q: Column, space: str) -> Column:
    """Euclidean in rgb; in oklab lightness on 0 .. 100 and the axes weighted by 2.35. In lab the CIEDE2000 difference of the fields as they are."""
    return of(space).distance(p, q)


def lightness(c: Column, space: str) -> Column:
    return of(space).lightness(c)


def chroma(c: Column, space: str) -> Column:
    return of(space).chroma(c)


def contrast(p: Column, q: Column, space: str) -> Column:
    return of(space).contrast(p, q)


def increase_contrast(of_: Column, against: Column, towards: Column, desired: Column, space: str, foreground: bool = True) -> Column:
    """`of_` moved away from `against`, to the lighter side if `towards` is lighter, until the contrast reaches `desired` or the range ends, by the space's own walk.

    foreground: `of_` is the ground that is read on `against`, else the other way round.
    """
    own = of(space)
    if own.walk is None:
        raise ValueError(f"no way to increase contrast in {space}")
    at = lambda c: own.contrast(against, c) if foreground else own.contrast(c, against)
    return own.walk(of_, against, towards, desired, at)


def hex_string(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(rgb)), 6, "0"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(r * 0.299 + g * 0.587 + b * 0.114).cast("int")
