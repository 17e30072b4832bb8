"""Named colours and the nearest name by CIEDE2000."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .spaces import ciede2000  # noqa: F401

#: The CSS colour keywords, in alphabetical order.
CSS = (
    "aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 "
    "chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b "
    "darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 "
    "deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 "
    "green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 "
    "lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 "
    "lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 "
    "mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 "
    "olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 "
    "purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd "
    "slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32"
)
#: The sixteen basic keywords.
BASIC = frozenset("aqua black blue fuchsia gray green lime maroon navy olive purple red silver teal white yellow".split())
#: Linear sRGB to XYZ adapted to D50, and its white.
D50 = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
WHITE = (0.9642956764, 1.0, 0.8251046025)


def names(spark: SparkSession, basic: bool = False) -> DataFrame:
    """(name, name_ord, name_rgb): 148 rows at most."""
    words = CSS.split()
    pairs = [(n, i, int(h, 16)) for i, (n, h) in enumerate(zip(words[::2], words[1::2], strict=True)) if not basic or n in BASIC]
    return spark.createDataFrame(pairs, "name string, name_ord int, name_rgb int")


def nearest_name(rgb: np.ndarray, basic: bool = False) -> np.ndarray:
    """The keyword nearest to each packed RGB colour, ties to the first, in blocks of colours."""
    words = CSS.split()
    known = [(n, int(h, 16)) for n, h in zip(words[::2], words[1::2], strict=True) if not basic or n in BASIC]
    labs, own = _lab(np.array([c for _, c in known])), np.array([n for n, _ in known], object)
    out = np.empty(len(rgb), object)
    for a in range(0, len(rgb), 1000):
        d = arrays.ciede2000(labs[None, :, :], _lab(rgb[a : a + 1000])[:, None, :])
        out[a : a + 1000] = own[np.round(d, 9).argmin(1)]
    return out


def _lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab (D50) of packed RGB colours."""
    v = arrays.channels(rgb) / 255
    xyz = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4) @ np.array(D50).T / np.array(WHITE)
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (xyz * (24389 / 27) + 16) / 116)
    return np.stack([f[..., 1] * 116 - 16, (f[..., 0] - f[..., 1]) * 500, (f[..., 1] - f[..., 2]) * 200], -1)


def nearest(colours: DataFrame, column: str, basic: bool = False) -> DataFrame:
    """colours with `name`, the keyword nearest to the packed RGB of `column`, ties to the first (by nine decimals)."""

    @F.pandas_udf("string")
    def name(rgb: pd.Series) -> pd.Series:  # a batch of rows at a time
        each, back = np.unique(rgb.fillna(-1).to_numpy(np.int64), return_inverse=True)
        found = nearest_name(each & 0xFFFFFF, basic)
        found[each < 0] = None
        return pd.Series(found[back])

    return colours.withColumn("name", name(F.col(column)))
