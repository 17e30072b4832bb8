"""Standard colour conversions as Columns: a chain of spaces, any two of which are joined by composing its steps.

A colour is three Columns. rgb is gamma-encoded on 0 .. 1 with the linear toe, the sign kept; linear, xyz (D65), oklab and oklch (hue in degrees, null for greys) follow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spaces import M1, M1_INVERSE, M2, M2_INVERSE, M3, M3_INVERSE, _bound, _times

Colour = list[Column]
CHAIN = ("rgb", "linear", "xyz", "oklab", "oklch")
#: Bounds of the gamma curve's toe on either side, and the size of axes under which a colour has no hue.
TOE, TOE_LINEAR, GREY = 0.04045, 0.0031308, 0.0002


def _signed(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.signum(v) * f(F.abs(v))


def _to_linear(c: Colour) -> Colour:
    return [F.when(F.abs(v) <= TOE, v / 12.92).otherwise(_signed(v, lambda x: F.pow((x + 0.055) / 1.055, F.lit(2.4)))) for v in c]


def _from_linear(c: Colour) -> Colour:
    return [F.when(F.abs(v) > TOE_LINEAR, _signed(v, lambda x: F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)).otherwise(v * 12.92) for v in c]


def _to_oklch(c: Colour) -> Colour:
    grey = (F.abs(c[1]) < GREY) & (F.abs(c[2]) < GREY)
    return [c[0], F.sqrt(c[1] * c[1] + c[2] * c[2]), F.when(~grey, F.pmod(F.degrees(F.atan2(c[2], c[1])), F.lit(360.0)))]


def _from_oklch(c: Colour) -> Colour:
    hue = F.radians(c[2])
    return [c[0], F.coalesce(c[1] * F.cos(hue), F.lit(0.0)), F.coalesce(c[1] * F.sin(hue), F.lit(0.0))]


#: Each step of the chain, there and back.
STEPS: dict[tuple[str, str], Callable[[Colour], Colour]] = {
    ("rgb", "linear"): _to_linear,
    ("linear", "rgb"): _from_linear,
    ("linear", "xyz"): lambda c: _times(M1, c),
    ("xyz", "linear"): lambda c: _times(M1_INVERSE, c),
    ("xyz", "oklab"): lambda c: _times(M3, [F.cbrt(v) for v in _times(M2, c)]),
    ("oklab", "xyz"): lambda c: _times(M2_INVERSE, [v * v * v for v in _times(M3_INVERSE, c)]),
    ("oklab", "oklch"): _to_oklch,
    ("oklch", "oklab"): _from_oklch,
}


def convert(colour: Colour, source: str, target: str) -> Column:
    """The colour, given in `source`, in `target`: an array of three doubles, each step's values computed once."""
    a, b = CHAIN.index(source), CHAIN.index(target)
    path = CHAIN[a : b + 1] if a <= b else CHAIN[b : a + 1][::-1]
    steps = [STEPS[pair] for pair in zip(path, path[1:], strict=False)]

    def go(c: Colour, rest: list) -> Column:
        return _bound(rest[0](c), lambda v: go(v, rest[1:])) if rest else F.array(*c)

    return go([c.cast("double") for c in colour], steps)


def bytes_to_unit(rgb: Column) -> Colour:
    """The channels of a packed RGB colour on 0 .. 1."""
    return [F.shiftright(rgb, n).bitwiseAND(255) / 255 for n in (16, 8, 0)]


def unit_to_bytes(c: Column) -> Column:
    """The packed RGB colour of an array of three on 0 .. 1, rounded (halves up) and held to bytes."""
    byte = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v * 255 + 0.5))).cast("int")
    return F.shiftleft(byte(c[0]), 16).bitwiseOR(F.shiftleft(byte(c[1]), 8)).bitwiseOR(byte(c[2]))
