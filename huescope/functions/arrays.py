"""Distances of numpy arrays of packed colours, for tasks that take a block of colours at a time: the twins of the spaces' Column distances."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def channels(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, np.int64)
    return np.stack([c >> 16 & 255, c >> 8 & 255, c & 255], axis=-1)


def pack(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    return v[..., 0] << 16 | v[..., 1] << 8 | v[..., 2]


@dataclass(frozen=True)
class Measure:
    """How far colours are apart: fields(packed) gives their coordinates, between(x, y) the distances of coordinates that broadcast.

    grid: where distances are Euclidean on the bytes, whole numbers that the squares of the bytes' differences count in proportion to.
    """

    fields: Callable[[np.ndarray], np.ndarray]
    between: Callable[[np.ndarray, np.ndarray], np.ndarray]
    grid: tuple[int, int, int] | None = None


def scaled(weights: tuple[float, float, float], grid: tuple[int, int, int] | None = None) -> Measure:
    """Euclidean on the three bytes, weighted."""

    def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = [(x[..., i] - y[..., i]) * w for i, w in enumerate(weights)]
        return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    return Measure(lambda c: channels(c).astype(float), between, grid)


def apart(p: np.ndarray, q: np.ndarray, measure: Measure) -> np.ndarray:
    """The distance of each colour of p to the one of q at its place."""
    return measure.between(measure.fields(p), measure.fields(q))


def nearest(p: np.ndarray, q: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """For each colour of p the place in q of the nearest one, ties to the first, and its distance; in blocks of rows."""
    x, y = measure.fields(p), measure.fields(q)
    at, d = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, (1 << 18) // max(1, len(y)))
    for a in range(0, len(x), step):
        part = measure.between(x[a : a + step, None, :], y[None, :, :])
        at[a : a + step] = part.argmin(1)
        d[a : a + step] = part[np.arange(len(part)), at[a : a + step]]
    return at, d


class Room:
    """Arrays by name that a task uses again and again, as new memory for each of them takes longer than what is done in it. What take() gives is as it was left."""

    def __init__(self):
        self.flat: dict[str, np.ndarray] = {}

    def take(self, name: str, shape: tuple[int, ...], kind: type = float) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.flat or len(self.flat[name]) < n:
            self.flat[name] = np.empty(n, kind)
        return self.flat[name][:n].reshape(shape)


class Nearest:
    """For colours and runs of centroids beside each other: which of a run's centroids is nearest to each colour, ties to the first, round after round.

    Distances to centroids that stay are kept. On a grid, squared distances (less the colour's own square) are whole numbers that one matrix product has exactly, with the centroid's place in
    the lowest bits, so that a plain minimum finds the nearest; where two are equal, between() decides as it does without a grid.
    """

    BITS = 20

    def __init__(self, colours: np.ndarray, measure: Measure, room: Room | None = None):
        self.measure, self.room, self.x, self.known, self.rows, self.odd = measure, room or Room(), measure.fields(colours), np.zeros(0, np.int64), np.zeros((0, len(colours))), False
        if measure.grid:
            self.weighed = np.append(self.x, np.ones((len(self.x), 1)), 1).T.copy()

    def _rows(self, y: np.ndarray, places: np.ndarray, out: np.ndarray) -> np.ndarray:
        if not self.measure.grid:
            out[:] = self.measure.between(self.x[None, :, :], y[:, None, :])
            return out
        w, one = np.array(self.measure.grid, float), float(1 << self.BITS)
        return np.matmul(np.append(-2 * one * w * y, (one * (w * y * y).sum(1) + places)[:, None], 1), self.weighed, out=out)

    def _other(self, n: int) -> np.ndarray:
        """Room for n rows that isn't the rows' own."""
        return self.room.take(f"rows{not self.odd}", (n, len(self.x)))

    def keep(self, stay: np.ndarray) -> None:
        """Only these of the centroids are left."""
        at = np.flatnonzero(stay)
        self.rows, self.known, self.odd = np.take(self.rows, at, 0, out=self._other(len(at)), mode="clip"), self.known[stay], not self.odd

    def places(self, cents: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(runs, colours): the place in all of cents, of which each run has the next so many of sizes; to be used before the next call."""
        starts = np.cumsum(sizes) - sizes
        local = np.arange(len(cents)) - np.repeat(starts, sizes)
        if len(self.known) != len(cents):
            self.odd = not self.odd
            self.rows = self._rows(self.measure.fields(cents), local, self.room.take(f"rows{self.odd}", (len(cents), len(self.x))))
        else:
            new = np.flatnonzero(self.known != cents)
            if len(new):
                self.rows[new] = self._rows(self.measure.fields(cents[new]), local[new], self._other(len(new)))
        self.known = cents
        spans = list(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
        at = self.room.take("at", (len(sizes), len(self.x)), np.int64)
        if not self.measure.grid:
            for j, (a, b) in enumerate(spans):
                self.rows[a:b].argmin(0, out=at[j])
                at[j] += a
            return at
        least = self.room.take("least", at.shape)
        for j, (a, b) in enumerate(spans):
            self.rows[a:b].min(0, out=least[j])
        low = (1 << self.BITS) - 1
        np.copyto(at, least, casting="unsafe")
        np.bitwise_or(at, low, out=at)
        beyond = np.add(at, 1, out=self.room.take("beyond", at.shape), casting="unsafe")
        equal = self.room.take("equal", self.rows.shape, bool)
        for j, (a, b) in enumerate(spans):
            np.less(self.rows[a:b], beyond[j], out=equal[a:b])
        np.copyto(at, least, casting="unsafe")
        np.bitwise_and(at, low, out=at)
        at += starts[:, None]
        if np.count_nonzero(equal) > at.size:
            row, col = np.divmod(np.flatnonzero(equal), len(self.x))
            pair = np.repeat(np.arange(len(sizes)), sizes)[row] * len(self.x) + col
            some = np.bincount(pair, minlength=at.size)[pair] > 1
            row, col, pair = row[some], col[some], pair[some]
            d = self.measure.between(self.x[col], self.measure.fields(cents[row]))
            order = np.lexsort((row, d, pair))[::-1]  # the nearest is written last
            at.ravel()[pair[order]] = row[order]
        return at


def seeds(colours: np.ndarray, most: int, measure: Measure, epsilon: float) -> np.ndarray:
    """The first `most` colours that are each at least epsilon from those before; in blocks, as few colours are often enough."""
    x, kept = measure.fields(colours), []
    for a in range(0, len(x), 64):
        part = x[a : a + 64]
        far = (measure.between(part[None, :, :], x[kept][:, None, :]) >= epsilon).all(0) if kept else np.ones(len(part), bool)
        while len(kept) < most and far.any():
            i = int(far.argmax())
            kept.append(a + i)
            far &= measure.between(part, part[i]) >= epsilon
            far[i] = False
        if len(kept) >= most:
            break
    return colours[kept]


def signed_fields(c: np.ndarray) -> np.ndarray:
    """Two bytes, and before them the rest of the number as it is, sign and all."""
    v = channels(c).astype(float)
    v[..., 0] = np.asarray(c, np.int64) >> 16
    return v


def _length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(a * a + b * b)


def _share(c: np.ndarray) -> np.ndarray:
    """The root of c**7's share in c**7 + 25**7."""
    out = c * c
    out *= c
    out *= out
    out *= c
    out /= out + 25.0**7
    return np.sqrt(out, out=out)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In radians from 0 on."""
    out = np.arctan2(b, a)
    return np.add(out, 2 * math.pi, out=out, where=out < 0)


def ciede2000(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The CIEDE2000 differences of Lab colours, by the published formula, in place where it can; cosines of multiples of the hue are by those of the hue itself."""
    if p.ndim == q.ndim == 1:
        return ciede2000(p[None], q[None])[0]
    (l1, a1, b1), (l2, a2, b2) = (np.moveaxis(v, -1, 0) for v in (p, q))
    stretch = _share((_length(a1, b1) + _length(a2, b2)) / 2)
    stretch *= -0.5
    stretch += 1.5
    a1, a2 = a1 * stretch, a2 * stretch
    c1, c2 = _length(a1, b1), _length(a2, b2)
    h1, h2 = _angle(a1, b1), _angle(a2, b2)
    z = c1 * c2
    grey = z == 0
    h = h1 + h2
    turn = np.subtract(h2, h1, out=h2)
    over, under = turn > math.pi, turn < -math.pi
    wide = over | under
    np.subtract(turn, 2 * math.pi, out=turn, where=over)
    np.add(turn, 2 * math.pi, out=turn, where=under)
    turn[grey] = 0
    both = h[grey]
    below = h < 2 * math.pi
    np.add(h, 2 * math.pi, out=h, where=wide & below)
    np.subtract(h, 2 * math.pi, out=h, where=wide & ~below)
    h /= 2
    h[grey] = both
    np.sqrt(z, out=z)
    turn /= 2
    z *= np.sin(turn, out=turn)
    z *= 2
    cos, sin = np.cos(h), np.sin(h)
    cos2, sin2 = cos * cos, sin * cos
    cos2 *= 2
    cos2 -= 1
    sin2 *= 2
    t = cos2 * 0.24
    t += 1
    for weight, degrees, x, y in ((-0.17, -30, cos, sin), (0.32, 6, cos2 * cos - sin2 * sin, sin2 * cos + cos2 * sin), (-0.20, -63, 2 * cos2 * cos2 - 1, 2 * sin2 * cos2)):
        t += x * (weight * math.cos(math.radians(degrees)))
        t -= y * (weight * math.sin(math.radians(degrees)))
    y = c2 - c1
    c = np.add(c1, c2, out=c1)
    c /= 2
    t *= c
    t *= 0.015
    t += 1
    z /= t
    np.multiply(c, 0.045, out=t)
    t += 1
    y /= t
    h -= math.radians(275)
    h /= math.radians(25)
    h *= h
    np.exp(np.negative(h, out=h), out=h)
    h *= math.radians(60)
    np.sin(h, out=h)
    h *= _share(c)
    h *= -2
    h *= y
    h *= z
    off = (l1 + l2) / 2
    off -= 50
    off *= off
    x = l2 - l1
    x /= 1 + 0.015 * off / np.sqrt(off + 20)
    for v in (x, y, z):
        v *= v
        h += v
    return np.sqrt(np.maximum(0.0, h, out=h), out=h)


CIEDE2000 = Measure(signed_fields, ciede2000)
