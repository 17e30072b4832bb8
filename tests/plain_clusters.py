"""The summary of one image in plain Python and numpy, step by step: what the engine's bulk rounds are compared with."""

from __future__ import annotations

import math

import numpy as np

from huescope.functions import arrays
from huescope.functions.spaces import BLACK, EPSILON, LAB_SLOPE, LAB_WHITE, M1, M1_INVERSE, M2, M2_INVERSE, M3, M3_INVERSE, WHITE
from huescope.operators.clusters import Options


def distances(p, q, space):
    """The matrix of distances between two lists of colours."""
    fields = arrays.signed_fields if space == "lab" else arrays.channels
    x, y = fields(p)[:, None, :], fields(q)[None, :, :]
    if space == "lab":
        return arrays.ciede2000(x, y)
    d = (x - y) * np.array((1.0, 1.0, 1.0) if space == "rgb" else (1 / 2.55, 2.35 / 1.275, 2.35 / 1.275))
    return np.sqrt((d * d).sum(-1))


def linear(c: np.ndarray) -> np.ndarray:
    return ((arrays.channels(c) + 0.055) / 1.055) ** 2.4


def to_rgb(c: np.ndarray, space: str) -> np.ndarray:
    if space == "rgb":
        return np.asarray(c, np.int64)
    v = (arrays.signed_fields if space == "lab" else arrays.channels)(c).astype(float)
    if space == "lab":
        light, a, b = v[..., 0] / 2.55, v[..., 1] / 1.02 - 125, v[..., 2] / 1.02 - 125
        f1 = (light + 16) / 116
        cube = lambda f: np.where(f > 24 / 116, f**3, (116 * f - 16) / LAB_SLOPE)
        xyz = np.stack([cube(a / 500 + f1), np.where(light > 8, f1**3, light / LAB_SLOPE), cube(f1 - b / 200)], -1) * np.array(LAB_WHITE)
        flat, half = xyz @ np.array(M1_INVERSE).T, 0.5
    else:
        lab = np.stack([v[..., 0] / 2.55, v[..., 1] / 1.275 - 100, v[..., 2] / 1.275 - 100], -1)
        flat, half = ((lab @ np.array(M3_INVERSE).T) ** 3) @ np.array(M2_INVERSE).T @ np.array(M1_INVERSE).T, 0.499999999
    byte = np.where(flat < 0, 0.0, np.maximum(flat, 0) ** (1 / 2.4) * 1.055 - 0.055)
    return arrays.pack(np.clip(np.floor(byte + half), 0, 255))


def lightness(c: np.ndarray, space: str) -> np.ndarray:
    if space == "rgb":
        return linear(c) @ np.array(M1[1]) * 100
    return (np.asarray(c, np.int64) >> 16) / (2.06 if space == "oklab" else 2.55)


def chroma(c: np.ndarray, space: str) -> np.ndarray:
    v = arrays.channels(c)
    if space == "rgb":
        lab = np.cbrt(linear(c) @ np.array(M1).T @ np.array(M2).T) @ np.array(M3).T
        a, b = lab[..., 1], lab[..., 2]
    else:
        a, b = (v[..., i] / (1.275 if space == "oklab" else 1.02) - (100 if space == "oklab" else 125) for i in (1, 2))
    return np.where((np.abs(a) < 7.5e-5) & (np.abs(b) < 7.5e-5), 0.0, np.hypot(a, b)) / 1.5


def contrast(text: np.ndarray, ground: np.ndarray, space: str) -> np.ndarray:
    if space == "lab":
        return np.abs((np.asarray(text, np.int64) >> 16) - (np.asarray(ground, np.int64) >> 16)) / 2.55

    def luminance(c):
        y = ((arrays.channels(to_rgb(c, space)) / 255) ** 2.4) @ np.array((0.2126729, 0.7151522, 0.0721750))
        return np.where(y < 0.022, y + np.maximum(0.022 - y, 0) ** 1.414, y)

    t, g = luminance(text), luminance(ground)
    raw = np.where(g > t, 1.14 * (g**0.56 - t**0.57), 1.14 * (g**0.65 - t**0.62))
    raw = np.where(np.abs(g - t) < 0.0005, 0.0, raw)
    cut = np.where(np.abs(raw) < 0.1, 0.0, raw - np.sign(raw) * 0.027) * 100
    return np.where(cut < 0, -cut / 1.08, cut / 1.06)


def seeds(colours: np.ndarray, k: int, space: str) -> np.ndarray:
    """The first k colours that are each at least epsilon from those before; fewer if there aren't so many, all for k = 0."""
    kept: list[int] = []
    for i in range(len(colours)):
        if not kept or (distances(colours[i : i + 1], colours[kept], space) >= EPSILON[space]).all():
            kept.append(i)
            if len(kept) == k:
                break
    return colours[kept]


def kmeans(colours: np.ndarray, counts: np.ndarray, k: int, space: str, rounds: int = 100) -> tuple[dict[int, int], float]:
    """(medoid -> count in the clusters' order, mean squared distance to the rounded means).

    Colours are in rank order. Means are packed ints each round; a cluster without weight has the mean 0. A later
    cluster of the same medoid takes its place's count over.
    """
    now, bytes_ = seeds(colours, k, space), arrays.channels(colours)
    mine = np.full(len(colours), -1)
    for _ in range(rounds):
        to = distances(colours, now, space).argmin(1)
        if (to == mine).all():
            break
        mine = to
        sums = np.stack([np.bincount(mine, bytes_[:, c] * counts, minlength=len(now)) for c in range(3)], 1)
        weight = np.bincount(mine, counts, minlength=len(now))[:, None]
        now = arrays.pack(np.where(weight > 0, np.floor(sums / np.maximum(weight, 1) + 0.499999999), 0))
    away = distances(colours, now, space)
    out: dict[int, int] = {}
    for j in range(len(now)):
        member = np.flatnonzero(mine == j)
        out[int(colours[member[away[member, j].argmin()]]) if len(member) else int(now[j])] = int(counts[member].sum())
    total = counts.sum()
    own = away[np.arange(len(colours)), mine]
    return out, float((own * own * counts).sum() / total) if total else math.nan


def slope(points: list[int], values: list[float]) -> float:
    """Least-squares slope; values beyond 1.5 interquartile ranges are left out of the sums, but counted."""
    n = len(points)
    ordered = sorted(values)
    q1, q3 = ordered[n // 4], ordered[3 * n // 4]
    kept = [(x, y) for x, y in zip(points, values, strict=True) if q1 - 1.5 * (q3 - q1) <= y <= q3 + 1.5 * (q3 - q1)]
    sx, sy = sum(x for x, _ in kept), sum(y for _, y in kept)
    below = n * sum(x * x for x, _ in kept) - sx * sx
    return (n * sum(x * y for x, y in kept) - sx * sy) / below if n >= 2 and below else 0.0


def elbow_k(fit, n: int, start: tuple[int, ...], end: tuple[int, ...]) -> int:
    """k where the lines through the first and the last fits meet; n colours, fit(k) = error. 0 stands for all colours that aren't alike.
    Few colours: all of them, at most max(start). Lines that meet below 0 give 1."""
    if n == 1:
        return 1
    early, late = [k for k in start if k < n], [k for k in end if k < n]
    errors = {k: fit(k) for k in early + late}
    if end and n > 2 * end[-1]:
        late, errors[n] = [*late, n], 0.0
    if not early or not late:
        return min(n, max((1, *start)))
    s, e = slope(early, [errors[k] for k in early]), slope(late, [errors[k] for k in late])
    if s == e or math.isnan(s) or math.isnan(e):
        return 1
    k = min(n, math.ceil((errors[late[0]] - e * late[0] - errors[early[0]] + s * early[0]) / (s - e)))
    return k if k >= 0 else 1


def uniform_reference(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The gap statistic's reference for n pixels: (colours, counts) as the evenly spread list pairs off when read two by two."""
    flat = np.zeros(2 * n + 1, np.int64)
    flat[:n] = np.floor(np.arange(n) * (0xFFFFFF / max(n, 1)) + 0.5)
    flat[n] = 1
    return flat[0 : 2 * n : 2], flat[1 : 2 * n : 2]


def fit(colours: np.ndarray, counts: np.ndarray, reference: list[float], o: Options) -> dict[int, int]:
    """The centroids by the chosen strategy; reference: the gap statistic's, as references() gives it."""
    done: dict[int, tuple[dict[int, int], float]] = {}

    def run(k: int) -> float:
        if k not in done:
            done[k] = kmeans(colours, counts, k, o.space, o.rounds)
        return done[k][1]

    if o.strategy == "constant":
        k = o.k
    elif o.strategy == "elbow":
        k = elbow_k(run, len(colours), o.start, o.end)
    else:
        best, k = -math.inf, o.min_k
        for i in range(o.min_k, o.max_k + 1):
            error, even = run(i), reference[i - o.min_k]
            gap = math.inf if error == 0 else math.log(even) - math.log(error) if even > 0 else -math.inf
            if gap > best:
                best, k = gap, i
    run(k)
    return done[k][0]


def clamp(centroids: dict[int, int], colours: np.ndarray, counts: np.ndarray, total: int, percent: float, space: str) -> dict[int, int]:
    """Centroids moved to colours of the image with a share of at least `percent`; one that is its own nearest stays."""
    least, known, out = percent / 100, dict(zip(colours.tolist(), counts.tolist(), strict=True)), dict(centroids)
    often = counts / total >= least
    pool = colours[often] if often.any() else colours
    for c in list(centroids):
        if known.get(c, 0) > 0 and known[c] / total >= least:
            continue
        near = int(pool[distances(np.array([c]), pool, space)[0].argmin()])
        if near != c:
            out[near] = out.get(near, 0) + out.pop(c)
    return out


def merge(centroids: dict[int, int], space: str) -> dict[int, int]:
    """Colours within epsilon of each other become one, the most frequent, last in order. A pair that meets groups joins these but isn't added itself."""
    keys, groups = list(centroids), []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if distances(np.array([a]), np.array([b]), space)[0, 0] < EPSILON[space]:
                met = [g for g in groups if a in g or b in g]
                groups = [g for g in groups if not (a in g or b in g)] + [list(dict.fromkeys(x for g in met for x in g)) if met else [a, b]]
    out = dict(centroids)
    for g in groups:
        n = {c: out.pop(c) for c in g if c in out}
        if n:
            top = max(n, key=lambda c: n[c])
            out[top if n[top] > 0 else 0] = sum(n.values())
    return out


def roles(centroids: dict[int, int], near: dict[int, tuple[int, int]], outer: int, total: int, o: Options) -> dict:
    """outer, inner, third, accent and the pools. near: centroid -> (salient pixels, first pixel) of the colours nearest to it."""
    c, s = dict(centroids), o.space
    salient = sum(x for x, _ in near.values())
    delta = {k: ((near[k][0] / salient - c[k] / total) + 100) / 2 for k in sorted(near, key=lambda k: near[k][1])} if salient else {}
    ratio = lambda p, q: float(contrast(np.array([p]), np.array([q]), s)[0])
    inner = next((k for k in sorted(delta, key=lambda k: -delta[k]) if ratio(outer, k) >= o.min_contrast), None)
    if inner is None:
        rest = [(ratio(outer, k), -i, k) for i, k in enumerate(c) if k != outer]
        if rest and max(rest)[0] >= o.min_contrast:
            inner = max(rest)[2]
        else:
            inner = WHITE[s] if ratio(outer, WHITE[s]) > ratio(outer, BLACK[s]) else BLACK[s]
            c[inner] = 1
            c[outer] = c.get(outer, 0) - 1
    light = lambda k: float(lightness(np.array(k), s))
    f = 0.8 if light(inner) > light(outer) else 1.2
    outside = [k for k in c if abs(light(k) - light(inner)) * f > abs(light(k) - light(outer))]
    inside = [k for k in c if k not in outside]
    accent, best = inner, 0.0
    for k in inside:
        if k not in (outer, inner) and c[k] / total >= 0.01 and ratio(outer, k) >= 9:
            l = 100 - light(k) if light(outer) > light(inner) else light(k)  # noqa: E741
            value = float(chroma(np.array(k), s)) * distances(np.array([k]), np.array([inner]), s)[0, 0] * c[k] / total * 100 * l**4 * (delta.get(k, 0) + 1) ** 3
            if value > best:
                accent, best = k, value
    third, best = outer, 0.0
    for k in outside:
        if k not in (outer, inner) and c[k] / total >= 0.01:
            value = min(ratio(k, inner), ratio(k, accent)) * c[k] / total * 100
            if value > best:
                third, best = k, value
    rgb = lambda ks: [int(x) for x in to_rgb(np.array(list(ks), np.int64), s)] if len(ks) else []
    counted = lambda ks: list(zip(rgb(ks), [c[k] for k in ks], strict=True))
    picked = {"outer": outer, "inner": inner, "third": third, "accent": accent}
    names = dict(zip(picked, rgb(picked.values()), strict=True))
    pairs = {"outer_inner": ratio(outer, inner), "outer_accent": ratio(outer, accent), "third_inner": ratio(third, inner), "third_accent": ratio(third, accent)}
    return names | {"outer_colors": counted(outside), "inner_colors": counted(inside), "centroids": counted(list(c)), "contrasts": pairs, "lightnesses": {n: light(k) for n, k in picked.items()}}


def _near(colours, keys, weight, first, space):
    to = distances(colours, keys, space).argmin(1)
    return {int(keys[j]): (int(weight[to == j].sum()), int(first[to == j].min())) for j in np.unique(to)}


def summary(t, o: Options, reference=None) -> tuple[dict, dict]:
    """(the centroids, the record) of one image's colour table, a pandas frame."""
    t = t.sort_values("rank")
    c, cnt, total = t["c"].to_numpy(), t["cnt"].to_numpy(), int(t["n"].sum())
    found = fit(c, cnt, reference, o)
    if o.clamp is not None:
        found = clamp(found, c, cnt, total, o.clamp, o.space)
    found = merge(found, o.space)
    keys = np.array(list(found), np.int64)
    border = t["ring_n"].to_numpy() > 0
    zones = _near(c[border], keys, t["ring_n"].to_numpy()[border], t["ring_first"].fillna(0).to_numpy()[border], o.space)
    outer = min(zones, key=lambda k: (-zones[k][0], zones[k][1])) if zones else 0
    return found, roles(found, _near(c, keys, t["s"].to_numpy(), t["first"].to_numpy(), o.space), outer, total, o)
