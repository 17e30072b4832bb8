"""DuckDB SQL for the queries that SQL can express: one chain of named steps, a final SELECT for each query."""

from __future__ import annotations

import re

from ..functions.names import CSS, D50
from ..functions.names import WHITE as D50_WHITE
from ..functions.spaces import BLACK, LAB_LOW, LAB_SLOPE, LAB_WHITE, M1, M1_INVERSE, M2, M2_INVERSE, M3, M3_INVERSE


def _row(m, names) -> str:
    return " + ".join(f"({w!r}) * {n}" for w, n in zip(m, names, strict=True))


def _oklab(source: str, keep: str) -> str:
    """SQL that gives `keep`, l, a, b and the packed colour c for rows with r, g, b of `source`."""
    lin = ", ".join(f"pow(({v} + 0.055e0) / 1.055e0, 2.4e0) AS l{v}" for v in "rgb")
    xyz = ", ".join(f"{_row(row, ('lr', 'lg', 'lb'))} AS {n}" for row, n in zip(M1, ("tx", "ty", "tz"), strict=True))
    lms = ", ".join(f"cbrt({_row(row, ('tx', 'ty', 'tz'))}) AS {n}" for row, n in zip(M2, ("c1", "c2", "c3"), strict=True))
    lab = ", ".join(f"{_row(row, ('c1', 'c2', 'c3'))} AS {n}" for row, n in zip(M3, ("ll", "la", "lb_"), strict=True))
    pack = "CAST(floor(ll * 2.55e0 + 0.499999999e0) * 65536 + floor((la + 100) * 1.275e0 + 0.499999999e0) * 256 + floor((lb_ + 100) * 1.275e0 + 0.499999999e0) AS INT)"
    return f"SELECT {keep}, ll, la, lb_, {pack} AS c FROM (SELECT {keep}, {lab} FROM (SELECT {keep}, {lms} FROM (SELECT {keep}, {xyz} FROM (SELECT {keep}, {lin} FROM {source}))))"


def _rgb_of(c: str) -> str:
    """An expression for the packed RGB of a packed oklab colour."""
    step = f"list_value((({c}) // 65536) / 2.55e0, ((({c}) // 256) % 256) / 1.275e0 - 100, (({c}) % 256) / 1.275e0 - 100)"
    for m, after in ((M3_INVERSE, "pow({}, 3)"), (M2_INVERSE, "{}"), (M1_INVERSE, "{}")):
        rows = ", ".join(after.format("(" + _row(r, ("v[1]", "v[2]", "v[3]")) + ")") for r in m)
        step = f"list_transform([{step}], lambda v: list_value({rows}))[1]"
    byte = "CAST(least(255, greatest(0, floor((CASE WHEN {0} < 0 THEN 0 ELSE pow(greatest({0}, 0), 1 / 2.4e0) * 1.055e0 - 0.055e0 END) + 0.499999999e0))) AS INT)"
    return f"list_transform([{step}], lambda u: {byte.format('u[1]')} * 65536 + {byte.format('u[2]')} * 256 + {byte.format('u[3]')})[1]"


def _apca(text: str, ground: str) -> str:
    """An expression for the contrast of two packed RGB colours."""
    y = lambda c: f"(0.2126729e0 * pow(({c} // 65536) / 255e0, 2.4e0) + 0.7151522e0 * pow((({c} // 256) % 256) / 255e0, 2.4e0) + 0.0721750e0 * pow(({c} % 256) / 255e0, 2.4e0))"
    soft = lambda v: f"CASE WHEN {v} < 0.022e0 THEN {v} + pow(greatest(0.022e0 - {v}, 0), 1.414e0) ELSE {v} END"
    ys = f"list_transform([list_value({y(text)}, {y(ground)})], lambda p: list_value({soft('p[1]')}, {soft('p[2]')}))[1]"
    raw = "CASE WHEN abs(q[2] - q[1]) < 0.0005e0 THEN 0e0 WHEN q[2] > q[1] THEN 1.14e0 * (pow(q[2], 0.56e0) - pow(q[1], 0.57e0)) ELSE 1.14e0 * (pow(q[2], 0.65e0) - pow(q[1], 0.62e0)) END"
    cut = "CASE WHEN abs(s) < 0.1e0 THEN 0e0 WHEN s > 0 THEN s - 0.027e0 ELSE s + 0.027e0 END"
    return f"list_transform(list_transform(list_transform([{ys}], lambda q: {raw}), lambda s: 100e0 * ({cut})), lambda z: CASE WHEN z < 0 THEN -z / 1.08e0 ELSE z / 1.06e0 END)[1]"


def _distance(p: str, q: str, space: str = "oklab") -> str:
    s = ("1e0", "1e0", "1e0") if space == "rgb" else ("(1 / 2.55e0)", "(2.35e0 / 1.275e0)", "(2.35e0 / 1.275e0)")
    return f"sqrt(pow((({p}) // 65536 - ({q}) // 65536) * {s[0]}, 2) + pow(((({p}) // 256) % 256 - (({q}) // 256) % 256) * {s[1]}, 2) + pow((({p}) % 256 - ({q}) % 256) * {s[2]}, 2))"


_BYTE = "CAST(least(255, greatest(0, round_even({}, 0))) AS INT)"
_BLACK, _WHITE = "32639", "13533055"
_LEVELS = 4  # of trimmed images that are 19 wide and at least 16 high


def _pyramid() -> str:
    out = ["p0 AS (SELECT image_id, w, h, x, y, v FROM gray)"]
    for n in range(1, _LEVELS + 1):
        out.append(f"p{n} AS (SELECT image_id, w // 2 AS w, h // 2 AS h, x // 2 AS x, y // 2 AS y, {_BYTE.format('sum(v) / 4e0')} AS v FROM p{n - 1} WHERE x < w // 2 * 2 AND y < h // 2 * 2 GROUP BY ALL)")
    return ",\n".join(out) + ",\npyr AS (" + " UNION ALL ".join(f"SELECT image_id, {n} AS level, CAST(y * w + x AS INT) AS pidx, v FROM p{n}" for n in range(_LEVELS + 1)) + ")"


def _pixels(key: str = "l_suppkey", width: int = 20, structured: bool = False) -> str:
    """SQL of the images derived from lineitem: rows of `width` pixels, the last one filled from the row above."""
    first = "floor(r * 0.299e0 + g * 0.587e0 + b * 0.114e0), " if structured else ""
    return f"""pix AS (SELECT image_id, {width} AS w, CAST((n + {width - 1}) // {width} AS INT) AS h, CAST(idx AS INT) AS idx, CAST(idx % {width} AS INT) AS x, CAST(idx // {width} AS INT) AS y, r, g, b FROM (
    WITH one AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {first}l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) - 1 AS idx, count(*) OVER (PARTITION BY image_id) AS n
        FROM (SELECT *, CAST({key} AS BIGINT) AS image_id, CAST(round(l_quantity * 5) AS INT) AS r, CAST(round(l_discount * 2500) AS INT) AS g, CAST(round(l_tax * 3000) AS INT) AS b FROM lineitem))
    SELECT image_id, idx, n, r, g, b FROM one UNION ALL SELECT image_id, idx + {width}, n, r, g, b FROM one WHERE idx + {width} >= n AND idx + {width} < (n + {width - 1}) // {width} * {width}))"""


def _chain(**how) -> str:
    return f"WITH RECURSIVE {_pixels(**how)},\n{STEPS}"


STEPS = f"""px AS (SELECT image_id, w1 - w0 AS w, h1 - h0 AS h, CAST((y - h0) * (w1 - w0) + x - w0 AS INT) AS idx, x - w0 AS x, y - h0 AS y, r, g, b FROM (
    SELECT *, CAST(floor(w * 0.025e0 + 0.5e0) AS INT) AS w0, CAST(floor(w * 0.975e0 + 0.5e0) AS INT) AS w1, CAST(floor(h * 0.025e0 + 0.5e0) AS INT) AS h0, CAST(floor(h * 0.975e0 + 0.5e0) AS INT) AS h1 FROM pix) WHERE x >= w0 AND x < w1 AND y >= h0 AND y < h1),
rgb AS (SELECT *, r * 65536 + g * 256 + b AS c FROM px),
ok AS ({_oklab("px", "image_id, w, h, idx, x, y, r, g, b")}),
gray AS (SELECT image_id, w, h, idx, x, y, {_BYTE.format(_distance("c", _BLACK))} AS v FROM ok),
{_pyramid()},
diffs AS (SELECT g.image_id, g.idx, sum(coalesce(abs(g.v - q.v), 0)) AS s FROM gray g CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS level) n
    LEFT JOIN pyr q ON q.image_id = g.image_id AND q.level = n.level AND q.pidx = (g.y // (1 << n.level)) * (g.w // (1 << n.level)) + g.x // (1 << n.level) GROUP BY ALL),
dd AS (SELECT image_id, idx, {_BYTE.format("s / 4e0")} AS d FROM diffs),
sal AS (SELECT image_id, idx, d, CAST(2 * d > max(d) OVER (PARTITION BY image_id) AS INT) AS sal FROM dd),
raw AS (SELECT o.image_id, o.c, count(*) AS n, sum(s.sal) AS s, min(o.idx) AS first_idx FROM ok o JOIN sal s USING (image_id, idx) GROUP BY ALL),
hist AS (SELECT image_id, c, CAST(floor((n + s * 2e0) / (sum(n) OVER i + sum(s) OVER i * 2e0) * sum(n) OVER i + 0.5e0) AS BIGINT) AS cnt, first_idx FROM raw WINDOW i AS (PARTITION BY image_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first_idx) AS rank FROM hist),
cents AS (SELECT image_id, CAST(rank AS INT) AS ord, c AS cent, cnt FROM ranked WHERE rank <= 8),
near AS (SELECT * FROM (SELECT h.image_id, h.c, h.cnt, k.ord, k.cent, {_distance("h.c", "k.cent")} AS d FROM hist h JOIN cents k USING (image_id)) QUALIFY row_number() OVER (PARTITION BY image_id, c ORDER BY d, ord) = 1),
ring AS (SELECT * FROM ok WHERE sqrt(pow(x - w / 2e0, 2) + pow(idx / CAST(w AS DOUBLE) - h / 2e0, 2)) > greatest(w, h) / 2e0 * 0.95e0),
zones AS (SELECT r.image_id, n.cent, count(*) AS n, min(r.idx) AS first FROM ring r JOIN near n ON r.image_id = n.image_id AND r.c = n.c GROUP BY ALL),
outers AS (SELECT image_id, cent AS "outer" FROM zones QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) = 1),
shares AS (SELECT n.image_id, n.cent, sum(r.s) AS s, min(r.first_idx) AS first FROM near n JOIN raw r ON r.image_id = n.image_id AND r.c = n.c GROUP BY ALL),
totals AS (SELECT image_id, sum(s) AS all_s, sum(n) AS total FROM raw GROUP BY ALL),
share AS (SELECT s.image_id, s.cent, (s.s / CAST(t.all_s AS DOUBLE) - k.cnt / CAST(t.total AS DOUBLE) + 100) / 2e0 AS delta, s.first FROM shares s JOIN totals t USING (image_id) JOIN cents k ON k.image_id = s.image_id AND k.cent = s.cent WHERE t.all_s > 0),
contrasts AS (SELECT k.image_id, k.ord, k.cent, o."outer", {_apca(_rgb_of('o."outer"'), _rgb_of("k.cent"))} AS k FROM cents k JOIN outers o USING (image_id)),
by_sal AS (SELECT s.image_id, s.cent FROM share s JOIN contrasts c ON c.image_id = s.image_id AND c.cent = s.cent WHERE c.k >= 22 QUALIFY row_number() OVER (PARTITION BY s.image_id ORDER BY s.delta DESC, s.first) = 1),
by_con AS (SELECT image_id, cent FROM contrasts WHERE cent <> "outer" AND k >= 22 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC, ord) = 1),
picked AS (SELECT o.image_id, o."outer", coalesce(s.cent, c.cent, CASE WHEN {_apca(_rgb_of('o."outer"'), _rgb_of(_WHITE))} > {_apca(_rgb_of('o."outer"'), _rgb_of(_BLACK))} THEN {_WHITE} ELSE {_BLACK} END) AS "inner"
    FROM outers o LEFT JOIN by_sal s ON s.image_id = o.image_id LEFT JOIN by_con c ON c.image_id = o.image_id),
luma AS (SELECT *, CAST(floor(r * 0.299e0 + g * 0.587e0 + b * 0.114e0) AS INT) AS v FROM pix),
adaptive AS (SELECT p.image_id, p.w, p.h, p.idx, p.x, p.y, CASE WHEN p.v > avg(q.v) - 10 THEN 255 ELSE 0 END AS v FROM luma p JOIN luma q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 7 AND p.x + 7 AND q.y BETWEEN p.y - 7 AND p.y + 7 GROUP BY p.image_id, p.w, p.h, p.idx, p.x, p.y, p.v)
"""


def _morph(name: str, source: str, function: str) -> str:
    return f",\n{name} AS (SELECT p.image_id, p.w, p.h, p.idx, p.x, p.y, CASE WHEN p.x BETWEEN 2 AND p.w - 3 AND p.y BETWEEN 2 AND p.h - 3 THEN {function}(q.v) ELSE 0 END AS v FROM {source} p JOIN {source} q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 2 GROUP BY p.image_id, p.w, p.h, p.idx, p.x, p.y)"


def _to_ring(limit: str) -> str:
    return f"sqrt(pow(x - w / 2e0, 2) + pow(idx / CAST(w AS DOUBLE) - h / 2e0, 2)) {limit}"


def sql() -> dict[str, str]:
    chroma = "CASE WHEN abs({0}) < 7.5e-5 AND abs({1}) < 7.5e-5 THEN 0e0 ELSE sqrt({0} * {0} + {1} * {1}) END / 1.5e0"
    packed_ab = ("(c // 256 % 256) / 1.275e0 - 100", "(c % 256) / 1.275e0 - 100")
    value = lambda e, t, digits=6: f"SELECT image_id, idx, round({e}, {digits}) AS value FROM {t}"
    spot = f"(SELECT c FROM ({_oklab('(SELECT 200 AS r, 100 AS g, 50 AS b)', 'r, g, b')}))"
    lin = lambda v: f"pow(({v} + 0.055e0) / 1.055e0, 2.4e0)"
    keep = f"({_to_ring('> greatest(w, h) / 2e0 * 0.95e0')} OR {_to_ring('< greatest(w, h) / 2e0 * 0.70e0')})"
    moved = f"{_to_ring('<= greatest(w, h) / 2e0 * 0.9e0')} AND {_to_ring('> greatest(w, h) / 2e0 * 0.9e0 / 2')}"
    finals = {
        "pixels_trim": "SELECT image_id, w, h, idx, x, y, r, g, b FROM px",
        "png_round_trip": "SELECT image_id, w, h, idx, r, g, b FROM pix",
        "pack_rgb": "SELECT image_id, idx, c FROM rgb",
        "pack_oklab": "SELECT image_id, idx, c FROM ok",
        "unpack_oklab": f"SELECT image_id, idx, {_rgb_of('c')} AS rgb FROM ok",
        "distance_rgb": value(_distance("c", str(200 * 65536 + 100 * 256 + 50), "rgb"), "rgb"),
        "distance_oklab": value(_distance("c", "spot"), f"ok CROSS JOIN (SELECT {spot} AS spot)"),
        "lightness_rgb": value(f"100e0 * (0.21263900587151027e0 * {lin('r')} + 0.715168678767756e0 * {lin('g')} + 0.07219231536073371e0 * {lin('b')})", "rgb", 3),
        "lightness_oklab": value("(c // 65536) / 2.06e0", "ok"),
        "chroma_rgb": value(chroma.format("la", "lb_"), "ok"),
        "chroma_oklab": value(chroma.format(*(f"({x})" for x in packed_ab)), "ok"),
        "contrast_rgb": value(_apca("0", "c"), "rgb"),
        "contrast_oklab": value(_apca(_rgb_of(_BLACK), _rgb_of("c")), "ok"),
        "conv_oklch": "SELECT image_id, idx, round(sqrt(la * la + lb_ * lb_), 6) AS chroma, CASE WHEN sqrt(la * la + lb_ * lb_) > 1e-6 THEN round((degrees(atan2(lb_, la)) + 360) % 360, 3) END AS hue FROM ok",
        "grayscale_distance": "SELECT image_id, idx, v FROM gray",
        "grayscale_luma": "SELECT image_id, idx, v FROM luma",
        "pyramid_all": "SELECT * FROM pyr",
        "saliency_mask": "SELECT * FROM sal",
        "hist_unweighted": "SELECT image_id, c, count(*) AS cnt, min(idx) AS first_idx FROM ok GROUP BY ALL",
        "hist_weighted": "SELECT image_id, c, cnt, first_idx FROM hist",
        "hist_rank": "SELECT image_id, c, CAST(rank AS INT) AS rank FROM ranked",
        "distinct_colors": "SELECT image_id, count(DISTINCT c) AS n FROM ok GROUP BY ALL",
        "top_colors": "SELECT image_id, CAST(rank AS INT) AS rank, '#' || lpad(lower(to_hex(c)), 6, '0') AS hex, cnt FROM (SELECT image_id, c, count(*) AS cnt, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, min(idx)) AS rank FROM rgb GROUP BY image_id, c) WHERE rank <= 5",
        "nearest_seed_assign": "SELECT image_id, c, cnt, ord, round(d, 6) AS d FROM near",
        "centroid_update": "SELECT image_id, ord, CAST(coalesce(floor(sum((c // 65536) * cnt) / CAST(nullif(sum(cnt), 0) AS DOUBLE) + 0.499999999e0), 0) * 65536 + coalesce(floor(sum((c // 256 % 256) * cnt) / CAST(nullif(sum(cnt), 0) AS DOUBLE) + 0.499999999e0), 0) * 256 + coalesce(floor(sum((c % 256) * cnt) / CAST(nullif(sum(cnt), 0) AS DOUBLE) + 0.499999999e0), 0) AS INT) AS mean, CAST(sum(cnt) AS BIGINT) AS wsum FROM near GROUP BY ALL",
        "wcss_step": "SELECT image_id, round(sum(d * d * cnt) / sum(cnt), 6) AS wcss FROM near GROUP BY ALL",
        "near_duplicate_pairs": f"SELECT p.image_id, p.ord AS a, q.ord AS b, round({_distance('p.cent', 'q.cent')}, 6) AS d FROM cents p JOIN cents q ON p.image_id = q.image_id AND p.ord < q.ord WHERE {_distance('p.cent', 'q.cent')} < 8",
        "border_ring": "SELECT image_id, idx, c FROM ring",
        "border_tally": "SELECT * FROM outers",
        "saliency_share": "SELECT image_id, cent, round(delta, 6) AS delta, first FROM share",
        "foreground_pick": "SELECT * FROM picked",
        "pool_split": 'SELECT k.image_id, k.cent, CASE WHEN abs((k.cent // 65536) / 2.06e0 - (p."inner" // 65536) / 2.06e0) * CASE WHEN p."inner" // 65536 > p."outer" // 65536 THEN 0.8e0 ELSE 1.2e0 END > abs((k.cent // 65536) / 2.06e0 - (p."outer" // 65536) / 2.06e0) THEN \'outer\' ELSE \'inner\' END AS pool FROM cents k JOIN picked p USING (image_id)',
        "otsu": "SELECT image_id, v AS threshold FROM (SELECT image_id, v, CASE WHEN n1 = 0 THEN 0 ELSE round(pow(s0 / CAST(n0 AS DOUBLE) - (sa - s0) / CAST(nullif(n1, 0) AS DOUBLE), 2) * n0 * n1, 3) END AS f FROM (SELECT image_id, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER i - sum(n) OVER w AS n1, sum(n * v) OVER i AS sa FROM (SELECT image_id, v, count(*) AS n FROM gray GROUP BY ALL) WINDOW w AS (PARTITION BY image_id ORDER BY v), i AS (PARTITION BY image_id))) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY f DESC, v) = 1",
        "global_threshold": "SELECT image_id, idx, CASE WHEN (v > 127) <> (avg(CAST(v > 127 AS INT)) OVER (PARTITION BY image_id) > 0.5) THEN 255 ELSE 0 END AS v FROM luma",
        "adaptive_threshold": "SELECT image_id, idx, v FROM adaptive",
        "mask_preview": f"SELECT image_id, idx, CASE WHEN {keep} THEN r ELSE 0 END AS r, CASE WHEN {keep} THEN g ELSE 0 END AS g, CASE WHEN {keep} THEN b ELSE 0 END AS b FROM pix",
        "saliency_overlay": "SELECT p.image_id, p.idx, p.r * s.sal AS r, p.g * s.sal AS g, p.b * s.sal AS b, s.sal * 255 AS a FROM px p JOIN sal s USING (image_id, idx)",
        "scramble": f"SELECT p.image_id, p.idx, coalesce(m.r, 0) AS r, coalesce(m.g, 0) AS g, coalesce(m.b, 0) AS b FROM pix p LEFT JOIN (SELECT image_id, CASE WHEN {moved} THEN w * h - idx ELSE idx END AS dest, arg_max(r, idx) AS r, arg_max(g, idx) AS g, arg_max(b, idx) AS b FROM pix GROUP BY ALL) m ON m.image_id = p.image_id AND m.dest = p.idx",
        "uniform_reference": "SELECT n AS total, CAST(i AS INT) AS id, CAST(CASE WHEN 2 * i < n THEN CAST(floor((2 * i) * (16777215 / CAST(n AS DOUBLE)) + 0.5e0) AS BIGINT) WHEN 2 * i = n THEN 1 ELSE 0 END AS INT) AS c, CASE WHEN 2 * i + 1 < n THEN CAST(floor((2 * i + 1) * (16777215 / CAST(n AS DOUBLE)) + 0.5e0) AS BIGINT) WHEN 2 * i + 1 = n THEN 1 ELSE 0 END AS cnt FROM (SELECT n, unnest(range(n)) AS i FROM (SELECT DISTINCT n FROM (SELECT count(*) AS n FROM px GROUP BY image_id)))",
    }
    finals |= {
        "pack_lab": f"SELECT image_id, idx, c FROM ({_lab()})",
        "unpack_lab": f"SELECT image_id, idx, {_rgb_of_lab('c')} AS rgb FROM ({_lab()})",
        "lightness_lab": value("floor(c / 65536e0) / 2.55e0", f"({_lab()})"),
        "chroma_lab": value(chroma.format("((c & 65280) / 256 / 1.02e0 - 125)", "((c & 255) / 1.02e0 - 125)"), f"({_lab()})"),
        "contrast_lab": value(f"abs({BLACK['lab'] >> 16} - floor(c / 65536e0)) / 2.55e0", f"({_lab()})"),
        "distance_lab": f"SELECT image_id, idx, round(d, 6) AS value FROM ({_ciede(f'(SELECT p.image_id, p.idx, {_lab_fields("p.c", 1)}, {_lab_fields("q.c", 2)} FROM ({_lab()}) p CROSS JOIN ({_lab("(SELECT 0 AS image_id, 0 AS idx, 200 AS r, 100 AS g, 50 AS b)")}) q)', 'image_id, idx')})",
        "nearest_css_name": f"SELECT n.image_id, CAST(n.rank AS INT) AS rank, n.c, m.name FROM (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, min(idx)) AS rank FROM rgb GROUP BY image_id, c) n JOIN ({_named()}) m ON m.c = n.c",
        "accent_pick": "SELECT * FROM accents",
        "third_pick": "SELECT * FROM thirds",
        "seed_colours": "SELECT image_id, ord, c FROM seeds",
        "clamp_nearest": "SELECT image_id, c, CAST(sum(n) AS BIGINT) AS n FROM clamped GROUP BY ALL",
        "iqr_outliers": "SELECT image_id, k, round(wcss, 6) AS wcss, kept FROM kept_errors",
        "elbow_slope": "SELECT image_id, round((m * sum(k * wcss) FILTER (kept) - sum(k) FILTER (kept) * sum(wcss) FILTER (kept)) / (m * sum(k * k) FILTER (kept) - sum(k) FILTER (kept) * sum(k) FILTER (kept)), 6) AS slope FROM kept_errors GROUP BY image_id, m",
    }
    more = _later()
    out = {name: f"{_chain()}{more.get(name, '')}{final}" for name, final in finals.items()}
    shape = "SELECT image_id, idx, v FROM {}"
    smooth = _chain(structured=True).rstrip()
    out["erosion"] = smooth + _morph("e", "adaptive", "min") + "\n" + shape.format("e")
    out["dilation"] = smooth + _morph("e", "adaptive", "max") + "\n" + shape.format("e")
    out["opening"] = smooth + _morph("e", "adaptive", "min") + _morph("f", "e", "max") + "\n" + shape.format("f")
    out["closing"] = smooth + _morph("e", "adaptive", "max") + _morph("f", "e", "min") + "\n" + shape.format("f")
    sum_of = lambda w: f"sum(q.v * {w})"
    gx, gy = sum_of("(q.x - p.x) * (2 - abs(q.y - p.y))"), sum_of("(q.y - p.y) * (2 - abs(q.x - p.x))")
    out["sobel"] = f"{smooth}\nSELECT p.image_id, p.idx, CASE WHEN p.x BETWEEN 1 AND p.w - 2 AND p.y BETWEEN 1 AND p.h - 2 AND sqrt({gx} * {gx} + {gy} * {gy}) > 128 THEN 255 ELSE 0 END AS v FROM adaptive p JOIN adaptive q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.w, p.h, p.idx, p.x, p.y"
    from . import oracle_clusters  # its steps come after these

    out |= oracle_clusters.sql()
    out |= _standard()
    out["text_segments"] = f"WITH RECURSIVE {_pages()}\nSELECT image_id, y, x1, x2 FROM segments"
    out["text_regions"] = f"WITH RECURSIVE {_pages()},\n{_JOINED}\nSELECT image_id, ord, x1, y1, x2, y2, area FROM regions"
    out["text_region_pixels"] = f"WITH RECURSIVE {_pages()},\n{_JOINED}\nSELECT DISTINCT p.image_id, p.idx, p.x, p.y, p.r, p.g, p.b FROM pix p JOIN regions r ON r.image_id = p.image_id AND p.x BETWEEN r.x1 AND r.x2 AND p.y BETWEEN r.y1 AND r.y2"
    edges = smooth + _morph("e1", "adaptive", "min") + _morph("e2", "e1", "max") + _morph("e3", "e2", "max") + _morph("e4", "e3", "min")
    gx, gy = sum_of("(q.x - p.x) * (2 - abs(q.y - p.y))"), sum_of("(q.y - p.y) * (2 - abs(q.x - p.x))")
    edges += f",\nedges AS MATERIALIZED (SELECT p.image_id, p.w, p.idx FROM e4 p JOIN e4 q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.w, p.h, p.idx, p.x, p.y HAVING p.x BETWEEN 1 AND p.w - 2 AND p.y BETWEEN 1 AND p.h - 2 AND sqrt({gx} * {gx} + {gy} * {gy}) > 128),\n{_FILLED}"
    out["contours"] = f"{edges}\nSELECT image_id, CAST(contour AS INT) AS contour_id, CAST(ord AS INT) AS ord, CAST(p % w AS INT) AS x, CAST(p // w AS INT) AS y FROM points"
    out["contour_pixels"] = f"{edges}\nSELECT image_id, idx, x, y, r, g, b FROM pix SEMI JOIN points ON points.image_id = pix.image_id AND points.p = pix.idx"
    return out


def _standard() -> dict[str, str]:
    """The standard conversions, and the walks that increase contrast."""
    toe = lambda v: f"CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(({v} + 0.055e0) / 1.055e0, 2.4e0) END"
    out = lambda v: f"CASE WHEN abs({v}) > 0.0031308e0 THEN sign({v}) * (1.055e0 * pow(abs({v}), 1 / 2.4e0) - 0.055e0) ELSE 12.92e0 * {v} END"
    rows = lambda m, v, names, f="{}": ", ".join(f.format(f"({_row(r, v)})") + f" AS {n}" for r, n in zip(m, names, strict=True))
    lin = ", ".join(f"{toe(e)} AS l{i}" for i, e in enumerate(("(c // 65536 / 255e0)", "(c // 256 % 256 / 255e0)", "(c % 256 / 255e0)")))
    t, p, b, u = ([f"{n}{i}" for i in range(3)] for n in "tpbu")
    there = f"SELECT *, {rows(M3, ('q0', 'q1', 'q2'), ('k0', 'k1', 'k2'))} FROM (SELECT *, {rows(M2, t, ('q0', 'q1', 'q2'), 'cbrt({})')} FROM (SELECT *, {rows(M1, ('l0', 'l1', 'l2'), t)} FROM (SELECT *, {lin} FROM (SELECT image_id, c, count(*) AS n FROM rgb GROUP BY ALL))))"
    back = lambda source, v: f"SELECT *, {rows(M1_INVERSE, b, u)} FROM (SELECT *, {rows(M2_INVERSE, p, b)} FROM (SELECT *, {rows(M3_INVERSE, v, p, 'pow({}, 3)')} FROM ({source})))"
    hue = "CASE WHEN abs(k1) >= 0.0002e0 OR abs(k2) >= 0.0002e0 THEN (degrees(atan2(k2, k1)) + 360) % 360 END"
    polar = f"SELECT *, coalesce(ch * cos(radians(hue)), 0) AS a, coalesce(ch * sin(radians(hue)), 0) AS b FROM (SELECT *, sqrt(k1 * k1 + k2 * k2) AS ch, {hue} AS hue FROM ({there}))"
    byte = lambda v: f"CAST(least(255, greatest(0, floor(({out(v)}) * 255 + 0.5e0))) AS INT)"
    lch = f"{_chain()}SELECT image_id, c, n, round(k0, 6) AS lightness, round(ch, 6) AS chroma, round(hue, 3) AS hue, {byte('u0')} * 65536 + {byte('u1')} * 256 + {byte('u2')} AS back FROM ({back(polar, ('k0', 'a', 'b'))})"
    xyz = f"{_chain()}SELECT image_id, c, {', '.join(f'round({v}{i}, 6) AS {n}{i}' for n, v in (('lab', 'k'), ('xyz', 'b'), ('linear', 'u')) for i in range(3))} FROM ({back(there, ('k0', 'k1', 'k2'))})"
    white = {"rgb": "16777215", "oklab": _WHITE}
    light = {"rgb": lambda c: "({})".format(_row(M1[1], [f"pow((({e}) + 0.055e0) / 1.055e0, 2.4e0)" for e in (f"{c} // 65536", f"{c} // 256 % 256", f"{c} % 256")])), "oklab": lambda c: f"(({c}) // 65536 / 2.06e0)"}
    found = {"rgb": _apca("ground", "c"), "oklab": _apca(_rgb_of("ground"), _rgb_of("c"))}
    held = "CASE WHEN {0} < 0 THEN 0 ELSE least(255, greatest(0, floor(pow(greatest({0}, 0), 1 / 2.4e0) * 1.055e0 - 0.055e0 + 0.5e0))) END"
    xyz0 = ", ".join(f"{_row(r, [f'pow((({e}) + 0.055e0) / 1.055e0, 2.4e0)' for e in ('cent // 65536', 'cent // 256 % 256', 'cent % 256')])} AS v{i}" for i, r in enumerate(M1))
    axes = ("((cent // 256 % 256) / 1.275e0 - 100)", "((cent % 256) / 1.275e0 - 100)")
    chroma = f"(CASE WHEN abs({axes[0]}) < 7.5e-5 AND abs({axes[1]}) < 7.5e-5 THEN 0e0 ELSE sqrt({axes[0]} * {axes[0]} + {axes[1]} * {axes[1]}) END / 1.5e0)"
    turn = f"CASE WHEN abs({axes[0]}) >= 0.0002e0 OR abs({axes[1]}) >= 0.0002e0 THEN (degrees(atan2({axes[1]}, {axes[0]})) + 360) % 360 END"
    start = {"rgb": xyz0, "oklab": f"cent // 65536 / 2.06e0 AS v0, {chroma} AS v1, {turn} AS v2"}
    step = {"rgb": "v0, v1 + CASE WHEN lighter THEN 0.01e0 ELSE -0.01e0 END AS v1, v2", "oklab": "v0 + CASE WHEN lighter THEN 1e0 ELSE -1e0 END AS v0, v1 - 0.01e0 AS v1, v2"}
    inside = {"rgb": "v1 > 0 AND v1 < 1", "oklab": "v0 > 0 AND v0 < 100"}
    colour = {
        "rgb": "CAST(" + " + ".join(f"({held.format('(' + _row(r, ('v0', 'v1', 'v2')) + ')')}) * {m}" for r, m in zip(M1_INVERSE, (65536, 256, 1), strict=True)) + " AS INT)",
        "oklab": "CAST(trunc(v0 * 2.06e0) * 65536 + coalesce(floor((v1 * cos(radians(v2)) + 100) * 1.275e0 + 0.5e0), 0) * 256 + coalesce(floor((v1 * sin(radians(v2)) + 100) * 1.275e0 + 0.5e0), 0) AS INT)",
    }
    table = {"rgb": "rgb", "oklab": "ok"}
    result = {"standard_oklch": lch, "standard_xyz": xyz}
    for s in ("rgb", "oklab"):
        tops = f"SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, min(idx)) AS INT) AS ord, c AS cent FROM {table[s]} GROUP BY image_id, c QUALIFY ord <= 8"
        result[f"increase_contrast_{s}"] = f"""{_chain().rstrip()},
tops AS MATERIALIZED ({tops}),
walked AS (SELECT 0 AS i, t.image_id, t.ord, t.cent, g.cent AS ground, {light[s](white[s])} > {light[s]("g.cent")} AS lighter, {re.sub(r"\bcent\b", "t.cent", start[s])}, t.cent AS c, 0e0 AS k FROM tops t JOIN tops g ON g.image_id = t.image_id AND g.ord = 1
    UNION ALL SELECT i + 1, image_id, ord, cent, ground, lighter, v0, v1, v2, c, {found[s]} FROM (SELECT * REPLACE ({colour[s]} AS c) FROM (SELECT i, image_id, ord, cent, ground, lighter, {step[s]}, c, k FROM walked WHERE k < 40) WHERE {inside[s]}))
SELECT image_id, ord, cent, arg_max(c, i) AS moved FROM walked GROUP BY image_id, ord, cent"""
    return result


def _pages() -> str:
    return f"{_pixels('l_suppkey // 16', 64)},\n{_SCAN}"


#: The segments of each line meet those of the next lines, one at a time: `todo` are those of line y that have yet to meet line y + w.
_JOINED = """listed AS (SELECT s.image_id, p.h, 6 * p.h // 640 AS gap, list({'id': s.id, 'line': s.y, 'pos': s.x1, 'x1': s.x1, 'y1': s.y, 'x2': s.x2, 'y2': s.y}) AS segs FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x1) AS id FROM segments) s
    JOIN (SELECT image_id, any_value(h) AS h FROM pix GROUP BY image_id) p ON p.image_id = s.image_id GROUP BY s.image_id, p.h),
met AS (SELECT image_id, h, gap, -1 AS y, gap AS w, CAST([] AS BIGINT[]) AS todo, segs, CAST(1000000 AS BIGINT) AS n FROM listed
    UNION ALL SELECT image_id, h, gap, y, w, CASE WHEN a IS NULL THEN list_transform(list_sort(list_transform(list_filter(segs, lambda s: s.line = y), lambda s: {'pos': s.pos, 'id': s.id})), lambda s: s.id) ELSE todo[2:] END,
        CASE WHEN b IS NULL THEN segs ELSE list_append(list_filter(segs, lambda s: s.id <> a.id AND s.id <> b.id), {'id': n, 'line': b.line, 'pos': n, 'x1': least(a.x1, b.x1), 'y1': a.y1, 'x2': greatest(a.x2, b.x2), 'y2': b.y2}) END, n + 1
    FROM (SELECT *, list_sort(list_transform(list_filter(segs, lambda s: a IS NOT NULL AND s.line = y + w AND a.x1 <= s.x2 AND s.x1 <= a.x2), lambda s: {'pos': s.pos, 's': s}))[1].s AS b
        FROM (SELECT image_id, h, gap, CASE WHEN len(todo) > 0 THEN y WHEN w < gap THEN y ELSE y + 1 END AS y, CASE WHEN len(todo) > 0 THEN w WHEN w < gap THEN w + 1 ELSE 1 END AS w, todo, segs, n, CASE WHEN len(todo) > 0 THEN list_filter(segs, lambda s: s.id = todo[1])[1] END AS a
            FROM met WHERE gap > 0 AND (len(todo) > 0 OR y < h - gap))) WHERE y < h - gap),
ended AS (SELECT image_id, arg_max(segs, n) AS segs FROM met GROUP BY image_id),
regions AS MATERIALIZED (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY s.line, s.pos) - 1 AS INT) AS ord, CAST(s.x1 AS INT) AS x1, CAST(s.y1 AS INT) AS y1, CAST(s.x2 AS INT) AS x2, CAST(s.y2 AS INT) AS y2, CAST((s.x2 - s.x1 + 1) * (s.y2 - s.y1 + 1) AS BIGINT) AS area FROM (SELECT image_id, unnest(segs) AS s FROM ended))"""

#: A flood fill a pixel at a time: `todo` is a stack, `got` what its top brought up; edge pixels never lie on an image's border.
_FILLED = """filled AS (SELECT image_id, w, list_sort(list(idx)) AS rest, CAST([] AS INT[]) AS todo, CAST([] AS INT[]) AS got, -1 AS contour, 0 AS n, 0 AS i FROM edges GROUP BY image_id, w
    UNION ALL SELECT image_id, w, CASE WHEN len(todo) = 0 THEN rest[2:] ELSE list_filter(rest, lambda p: NOT list_contains(new, p)) END, CASE WHEN len(todo) = 0 THEN [rest[1]] ELSE list_concat(todo[:-2], new) END,
        CASE WHEN len(todo) = 0 THEN [] ELSE new END, CASE WHEN len(todo) > 0 AND n = 0 AND len(new) > 0 THEN contour + 1 ELSE contour END, CASE WHEN len(todo) = 0 THEN 0 ELSE n + len(new) END, i + 1
    FROM (SELECT *, list_filter([todo[-1] - 1, todo[-1] + 1, todo[-1] - w, todo[-1] + w, todo[-1] - w - 1, todo[-1] + w - 1, todo[-1] - w + 1, todo[-1] + w + 1], lambda p: list_contains(rest, p)) AS new FROM filled WHERE len(rest) > 0)),
points AS MATERIALIZED (SELECT image_id, w, contour, unnest(got) AS p, n - len(got) + unnest(range(len(got))) AS ord FROM filled)"""


#: The scan of each row, pixel by pixel, with its counters as they are after each.
_SCAN = """bw AS MATERIALIZED (SELECT image_id, w, y, x, (v > 127) <> (avg(CAST(v > 127 AS INT)) OVER (PARTITION BY image_id) > 0.5) AS white FROM (SELECT *, CAST(floor(r * 0.299e0 + g * 0.587e0 + b * 0.114e0) AS INT) AS v FROM pix)),
scan AS (SELECT DISTINCT image_id, w, y, -1 AS x, -1 AS start, 0 AS whites, 0 AS blacks, 0 AS len, -1 AS x1, -1 AS x2 FROM bw
    UNION ALL SELECT image_id, w, y, x, CASE WHEN shut THEN -1 ELSE start END, CASE WHEN shut THEN 0 ELSE whites END, CASE WHEN shut THEN 0 ELSE blacks END, CASE WHEN shut OR start < 0 THEN 0 ELSE len + 1 END,
        CASE WHEN shut AND len >= 30 * w / 640e0 THEN start ELSE -1 END, CASE WHEN shut AND len >= 30 * w / 640e0 THEN start + len ELSE -1 END
    FROM (SELECT *, whites > 13 * w / 640e0 OR blacks > 10 * w / 640e0 OR x = w - 1 AS shut FROM (
        SELECT b.image_id, b.w, b.y, b.x, CASE WHEN s.start < 0 AND NOT b.white THEN b.x ELSE s.start END AS start, CASE WHEN NOT b.white THEN 0 WHEN s.start >= 0 THEN s.whites + 1 ELSE s.whites END AS whites,
            CASE WHEN NOT b.white THEN s.blacks + 1 WHEN s.start >= 0 THEN 0 ELSE s.blacks END AS blacks, s.len FROM scan s JOIN bw b ON b.image_id = s.image_id AND b.y = s.y AND b.x = s.x + 1))),
segments AS MATERIALIZED (SELECT image_id, y, x1, x2 FROM scan WHERE x1 >= 0)"""


def _lab(source: str = "px") -> str:
    """SQL for image_id, idx and the packed lab colour c of rows with r, g, b."""
    lin = ", ".join(f"pow(({v} + 0.055e0) / 1.055e0, 2.4e0) AS l{v}" for v in "rgb")
    xyz = ", ".join(f"({_row(row, ('lr', 'lg', 'lb'))}) / {white!r} AS t{i}" for i, (row, white) in enumerate(zip(M1, LAB_WHITE, strict=True)))
    f = ", ".join(f"CASE WHEN t{i} > {LAB_LOW!r} THEN cbrt(t{i}) ELSE (t{i} * {LAB_SLOPE!r} + 16) / 116 END AS f{i}" for i in range(3))
    whole = lambda e: f"CAST(floor({e} + 0.5e0) AS BIGINT)"
    bits = f"({whole('(f1 * 116 - 16) * 2.55e0')} * 65536 | {whole('((f0 - f1) * 500 + 125) * 1.02e0')} * 256 | {whole('((f1 - f2) * 200 + 125) * 1.02e0')})"
    return f"SELECT image_id, idx, CAST((({bits} & 4294967295) + 2147483648) % 4294967296 - 2147483648 AS INT) AS c FROM (SELECT image_id, idx, {f} FROM (SELECT image_id, idx, {xyz} FROM (SELECT image_id, idx, {lin} FROM {source})))"


def _lab_fields(c: str, n: int) -> str:
    return f"CAST(floor({c} / 65536e0) AS DOUBLE) AS l{n}, CAST(({c} & 65280) // 256 AS DOUBLE) AS a{n}, CAST({c} & 255 AS DOUBLE) AS b{n}"


def _rgb_of_lab(c: str) -> str:
    step = f"list_value(floor(({c}) / 65536e0) / 2.55e0, ((({c}) & 65280) // 256) / 1.02e0 - 125, (({c}) & 255) / 1.02e0 - 125)"
    step = f"list_transform([{step}], lambda v: list_value(v[1], v[2] / 500e0 + (v[1] + 16) / 116e0, (v[1] + 16) / 116e0, (v[1] + 16) / 116e0 - v[3] / 200e0))[1]"
    cube = lambda f: f"(CASE WHEN {f} > 24 / 116e0 THEN {f} * {f} * {f} ELSE ({f} * 116 - 16) / {LAB_SLOPE!r} END)"
    step = f"list_transform([{step}], lambda v: list_value({cube('v[2]')} * {LAB_WHITE[0]!r}, (CASE WHEN v[1] > 8 THEN v[3] * v[3] * v[3] ELSE v[1] / {LAB_SLOPE!r} END) * {LAB_WHITE[1]!r}, {cube('v[4]')} * {LAB_WHITE[2]!r}))[1]"
    rows = ", ".join(_row(r, ("v[1]", "v[2]", "v[3]")) for r in M1_INVERSE)
    step = f"list_transform([{step}], lambda v: list_value({rows}))[1]"
    byte = "CAST(CASE WHEN {0} < 0 THEN 0 ELSE least(255, greatest(0, floor(pow(greatest({0}, 0), 1 / 2.4e0) * 1.055e0 - 0.055e0 + 0.5e0))) END AS INT)"
    return f"list_transform([{step}], lambda u: {byte.format('u[1]')} * 65536 + {byte.format('u[2]')} * 256 + {byte.format('u[3]')})[1]"


def _ciede(source: str, keep: str) -> str:
    """SQL for `keep` and d, the CIEDE2000 difference of (l1, a1, b1) and (l2, a2, b2) of the source."""
    hue = lambda a, b: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE (degrees(atan2({b}, {a})) + 360) % 360 END"
    steps = (
        "pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS c7",
        "a1 * (1.5e0 - sqrt(c7 / (c7 + 6103515625e0)) / 2) AS p1, a2 * (1.5e0 - sqrt(c7 / (c7 + 6103515625e0)) / 2) AS p2",
        f"sqrt(p1 * p1 + b1 * b1) AS k1, sqrt(p2 * p2 + b2 * b2) AS k2, {hue('p1', 'b1')} AS h1, {hue('p2', 'b2')} AS h2",
        "CASE WHEN k1 * k2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN k1 * k2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (k1 + k2) / 2 AS km, pow((l1 + l2) / 2 - 50, 2) AS off",
        "1 - 0.17e0 * cos(radians(hm - 30)) + 0.24e0 * cos(radians(2 * hm)) + 0.32e0 * cos(radians(3 * hm + 6)) - 0.20e0 * cos(radians(4 * hm - 63)) AS t, -sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(km, 7) / (pow(km, 7) + 6103515625e0)) AS turn",
        "(l2 - l1) / (1 + 0.015e0 * off / sqrt(off + 20)) AS dl, (k2 - k1) / (1 + 0.045e0 * km) AS dk, 2 * sqrt(k1 * k2) * sin(radians(dh) / 2) / (1 + 0.015e0 * km * t) AS dx",
        "sqrt(greatest(0, dl * dl + dk * dk + dx * dx + turn * dk * dx)) AS d",
    )
    for step in steps:
        source = f"(SELECT *, {step} FROM {source})"
    return f"SELECT {keep}, d FROM {source}"


def _named(colours: str = "(SELECT DISTINCT c FROM rgb)") -> str:
    """SQL for (c, name) of each of the packed RGB colours."""
    words = CSS.split()
    rows = ", ".join(f"({i}, '{n}', {int(h, 16)})" for i, (n, h) in enumerate(zip(words[::2], words[1::2], strict=True)))

    def lab(source: str, n: int) -> str:
        lin = ", ".join(f"CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(({v} + 0.055e0) / 1.055e0, 2.4e0) END AS q{i}" for i, v in enumerate(("c // 65536 / 255e0", "c // 256 % 256 / 255e0", "c % 256 / 255e0")))
        xyz = ", ".join(f"({_row(row, ('q0', 'q1', 'q2'))}) / {white!r} AS t{i}" for i, (row, white) in enumerate(zip(D50, D50_WHITE, strict=True)))
        f = ", ".join(f"CASE WHEN t{i} > {LAB_LOW!r} THEN cbrt(t{i}) ELSE (t{i} * {LAB_SLOPE!r} + 16) / 116 END AS f{i}" for i in range(3))
        return f"(SELECT * EXCLUDE (c), c AS c{n}, f1 * 116 - 16 AS l{n}, (f0 - f1) * 500 AS a{n}, (f1 - f2) * 200 AS b{n} FROM (SELECT * EXCLUDE (t0, t1, t2), {f} FROM (SELECT * EXCLUDE (q0, q1, q2), {xyz} FROM (SELECT *, {lin} FROM {source}))))"

    both = f"(SELECT k.name, k.o, e.c2, k.l1, k.a1, k.b1, e.l2, e.a2, e.b2 FROM {lab(f'(VALUES {rows}) v(o, name, c)', 1)} k CROSS JOIN {lab(colours, 2)} e)"
    return f"SELECT c2 AS c, name FROM ({_ciede(both, 'c2, name, o')}) QUALIFY row_number() OVER (PARTITION BY c2 ORDER BY round(d, 9), o) = 1"


def _later() -> dict[str, str]:
    """Further steps that single queries need, after the common ones."""
    light = lambda c: f"(({c} // 65536) / 2.06e0)"
    contrast = lambda a, b: _apca(_rgb_of(a), _rgb_of(b))
    a, b = ("((cent // 256 % 256) / 1.275e0 - 100)", "((cent % 256) / 1.275e0 - 100)")
    chroma = f"(CASE WHEN abs({a}) < 7.5e-5 AND abs({b}) < 7.5e-5 THEN 0e0 ELSE sqrt({a} * {a} + {b} * {b}) END / 1.5e0)"
    pools = f""",
weights AS (SELECT image_id, cent, sum(cnt) AS n FROM near GROUP BY ALL),
pools AS (SELECT k.image_id, k.ord, k.cent, p."outer", p."inner", abs({light("k.cent")} - {light('p."inner"')}) * CASE WHEN p."inner" // 65536 > p."outer" // 65536 THEN 0.8e0 ELSE 1.2e0 END > abs({light("k.cent")} - {light('p."outer"')}) AS outside,
    w.n / CAST(t.total AS DOUBLE) AS part, coalesce(s.delta, 0e0) AS delta FROM cents k JOIN picked p USING (image_id) JOIN totals t USING (image_id) JOIN weights w ON w.image_id = k.image_id AND w.cent = k.cent LEFT JOIN share s ON s.image_id = k.image_id AND s.cent = k.cent
    WHERE k.cent <> p."outer" AND k.cent <> p."inner" AND w.n / CAST(t.total AS DOUBLE) >= 0.01e0),
scored AS (SELECT image_id, ord, cent, {chroma} * {_distance("cent", '"inner"')} * part * 100 * pow(CASE WHEN {light('"outer"')} > {light('"inner"')} THEN 100 - {light("cent")} ELSE {light("cent")} END, 4) * pow(delta + 1, 3) AS score FROM pools WHERE NOT outside AND {contrast('"outer"', "cent")} >= 9),
best AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) = 1),
accents AS (SELECT p.image_id, p."outer", p."inner", coalesce(b.cent, p."inner") AS accent FROM picked p LEFT JOIN best b ON b.image_id = p.image_id)"""
    thirds = f""",
ranked3 AS (SELECT p.image_id, p.ord, p.cent, least({contrast("p.cent", 'p."inner"')}, {contrast("p.cent", "a.accent")}) * p.part * 100 AS score FROM pools p JOIN accents a USING (image_id) WHERE p.outside),
best3 AS (SELECT * FROM ranked3 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) = 1),
thirds AS (SELECT p.image_id, coalesce(b.cent, p."outer") AS third FROM picked p LEFT JOIN best3 b ON b.image_id = p.image_id)"""
    seeds = f""",
listed AS (SELECT image_id, list(c ORDER BY rank) AS l FROM ranked GROUP BY image_id),
seeds AS (SELECT image_id, 1 AS ord, l[1] AS c, list_filter(l, lambda v: {_distance("v", "l[1]")} >= 8) AS rest FROM listed
    UNION ALL SELECT image_id, ord + 1, rest[1], list_filter(rest, lambda v: {_distance("v", "rest[1]")} >= 8) FROM seeds WHERE ord < 6 AND len(rest) > 0)"""
    mean = lambda e: f"coalesce(floor(sum(({e}) * cnt) / CAST(nullif(sum(cnt), 0) AS DOUBLE) + 0.499999999e0), 0)"
    clamped = f""",
means AS (SELECT image_id, mean, sum(n) AS n FROM (SELECT image_id, ord, CAST({mean("c // 65536")} * 65536 + {mean("c // 256 % 256")} * 256 + {mean("c % 256")} AS INT) AS mean, sum(cnt) AS n FROM near GROUP BY image_id, ord) GROUP BY image_id, mean),
often AS (SELECT r.image_id, r.c, r.rank, r.cnt / CAST(t.total AS DOUBLE) >= 0.003e0 AS often FROM ranked r JOIN totals t USING (image_id)),
pool AS (SELECT * FROM often QUALIFY often OR NOT bool_or(often) OVER (PARTITION BY image_id)),
clamped AS (SELECT m.image_id, m.n, CASE WHEN o.c IS NOT NULL THEN m.mean ELSE p.c END AS c FROM means m LEFT JOIN often o ON o.image_id = m.image_id AND o.c = m.mean AND o.often JOIN pool p ON p.image_id = m.image_id
    QUALIFY row_number() OVER (PARTITION BY m.image_id, m.mean ORDER BY {_distance("p.c", "m.mean")}, p.rank) = 1)"""
    errors = f""",
upto AS (SELECT h.image_id, h.c, h.cnt, k.ord AS k, min({_distance("h.c", "k.cent")}) OVER (PARTITION BY h.image_id, h.c ORDER BY k.ord) AS d FROM hist h JOIN cents k USING (image_id)),
errors AS (SELECT image_id, k, sum(d * d * cnt) / sum(cnt) AS wcss FROM upto GROUP BY ALL),
quartiles AS (SELECT image_id, list_sort(list(wcss)) AS l, count(*) AS m FROM errors GROUP BY image_id),
kept_errors AS (SELECT e.image_id, e.k, e.wcss, q.m, e.wcss BETWEEN l[m // 4 + 1] - 1.5e0 * (l[3 * m // 4 + 1] - l[m // 4 + 1]) AND l[3 * m // 4 + 1] + 1.5e0 * (l[3 * m // 4 + 1] - l[m // 4 + 1]) AS kept FROM errors e JOIN quartiles q USING (image_id))"""
    out = {"accent_pick": pools, "third_pick": pools + thirds, "seed_colours": seeds, "clamp_nearest": clamped, "iqr_outliers": errors, "elbow_slope": errors}
    return {name: text.removeprefix("\n") + "\n" for name, text in out.items()}
