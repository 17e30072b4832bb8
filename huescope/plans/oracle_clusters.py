"""DuckDB SQL for k-means to its end, the strategies, clamping, merging and roles, as steps after those of oracle.py."""

from __future__ import annotations

from .oracle import _BLACK, _WHITE, _apca, _chain, _distance, _named, _rgb_of


def _mean(e: str) -> str:
    return f"coalesce(floor(sum(({e}) * cnt) / CAST(nullif(sum(cnt), 0) AS DOUBLE) + 0.499999999e0), 0)"


def _source(more: str = "") -> str:
    """src: the colours of each group (image), seeded: those that aren't alike, by place."""
    return f"""src AS MATERIALIZED (SELECT image_id AS gid, rank, c, cnt FROM ranked{more}),
listed AS (SELECT gid, list(c ORDER BY rank) AS l FROM src GROUP BY gid),
seeded AS (SELECT gid, 1 AS ord, l[1] AS c, list_filter(l, lambda v: {_distance("v", "l[1]")} >= 8) AS rest FROM listed
    UNION ALL SELECT gid, ord + 1, rest[1], list_filter(rest, lambda v: {_distance("v", "rest[1]")} >= 8) FROM seeded WHERE len(rest) > 0),
sizes AS MATERIALIZED (SELECT s.gid, count(*) AS n FROM src s GROUP BY s.gid)"""


def _fits(p: str, wanted: str) -> str:
    """{p}errors (gid, k, error) and {p}fitted (gid, k, ord, c, cnt) of the groups and numbers wanted: rounds until no centroid moves, 100 at most."""
    mean = f"CAST({_mean('c // 65536')} * 65536 + {_mean('c // 256 % 256')} * 256 + {_mean('c % 256')} AS INT)"
    return f"""{p}km AS (SELECT 0 AS i, w.gid, w.k, s.ord, s.c AS prev, s.c AS now, true AS moving FROM ({wanted}) w JOIN seeded s ON s.gid = w.gid AND (s.ord <= w.k OR w.k = 0)
    UNION ALL SELECT i, gid, k, ord, prev, now, bool_or(prev <> now) OVER (PARTITION BY gid, k) FROM (
        SELECT t.i + 1 AS i, t.gid, t.k, t.ord, t.now AS prev, coalesce(m.mean, 0) AS now FROM (SELECT * FROM {p}km WHERE moving AND i < 100) t LEFT JOIN (
            SELECT gid, k, ord, {mean} AS mean FROM (
                SELECT s.gid, u.k, s.c, s.cnt, s.rank, min({{'d': {_distance("s.c", "u.now")}, 'o': u.ord}}).o AS ord FROM src s JOIN (SELECT * FROM {p}km WHERE moving AND i < 100) u ON u.gid = s.gid GROUP BY s.gid, u.k, s.c, s.cnt, s.rank)
            GROUP BY gid, k, ord) m ON m.gid = t.gid AND m.k = t.k AND m.ord = t.ord)),
{p}last AS MATERIALIZED (SELECT * FROM {p}km QUALIFY i = max(i) OVER (PARTITION BY gid, k)),
{p}member AS MATERIALIZED (SELECT o.*, l.now, {_distance("o.c", "l.now")} AS d FROM (
        SELECT s.gid, u.k, s.c, s.cnt, s.rank, min({{'d': {_distance("s.c", "u.prev")}, 'o': u.ord}}).o AS ord FROM src s JOIN {p}last u ON u.gid = s.gid GROUP BY s.gid, u.k, s.c, s.cnt, s.rank) o
    JOIN {p}last l ON l.gid = o.gid AND l.k = o.k AND l.ord = o.ord),
{p}errors AS MATERIALIZED (SELECT gid, k, sum(d * d * cnt) / sum(cnt) AS error FROM {p}member GROUP BY gid, k),
{p}medoid AS (SELECT l.gid, l.k, l.ord, coalesce(x.m.c, l.now) AS c, coalesce(x.n, 0) AS cnt FROM {p}last l LEFT JOIN (SELECT gid, k, ord, min({{'d': d, 'r': rank, 'c': c}}) AS m, sum(cnt) AS n FROM {p}member GROUP BY gid, k, ord) x ON x.gid = l.gid AND x.k = l.k AND x.ord = l.ord),
{p}fitted AS MATERIALIZED (SELECT gid, k, row_number() OVER (PARTITION BY gid, k ORDER BY ord) - 1 AS ord, c, cnt FROM (SELECT gid, k, c, min(ord) AS ord, arg_max(cnt, ord) AS cnt FROM {p}medoid GROUP BY gid, k, c))"""


def _each(ks) -> str:
    return f"SELECT gid, n, unnest([{', '.join(map(str, ks))}]) AS k FROM sizes WHERE gid >= 0"


def _constant(k: int) -> str:
    return f"{_source()},\n{_fits('f', _each([k]))},\nchosen AS MATERIALIZED (SELECT gid, ord, c, cnt FROM ffitted)"


def _elbow(start=(1, 2, 3, 4), end=(50, 100)) -> str:
    return f"""{_source()},
{_fits("p", f"SELECT * FROM ({_each(sorted({*start, *end}))}) WHERE k < n")},
points AS (SELECT e.gid, k IN {start} AS early, e.k, e.error FROM perrors e UNION ALL SELECT gid, false, n, 0e0 FROM sizes WHERE n > {2 * end[-1]}),
ranges AS (SELECT gid, early, list_sort(list(error)) AS l, count(*) AS m FROM points GROUP BY gid, early),
lines AS (SELECT p.gid, p.early, arg_min(p.k, p.k) AS k0, arg_min(p.error, p.k) AS e0, r.m * sum(k * k) FILTER (kept) - sum(k) FILTER (kept) * sum(k) FILTER (kept) AS below,
    r.m * sum(k * error) FILTER (kept) - sum(k) FILTER (kept) * sum(error) FILTER (kept) AS above, r.m FROM (
        SELECT p.*, p.error BETWEEN l[m // 4 + 1] - 1.5e0 * (l[3 * m // 4 + 1] - l[m // 4 + 1]) AND l[3 * m // 4 + 1] + 1.5e0 * (l[3 * m // 4 + 1] - l[m // 4 + 1]) AS kept FROM points p JOIN ranges r ON r.gid = p.gid AND r.early = p.early) p
    JOIN ranges r ON r.gid = p.gid AND r.early = p.early GROUP BY p.gid, p.early, r.m),
sloped AS (SELECT *, CASE WHEN m >= 2 AND below <> 0 THEN above / below ELSE 0e0 END AS slope FROM lines),
elbows AS MATERIALIZED (SELECT s.gid, CASE WHEN s.n = 1 THEN 1 WHEN a.gid IS NULL OR b.gid IS NULL THEN least(s.n, {max(start)}) WHEN a.slope = b.slope THEN 1
    WHEN ceil((b.e0 - b.slope * b.k0 - a.e0 + a.slope * a.k0) / (a.slope - b.slope)) < 0 THEN 1 ELSE CAST(least(s.n, ceil((b.e0 - b.slope * b.k0 - a.e0 + a.slope * a.k0) / (a.slope - b.slope))) AS BIGINT) END AS k
    FROM sizes s LEFT JOIN sloped a ON a.gid = s.gid AND a.early LEFT JOIN sloped b ON b.gid = s.gid AND NOT b.early),
{_fits("f", "SELECT e.gid, e.k FROM elbows e ANTI JOIN perrors p ON p.gid = e.gid AND p.k = e.k")},
chosen AS MATERIALIZED (SELECT f.gid, ord, c, cnt FROM (SELECT * FROM pfitted UNION ALL SELECT * FROM ffitted) f JOIN elbows e ON e.gid = f.gid AND e.k = f.k)"""


def _gap(low: int, high: int) -> str:
    flat = lambda j: f"CASE WHEN {j} < n THEN CAST(floor(({j}) * (16777215 / CAST(n AS DOUBLE)) + 0.5e0) AS BIGINT) WHEN {j} = n THEN 1 ELSE 0 END"
    even = f" UNION ALL SELECT -n, i + 1, CAST({flat('2 * i')} AS INT), {flat('2 * i + 1')} FROM (SELECT n, unnest(range(n)) AS i FROM (SELECT DISTINCT CAST(total AS BIGINT) AS n FROM totals))"
    ks = ", ".join(map(str, range(low, high + 1)))
    return f"""{_source(even)},
{_fits("f", f"SELECT gid, unnest([{ks}]) AS k FROM sizes")},
gaps AS (SELECT o.gid, o.k, CASE WHEN o.error = 0 THEN 'infinity'::DOUBLE WHEN e.error > 0 THEN ln(e.error) - ln(o.error) ELSE '-infinity'::DOUBLE END AS gap FROM ferrors o JOIN totals t ON t.image_id = o.gid JOIN ferrors e ON e.gid = -t.total AND e.k = o.k WHERE o.gid >= 0),
best_k AS (SELECT gid, k FROM gaps QUALIFY row_number() OVER (PARTITION BY gid ORDER BY gap DESC, k) = 1),
chosen AS MATERIALIZED (SELECT f.gid, ord, c, cnt FROM ffitted f JOIN best_k b ON b.gid = f.gid AND b.k = f.k)"""


def _clamped(percent: float) -> str:
    """clamped (gid, ord, c, cnt). Right wherever an image has a colour of that share, which no moved centroid then is."""
    return f""",
common AS (SELECT r.image_id AS gid, r.c, r.rank, r.cnt / CAST(t.total AS DOUBLE) >= {percent / 100!r} AND r.cnt > 0 AS often FROM ranked r JOIN totals t USING (image_id)),
moves AS (SELECT k.gid, k.ord, p.c FROM chosen k ANTI JOIN (SELECT * FROM common WHERE often) o ON o.gid = k.gid AND o.c = k.c JOIN (SELECT * FROM common QUALIFY often OR NOT bool_or(often) OVER (PARTITION BY gid)) p ON p.gid = k.gid
    QUALIFY row_number() OVER (PARTITION BY k.gid, k.ord ORDER BY {_distance("p.c", "k.c")}, p.rank) = 1),
clamped AS MATERIALIZED (SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY place) - 1 AS ord, c, cnt FROM (
    SELECT k.gid, coalesce(m.c, k.c) AS c, sum(k.cnt) AS cnt, min(CASE WHEN m.c IS NULL OR m.c = k.c THEN k.ord ELSE 1000000 + k.ord END) AS place FROM chosen k LEFT JOIN moves m ON m.gid = k.gid AND m.ord = k.ord GROUP BY k.gid, coalesce(m.c, k.c)))"""


def _merged() -> str:
    """merged (gid, ord, c, cnt): pairs nearer than epsilon join groups one after the other."""
    flat = "flatten(list_filter(groups, lambda g: list_contains(g, p[i].a) OR list_contains(g, p[i].b)))"
    return f""",
alike AS (SELECT x.gid, list({{'a': x.c, 'b': y.c}} ORDER BY x.ord, y.ord) AS p FROM clamped x JOIN clamped y ON x.gid = y.gid AND x.ord < y.ord WHERE {_distance("x.c", "y.c")} < 8 GROUP BY x.gid),
grouped AS (SELECT gid, p, 1 AS i, CAST([] AS INT[][]) AS groups FROM alike
    UNION ALL SELECT gid, p, i + 1, list_concat(list_filter(groups, lambda g: NOT (list_contains(g, p[i].a) OR list_contains(g, p[i].b))),
        [CASE WHEN len({flat}) > 0 THEN list_transform([{flat}], lambda f: list_filter(f, lambda x, j: list_position(f, x) = j))[1] ELSE [p[i].a, p[i].b] END]) FROM grouped WHERE i <= len(p)),
inside AS (SELECT gid, n, unnest(g) AS c, unnest(range(1, len(g) + 1)) AS j FROM (SELECT gid, unnest(groups) AS g, unnest(range(1, len(groups) + 1)) AS n FROM grouped WHERE i = len(p) + 1)),
merged AS MATERIALIZED (SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY place) - 1 AS ord, c, cnt FROM (
    SELECT k.gid, k.ord AS place, k.c, k.cnt FROM clamped k ANTI JOIN inside i ON i.gid = k.gid AND i.c = k.c
    UNION ALL SELECT i.gid, 1000000 + i.n, first(i.c ORDER BY k.cnt DESC, i.j), sum(k.cnt) FROM inside i JOIN clamped k ON k.gid = i.gid AND k.c = i.c GROUP BY i.gid, i.n))"""


def _roles() -> str:
    """roled: image_id, outer, inner, third, accent of the merged centroids."""
    light = lambda c: f"(({c}) // 65536 / 2.06e0)"
    contrast = lambda a, b: _apca(_rgb_of(a), _rgb_of(b))
    a, b = ("((c // 256 % 256) / 1.275e0 - 100)", "((c % 256) / 1.275e0 - 100)")
    chroma = f"(CASE WHEN abs({a}) < 7.5e-5 AND abs({b}) < 7.5e-5 THEN 0e0 ELSE sqrt({a} * {a} + {b} * {b}) END / 1.5e0)"
    return f""",
owner AS MATERIALIZED (SELECT r.image_id AS gid, r.c, r.s, r.first_idx, k.ord FROM raw r JOIN merged k ON k.gid = r.image_id QUALIFY row_number() OVER (PARTITION BY r.image_id, r.c ORDER BY {_distance("r.c", "k.c")}, k.ord) = 1),
rims AS (SELECT o.gid, o.ord, count(*) AS n, min(g.idx) AS first FROM ring g JOIN owner o ON o.gid = g.image_id AND o.c = g.c GROUP BY o.gid, o.ord),
about AS MATERIALIZED (SELECT k.gid, k.ord, k.c, k.cnt, t.all_s, t.total, s.s, s.first, q.c AS "outer", {contrast("q.c", "k.c")} AS k FROM merged k JOIN totals t ON t.image_id = k.gid
    LEFT JOIN (SELECT gid, ord, sum(s) AS s, min(first_idx) AS first FROM owner GROUP BY gid, ord) s ON s.gid = k.gid AND s.ord = k.ord
    JOIN (SELECT r.gid, m.c FROM rims r JOIN merged m ON m.gid = r.gid AND m.ord = r.ord QUALIFY row_number() OVER (PARTITION BY r.gid ORDER BY r.n DESC, r.first) = 1) q ON q.gid = k.gid),
deltas AS (SELECT *, CASE WHEN all_s > 0 AND first IS NOT NULL THEN (s / CAST(all_s AS DOUBLE) - cnt / CAST(total AS DOUBLE) + 100) / 2e0 END AS delta FROM about),
told AS (SELECT gid, c FROM deltas WHERE k >= 22 AND delta IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gid ORDER BY delta DESC, first) = 1),
plain AS (SELECT gid, c FROM deltas WHERE k >= 22 AND c <> "outer" QUALIFY row_number() OVER (PARTITION BY gid ORDER BY k DESC, ord) = 1),
inners AS MATERIALIZED (SELECT d.*, coalesce(t.c, p.c, CASE WHEN {contrast('d."outer"', _WHITE)} > {contrast('d."outer"', _BLACK)} THEN {_WHITE} ELSE {_BLACK} END) AS "inner" FROM deltas d LEFT JOIN told t ON t.gid = d.gid LEFT JOIN plain p ON p.gid = d.gid),
sides AS MATERIALIZED (SELECT *, abs({light("c")} - {light('"inner"')}) * CASE WHEN {light('"inner"')} > {light('"outer"')} THEN 0.8e0 ELSE 1.2e0 END > abs({light("c")} - {light('"outer"')}) AS outside, c <> "outer" AND c <> "inner" AND cnt / CAST(total AS DOUBLE) >= 0.01e0 AS free FROM inners),
accented AS (SELECT gid, ord, c, {chroma} * {_distance("c", '"inner"')} * cnt / CAST(total AS DOUBLE) * 100 * pow(CASE WHEN {light('"outer"')} > {light('"inner"')} THEN 100 - {light("c")} ELSE {light("c")} END, 4) * pow(coalesce(delta, 0e0) + 1, 3) AS v FROM sides WHERE NOT outside AND free AND k >= 9),
accent1 AS (SELECT DISTINCT s.gid, coalesce(a.c, s."inner") AS accent FROM sides s LEFT JOIN (SELECT * FROM accented WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY v DESC, ord) = 1) a ON a.gid = s.gid),
third1 AS (SELECT s.gid, s.ord, s.c, least({contrast("s.c", 's."inner"')}, {contrast("s.c", "a.accent")}) * s.cnt / CAST(s.total AS DOUBLE) * 100 AS v FROM sides s JOIN accent1 a ON a.gid = s.gid WHERE s.outside AND s.free),
roled AS MATERIALIZED (SELECT DISTINCT s.gid AS image_id, s."outer", s."inner", coalesce(t.c, s."outer") AS third, a.accent FROM sides s JOIN accent1 a ON a.gid = s.gid LEFT JOIN (SELECT * FROM third1 WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY v DESC, ord) = 1) t ON t.gid = s.gid)"""


def sql() -> dict[str, str]:
    chain = _chain().rstrip() + ",\n"
    flat = lambda t: f"\nSELECT gid AS image_id, CAST(ord AS INT) AS ord, c, CAST(cnt AS BIGINT) AS cnt FROM {t}"
    extract = chain + _elbow() + _clamped(0.005) + _merged() + _roles()
    hexed = lambda n: f"'#' || lpad(lower(to_hex({_rgb_of(n)})), 6, '0')"
    near = lambda e: f"CAST(floor({e} + 0.5e0) AS INT)"
    names = ("outer", "inner", "third", "accent")
    pairs = [(p, q, near(_apca(_rgb_of(f'"{p}"'), _rgb_of(f'"{q}"')))) for p, q in (("outer", "inner"), ("outer", "accent"), ("third", "inner"), ("third", "accent"))]
    lights = ", ".join(f"{near(f'\"{n}\" // 65536 / 2.06e0')} AS lightness_{n}" for n in names)
    summary = f"\nSELECT image_id, {', '.join(f'{hexed(f'\"{n}\"')} AS \"{n}\"' for n in names)}, {', '.join(f'{e} AS contrast_{p}_{q}' for p, q, e in pairs)}, {lights} FROM roled"
    shown = ", ".join(f"SELECT image_id, '{n}' AS role, {_rgb_of(f'\"{n}\"')} AS c FROM roled" for n in names).replace(", SELECT", " UNION ALL SELECT")
    named = _named("(SELECT DISTINCT c FROM shown)")
    return {
        "kmeans_k": f"{chain}{_source()},\n{_fits('f', _each([2, 4, 8]))}\nSELECT f.gid AS image_id, CAST(f.k AS INT) AS k, round(e.error, 6) AS wcss, CAST(f.ord AS INT) AS ord, f.c, CAST(f.cnt AS BIGINT) AS cnt FROM ffitted f JOIN ferrors e ON e.gid = f.gid AND e.k = f.k",
        "strategy_constant": chain + _constant(6) + flat("chosen"),
        "strategy_elbow": chain + _elbow() + flat("chosen"),
        "strategy_gap": chain + _gap(1, 10) + flat("chosen"),
        "clamp_full": chain + _constant(8) + _clamped(0.005) + flat("clamped"),
        "merge_groups": chain + _constant(8) + _clamped(0.005) + _merged() + flat("merged"),
        "summary": extract + summary,
        "role_names": f"{extract},\nshown AS MATERIALIZED ({shown})\nSELECT s.image_id, s.role, s.c AS rgb, m.name FROM shown s JOIN ({named}) m ON m.c = s.c",
    }
