"""DuckDB SQL of the registered queries, written apart from the operators' own expressions."""

from __future__ import annotations

from tilestrata.fixtures import CANVAS, PALETTE_SQL, PX_SQL, STROKES_SQL, layer_sql
from tilestrata.operators.tiles import Rect

BOX, SEL_A = Rect(-12, -10, 20, 18), Rect(-20, -20, 30, 24)
POLYGON = [(-20, -18), (22, -10), (10, 20), (-6, 2), (-24, 14)]
PX = f"px AS ({PX_SQL.format(n=64, h=32)})"
GREY = "grey AS (SELECT i AS x, CAST(vec_id AS INT) AS y, v AS r, v AS g, v AS b, 1.0::DOUBLE AS a FROM (SELECT vec_id, CAST(i AS INT) AS i, least(greatest(embedding[i + 1]::DOUBLE + 0.5, 0.0::DOUBLE), 1.0::DOUBLE) AS v FROM embeddings, range(64) t(i)))"
STAMPS = f"k AS (SELECT seq AS n, px * 0.5 - 30.0 AS cx, py * 0.5 - 32.0 AS cy FROM ({STROKES_SQL}))"


def R(e: str, name: str) -> str:
    return f"floor(({e}) * 10000.0::DOUBLE + 0.5001) / 10000.0 AS {name}"


def rgba(prefix: str = "") -> str:
    return ", ".join(R(prefix + c, c) for c in "rgba")


def clamp(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


def enc(c: str) -> str:
    c = clamp(c)
    return f"(CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 1.0::DOUBLE / 2.4) - 0.055 END)"


def dec(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


def grid(r: Rect, name: str = "gr") -> str:
    return f"{name} AS (SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM range({r.x}, {r.right}) a(i), range({r.y}, {r.bottom}) b(j))"


def inside(r: Rect, x: str = "x", y: str = "y") -> str:
    return f"({x} >= {r.x} AND {x} < {r.right} AND {y} >= {r.y} AND {y} < {r.bottom})"


L = {i: f"l{i} AS ({layer_sql(i)})" for i in range(1, 8)}


def w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


B = {
    "normal": "{s}", "multiply": "{d} * {s}", "screen": "{d} + {s} - {d} * {s}",
    "overlay": "CASE WHEN {d} <= 0.5 THEN 2 * {d} * {s} ELSE 1 - 2 * (1 - {d}) * (1 - {s}) END", "darken": "least({d}, {s})", "lighten": "greatest({d}, {s})",
    "color-dodge": "CASE WHEN {s} >= 1 THEN 1.0 ELSE least(greatest({d} / (1 - {s}), 0.0), 1.0) END", "color-burn": "CASE WHEN {s} <= 0 THEN 0.0 ELSE least(greatest(1 - (1 - {d}) / {s}, 0.0), 1.0) END",
    "hard-light": "CASE WHEN {s} <= 0.5 THEN 2 * {d} * {s} ELSE 1 - 2 * (1 - {d}) * (1 - {s}) END",
    "soft-light": "CASE WHEN {s} <= 0.5 THEN least(greatest({d}, 0.0), 1.0) - (1 - 2 * {s}) * least(greatest({d}, 0.0), 1.0) * (1 - least(greatest({d}, 0.0), 1.0)) ELSE least(greatest({d}, 0.0), 1.0) + (2 * {s} - 1) * (sqrt(least(greatest({d}, 0.0), 1.0)) - least(greatest({d}, 0.0), 1.0)) END",
    "difference": "abs({d} - {s})", "exclusion": "{d} + {s} - 2 * {d} * {s}", "add": "{d} + {s}",
}


def over(mode: str, opacity: str, d: str = "d.", s: str = "s.") -> dict[str, str]:
    """Channels of s over d; a missing s (null alpha) leaves d."""
    sa, da = f"least(greatest({s}a, 0.0) * {opacity}, 1.0)", clamp(d + "a")
    oa = f"least({da} + {sa} * (1 - {da}), 1.0)"
    out = {c: f"CASE WHEN {s}a IS NULL OR {sa} <= 0 THEN {d}{c} ELSE ({d}{c} * {da} * (1 - {sa}) + {s}{c} * {sa} * (1 - {da}) + {sa} * {da} * ({B[mode].format(d=d + c, s=s + c)})) / {oa} END" for c in "rgb"}
    return out | {"a": f"CASE WHEN {s}a IS NULL OR {sa} <= 0 THEN {d}a ELSE {oa} END"}


def cols(x: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in x.items())


GREYL = "(0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b})"


def adjusted(kind: str, r: str, g: str, b: str) -> dict[str, str]:
    """The adjustments with the registered parameters, on clamped channels."""
    ch, l = {"r": r, "g": g, "b": b}, GREYL.format(r=r, g=g, b=b)
    one = lambda f: {c: f(e) for c, e in ch.items()}
    if kind == "invert":
        return one(lambda e: f"1 - {e}")
    if kind == "desaturate":
        return one(lambda e: clamp(l))
    if kind == "brightness_contrast":
        return one(lambda e: clamp(f"({e} - 0.5) * 1.3 + 0.5 + 0.1"))
    if kind == "levels":
        return one(lambda e: clamp(f"0.05 + pow({clamp(f'({e} - 0.1::DOUBLE) / (0.9::DOUBLE - 0.1::DOUBLE)')}, 1.0::DOUBLE / 1.5) * (0.95::DOUBLE - 0.05::DOUBLE)"))
    if kind == "curves":
        return one(lambda e: f"CASE WHEN {e} <= 0 THEN 0.1 WHEN {e} <= 0.3 THEN 0.1 + (0.2::DOUBLE - 0.1::DOUBLE) * ({e} / 0.3) WHEN {e} <= 0.7 THEN 0.2 + (0.9::DOUBLE - 0.2::DOUBLE) * (({e} - 0.3::DOUBLE) / (0.7::DOUBLE - 0.3::DOUBLE)) ELSE 0.9 + (0.95::DOUBLE - 0.9::DOUBLE) * (({e} - 0.7::DOUBLE) / (1.0::DOUBLE - 0.7::DOUBLE)) END")
    if kind == "posterize":
        return one(lambda e: f"floor({e} * 4 + 0.5) / 4")
    if kind == "threshold":
        return one(lambda e: f"CASE WHEN {l} >= 0.4 THEN 1.0 ELSE 0.0 END")
    if kind == "gradient_map":
        return {c: f"{f} + ({t}::DOUBLE - {f}::DOUBLE) * {clamp(l)}" for c, f, t in zip("rgb", (0.1, 0.2, 0.3), (0.9, 0.7, 0.5), strict=True)}
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    d, li = f"({hi} - {lo})", f"(({hi} + {lo}) * 0.5)"
    h = f"(CASE WHEN {d} = 0 THEN 0.0 WHEN {hi} = {r} THEN (({g} - {b}) / {d} + CASE WHEN {g} < {b} THEN 6.0 ELSE 0.0 END) / 6.0 WHEN {hi} = {g} THEN (({b} - {r}) / {d} + 2.0) / 6.0 ELSE (({r} - {g}) / {d} + 4.0) / 6.0 END)"
    s = f"(CASE WHEN {d} = 0 THEN 0.0 WHEN {li} > 0.5 THEN {d} / nullif(2.0 - {hi} - {lo}, 0) ELSE {d} / nullif({hi} + {lo}, 0) END)"
    return {"h": f"{h} + 40.0::DOUBLE / 360.0 - floor({h} + 40.0::DOUBLE / 360.0)", "s": clamp(f"{s} * 1.2"), "l": clamp(f"{li} + 0.05")}


def hue_part(k: str) -> str:
    q = "(CASE WHEN l < 0.5 THEN l * (1.0 + s) ELSE l + s - l * s END)"
    p = f"(2.0 * l - {q})"
    t = f"(h + {k} + CASE WHEN h + {k} < 0 THEN 1.0 ELSE 0.0 END)"
    t = f"({t} - CASE WHEN {t} > 1 THEN 1.0 ELSE 0.0 END)"
    return f"CASE WHEN s = 0 THEN l WHEN {t} < 1.0::DOUBLE / 6 THEN {p} + ({q} - {p}) * 6.0 * {t} WHEN {t} < 0.5 THEN {q} WHEN {t} < 2.0::DOUBLE / 3 THEN {p} + ({q} - {p}) * (2.0::DOUBLE / 3 - {t}) * 6.0 ELSE {p} END"


HUES = {"r": hue_part("1.0::DOUBLE / 3"), "g": hue_part("0.0"), "b": hue_part("-1.0::DOUBLE / 3")}


def adjust_sql(kind: str, source: str, keys: str, opacity: str | None) -> str:
    """Adjusted pixels of a CTE; opacity None: a filter on all places."""
    base = f"SELECT {keys}, r, g, b, a, {', '.join(f'{clamp(c)} AS {c}c' for c in 'rgb')} FROM {source}"
    new = adjusted(kind, "rc", "gc", "bc")
    if kind == "hue_sat":
        inner = f"SELECT {keys}, a, r, g, b, rc, gc, bc, {cols({c: HUES[c] for c in ()})}{', '.join(f'{HUES[c]} AS {c}n' for c in 'rgb')} FROM (SELECT *, {cols(new)} FROM ({base}))"
    else:
        inner = f"SELECT {keys}, a, r, g, b, rc, gc, bc, {', '.join(f'{new[c]} AS {c}n' for c in 'rgb')} FROM ({base})"
    if opacity is None:
        out = ", ".join(R(f"{c}n", c) for c in "rgb")
    else:
        out = ", ".join(R(f"CASE WHEN a = 0 THEN {c} ELSE {c}c + ({c}n - {c}c) * {opacity} END", c) for c in "rgb")
    return f"SELECT {keys}, {out}, {R('a', 'a')} FROM ({inner})"


def stack(layers: list[tuple[str, str, str]], prefix: str = "f", adjust: dict[int, str] | None = None) -> list[str]:
    """CTEs of a fold: layers are (cte, mode, opacity); adjust maps a place in the list to an SQL of (x, y, r, g, b, a) from {prev}."""
    base = " UNION ".join(f"SELECT x, y FROM {c}" for c, _, _ in layers if c)
    out = [f"{prefix}0 AS (SELECT x, y, 0.0::DOUBLE AS r, 0.0::DOUBLE AS g, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a FROM ({base}))"]
    for k, (c, mode, op) in enumerate(layers):
        prev = f"{prefix}{k}"
        out.append(f"{prefix}{k + 1} AS ({adjust[k].format(prev=prev)})" if adjust and k in adjust else f"{prefix}{k + 1} AS (SELECT d.x, d.y, {cols(over(mode, op))} FROM {prev} d LEFT JOIN {c} s ON d.x = s.x AND d.y = s.y)")
    return out


def moved(i: int, dx: int, dy: int, name: str) -> str:
    return f"{name} AS (SELECT x + {dx} AS x, y + {dy} AS y, r, g, b, a FROM l{i})"


FLAT = [("l1", "normal", "1.0"), ("l2", "multiply", "0.8"), ("m3", "screen", "0.6"), ("l6", "difference", "0.5"), ("l7", "color-dodge", "0.4")]
FLAT_CTES = [PX, *L.values(), moved(3, 3, -5, "m3"), *stack(FLAT)]
ALL = "x, y, " + rgba()
ELL = f"ell AS (SELECT x, y, t * t * (3 - 2 * t) AS cov FROM (SELECT x, y, least(greatest((d2 - (1 + {0.5 / 15})) / (-2 * {0.5 / 15}), 0.0), 1.0) AS t FROM (SELECT x, y, pow((x + 0.5 - (-5.0)) / 15.0, 2) + pow((y + 0.5 - (-8.0)) / 12.0, 2) AS d2 FROM gr)) WHERE t > 0)"
SEL = [grid(SEL_A), ELL]
BELL = f"bell AS (SELECT x, y, t * t * (3 - 2 * t) AS cov FROM (SELECT x, y, least(greatest((d2 - (1 + {0.5 / 10})) / (-2 * {0.5 / 10}), 0.0), 1.0) AS t FROM (SELECT x, y, pow((x + 0.5 - (-2.0)) / 10.0, 2) + pow((y + 0.5 - (-1.0)) / 9.0, 2) AS d2 FROM gb)) WHERE t > 0)"
MASK = "mask AS (SELECT x, y, r AS cov FROM l7)"
COV = "x, y, " + R("cov", "cov")
COVER = "cover AS (SELECT x, y, max((1 - t) * (1 - 0.5 * 0.5 * t)) AS cov FROM (SELECT i AS x, j AS y, sqrt(pow(i + 0.5 - cx, 2) + pow(j + 0.5 - cy, 2)) / 9.0 AS t FROM k, range(CAST(floor(cx - 9) AS BIGINT), CAST(ceil(cx + 9) AS BIGINT) + 1) a(i), range(CAST(floor(cy - 9) AS BIGINT), CAST(ceil(cy + 9) AS BIGINT) + 1) b(j)) WHERE t < 1 GROUP BY 1, 2)"
RETOUCH = [PX, L[1], STAMPS, COVER]
RECTS = "rects AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3000 - 1500 AS INT) AS x, CAST(o_custkey * 7 % 2000 - 1000 AS INT) AS y, CAST(o_orderkey % 700 AS INT) AS w, CAST(o_custkey % 600 AS INT) AS h FROM orders)"
INV = {"ia": 0.75 / 1.0625, "ib": -0.25 / 1.0625, "ic": 0.5 / 1.0625, "id": 1.25 / 1.0625}


#: The mask of layer 7, by name and CTEs.
MASKED = ("mask", PX, L[7], MASK)
CORNERS = [
    f"vt AS (SELECT stroke_id AS path, seq, CAST(floor(px / 4.0) AS INT) AS ax, CAST(floor(py / 4.0) AS INT) AS ay FROM ({STROKES_SQL}))",
    "pe AS (SELECT path, ax, ay, coalesce(lead(ax) OVER o, first_value(ax) OVER o) AS bx, coalesce(lead(ay) OVER o, first_value(ay) OVER o) AS by2 FROM vt WINDOW o AS (PARTITION BY path ORDER BY seq))",
]


def crossings(at: str) -> str:
    """CTEs of where edges pe cross the middles of rows, in order along a row."""
    row = "(PARTITION BY path, y ORDER BY cx)"
    return f"cr AS (SELECT path, y, {at} AS cx FROM (SELECT *, unnest(range(least(ay, by2), greatest(ay, by2))) AS y FROM pe WHERE ay <> by2)), pr AS (SELECT path, y, cx, lead(cx) OVER {row} AS nx, row_number() OVER {row} AS k FROM cr)"


def grown(name: str, *ctes: str) -> str:
    """SQL of a selection grown by 2."""
    return w(*ctes) + f"SELECT x, y, {R('cov', 'cov')} FROM (SELECT CAST(x + i AS INT) AS x, CAST(y + j AS INT) AS y, max(cov) AS cov FROM {name}, range(-2, 3) u(i), range(-2, 3) v(j) GROUP BY 1, 2)"


def feathered(name: str, *ctes: str) -> str:
    """SQL of a selection feathered by 1.5."""
    weights = "kw AS (SELECT i, exp(-(i * i) / 4.5) / (SELECT sum(exp(-(i * i) / 4.5)) FROM range(-5, 6) t(i)) AS w FROM range(-5, 6) t(i))"
    return w(*ctes, weights) + f"SELECT x, y, {R('cov', 'cov')} FROM (SELECT CAST(x + u.i AS INT) AS x, CAST(y + v.i AS INT) AS y, sum(cov * u.w * v.w) AS cov FROM {name}, kw u, kw v GROUP BY 1, 2)"


def retouched(target: dict[str, str], pre: str = "") -> str:
    """Target mixed in by coverage, where it changes enough."""
    mix = {c: f"{c} + ({target.get(c, c)} - {c}) * cov" for c in "rgba"}
    return w(*RETOUCH, f"j AS (SELECT l1.*, cov{pre} FROM l1 JOIN cover USING (x, y))", f"o AS (SELECT x, y, {cols(mix)}, {' + '.join(f'abs({mix[c]} - {c})' for c in 'rgba')} AS moved FROM j)") + f"SELECT {ALL} FROM o WHERE moved > 1e-4"


def painted(colour: tuple[str, ...], opacity: str, sel: str, px: str = "l1") -> str:
    """Normal blend of a colour where a selection CTE has coverage."""
    src = f"(SELECT c.x, c.y, {', '.join(f'{v} AS {n}' for n, v in zip('rgba', colour, strict=True))}, c.cov, coalesce(p.r, 0.0) AS dr, coalesce(p.g, 0.0) AS dg, coalesce(p.b, 0.0) AS db, coalesce(p.a, 0.0) AS da FROM {sel} c LEFT JOIN {px} p USING (x, y) WHERE c.cov > 0)"
    o = over("normal", f"(cov * {opacity})", "d", "q.")
    return f"SELECT x, y, {', '.join(R(o[c], c) for c in 'rgba')} FROM {src} q"


def gradient(t: str, reverse: bool) -> str:
    t = f"(1 - {t})" if reverse else t
    colour = tuple(f"{f} + ({b}::DOUBLE - {f}::DOUBLE) * t" for f, b in zip((0.1, 0.2, 0.3, 1.0), (0.9, 0.8, 0.4, 0.5), strict=True))
    return w(PX, L[1], grid(CANVAS), f"s AS (SELECT x, y, 1.0::DOUBLE AS cov, {t} AS t FROM (SELECT x, y, x + 0.5 + 10.0 AS vx, y + 0.5 + 6.0 AS vy FROM gr))") + painted(colour, "0.9", "s")


def taps(expr: dict[str, str]) -> str:
    """Nine clamped taps t00..t22 (row, column) of each channel over CANVAS; expr uses {c}XY names as `c_yx`."""
    names = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    fetch = ", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}" for c in "rgba" for k in range(9))
    off = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(names))
    return w(PX, L[1], grid(CANVAS), "dn AS (SELECT x, y, coalesce(r, 0.0) AS r, coalesce(g, 0.0) AS g, coalesce(b, 0.0) AS b, coalesce(a, 0.0) AS a FROM gr LEFT JOIN l1 USING (x, y))",
             f"t AS (SELECT gr.x, gr.y, k, d.r, d.g, d.b, d.a FROM gr, (VALUES {off}) o(k, dx, dy) JOIN dn d ON d.x = least(greatest(gr.x + dx, {CANVAS.x}), {CANVAS.right - 1}) AND d.y = least(greatest(gr.y + dy, {CANVAS.y}), {CANVAS.bottom - 1}))",
             f"n AS (SELECT x, y, {fetch} FROM t GROUP BY x, y)") + f"SELECT x, y, {', '.join(R(clamp(expr[c]), c) for c in 'rgb')}, {R('a4', 'a')} FROM n"


def blur(sigma: float, k: int) -> list[str]:
    """Two clamped passes over CANVAS."""
    total = f"(SELECT sum(exp(-(i * i) / (2 * {sigma} * {sigma}))) FROM range(-{k}, {k + 1}) q(i))"
    wt = f"wt AS (SELECT i AS d, exp(-(i * i) / (2 * {sigma} * {sigma})) / {total} AS w FROM range(-{k}, {k + 1}) q(i))"
    acc = ", ".join(f"sum(s.{c} * wt.w) AS {c}" for c in "rgba")
    return [PX, L[1], grid(CANVAS), "dn AS (SELECT x, y, coalesce(r, 0.0) AS r, coalesce(g, 0.0) AS g, coalesce(b, 0.0) AS b, coalesce(a, 0.0) AS a FROM gr LEFT JOIN l1 USING (x, y))", wt,
            f"h1 AS (SELECT gr.x, gr.y, {acc} FROM gr, wt JOIN dn s ON s.y = gr.y AND s.x = least(greatest(gr.x + wt.d, {CANVAS.x}), {CANVAS.right - 1}) GROUP BY gr.x, gr.y)",
            f"h2 AS (SELECT gr.x, gr.y, {acc} FROM gr, wt JOIN h1 s ON s.x = gr.x AND s.y = least(greatest(gr.y + wt.d, {CANVAS.y}), {CANVAS.bottom - 1}) GROUP BY gr.x, gr.y)"]


def resampled(span: str, wx: str, wy: str) -> str:
    bx = [1.25 * x - 0.5 * y + 3 for x in (CANVAS.x, CANVAS.right) for y in (CANVAS.y, CANVAS.bottom)]
    by = [0.25 * x + 0.75 * y - 2 for x in (CANVAS.x, CANVAS.right) for y in (CANVAS.y, CANVAS.bottom)]
    import math

    r = Rect(math.floor(min(bx)), math.floor(min(by)), math.ceil(max(bx)) - math.floor(min(bx)), math.ceil(max(by)) - math.floor(min(by)))
    ia, ib, ic, d = INV["ia"], INV["ib"], INV["ic"], INV["id"]
    tx, ty = -(ia * 3.0 + ic * -2.0), -(ib * 3.0 + d * -2.0)
    at = f"pos AS (SELECT x, y, x * {ia}::DOUBLE + y * {ic}::DOUBLE + ({tx})::DOUBLE AS sx, x * ({ib})::DOUBLE + y * {d}::DOUBLE + ({ty})::DOUBLE AS sy FROM gr), fl AS (SELECT *, CAST(floor(sx) AS INT) AS ix, CAST(floor(sy) AS INT) AS iy, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM pos)"
    base = [PX, L[1], grid(r), at, f"bx AS (SELECT * FROM l1 WHERE {inside(CANVAS)})"]
    if not span:
        return w(*base) + f"SELECT fl.x, fl.y, {rgba('p.')} FROM fl JOIN l1 p ON p.x = ix AND p.y = iy WHERE {inside(CANVAS, 'ix', 'iy')}"
    s = ", ".join(f"sum(wv * p.{c} * p.a) AS {c}" for c in "rgb")
    return w(*base, f"tp AS (SELECT x, y, ix + i AS qx, iy + j AS qy, ({wx}) * ({wy}) AS wv FROM fl, range({span}) u(i), range({span}) v(j))", f"sm AS (SELECT tp.x, tp.y, {s}, sum(wv * p.a) AS a FROM tp JOIN bx p ON p.x = qx AND p.y = qy WHERE wv <> 0 GROUP BY 1, 2)") + f"SELECT x, y, {', '.join(R(f'{c} / a', c) for c in 'rgb')}, {R('a', 'a')} FROM sm WHERE a > 0"


def perspective(quad: list[tuple[float, float]]) -> str:
    """CANVAS seen through a quad: the eight numbers of the map solve linear equations, places take four weighted taps."""
    import math

    import numpy as np

    to = [(CANVAS.x, CANVAS.y), (CANVAS.right, CANVAS.y), (CANVAS.right, CANVAS.bottom), (CANVAS.x, CANVAS.bottom)]
    rows = [r for (x, y), (u, v) in zip(quad, to, strict=True) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    m = [f"({float(v)!r})::DOUBLE" for v in np.linalg.solve(np.array(rows, float), np.array(to, float).ravel())]
    x0, y0 = (math.floor(min(p[k] for p in quad)) for k in (0, 1))
    out = Rect(x0, y0, math.ceil(max(p[0] for p in quad)) - x0, math.ceil(max(p[1] for p in quad)) - y0)
    pos = f"pos AS (SELECT x, y, ({m[0]} * x + {m[1]} * y + {m[2]}) / ({m[6]} * x + {m[7]} * y + 1) AS sx, ({m[3]} * x + {m[4]} * y + {m[5]}) / ({m[6]} * x + {m[7]} * y + 1) AS sy FROM gr)"
    fl = f"fl AS (SELECT *, CAST(floor(sx) AS INT) AS ix, CAST(floor(sy) AS INT) AS iy, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM pos WHERE {inside(CANVAS, 'sx', 'sy')})"
    tp = "tp AS (SELECT x, y, ix + i AS qx, iy + j AS qy, (CASE WHEN i = 0 THEN 1 - fx ELSE fx END) * (CASE WHEN j = 0 THEN 1 - fy ELSE fy END) AS wv FROM fl, range(2) u(i), range(2) v(j))"
    sums = ", ".join(f"sum(wv * p.{c} * p.a) AS {c}" for c in "rgb")
    return w(PX, L[1], grid(out), pos, fl, tp, f"sm AS (SELECT tp.x, tp.y, {sums}, sum(wv * p.a) AS a FROM tp JOIN l1 p ON p.x = qx AND p.y = qy WHERE wv <> 0 GROUP BY 1, 2)") + f"SELECT x, y, {', '.join(R(f'{c} / a', c) for c in 'rgb')}, {R('a', 'a')} FROM sm WHERE a > 0"


def hsl_columns(r: str, g: str, b: str) -> str:
    """Further columns z_h (degrees), z_s and z_l of a colour."""
    turn = lambda e: f"({e} - 6 * floor({e} / 6))"
    hue = f"CASE WHEN z_d < 1e-7 THEN 0.0 WHEN z_hi = z_1 THEN {turn('((z_2 - z_3) / z_d)')} WHEN z_hi = z_2 THEN (z_3 - z_1) / z_d + 2 ELSE (z_1 - z_2) / z_d + 4 END * 60"
    return f", {r} AS z_1, {g} AS z_2, {b} AS z_3, greatest(z_1, z_2, z_3) AS z_hi, least(z_1, z_2, z_3) AS z_lo, z_hi - z_lo AS z_d, (z_hi + z_lo) / 2 AS z_l, CASE WHEN z_d < 1e-7 THEN 0.0 ELSE z_d / nullif(1 - abs(2 * z_l - 1), 0) END AS z_s, {hue} AS z_h"


def from_hsl_columns(h: str, s: str, l: str) -> str:
    """Further columns z_r, z_g and z_b by the fast ramp."""
    one = lambda *k: "CASE " + " ".join(f"WHEN z_k = {i} THEN {v}" for i, v in enumerate(k)) + " END + z_m"
    return f", (({h}) - 360 * floor(({h}) / 360)) / 360 AS z_t, (1 - abs(2 * {l} - 1)) * {s} AS z_c, z_c * (1 - abs(z_t * 12 - 2 * floor(z_t * 6) - 1)) AS z_x, {l} - z_c / 2 AS z_m, CAST(floor(z_t * 6) AS INT) % 6 AS z_k, {one('z_c', 'z_x', '0', '0', 'z_x', 'z_c')} AS z_r, {one('z_x', 'z_c', 'z_c', 'z_x', '0', '0')} AS z_g, {one('0', '0', 'z_x', 'z_c', 'z_c', 'z_x')} AS z_b"


CUBE = "CASE WHEN abs({d}) <= 1 THEN 1.5 * abs({d}) * abs({d}) * abs({d}) - 2.5 * abs({d}) * abs({d}) + 1 WHEN abs({d}) <= 2 THEN -0.5 * abs({d}) * abs({d}) * abs({d}) + 2.5 * abs({d}) * abs({d}) - 4 * abs({d}) + 2 ELSE 0.0 END"


def component(like: str, x: int, y: int, name: str) -> str:
    """Recursive CTE of the places of `like` connected with a seed."""
    return f"{name} AS (SELECT x, y FROM {like} WHERE x = {x} AND y = {y} UNION SELECT l.x, l.y FROM {name} c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) JOIN {like} l ON l.x = c.x + dx AND l.y = c.y + dy)"


def like(name: str, x: int, y: int, tol: float, radius: int | None = None) -> str:
    near = f" AND (g.x - {x}) * (g.x - {x}) + (g.y - {y}) * (g.y - {y}) <= {radius * radius}" if radius else ""
    return f"{name} AS (SELECT g.x, g.y FROM grey g, (SELECT r AS v FROM grey WHERE x = {x} AND y = {y}) s WHERE 3 * pow({enc('g.r')} - {enc('s.v')}, 2) <= {tol}::DOUBLE * {tol} {near})"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    tile = "CAST(floor({c} / 256.0) AS INT)"
    q["composite_tiles"] = w(*FLAT_CTES) + f"SELECT CAST(floor(x / 16.0) AS INT) AS tx, CAST(floor(y / 16.0) AS INT) AS ty, {', '.join(R(f'avg({c})', c) for c in 'rgba')}, count(*) AS n FROM f5 GROUP BY 1, 2"
    q["tile_index"] = w(PX) + f"SELECT layer_id, x, y, {tile.format(c='x')} AS tx, {tile.format(c='y')} AS ty, CAST(x - 256 * floor(x / 256.0) AS INT) AS lx, CAST(y - 256 * floor(y / 256.0) AS INT) AS ly FROM px"
    q["tile_nnz"] = w(PX) + f"SELECT layer_id, {tile.format(c='x')} AS tx, {tile.format(c='y')} AS ty, count(*) AS nnz FROM px GROUP BY 1, 2, 3"
    q["tile_bounds"] = w(PX) + f"SELECT layer_id, min({tile.format(c='x')}) * 256 AS x, min({tile.format(c='y')}) * 256 AS y, CAST((max({tile.format(c='x')}) - min({tile.format(c='x')}) + 1) * 256 AS BIGINT) AS w, CAST((max({tile.format(c='y')}) - min({tile.format(c='y')}) + 1) * 256 AS BIGINT) AS h FROM px GROUP BY 1"
    bounds = "min(x) AS x, min(y) AS y, CAST(max(x) - min(x) + 1 AS BIGINT) AS w, CAST(max(y) - min(y) + 1 AS BIGINT) AS h"
    q["exact_bounds"] = w(PX) + f"SELECT layer_id, {bounds} FROM px WHERE a > 0.5 GROUP BY 1"
    q["prune_empty"] = w(PX) + f"SELECT layer_id, {ALL} FROM px WHERE NOT g > 0.3"
    q["get_pixel"] = w(PX) + f"SELECT layer_id, {ALL} FROM px WHERE x = 3 AND y = -4"
    q["set_pixel"] = w(PX, L[1]) + f"SELECT {ALL} FROM (SELECT * FROM l1 WHERE NOT (x = 3 AND y = -4 OR x = 0 AND y = 0) UNION ALL SELECT 3, -4, 0.1, 0.2, 0.3, 1.0)"
    q["read_rect"] = w(PX, L[1], grid(SEL_A)) + f"SELECT x, y, {', '.join(R(f'coalesce({c}, 0.0)', c) for c in 'rgba')} FROM gr LEFT JOIN l1 USING (x, y)"
    q["blit_rect"] = w(PX, L[1], L[2]) + f"SELECT {ALL} FROM (SELECT * FROM l1 WHERE NOT {inside(SEL_A)} UNION ALL SELECT * FROM l2 WHERE {inside(SEL_A)})"
    q["clear_rect"] = w(PX, L[1]) + f"SELECT {ALL} FROM l1 WHERE NOT {inside(SEL_A)}"
    q["copy_region"] = w(PX, L[1], f"mv AS (SELECT x + 7 AS x, y - 3 AS y, r, g, b, a FROM l1 WHERE {inside(SEL_A)})") + f"SELECT {ALL} FROM (SELECT * FROM l1 WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.x = l1.x AND mv.y = l1.y) UNION ALL SELECT * FROM mv)"
    q["tiles_covered"] = w(RECTS) + "SELECT id, CAST(i AS INT) AS tx, CAST(j AS INT) AS ty FROM rects, range(CAST(floor(x / 256.0) AS BIGINT), CAST(floor((x + w - 1) / 256.0) AS BIGINT) + 1) a(i), range(CAST(floor(y / 256.0) AS BIGINT), CAST(floor((y + h - 1) / 256.0) AS BIGINT) + 1) b(j) WHERE w > 0 AND h > 0"
    q["rect_algebra"] = w(RECTS) + "SELECT id, CAST(w AS BIGINT) * h AS area, CAST(greatest(least(x + w, 10) - greatest(x, -20), 0) AS BIGINT) * greatest(least(y + h, 4) - greatest(y, -20), 0) AS common, least(x, -20) AS ux, CAST(greatest(x + w, 10) - least(x, -20) AS BIGINT) AS uw FROM rects"
    for m in B:
        o = over(m, "0.8")
        q[f"blend_{m.replace('-', '_')}"] = w(PX, L[1], L[2]) + f"SELECT d.x, d.y, {', '.join(R(o[c], c) for c in 'rgba')} FROM l1 d JOIN l2 s ON d.x = s.x AND d.y = s.y"
    for k in ("invert", "desaturate", "brightness_contrast", "hue_sat", "levels", "curves", "posterize", "threshold", "gradient_map"):
        q[f"adj_{k}"] = w(PX) + adjust_sql(k, "px", "layer_id, x, y", "0.75")
        q[f"filter_{k}"] = w(PX, L[3], grid(CANVAS), "dn AS (SELECT x, y, coalesce(r, 0.0) AS r, coalesce(g, 0.0) AS g, coalesce(b, 0.0) AS b, coalesce(a, 0.0) AS a FROM gr LEFT JOIN l3 USING (x, y))") + adjust_sql(k, "dn", "x, y", None)
    q["srgb_roundtrip"] = w(PX) + f"SELECT layer_id, x, y, {R(enc('r'), 'e')}, {R(dec(enc('r')), 'r')} FROM px"
    q["premultiply"] = w(PX) + f"SELECT layer_id, x, y, {', '.join(R(f'{c} * a', c) for c in 'rgb')}, {R('a', 'a')} FROM px"
    dist = " + ".join(f"pow({enc(f'd.{c}')} - {enc(f's.{c}')}, 2)" for c in "rgb") + f" + pow({clamp('d.a')} - {clamp('s.a')}, 2)"
    q["perceptual_distance"] = w(PX, L[1], L[2]) + f"SELECT d.x, d.y, {R(dist, 'd')} FROM l1 d JOIN l2 s ON d.x = s.x AND d.y = s.y"
    q["luma"] = w(PX) + f"SELECT layer_id, x, y, {R(GREYL.format(r='r', g='g', b='b'), 'l')} FROM px"
    u8 = f"round({enc('r')} * 255)"
    q["u8_codec"] = w(PX) + f"SELECT layer_id, x, y, CAST({u8} AS INT) AS r8, CAST(round({clamp('g')} * 255) AS INT) AS g8, CAST(round({enc('b')} * 65535) AS INT) AS b16, {R(dec(f'({u8} / 255.0)'), 'back')} FROM px"
    q["composite_flat"] = w(*FLAT_CTES) + f"SELECT {ALL} FROM f5"
    q["composite_mask"] = w(PX, *L.values(), moved(3, 3, -5, "m3"), "k2 AS (SELECT x, y, l2.r, l2.g, l2.b, l2.a * l7.r AS a FROM l2 JOIN l7 USING (x, y) WHERE l2.a * l7.r <> 0)", *stack([FLAT[0], ("k2", "multiply", "0.8"), *FLAT[2:]])) + f"SELECT {ALL} FROM f5"
    grp = [PX, *L.values(), moved(2, 2, 1, "m2"), moved(3, 2, 1, "m3")]
    q["composite_group"] = w(*grp, *stack([("m2", "normal", "1.0"), ("m3", "screen", "0.5")], "g"), *stack([("l1", "normal", "1.0"), ("g2", "multiply", "0.7")])) + f"SELECT {ALL} FROM f2"
    q["composite_nested"] = w(*grp, moved(6, 1, 1, "m6"), moved(7, 1, 1, "m7"), *stack([("m6", "difference", "1.0"), ("m7", "normal", "0.6")], "h"), *stack([("m2", "normal", "1.0"), ("m3", "screen", "0.5"), ("h2", "normal", "0.8")], "g"), *stack([("l1", "normal", "1.0"), ("g3", "multiply", "0.7")])) + f"SELECT {ALL} FROM f2"
    lev = adjusted("levels", clamp("r"), clamp("g"), clamp("b"))
    lev_sql = f"SELECT x, y, {', '.join(f'CASE WHEN a = 0 THEN {c} ELSE {clamp(c)} + ({lev[c]} - {clamp(c)}) * 0.7 END AS {c}' for c in 'rgb')}, a FROM {{prev}}"
    q["composite_adjustment"] = w(PX, *L.values(), moved(3, 3, -5, "m3"), *stack([*FLAT[:3], ("", "", ""), *FLAT[3:]], adjust={3: lev_sql})) + f"SELECT {ALL} FROM f6"
    q["sample_pixel"] = w(*FLAT_CTES) + f"SELECT {ALL} FROM f5 WHERE x = 5 AND y = 6"
    q["composite_region"] = w(*FLAT_CTES) + f"SELECT {ALL} FROM f5 WHERE {inside(SEL_A)}"
    q["merge_down"] = w(PX, *L.values(), *stack(FLAT[:2])) + f"SELECT {ALL} FROM f2"
    check = "(CASE WHEN (CAST(floor(x / 8.0) + floor(y / 8.0) AS BIGINT) % 2 + 2) % 2 = 0 THEN 0.8 ELSE 0.6 END)"
    q["flatten_checker"] = w(*FLAT_CTES) + f"SELECT x, y, {', '.join(R(f'{c} * {clamp('a')} + {check} * (1 - {clamp('a')})', c) for c in 'rgb')} FROM f5"
    node = "nd AS (SELECT r_regionkey + 1000 AS id, NULL AS grp, r_regionkey AS g, -1 AS k FROM region UNION ALL SELECT n_nationkey, n_regionkey + 1000, n_regionkey, n_nationkey FROM nation)"
    q["render_order"] = w(node) + "SELECT CAST(row_number() OVER (ORDER BY g, k) - 1 AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, CAST(k >= 0 AS BIGINT) AS depth FROM nd"
    q["descendants"] = "SELECT CAST(n_regionkey + 1000 AS BIGINT) AS grp, CAST(n_nationkey AS BIGINT) AS id FROM nation"
    q["reorder_layer"] = "SELECT CAST(r_regionkey + 1000 AS BIGINT) AS id, CAST(row_number() OVER (ORDER BY CASE WHEN r_regionkey = 3 THEN 0.5 ELSE r_regionkey END) - 1 AS BIGINT) AS idx FROM region"
    q["visible_leaves"] = "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey <> 2 AND n_nationkey <> 3"
    q["soft_delete"] = w(node) + "SELECT CAST(id AS BIGINT) AS id FROM nd WHERE g <> 1"
    sel = w(PX, L[7], MASK, *SEL)
    q["sel_union"] = sel + f"SELECT {COV} FROM (SELECT x, y, greatest(coalesce(ell.cov, 0.0), coalesce(mask.cov, 0.0)) AS cov FROM ell FULL JOIN mask USING (x, y))"
    q["sel_intersect"] = sel + f"SELECT {COV} FROM (SELECT x, y, least(ell.cov, mask.cov) AS cov FROM ell JOIN mask USING (x, y)) WHERE cov > 0"
    q["sel_subtract"] = sel + f"SELECT {COV} FROM (SELECT x, y, ell.cov - coalesce(mask.cov, 0.0) AS cov FROM ell LEFT JOIN mask USING (x, y)) WHERE cov > 0"
    q["sel_invert"] = w(PX, L[7], MASK, grid(CANVAS)) + f"SELECT {COV} FROM (SELECT x, y, 1 - coalesce(cov, 0.0) AS cov FROM gr LEFT JOIN mask USING (x, y)) WHERE cov > 0"
    q["sel_ellipse"] = w("bx AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3000 - 1500 AS INT) AS x0, CAST(o_custkey * 7 % 2000 - 1000 AS INT) AS y0, CAST(o_orderkey % 11 AS INT) AS w, CAST(o_custkey % 9 AS INT) AS h FROM orders)", "pl AS (SELECT *, x0 + i AS x, y0 + j AS y, 0.5 / greatest(w / 2.0, h / 2.0) AS aa FROM (SELECT *, unnest(range(h)) AS j FROM bx), LATERAL (SELECT unnest(range(w)) AS i))", "el AS (SELECT *, least(greatest((pow((x + 0.5 - (x0 + w / 2.0)) / (w / 2.0), 2) + pow((y + 0.5 - (y0 + h / 2.0)) / (h / 2.0), 2) - (1 + aa)) / (-2 * aa), 0.0), 1.0) AS t FROM pl)") + f"SELECT id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {R('t * t * (3 - 2 * t)', 'cov')} FROM el WHERE t > 0"
    q["sel_polygon"] = w(*CORNERS, crossings("ax + (y + 0.5 - ay) / (by2 - ay)::DOUBLE * (bx - ax)"), "lim AS (SELECT path, min(ax) AS lo, max(ax) AS hi FROM pe GROUP BY 1)") + "SELECT DISTINCT path, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 1.0::DOUBLE AS cov FROM (SELECT *, unnest(range(CAST(least(greatest(ceil(cx), lo), hi) AS BIGINT), CAST(least(greatest(floor(nx) + 1, lo), hi) AS BIGINT))) AS x FROM pr JOIN lim USING (path) WHERE k % 2 = 1 AND nx IS NOT NULL)"
    wide = f"wm AS (SELECT CAST(l_orderkey AS INT) AS x, CAST(CAST(l_partkey AS BIGINT) % 8 AS INT) AS y, max(l_quantity) / 50.0 AS cov FROM lineitem WHERE l_linenumber = 7 GROUP BY 1, 2)"
    q["sel_grow"], q["sel_feather"] = grown("wm", wide), feathered("wm", wide)
    q["sel_shrink"] = w(PX, "fm AS (SELECT x, y, max(r) AS cov FROM px GROUP BY 1, 2)") + f"SELECT x, y, {R('cov', 'cov')} FROM (SELECT CAST(x + i AS INT) AS x, CAST(y + j AS INT) AS y, min(cov) AS cov FROM fm, range(-1, 2) u(i), range(-1, 2) v(j) GROUP BY 1, 2 HAVING count(*) = 9)"
    side = "(VALUES (-1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 0, 1, 1, 1)) s(nx, ny, ax, ay, ox, oy)"
    q["sel_outline"] = w(PX, L[7], "m AS (SELECT x, y FROM l7 WHERE r >= 0.5)") + f"SELECT x + ax AS x0, y + ay AS y0, x + ox AS x1, y + oy AS y1 FROM m, {side} WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.x = m.x + nx AND o.y = m.y + ny)"
    cd = " + ".join(f"pow({enc(f'coalesce({c}, 0.0)')} - {enc(v)}, 2)" for c, v in zip("rgb", ("0.6", "0.5", "0.5"), strict=True)) + " + pow(least(coalesce(a, 0.0), 1.0) - 0.6, 2)"
    q["select_by_color"] = w(PX, L[1], grid(CANVAS)) + f"SELECT x, y, 1.0::DOUBLE AS cov FROM gr LEFT JOIN l1 USING (x, y) WHERE {cd} <= 0.16000000000000003"
    sx = w(PX, L[1], *SEL)
    q["extract"] = sx + f"SELECT x, y, {', '.join(R(c, c) for c in 'rgb')}, {R('a * cov', 'a')} FROM l1 JOIN ell USING (x, y) WHERE a * cov <> 0"
    q["erase"] = sx + f"SELECT x, y, {', '.join(R(c, c) for c in 'rgb')}, {R('a * (1 - coalesce(cov, 0.0))', 'a')} FROM l1 LEFT JOIN ell USING (x, y) WHERE cov IS NULL OR a * (1 - cov) <> 0"
    q["cut_layer"] = w(PX, L[1]) + f"SELECT CASE WHEN {inside(SEL_A)} THEN 'new' ELSE 'old' END AS part, {ALL} FROM l1"
    q["fill_selection"] = sx + painted(("0.2", "0.4", "0.6", "0.9"), "0.8", "ell")
    q["stroke_selection"] = w(PX, L[1], grid(BOX, "gb"), "s AS (SELECT x, y, 1.0::DOUBLE AS cov FROM gb WHERE x < -9 OR x >= 5 OR y < -7 OR y >= 5)") + painted(("0.9", "0.1", "0.1", "1.0"), "0.7", "s")
    q["gradient_linear"] = gradient("least(greatest((vx * 24.0 + vy * 15.0) / 801.0, 0.0), 1.0)", False)
    rt = "(sqrt(vx * vx + vy * vy) / sqrt(801.0))"
    q["gradient_radial"] = gradient(f"({rt} - floor({rt}))", False)
    tt = "(atan2(24.0 * vy - 15.0 * vx, 24.0 * vx + 15.0 * vy) / (2 * pi()))"
    q["gradient_conical"] = gradient(f"({tt} - floor({tt}))", False)
    dt = "((abs(vx) + abs(vy)) / 39.0)"
    q["gradient_diamond"] = gradient(f"(1 - abs({dt} - 2 * floor({dt} / 2) - 1))", True)
    q["mask_apply"] = w(PX, L[1], L[7], MASK) + f"SELECT x, y, {', '.join(R(c, c) for c in 'rgb')}, {R('a * cov', 'a')} FROM l1 JOIN mask USING (x, y) WHERE a * cov <> 0"
    q["flip_h"] = w(PX, L[1]) + f"SELECT -1 - x AS x, y, {rgba()} FROM l1"
    q["flip_v"] = w(PX, L[1]) + f"SELECT x, -1 - y AS y, {rgba()} FROM l1"
    q["trim"] = w(*FLAT_CTES) + f"SELECT {bounds} FROM f5 WHERE a > 0.9"
    q["crop"] = w(*FLAT_CTES) + f"SELECT {ALL} FROM f5 WHERE {inside(BOX)}"
    q["resize_canvas"] = "SELECT o_orderkey AS id, anchor, CAST(trunc((o_custkey % 700 - o_orderkey % 640) * ax / 2.0) AS BIGINT) AS dx, CAST(trunc((o_orderkey % 500 - o_custkey % 480) * ay / 2.0) AS BIGINT) AS dy FROM orders, (VALUES ('nw', 0, 0), ('n', 1, 0), ('ne', 2, 0), ('w', 0, 1), ('c', 1, 1), ('e', 2, 1), ('sw', 0, 2), ('s', 1, 2), ('se', 2, 2)) t(anchor, ax, ay)"
    q["slice_export_rows"] = w(PX, L[1]) + f"SELECT regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') || '_' || sx || '_' || sy AS file, x - sx AS x, y - sy AS y, {rgba()} FROM l1, (VALUES ('top left', -32, -32, 10, 12), ('mid/é', -4, -4, 9, 7)) t(name, sx, sy, sw, sh) WHERE x >= sx AND x < sx + sw AND y >= sy AND y < sy + sh"
    q["slice_names"] = "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM pages"
    q["gaussian"] = w(*blur(1.2, 4)) + f"SELECT {ALL} FROM h2"
    q["sharpen"] = w(*blur(1.0, 3)) + f"SELECT d.x, d.y, {', '.join(R(clamp(f'd.{c} + 0.8 * (d.{c} - h2.{c})'), c) for c in 'rgb')}, {R('d.a', 'a')} FROM dn d JOIN h2 ON d.x = h2.x AND d.y = h2.y"
    q["emboss"] = taps({c: f"{c}4 + 0.6 * ((-{c}0 - {c}1 + {c}2 - {c}3 + {c}5 + {c}7 + {c}8 + {c}4) - {c}4)" for c in "rgb"})
    q["edge_detect"] = taps({c: f"{c}4 + 0.9 * (sqrt(pow(({c}2 - {c}0) + 2 * ({c}5 - {c}3) + ({c}8 - {c}6), 2) + pow(({c}6 + 2 * {c}1 + {c}0) - ({c}8 + 2 * {c}7 + {c}2), 2)) - {c}4)" for c in "rgb"})
    lum = f"lm AS (SELECT x, y, 0.2126 * {enc('r')} + 0.7152 * {enc('r')} + 0.0722 * {enc('r')} AS l FROM grey)"
    sob = "sb AS MATERIALIZED (SELECT gr.x, gr.y, sum(l * dx * (2 - abs(dy))) AS gx, sum(l * dy * (2 - abs(dx))) AS gy FROM gr, (SELECT i AS dx, j AS dy FROM range(-1, 2) a(i), range(-1, 2) b(j)) JOIN lm ON lm.x = gr.x + dx AND lm.y = gr.y + dy GROUP BY 1, 2)"
    g64 = "gr AS (SELECT x, y FROM grey)"
    mag = "sqrt(gx * gx + gy * gy)"
    q["sobel"] = w(GREY, lum, g64, sob) + f"SELECT x, y, {R(mag, 'mag')} FROM sb"
    q["box_mean"] = w(PX, L[1], grid(CANVAS)) + f"SELECT gr.x, gr.y, {', '.join(R(f'sum({c}) / 25', c) for c in 'rgba')} FROM gr JOIN l1 ON abs(l1.x - gr.x) <= 2 AND abs(l1.y - gr.y) <= 2 GROUP BY 1, 2"
    q["eyedropper"] = w(PX, L[1]) + f"SELECT {', '.join(R(f'coalesce(sum({c}), 0.0) / 20', c) for c in 'rgba')} FROM l1 WHERE x BETWEEN -32 AND -29 AND y BETWEEN 2 AND 6"
    q["thumbnail"] = w(PX, L[1]) + f"SELECT CAST(floor((x + 32) / 4.0) AS INT) AS x, CAST(floor((y + 32) / 4.0) AS INT) AS y, {', '.join(R(f'sum({c} * a) / sum(a)', c) for c in 'rgb')}, {R('sum(a) / 16', 'a')} FROM l1 GROUP BY 1, 2"
    q["snap_edge"] = w(GREY, lum, g64, sob) + f"SELECT x, y, {R('m', 'mag')} FROM (SELECT x, y, {mag} AS m FROM sb) WHERE m >= 0.2 AND pow(x - 30, 2) + pow(y - 30, 2) <= 64 ORDER BY m DESC, y, x LIMIT 1"
    q["resample_nearest"] = resampled("", "", "")
    q["resample_bilinear"] = resampled("0, 2", "CASE WHEN i = 0 THEN 1 - fx ELSE fx END", "CASE WHEN j = 0 THEN 1 - fy ELSE fy END")
    q["resample_bicubic"] = resampled("-1, 3", CUBE.format(d="(fx - i)"), CUBE.format(d="(fy - j)"))
    q["snap_grid"] = w(PX) + "SELECT layer_id, x, y, CAST(floor(x / 5.0 + 0.5) * 5 AS INT) AS gx, CAST(floor(y / 5.0 + 0.5) * 5 AS INT) AS gy FROM px"
    q["magic_wand"] = w(GREY, like("lk", 20, 20, 0.12), component("lk", 20, 20, "c")) + "SELECT x, y, 1.0::DOUBLE AS cov FROM c"
    q["region_grow"] = w(GREY, like("lk", 20, 20, 0.2, 9), component("lk", 20, 20, "c")) + "SELECT x, y, 1.0::DOUBLE AS cov FROM c"
    q["quick_select"] = w(GREY, like("lk", 20, 20, 0.15, 12), like("lm2", 40, 31, 0.15, 12), component("lk", 20, 20, "c"), component("lm2", 40, 31, "e")) + "SELECT x, y, 1.0::DOUBLE AS cov FROM (SELECT * FROM c UNION SELECT * FROM e)"
    dd = "sqrt(3 * pow(g.r - s.v, 2))"
    bk = f"bk AS (SELECT g.x, g.y, g.r, {dd} AS d FROM grey g, (SELECT r AS v FROM grey WHERE x = 20 AND y = 20) s WHERE 3 * pow(g.r - s.v, 2) <= 0.0625)"
    cv = "least(greatest(CASE WHEN d <= 0.125 THEN 1.0 ELSE (0.25 - d) / 0.125 END, 0.0), 1.0)"
    q["bucket_fill"] = w(GREY, bk, component("bk", 20, 20, "c"), f"f AS (SELECT x, y, r, {cv} AS cov FROM bk JOIN c USING (x, y))") + f"SELECT x, y, {', '.join(R(f'r * (1 - cov) + {v} * cov', c) for c, v in zip('rgb', ('0.9', '0.2', '0.1'), strict=True))}, {R('least(1 + cov * 0, 1.0)', 'a')} FROM f WHERE cov > 0"
    q["matte_unmix"] = w(PX, L[1], "u AS (SELECT *, least(greatest((sqrt(pow(r - 0.5, 2) + pow(g - 0.4, 2) + pow(b - 0.6, 2)) - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE), 0.0), 1.0) AS cov FROM l1)") + f"SELECT x, y, {', '.join(R(f'CASE WHEN cov > 0 THEN {clamp(f'({c} - {m} * (1 - cov)) / cov')} ELSE 0.0 END', c) for c, m in zip('rgb', ('0.5', '0.4', '0.6'), strict=True))}, {R('a * cov', 'a')} FROM u"
    q["palette_mode"] = w(PX, f"k AS (SELECT layer_id, {R('g', 'v')}, count(*) AS n FROM px GROUP BY 1, 2)") + "SELECT layer_id, v FROM (SELECT layer_id, v, row_number() OVER (PARTITION BY layer_id ORDER BY n DESC, v) AS k FROM k) WHERE k = 1"
    q["finger_coverage"] = w(STAMPS, COVER) + f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, {R('cov', 'cov')} FROM cover WHERE cov > 0"
    fall = "fo AS (SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, (CASE WHEN t <= 0 THEN 1.0 ELSE 1 - pow(t, 1.0::DOUBLE / (1.0::DOUBLE - 0.4::DOUBLE)) END) * 0.8 AS cov FROM (SELECT i, j, sqrt(pow(i + 0.5 - cx, 2) + pow(j + 0.5 - cy, 2)) / 7.0 AS t FROM k1, range(CAST(floor(cx - 7) AS BIGINT), CAST(ceil(cx + 7) AS BIGINT) + 1) a(i), range(CAST(floor(cy - 7) AS BIGINT), CAST(ceil(cy + 7) AS BIGINT) + 1) b(j)) WHERE t < 1)"
    q["stamp_single"] = w(PX, L[1], STAMPS, "k1 AS (SELECT (min(cx) + max(cx)) * 0.5 AS cx, (min(cy) + max(cy)) * 0.5 AS cy FROM k)", fall) + painted(("0.9", "0.2", "0.1", "1.0"), "1.0", "fo") + f" UNION ALL SELECT {ALL} FROM l1 WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.x = l1.x AND fo.y = l1.y)"
    lm = GREYL.format(r="r", g="g", b="b")
    mid = f"(least(greatest({clamp(f'1 - abs({clamp(lm)} - 0.5) * 2')} * 0.5, 0.0), 0.999))"
    q["dodge"] = retouched({c: clamp(f"{c} * (1 / (1 - {mid}))") for c in "rgb"})
    st = f"(least(greatest({clamp(lm)} / 0.5, 0.0), 1.0))"
    sh = f"(least(greatest({clamp(f'1 - {st} * {st} * (3 - 2 * {st})')} * 0.5, 0.0), 0.999))"
    q["burn"] = retouched({c: f"{c} * (1 - {sh})" for c in "rgb"})
    src = "sc AS (SELECT x - 6 AS x, y + 4 AS y, r AS sr, g AS sg, b AS sb, a AS sa FROM l1)"
    q["clone_stamp"] = w(*RETOUCH, src) + f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, {', '.join(R(f'coalesce({c}, 0.0) + (coalesce(s{c}, 0.0) - coalesce({c}, 0.0)) * cov', c) for c in 'rgba')} FROM cover LEFT JOIN l1 USING (x, y) LEFT JOIN sc USING (x, y) WHERE cov > 0"
    q["sponge"] = retouched({c: f"CASE WHEN z_s < 1e-6 THEN {c} ELSE {dec(f'z_{c}')} END" for c in "rgb"}, hsl_columns(enc("r"), enc("g"), enc("b")) + from_hsl_columns("z_h", clamp("z_s * 1.4"), "z_l"))
    mine, got = GREYL.format(r="r", g="g", b="b"), GREYL.format(r="z_r", g="z_g", b="z_b")
    q["recolor"] = retouched({c: f"CASE WHEN {got} > 1e-6 THEN {clamp(f'z_{c} * ({mine} / nullif({got}, 0))')} ELSE {mine} END" for c in "rgb"}, hsl_columns(clamp("r"), clamp("g"), clamp("b")) + from_hsl_columns("150.0::DOUBLE", "0.5::DOUBLE", "z_l"))
    q["perspective"] = perspective([(-34.0, -30.0), (28.0, -27.0), (30.0, 31.0), (-29.0, 26.0)])
    zero = lambda *t: ", ".join(f"coalesce({a}.{c}, 0.0) AS {p}{c}" for a, p in t for c in "rgba")
    spot = "spot AS (SELECT CAST(floor(cx) AS INT) AS x, CAST(floor(cy) AS INT) AS y FROM k)"
    mm = "mm AS (SELECT " + ", ".join(f"avg(s{c}) AS ms{c}, avg({c}) AS md{c}" for c in "rgb") + f" FROM (SELECT {zero(('d', ''), ('s', 's'))} FROM spot LEFT JOIN l1 d ON d.x = spot.x AND d.y = spot.y LEFT JOIN l1 s ON s.x = spot.x + 6 AND s.y = spot.y - 4))"
    hh = f"hh AS (SELECT cover.x, cover.y, cov, {zero(('d', ''), ('s', 's'))} FROM cover LEFT JOIN l1 d ON d.x = cover.x AND d.y = cover.y LEFT JOIN l1 s ON s.x = cover.x + 6 AND s.y = cover.y - 4)"
    healed = {c: f"{c} + ({clamp(f's{c} - ms{c} + md{c}')} - {c}) * cov" for c in "rgb"}
    q["heal"] = w(*RETOUCH, spot, mm, hh, f"o AS (SELECT x, y, {cols(healed)}, a, {' + '.join(f'abs({e} - {c})' for c, e in healed.items())} AS moved FROM hh, mm)") + f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, {rgba()} FROM o WHERE moved > 1e-4"
    # smudge: stamps of 6 places, 6 apart; a running mix along each stroke; at a place the last stamp's colour and the greatest cover
    sg = f"sg AS (SELECT *, lead(cx) OVER q AS nx, lead(cy) OVER q AS ny, count(*) OVER (PARTITION BY stroke_id) AS m FROM (SELECT stroke_id, seq, px * 0.5 - 30.0 AS cx, py * 0.5 - 32.0 AS cy FROM ({STROKES_SQL})) WINDOW q AS (PARTITION BY stroke_id ORDER BY seq))"
    sl = "sl AS (SELECT *, CASE WHEN m = 1 THEN 0.0 ELSE sqrt(pow(nx - cx, 2) + pow(ny - cy, 2)) END AS ln FROM sg)"
    ss = "ss AS (SELECT stroke_id, row_number() OVER (PARTITION BY stroke_id ORDER BY seq, i) AS n, CASE WHEN ln = 0 THEN cx ELSE cx + (nx - cx) * (i * 6.0::DOUBLE / ln) END AS cx, CASE WHEN ln = 0 THEN cy ELSE cy + (ny - cy) * (i * 6.0::DOUBLE / ln) END AS cy FROM (SELECT *, unnest(range(0, CAST(floor(ln / 6.0) AS BIGINT) + 1)) AS i FROM sl WHERE m = 1 OR ln > 0))"
    un = f"un AS MATERIALIZED (SELECT ss.*, {zero(('p', ''))} FROM ss LEFT JOIN l1 p ON p.x = CAST(trunc(cx) AS INT) AND p.y = CAST(trunc(cy) AS INT))"
    ca = f"ca AS (SELECT stroke_id, n, cx, cy, r, g, b, a FROM un WHERE n = 1 UNION ALL SELECT un.stroke_id, un.n, un.cx, un.cy, {', '.join(f'ca.{c} + (un.{c} - ca.{c}) * 0.6::DOUBLE' for c in 'rgba')} FROM ca JOIN un ON un.stroke_id = ca.stroke_id AND un.n = ca.n + 1)"
    pl = "pl AS (SELECT *, sqrt(pow(i + 0.5 - cx, 2) + pow(j + 0.5 - cy, 2)) / 3.0::DOUBLE AS t FROM ca, range(-4, 5) u(di), range(-4, 5) v(dj), LATERAL (SELECT CAST(floor(cx) AS INT) + di AS i, CAST(floor(cy) AS INT) + dj AS j))"
    hi = "hi AS (SELECT stroke_id, CAST(i AS INT) AS x, CAST(j AS INT) AS y, max((1 - t) * (1 - 0.25 * t)) AS cov, " + ", ".join(f"arg_max({c}, n) AS s{c}" for c in "rgba") + " FROM pl WHERE t < 1 GROUP BY 1, 2, 3)"
    q["smudge"] = w(PX, L[1], sg, sl, ss, un, ca, pl, hi) + f"SELECT stroke_id, x, y, {', '.join(R(f'coalesce(l1.{c}, 0.0) * (1 - cov * 0.6) + s{c} * (cov * 0.6)', c) for c in 'rgba')} FROM hi LEFT JOIN l1 USING (x, y) WHERE cov > 0"
    # border means in rounds, corners twice
    ext = "ex AS (SELECT max(x) AS mx, max(y) AS my FROM grey)"
    bo = "bo AS (SELECT r, g, b, CAST(x = 0 AS INT) + CAST(x = mx AS INT) + CAST(y = 0 AS INT) + CAST(y = my AS INT) AS n FROM grey, ex WHERE x = 0 OR y = 0 OR x = mx OR y = my)"
    away = lambda m: f"(pow(r - {m}.mr, 2) + pow(g - {m}.mg, 2) + pow(b - {m}.mb, 2)) <= 0.3::DOUBLE * 0.3"
    rounds = ["k0 AS (SELECT " + ", ".join(f"sum({c} * n) / sum(n) AS m{c}" for c in "rgb") + " FROM bo)"]
    rounds += [f"k{i + 1} AS (SELECT " + ", ".join(f"coalesce(sum({c} * n) / nullif(sum(n), 0), 0.0) AS m{c}" for c in "rgb") + f" FROM bo, k{i} WHERE {away(f'k{i}')})" for i in range(4)]
    q["matte_detect_solid"] = w(GREY, ext, bo, *rounds) + f"SELECT {', '.join(R(f'max(k4.m{c})', c) for c in 'rgb')}, {R('sum(CASE WHEN ' + away('k4') + ' THEN n ELSE 0 END) / sum(n)', 'covered')}, sum(CASE WHEN {away('k4')} THEN n ELSE 0 END) / sum(n) >= 0.5 AS solid FROM bo, k4"
    # two means, eight rounds from the least and the greatest r + g + b
    pal = f"pal AS ({PALETTE_SQL})"
    order = "{'s': r + g + b, 'r': r, 'g': g, 'b': b}"
    means = [f"c0 AS (SELECT 0 AS k, arg_min(r, {order}) AS r, arg_min(g, {order}) AS g, arg_min(b, {order}) AS b, 0 AS n FROM pal UNION ALL SELECT 1, arg_max(r, {order}), arg_max(g, {order}), arg_max(b, {order}), 0 FROM pal)"]
    for i in range(8):
        d = lambda k: f"(pow(p.r - {k}.r, 2) + pow(p.g - {k}.g, 2) + pow(p.b - {k}.b, 2))"
        means.append(f"c{i + 1} AS (SELECT o.k, coalesce(avg(p.r), any_value(o.r)) AS r, coalesce(avg(p.g), any_value(o.g)) AS g, coalesce(avg(p.b), any_value(o.b)) AS b, count(p.r) AS n FROM c{i} o LEFT JOIN (SELECT p.r, p.g, p.b, CASE WHEN {d('u')} <= {d('v')} THEN 0 ELSE 1 END AS k FROM pal p, (SELECT * FROM c{i} WHERE k = 0) u, (SELECT * FROM c{i} WHERE k = 1) v) p ON p.k = o.k GROUP BY o.k)")
    q["palette_two_means"] = w(pal, *means) + f"SELECT k, {', '.join(R(c, c) for c in 'rgb')}, n FROM c8"
    # eight by eight samples of a polygon a place
    shapes = [
        f"sv AS (SELECT stroke_id AS path, seq, px / 16.0 AS ax, py / 16.0 AS ay FROM ({STROKES_SQL}))",
        "eg AS (SELECT path, ax, ay, coalesce(lead(ax) OVER o, first_value(ax) OVER o) AS bx, coalesce(lead(ay) OVER o, first_value(ay) OVER o) AS by2 FROM sv WINDOW o AS (PARTITION BY path ORDER BY seq))",
        "lm AS (SELECT path, CAST(floor(min(ax)) AS BIGINT) AS x0, CAST(ceil(max(ax)) AS BIGINT) AS x1, CAST(floor(min(ay)) AS BIGINT) AS y0, CAST(ceil(max(ay)) AS BIGINT) AS y1 FROM sv GROUP BY 1)",
        "sm AS (SELECT path, x, y, x + (i + 0.5) / 8.0::DOUBLE AS sx, y + (j + 0.5) / 8.0::DOUBLE AS sy FROM (SELECT *, unnest(range(x0, x1)) AS x FROM lm), LATERAL (SELECT unnest(range(y0, y1)) AS y), range(8) c(i), range(8) d(j))",
        "hits AS (SELECT sm.path, x, y, sx, sy, count(*) AS n FROM sm JOIN eg ON eg.path = sm.path AND (ay > sy) <> (by2 > sy) AND sx < ax + (sy - ay) / (by2 - ay) * (bx - ax) GROUP BY 1, 2, 3, 4, 5)",
    ]
    q["supersample"] = w(*shapes) + f"SELECT path, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {R('count(*) / 64.0::DOUBLE', 'cov')} FROM hits WHERE n % 2 = 1 GROUP BY 1, 2, 3"
    st6 = f"st AS (SELECT * FROM ({STROKES_SQL}))"

    def spline(c: str) -> str:
        return f"0.5 * (2 * {c} + ({c}n - {c}p) * t + (2 * {c}p - 5 * {c} + 4 * {c}n - {c}m) * t * t + (3 * {c} - {c}p - 3 * {c}n + {c}m) * t * t * t)"

    nb = ", ".join(f"coalesce(lag({c}) OVER o, 2 * {c} - lead({c}) OVER o) AS {c}p, lead({c}) OVER o AS {c}n, coalesce(lead({c}, 2) OVER o, 2 * lead({c}) OVER o - {c}) AS {c}m" for c in ("px", "py"))
    q["catmull_rom"] = w(st6, f"nb AS (SELECT *, {nb} FROM st WINDOW o AS (PARTITION BY stroke_id ORDER BY seq))") + f"SELECT stroke_id, seq, CAST(k AS INT) AS k, {R(spline('px'), 'px')}, {R(spline('py'), 'py')} FROM (SELECT *, k / 4.0::DOUBLE AS t FROM nb, range(4) u(k)) WHERE pxn IS NOT NULL"
    ln = "ln AS (SELECT stroke_id, seq, CAST(floor(px) AS INT) AS x0, CAST(floor(py) AS INT) AS y0, CAST(floor(lead(px) OVER o) AS INT) AS x1, CAST(floor(lead(py) OVER o) AS INT) AS y1 FROM st WINDOW o AS (PARTITION BY stroke_id ORDER BY seq))"
    n = "greatest(abs(x1 - x0), abs(y1 - y0))"
    q["bresenham"] = w(st6, ln) + f"SELECT DISTINCT stroke_id, seq, CAST(x0 + CASE WHEN n = 0 THEN 0 ELSE floor((x1 - x0) * k / n::DOUBLE + 0.5) END AS INT) AS x, CAST(y0 + CASE WHEN n = 0 THEN 0 ELSE floor((y1 - y0) * k / n::DOUBLE + 0.5) END AS INT) AS y FROM (SELECT *, {n} AS n, unnest(range(0, {n} + 1)) AS k FROM ln WHERE x1 IS NOT NULL)"
    q["scanline_fill"] = w(*CORNERS, crossings("ax + (y + 0.5 - ay) * (bx - ax) / (by2 - ay)::DOUBLE")) + "SELECT DISTINCT path, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT path, y, CAST(ceil(cx) AS BIGINT) AS s, CAST(ceil(nx - 1) AS BIGINT) AS e FROM pr WHERE k % 2 = 1 AND nx IS NOT NULL) z, LATERAL (SELECT unnest(range(s, greatest(s, e) + 1)) AS x)"
    q["nearest_vertex"] = w(st6) + "SELECT stroke_id AS path, seq AS vertex, px AS vx, py AS vy FROM st WHERE pow(px - 60, 2) + pow(py - 60, 2) <= 1600 ORDER BY pow(px - 60, 2) + pow(py - 60, 2), stroke_id, seq LIMIT 1"
    q["last_write_wins"] = w(PX) + f"SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY layer_id DESC) AS k FROM px) WHERE k = 1"
    return q



