"""Operators without SQL against plain Python on small images."""

import math
import random

import pytest

from tilestrata import fixtures as fx
from tilestrata import queries as q
from tilestrata.operators import brush, region, resample, vector
from tilestrata.operators.tiles import Rect

SF = "/root/testdata/sf0.001"
PX = "x int, y int, r double, g double, b double, a double"
FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def image(df):
    return {(r["x"], r["y"]): tuple(r[c] for c in "rgba") for r in df.collect()}


def close(a, b):
    assert set(a) == set(b)
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def part(places, start, steps):
    todo, seen = [start], {start}
    while todo:
        x, y = todo.pop()
        for dx, dy in steps:
            p = (x + dx, y + dy)
            if p in places and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def plain_specks(candidates, cleared, most):
    out, left = set(), set(candidates)
    while left:
        one = part(candidates, next(iter(left)), EIGHT)
        left -= one
        if len(one) <= most + 1 and any((x + dx, y + dy) in cleared for x, y in one for dx, dy in EIGHT):
            out |= one
    return out


@pytest.mark.parametrize("most", [3, 64])
def test_specks(spark, most):
    rng = random.Random(most)
    places = {(x, y) for x in range(236, 276) for y in range(236, 276) if rng.random() < 0.3}
    cleared = {(x, y) for x in range(236, 276) for y in range(236, 276) if rng.random() < 0.05} - places
    df = lambda s: spark.createDataFrame(sorted(s), "x int, y int")
    assert {(r["x"], r["y"]) for r in region.specks(df(places), df(cleared), most).collect()} == plain_specks(places, cleared, most)


def plain_unmix(p, k):
    share = lambda c, m: (m - c) / m if c < m and m > 0 else (c - m) / (1 - m) if c > m and m < 1 else 0.0
    a = min(1.0, max(0.0, max(share(c, m) for c, m in zip(p, k, strict=False))))
    if a <= 0:
        return (0.0,) * 4 if sum((c - m) ** 2 for c, m in zip(p, k, strict=False)) <= region.EPSILON else p
    return (*[(c - m) / a + m for c, m in zip(p, k, strict=False)], p[3] * a)


def plain_matte(img, w, h, key, tol, soft, enclosed):
    """The rules one place at a time; key: colour of a place."""
    dist = {p: sum((c - m) ** 2 for c, m in zip(v, key(*p), strict=False)) for p, v in img.items()}
    opaque = {p for p, v in img.items() if v[3] >= region.OPAQUE}
    like = {p for p in opaque if dist[p] <= tol * tol}
    if enclosed:
        gone = set(like)
    else:
        gone, edge = set(), [p for p in like if p[0] in (0, w - 1) or p[1] in (0, h - 1)]
        for p in edge:
            if p not in gone:
                gone |= part(like, p, FOUR)
    cleared = gone | plain_specks({p for p in opaque - gone if dist[p] <= (1.6 * tol) ** 2}, gone, 64)
    near = lambda p: [(p[0] + dx, p[1] + dy) for dx, dy in FOUR if 0 <= p[0] + dx < w and 0 <= p[1] + dy < h]
    ramp = {p for p in opaque - cleared if any(n in opaque - cleared and dist[n] > dist[p] + 0.05 for n in near(p))}
    fringe = front = {p for p in ramp if any(n in cleared for n in near(p))}
    for _ in range(math.floor(2 * soft + 0.5)):
        front = {n for p in front for n in near(p) if n in ramp} - fringe
        fringe = fringe | front
    out = {}
    for p, v in img.items():
        if p in cleared:
            v = plain_unmix(v, key(*p)) if any(n not in cleared for n in near(p)) and dist[p] > tol * tol else (0.0,) * 4
        elif p in fringe:
            v = plain_unmix(v, key(*p))
        if any(v):
            out[p] = v
    return out


def portrait(w, h, key, rng):
    """A disc with a soft rim, a hole of background, and crumbs of nearly the background's colour beside it."""
    img = {}
    for x in range(w):
        for y in range(h):
            d = math.hypot(x - w / 2, y - h / 2)
            t = min(1.0, max(0.0, (8 - d) / 3)) if d > 2 else 0.0
            k = key(x, y)
            img[x, y] = (*[m + (c - m) * t for c, m in zip((0.1, 0.2, 0.7), k, strict=True)], 1.0)
    for _ in range(6):
        x, y = rng.randrange(w // 2 - 6, w // 2 + 6), rng.randrange(h // 2 - 6, h // 2 + 6)
        img[x, y] = (*[m * 0.8 for m in key(x, y)], 1.0)
    img[w // 2, h // 2 + 4] = (0.5, 0.5, 0.5, 0.4)
    return img


@pytest.mark.parametrize(("kind", "enclosed", "soft"), [("solid", False, 0.55), ("solid", True, 0.25), ("checker", False, 1.0)])
def test_remove_matte(spark, kind, enclosed, soft):
    w, h = 32, 28
    light, dark = (0.9, 0.9, 0.9), (0.5, 0.5, 0.5)
    key = (lambda x, y: light) if kind == "solid" else (lambda x, y: light if (x // 4 + y // 4) % 2 == 0 else dark)
    img = portrait(w, h, key, random.Random(5))
    px = spark.createDataFrame([(*p, *v) for p, v in img.items()], PX)
    close(image(region.remove_matte(px, Rect(0, 0, w, h), 0.2, soft, enclosed)), plain_matte(img, w, h, key, 0.2, soft, enclosed))


def test_no_matte_is_an_error(spark):
    rng = random.Random(2)
    px = spark.createDataFrame([(x, y, rng.random(), rng.random(), rng.random(), 1.0) for x in range(9) for y in range(9)], PX)
    with pytest.raises(ValueError, match="background"):
        region.remove_matte(px, Rect(0, 0, 9, 9), 0.05)


def test_two_means_keeps_an_empty_cluster(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 0.5)] * 3, "r double, g double, b double")
    assert [tuple(r) for r in region.two_means(rows).orderBy("k").collect()] == [(0, 0.5, 0.5, 0.5, 3), (1, 0.5, 0.5, 0.5, 0)]


def test_bezier_warp(spark):
    """Nearest samples of every place, cell by cell."""
    src = Rect(0, 0, 12, 8)
    px = spark.createDataFrame([(x, y, x / 12, y / 8, 0.5, 1.0) for x in range(12) for y in range(8)], PX)
    pts = [(0, 0), (6, -3), (14, 0), (1, 7), (8, 5), (13, 9), (0, 4), (7, 12), (12, 13)]  # the last row folds back over the one before
    at = lambda i, j: pts[i * 3 + j]
    want = {}
    for y in range(-3, 14):
        for x in range(0, 15):
            for i in range(2):
                for j in range(2):
                    quad = [at(i, j), at(i, j + 1), at(i + 1, j + 1), at(i + 1, j)]
                    side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(quad, quad[1:] + quad[:1], strict=True)]
                    if min(side) < 0 < max(side):
                        continue
                    u = v = 0.5
                    e = [[quad[1][k] - quad[0][k], quad[3][k] - quad[0][k], quad[2][k] - quad[3][k] - quad[1][k] + quad[0][k]] for k in (0, 1)]
                    for _ in range(8):
                        off = [p - quad[0][k] - u * e[k][0] - v * e[k][1] - u * v * e[k][2] for k, p in enumerate((x, y))]
                        du, dv = [e[k][0] + v * e[k][2] for k in (0, 1)], [e[k][1] + u * e[k][2] for k in (0, 1)]
                        det = du[0] * dv[1] - dv[0] * du[1]
                        if abs(det) < 1e-10:
                            break
                        u = min(1.0, max(0.0, u + (dv[1] * off[0] - dv[0] * off[1]) / det))
                        v = min(1.0, max(0.0, v + (du[0] * off[1] - du[1] * off[0]) / det))
                    s = math.floor((j + u) / 2 * 12), math.floor((i + v) / 2 * 8)
                    if 0 <= s[0] < 12 and 0 <= s[1] < 8:
                        want[x, y] = (s[0] / 12, s[1] / 8, 0.5, 1.0)
                    break
    # a later row that covers a place but samples nothing leaves the row before
    got = image(resample.bezier_warp(px, src, 3, 3, pts, "nearest"))
    same = [k for k in want if k in got and got[k] == pytest.approx(want[k])]
    assert set(got) <= set(want) and len(same) > 0.97 * len(want)


def test_stamps_fold_in_order(spark):
    stamps = [(1, 0, 4.0, 4.0, 1.0), (1, 1, 6.0, 5.0, 0.5), (2, 0, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(stamps, "stroke_id long, n int, cx double, cy double, pressure double")
    tip = brush.Brush(6.0, 0.3, 0.8, opacity_pressure=True, size_pressure=True)
    px = spark.createDataFrame([(x, y, 0.2, 0.4, 0.6, 0.5) for x in range(10) for y in range(10)], PX)
    got = image(brush.paint_stamps(px, brush.stamp_cover(df, tip), (0.9, 0.1, 0.2, 0.7)))
    want = {(x, y): (0.2, 0.4, 0.6, 0.5) for x in range(10) for y in range(10)}
    for _, _, cx, cy, pressure in stamps:
        for p, d in list(want.items()):
            t = math.hypot(p[0] + 0.5 - cx, p[1] + 0.5 - cy) / (3.0 * pressure)
            if t < 1:
                a = (1 - t ** (1 / 0.7)) * 0.8 * pressure * 0.7
                o = d[3] + a * (1 - d[3])
                want[p] = (*[(c * d[3] * (1 - a) + s * a * (1 - d[3]) + a * d[3] * s) / o for c, s in zip(d, (0.9, 0.1, 0.2), strict=False)], o)
    close(got, want)


def test_stroke_spacing_carries_over(spark):
    samples = [(1, k, float(x), float(y), p) for k, (x, y, p) in enumerate([(0, 0, 0.0), (7, 0, 1.0), (7, 0, 1.0), (7, 5, 0.5), (20, 5, 1.0)])]
    got = brush.stroke_stamps(spark.createDataFrame(samples, "stroke_id long, seq int, px double, py double, pressure double"), brush.Brush(8.0)).orderBy("n").collect()
    want, acc = [], 0.0
    for (_, _, ax, ay, ap), (_, _, bx, by, bp) in zip(samples, samples[1:], strict=False):
        n = math.hypot(bx - ax, by - ay)
        d = acc
        while n and d < n:
            want.append((ax + (bx - ax) * d / n, ay + (by - ay) * d / n, ap + (bp - ap) * d / n))
            d += 2.0
        acc = d - n if n else acc
    want.append(samples[-1][2:])
    assert [pytest.approx(w) for w in want] == [(r["cx"], r["cy"], r["pressure"]) for r in got]


def test_simplify_path(spark):
    rows = fx.strokes(spark, SF)

    def keep(p):
        if len(p) < 3:
            return p
        (ax, ay), (bx, by) = p[0][1:], p[-1][1:]
        n = math.hypot(bx - ax, by - ay)
        away = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / n if n else math.hypot(x - ax, y - ay) for _, x, y in p]
        k = max(range(1, len(p) - 1), key=lambda i: (away[i], -i))
        return keep(p[: k + 1])[:-1] + keep(p[k:]) if away[k] > 25 else [p[0], p[-1]]

    want = set()
    by = {}
    for r in rows.orderBy("stroke_id", "seq").collect():
        by.setdefault(r["stroke_id"], []).append((r["seq"], r["px"], r["py"]))
    for i, p in by.items():
        want |= {(i, s) for s, _, _ in keep(p)}
    assert {(r["stroke_id"], r["seq"]) for r in q.queries()["simplify_path"](spark, SF).collect()} == want


def test_shapes():
    assert vector.rectangle(1, 2, 3, 4) == [(1, 2), (4, 2), (4, 6), (1, 6)]
    for x, y in vector.ellipse(10, 10, 30, 12):
        assert abs(((x - 10) / 30) ** 2 + ((y - 10) / 12) ** 2 - 1) < 0.15
    assert vector.rounded_rectangle(0, 0, 10, 6, 0) == vector.rectangle(0, 0, 10, 6)[1:] + [(0, 0)]
    assert len(vector.regular_polygon(0, 0, 20, 5)) == 5
    curve = vector.cubic([(0, 0), (0, 30), (40, 30), (40, 0)], 0.5)
    assert curve[0] == (0, 0) and curve[-1] == (40, 0) and len(curve) > 4


def test_clone_strokes_aligned_or_not(spark):
    px = spark.createDataFrame([(x, 0, x / 40, 0.0, 0.0, 1.0) for x in range(40)], PX)
    samples = spark.createDataFrame([(1, 0, 20.0, 0.0), (2, 0, 30.0, 0.0)], "stroke_id long, seq int, px double, py double")
    cover = spark.createDataFrame([(1, 20, 0, 1.0), (2, 30, 0, 1.0)], "stroke_id long, x int, y int, cov double")
    from tilestrata.operators.retouch import clone_strokes

    for aligned, second in ((True, 15 / 40), (False, 5 / 40)):
        got = {r["stroke_id"]: r["r"] for r in clone_strokes(px, cover, samples, (5, 0), aligned).collect()}
        assert got == {1: pytest.approx(5 / 40), 2: pytest.approx(second)}


def test_eraser_is_a_product(spark):
    px = spark.createDataFrame([(0, 0, 0.1, 0.2, 0.3, 0.8), (5, 5, 0.1, 0.2, 0.3, 0.8)], PX)
    cover = spark.createDataFrame([(0, 0, 0.5, 1), (0, 0, 0.25, 2)], "x int, y int, cov double, n int")
    got = image(brush.paint_stamps(px, cover, (0, 0, 0, 1), erase=True))
    assert got[0, 0][3] == pytest.approx(0.8 * 0.5 * 0.75) and got[5, 5][3] == 0.8
