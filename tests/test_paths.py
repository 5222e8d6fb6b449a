"""Coverage of curved outlines and strokes against exact clipping and distances; strokes by arc length."""

import math
import random

import pytest

from tilestrata.operators import arclength, coverage

SCHEMA = "path long, verbs array<struct<v:string,p:array<double>>>, width double"


def clipped_area(poly, x, y):
    """Signed area of a polygon inside a place, by clipping at its four sides."""
    for axis, sign, limit in ((0, 1, x), (0, -1, -(x + 1)), (1, 1, y), (1, -1, -(y + 1))):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            a, b = sign * p[axis] - limit, sign * q[axis] - limit
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
        poly = out
        if not poly:
            return 0.0
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1])) / 2


def areas(poly):
    xs, ys = [p[0] for p in poly], [p[1] for p in poly]
    out = {(x, y): abs(clipped_area(poly, x, y)) for x in range(math.floor(min(xs)), math.ceil(max(xs))) for y in range(math.floor(min(ys)), math.ceil(max(ys)))}
    return {k: v for k, v in out.items() if v > 1e-9}


def cubic(p, n):
    weigh = lambda t: ((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3)
    return [tuple(sum(w * q[k] for w, q in zip(weigh(i / n), p)) for k in (0, 1)) for i in range(n + 1)]


def found(df):
    return {(r["path"], r["x"], r["y"]): r["cov"] for r in df.collect()}


def test_polygons_and_curves_are_exact(spark):
    r = random.Random(4)
    star = [(5 + (4 if k % 2 else 1.7) * math.cos(k * math.pi / 5 + 0.3), -3 + (4 if k % 2 else 1.7) * math.sin(k * math.pi / 5 + 0.3)) for k in range(10)]
    wide = [(-20.25, 0.1), (40.3, 2.2), (39.0, 9.75), (-19.0, 7.0)]
    tiny = [(3.1, 3.1), (3.4, 3.2), (3.2, 3.9)]
    walk = sorted(((r.uniform(2, 9), r.uniform(0, 2 * math.pi)) for _ in range(12)), key=lambda q: q[1])
    shapes = {1: star, 2: wide, 3: tiny, 4: star[::-1], 5: [(a * math.cos(t), a * math.sin(t)) for a, t in walk], 6: [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]}
    rows = [(k, [("M", list(map(float, p[0])))] + [("L", list(map(float, q))) for q in p[1:]] + ([("z", [])] if k % 2 else []), 1.0) for k, p in shapes.items()]
    curve = [(0.5, 0.5), (9.0, -6.0), (12.0, 14.0), (1.0, 8.0)]
    rows.append((7, [("M", [0.5, 0.5]), ("C", [9.0, -6.0, 12.0, 14.0, 1.0, 8.0]), ("Z", [])], 1.0))
    quad = [(0.0, 0.0), (2 * 6 / 3, 2 * 9 / 3), (9 + 2 / 3 * (6 - 9), 1 + 2 / 3 * (9 - 1)), (9.0, 1.0)]
    rows.append((8, [("M", [0.0, 0.0]), ("Q", [6.0, 9.0, 9.0, 1.0])], 1.0))
    got = found(coverage.coverage(coverage.fill_edges(spark.createDataFrame(rows, SCHEMA).repartition(3), 1e-5)))
    shapes |= {7: cubic(curve, 4000), 8: cubic(quad, 4000)}
    for k, poly in shapes.items():
        want, mine = areas(poly), {p[1:]: c for p, c in got.items() if p[0] == k}
        for place in want.keys() | mine.keys():
            assert mine.get(place, 0.0) == pytest.approx(want.get(place, 0.0), abs=1e-9 if k < 7 else 1e-4), (k, place)


def test_rules_and_odd_verbs(spark):
    ring = [("M", [0.0, 0.0]), ("L", [8.0, 0.0]), ("L", [8.0, 8.0]), ("L", [0.0, 8.0]), ("Z", []), ("M", [2.0, 2.0]), ("L", [6.0, 2.0]), ("L", [6.0, 6.0]), ("L", [2.0, 6.0]), ("Z", [])]
    odd = [("L", [1.0, 1.0]), ("Z", []), ("M", [0.0, 0.0]), ("?", [1.0]), ("L", [float("nan"), 1.0]), ("L", [4.0, None]), ("L", [4.0]), ("L", [4.0, 0.0]), ("L", [0.0, 4.0]), (None, None)]
    df = spark.createDataFrame([(1, ring, 1.0), (2, odd, None), (3, [], 1.0), (4, None, 1.0), (5, [("M", [1.0, 1.0])], 1.0)], SCHEMA)
    both = {rule: found(coverage.coverage(coverage.fill_edges(df), rule)) for rule in ("nonzero", "evenodd")}
    assert both["nonzero"][1, 4, 4] == 1.0 and (1, 4, 4) not in both["evenodd"] and both["evenodd"][1, 1, 4] == 1.0
    assert {k: v for k, v in both["nonzero"].items() if k[0] == 2} == pytest.approx({(2, x, y): 1.0 if x + y < 3 else 0.5 for x in range(4) for y in range(4) if x + y < 4})
    assert {k[0] for k in both["nonzero"]} == {1, 2}
    assert coverage.coverage(coverage.fill_edges(df.limit(0))).count() == 0
    assert {(r["x"], r["y"]) for r in coverage.selection(df).collect()} == {k[1:] for k in both["evenodd"] if k[0] == 1}
    with pytest.raises(ValueError):
        coverage.coverage(coverage.fill_edges(df), "no rule")


def test_straight_strokes_with_joins_and_caps(spark):
    line = [("M", [2.5, 3.5]), ("L", [10.5, 3.5])]
    bend = [("M", [2.0, 2.0]), ("L", [12.0, 2.0]), ("L", [12.0, 10.0])]
    box = [("M", [2.0, 2.0]), ("L", [12.0, 2.0]), ("L", [12.0, 10.0]), ("L", [2.0, 10.0]), ("Z", [])]
    df = spark.createDataFrame([(1, line, 2.0), (2, bend, 2.0), (3, box, 2.0), (4, [("M", [1.0, 1.0]), ("L", [1.0, 1.0])], 2.0), (5, line, 0.0), (6, line, None)], SCHEMA)
    total = lambda c, k: sum(v for p, v in c.items() if p[0] == k)
    stroke = lambda **o: found(coverage.coverage(coverage.stroke_edges(df, 1e-4, **o)))
    butt = stroke()
    assert {k[0] for k in butt} == {1, 2, 3}
    assert butt == pytest.approx({k: v for k, v in butt.items()}) and all(v <= 1 for v in butt.values())
    poly = [(2.5, 2.5), (10.5, 2.5), (10.5, 4.5), (2.5, 4.5)]
    assert {p[1:]: v for p, v in butt.items() if p[0] == 1} == pytest.approx(areas(poly))
    corner = [(2.0, 1.0), (13.0, 1.0), (13.0, 10.0), (11.0, 10.0), (11.0, 3.0), (2.0, 3.0)]
    assert {p[1:]: v for p, v in butt.items() if p[0] == 2} == pytest.approx(areas(corner))
    assert total(butt, 3) == pytest.approx(12 * 10 - 8 * 6) and (3, 5, 5) not in butt
    assert total(stroke(cap="square"), 1) == pytest.approx(20.0)
    assert total(stroke(join="bevel"), 2) == pytest.approx(total(butt, 2) - 0.5)
    round_ = stroke(join="round", cap="round")
    assert total(round_, 1) == pytest.approx(16 + math.pi, abs=1e-2)
    assert total(round_, 2) == pytest.approx(total(butt, 2) - 1 + math.pi / 4 + math.pi, abs=1e-2)


def test_round_strokes_are_all_places_near_the_path(spark):
    """A curved stroke with round ends covers what lies within half its width, by 32 x 32 samples a place."""
    path = [(3.0, 4.0), (12.0, -4.0), (10.0, 18.0), (19.0, 9.0)]
    df = spark.createDataFrame([(1, [("M", list(path[0])), ("C", [v for q in path[1:] for v in q])], 3.0)], SCHEMA)
    got = {k[1:]: v for k, v in found(coverage.coverage(coverage.stroke_edges(df, 1e-3, join="round", cap="round"))).items()}
    points = cubic(path, 400)
    near = lambda x, y: min((x - a) ** 2 + (y - b) ** 2 for a, b in points) <= 2.25
    r = random.Random(1)
    for x, y in r.sample([(x, y) for x in range(0, 22) for y in range(-1, 15)], 60):
        corners = [min((x + 0.5 - a) ** 2 + (y + 0.5 - b) ** 2 for a, b in points)]
        want = 1.0 if corners[0] < 0.6 else 0.0 if corners[0] > 6.3 else sum(near(x + (i + 0.5) / 32, y + (j + 0.5) / 32) for i in range(32) for j in range(32)) / 1024
        assert got.get((x, y), 0.0) == pytest.approx(want, abs=0.02), (x, y)


def test_ink_is_stroke_over_fill(spark):
    df = spark.createDataFrame([(1, [("M", [1.0, 1.0]), ("L", [7.0, 1.0]), ("L", [7.0, 7.0]), ("L", [1.0, 7.0]), ("Z", [])], 1.0)], SCHEMA)
    df = df.selectExpr("*", "named_struct('r', 1.0D, 'g', 0.0D, 'b', 0.0D, 'a', 1.0D) AS fill", "named_struct('r', 0.0D, 'g', 0.0D, 'b', 1.0D, 'a', 1.0D) AS stroke")
    got = {(r["x"], r["y"]): (r["r"], r["b"], r["a"]) for r in coverage.rasterize(df).collect()}
    assert got[4, 4] == (1.0, 0.0, 1.0) and got[4, 0] == pytest.approx((0.0, 1.0, 0.5)) and got[4, 1] == pytest.approx((0.5, 0.5, 1.0))


def test_arc_length(spark):
    r = random.Random(2)
    rows = [(k, i, r.uniform(0, 40), r.uniform(0, 40), r.random()) for k in range(5) for i in range(r.choice([1, 2, 9]))] + [(9, 0, 1.0, 1.0, 0.5), (9, 1, 1.0, 1.0, 0.5), (9, 2, 4.0, 5.0, 0.5)]
    samples = spark.createDataFrame(rows, "stroke_id long, seq int, px double, py double, pressure double")
    for c in arclength.curves(samples).withColumn("len", arclength.length()).collect():
        points = cubic([(c[f"x{k}"], c[f"y{k}"]) for k in range(4)], 5000)
        assert c["len"] == pytest.approx(sum(math.dist(p, q) for p, q in zip(points, points[1:])), abs=5e-3)
    by = {}
    for c in arclength.resampled(samples, 1.5).orderBy("stroke_id", "seq", "i").collect():
        by.setdefault(c["stroke_id"], []).append((c["x"], c["y"]))
    assert all(math.dist(p, q) < 4.5 for x in by.values() for p, q in zip(x, x[1:]))
    ends = {k: [(x, y) for s, _, x, y, _ in rows if s == k] for k in by}
    assert all(by[k][0] == pytest.approx(p[0]) and by[k][-1] == pytest.approx(p[-1]) for k, p in ends.items())
    even = {}
    for c in arclength.even(samples.withColumnsRenamed({"px": "x", "py": "y"}), 0.7).orderBy("stroke_id", "n").collect():
        even.setdefault(c["stroke_id"], []).append((c["n"], (c["x"], c["y"])))
    for k, p in ends.items():
        total, want, at = sum(math.dist(a, b) for a, b in zip(p, p[1:])), [], 0.0
        for a, b in zip(p, p[1:]):
            d = math.dist(a, b)
            while d > 0 and len(want) * 0.7 < at + d:
                t = (len(want) * 0.7 - at) / d
                want.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
            at += d
        assert [n for n, _ in even[k]] == list(range(len(want))) and len(want) == math.ceil(total / 0.7)
        assert all(q == pytest.approx(v) for (_, q), v in zip(even[k], want))
