"""Nested transforms, arcs and styles of drawings."""

import math
import random

import pytest

from tilestrata.sources import svg


def on(verbs, n=64):
    """Points along verbs."""
    out, at = [], None
    for v, p in verbs:
        q = list(zip(p[::2], p[1::2]))
        if v == "C":
            a = [at, *q]
            out += [tuple(sum(w * b[k] for w, b in zip(((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3), a)) for k in (0, 1)) for t in (i / n for i in range(1, n + 1))]
        elif v != "Z":
            out += q[-1:]
        if q:
            at = q[-1]
    return out


def test_arcs_stay_on_their_ellipse():
    r = random.Random(3)
    for _ in range(300):
        rx, ry, turn = r.uniform(1, 20), r.uniform(1, 20), r.uniform(-180, 180)
        cx, cy, a, span = r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-4, 4), r.choice([-1, 1]) * r.uniform(0.2, 6.0)
        c, t = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        place = lambda k: (cx + rx * math.cos(k) * c - ry * math.sin(k) * t, cy + rx * math.cos(k) * t + ry * math.sin(k) * c)  # noqa: E731, B023
        p, q = place(a), place(a + span)
        verbs = svg.arc(*p, rx, ry, turn, abs(span) > math.pi, span > 0, *q)
        assert len(verbs) == math.ceil(abs(span) / (math.pi / 2) - 1e-9) and verbs[-1][1][-2:] == list(q)
        points = on([("M", list(p)), *verbs])
        assert all(min(math.dist(x, place(a + span * k / 400)) for k in range(401)) < 0.2 for x in points[:: max(1, len(points) // 9)])
        for x, y in points:
            u, v = (c * (x - cx) + t * (y - cy)) / rx, (c * (y - cy) - t * (x - cx)) / ry
            assert math.hypot(u, v) == pytest.approx(1, abs=1e-3)


def test_odd_arcs():
    assert svg.arc(1, 1, 5, 5, 0, True, True, 1, 1) == [] and svg.arc(0, 0, 0, 5, 0, True, True, 3, 4) == [("L", [3, 4])]
    points = on([("M", [0.0, 0.0]), *svg.arc(0, 0, 1, 1, 0, False, True, 10, 0)])  # radii that don't reach
    assert all(math.dist(p, (5, 0)) == pytest.approx(5, abs=5e-3) for p in points)


def test_nested_transforms_and_styles():
    drawing = b"""<svg width="100" height="100"><!-- note --><g transform="translate(10,20) scale(2)" fill="red" opacity="0.5" stroke="blue" stroke-width="3">
    <g transform="rotate(90)"><path d="M0 0 H4 V1 Z"/><rect x="1" y="2" width="3" height="4" transform="skewX(45)" fill="none"/></g><g visibility="hidden"><rect width="1" height="1"/></g></g>
    <g display="none"><rect width="9" height="9"/></g><circle cx="5" cy="6" r="2" transform="matrix(1 0 0 3 7 8)"/><rect width="4" height="4" rx="1" transform="rotate(90 2 2)"/></svg>"""
    size, paths = svg.curves(drawing)
    assert size == (100, 100) and len(paths) == 4
    ends = lambda k: [p[-2:] for v, p in paths[k]["verbs"] if p]
    assert [x for p in ends(0) for x in p] == pytest.approx([10, 20, 10, 28, 8, 28])
    assert [x for p in ends(1) for x in p] == pytest.approx([10 - 2 * 2, 20 + 2 * 3, 6, 20 + 2 * 6, 10 - 2 * 6, 20 + 2 * 10, -2, 20 + 2 * 7])
    assert paths[0]["fill"] == (1.0, 0.0, 0.0, 0.5) and paths[1]["fill"] == svg.CLEAR and paths[0]["stroke"][2:] == (1.0, 0.5) and paths[0]["width"] == pytest.approx(6)
    xs, ys = zip(*on(paths[2]["verbs"]))
    assert (min(xs), max(xs), min(ys), max(ys)) == pytest.approx((10, 14, 20, 32), abs=0.05)
    assert all(-1e-9 <= v <= 4 + 1e-9 for p in on(paths[3]["verbs"]) for v in p)
    whole = svg.parse(drawing)[1]
    assert whole[0]["vertices"] == [(10, 20), (10, 28), (8, 28)] and whole[0]["closed"]


def test_path_data():
    assert svg.verbs_of("m1 2 3 4z l1 1") == [("M", [1, 2]), ("L", [4, 6]), ("Z", []), ("M", [1, 2]), ("L", [2, 3])]
    assert svg.verbs_of("M0 0C1 1 2 2 3 3S5 5 6 6T9 9") == [("M", [0, 0]), ("C", [1, 1, 2, 2, 3, 3]), ("C", [4, 4, 5, 5, 6, 6]), ("Q", [6, 6, 9, 9])]
    assert svg.verbs_of("M0 0Q1 2 2 0T4 0") == [("M", [0, 0]), ("Q", [1, 2, 2, 0]), ("Q", [3, -2, 4, 0])]
    for bad in ("L1 1", "M1", "M0 0 L 1 L 2 2", "M0 0 X", "M0 0 Z 4"):
        with pytest.raises(svg.SvgError):
            svg.verbs_of(bad)
    for bad in ("<svg width='9' height='9'><g transform='turn(3)'/></svg>", "<svg width='9' height='9'>" + "<g>" * 300 + "</g>" * 300 + "</svg>"):
        with pytest.raises(svg.SvgError):
            svg.curves(bad.encode())
