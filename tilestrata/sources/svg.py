"""SVG drawings: shapes, with the transforms and styles of all groups above them, as outlines of curves (operators/coverage.py) or whole places (operators/vector.py).

Arcs become cubics over their centre form. Text, clips, gradients and effects are not read; a group's opacity goes to each of its shapes.
"""

from __future__ import annotations

import gzip
import math
import re
from xml.etree import ElementTree

from tilestrata.operators.vector import _whole, cubic, ellipse, rectangle, rounded_rectangle

#: Colours by name (fixed values of the format, the most usual ones).
NAMES = {"black": 0x000000, "white": 0xFFFFFF, "red": 0xFF0000, "green": 0x008000, "blue": 0x0000FF, "yellow": 0xFFFF00, "gray": 0x808080, "grey": 0x808080, "orange": 0xFFA500, "purple": 0x800080}
#: Pixels of a unit, by inches.
UNITS = {"": None, "px": None, "in": 1.0, "mm": 1 / 25.4, "cm": 1 / 2.54, "pt": 1 / 72, "pc": 1 / 6}
CLEAR = (0.0, 0.0, 0.0, 0.0)


class SvgError(ValueError):
    """Not a drawing that this reader understands."""


def _length(text: str | None, dpi: float, default: float = 0.0) -> float:
    m = re.fullmatch(r"\s*([-+]?[0-9.]+(?:[eE][-+]?\d+)?)\s*([a-z]*)\s*", text or "")
    if not m or m[2] not in UNITS:
        return default
    return float(m[1]) * (dpi * UNITS[m[2]] if UNITS[m[2]] else 1.0)


def _linear(v: int) -> float:
    c = v / 255
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def colour(text: str | None, alpha: float, default: tuple[float, ...]) -> tuple[float, ...]:
    """Linear (r, g, b, a) of a colour; `none` and what isn't a plain colour paint nothing."""
    if text is None:
        return default
    text = text.strip().lower()
    if m := re.fullmatch(r"#([0-9a-f])([0-9a-f])([0-9a-f])", text):
        n = int("".join(c * 2 for c in m.groups()), 16)
    elif re.fullmatch(r"#[0-9a-f]{6}", text):
        n = int(text[1:], 16)
    elif m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", text):
        n = sum(min(255, int(v)) << s for v, s in zip(m.groups(), (16, 8, 0), strict=True))
    elif text in NAMES:
        n = NAMES[text]
    else:
        return CLEAR
    return (*(_linear(n >> s & 255) for s in (16, 8, 0)), min(1.0, max(0.0, alpha)))


#: Row-major (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f.
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
MAX_DEPTH = 256
#: Attributes that shapes take from the groups above.
INHERITED = ("fill", "stroke", "stroke-width", "fill-opacity", "stroke-opacity", "visibility")
Verb = tuple[str, list[float]]


def product(m: Matrix, n: Matrix) -> Matrix:
    """m after n."""
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def transform(text: str) -> Matrix:
    """The matrix of a transform attribute; its parts apply from the right."""
    out = UNIT
    for name, inner in re.findall(r"(\w+)\s*\(([^)]*)\)", text):
        v = [float(x) for x in re.findall(NUMBER, inner)]
        if name == "matrix" and len(v) == 6:
            m = tuple(v)
        elif name == "translate" and v:
            m = (1.0, 0.0, 0.0, 1.0, v[0], v[1] if len(v) > 1 else 0.0)
        elif name == "scale" and v:
            m = (v[0], 0.0, 0.0, v[1] if len(v) > 1 else v[0], 0.0, 0.0)
        elif name == "rotate" and v:
            c, t = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            m = (c, t, -t, c, 0.0, 0.0)
            if len(v) == 3:
                m = product(product((1.0, 0.0, 0.0, 1.0, v[1], v[2]), m), (1.0, 0.0, 0.0, 1.0, -v[1], -v[2]))
        elif name == "skewX" and v:
            m = (1.0, 0.0, math.tan(math.radians(v[0])), 1.0, 0.0, 0.0)
        elif name == "skewY" and v:
            m = (1.0, math.tan(math.radians(v[0])), 0.0, 1.0, 0.0, 0.0)
        else:
            raise SvgError(f"unknown transform {name!r}")
        out = product(out, m)
    return out


def arc(x0: float, y0: float, rx: float, ry: float, turn: float, large: bool, sweep: bool, x1: float, y1: float) -> list[Verb]:
    """Cubics, each of a quarter turn at most, from one end of an elliptical arc to the other; radii that don't reach grow."""
    rx, ry = abs(rx), abs(ry)
    if (x0, y0) == (x1, y1):
        return []
    if not rx or not ry:
        return [("L", [x1, y1])]
    c, t = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    # half the chord, in the ellipse's own axes and radii
    hx, hy = (c * (x0 - x1) + t * (y0 - y1)) / 2 / rx, (c * (y0 - y1) - t * (x0 - x1)) / 2 / ry
    half = math.hypot(hx, hy)
    if half > 1:
        rx, ry, hx, hy, half = rx * half, ry * half, hx / half, hy / half, 1.0
    rise = math.sqrt(max(0.0, 1 - half * half)) / half * (-1 if large == sweep else 1)
    ux, uy = rise * hy, -rise * hx  # the centre of the unit circle, from the middle of the chord
    first = math.atan2(hy - uy, hx - ux)
    span = math.atan2(-hy - uy, -hx - ux) - first
    if sweep and span < 0:
        span += 2 * math.pi
    if not sweep and span > 0:
        span -= 2 * math.pi
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2

    def out(x: float, y: float) -> tuple[float, float]:
        x, y = (x + ux) * rx, (y + uy) * ry
        return mx + c * x - t * y, my + t * x + c * y

    n = max(1, math.ceil(abs(span) / (math.pi / 2) - 1e-9))
    k = 4 / 3 * math.tan(span / n / 4)
    verbs: list[Verb] = []
    for i in range(n):
        a, b = first + span * i / n, first + span * (i + 1) / n
        p = out(math.cos(a) - k * math.sin(a), math.sin(a) + k * math.cos(a))
        q = out(math.cos(b) + k * math.sin(b), math.sin(b) - k * math.cos(b))
        verbs.append(("C", [*p, *q, *((x1, y1) if i + 1 == n else out(math.cos(b), math.sin(b)))]))
    return verbs


def verbs_of(d: str) -> list[Verb]:
    """Path data as absolute M, L, C, Q and Z."""
    words = re.findall(rf"[A-Za-z]|{NUMBER}", d)
    out: list[Verb] = []
    at, start, op, held, i, closed = (0.0, 0.0), (0.0, 0.0), "", None, 0, False
    need = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    while i < len(words):
        if words[i].isalpha():
            op = words[i]
            i += 1
        elif op.upper() == "M":
            op = "L" if op == "M" else "l"
        kind = op.upper()
        if kind not in need:
            raise SvgError(f"unknown path command {op!r}")
        if kind == "Z":
            if out:
                out.append(("Z", []))
                closed = True
            at, held = start, None
            if i < len(words) and not words[i].isalpha():
                raise SvgError("numbers after the end of a path")
            continue
        v = words[i : i + need[kind]]
        if len(v) < need[kind] or any(x.isalpha() for x in v):
            raise SvgError("path data is cut off")
        v = [float(x) for x in v]
        i += need[kind]
        ox, oy = at if op.islower() else (0.0, 0.0)
        end = (v[0] + ox, at[1]) if kind == "H" else (at[0], v[0] + oy) if kind == "V" else (v[-2] + ox, v[-1] + oy)
        if kind != "M" and not out:
            raise SvgError("path data starts without a move")
        if kind != "M" and closed:  # goes on after a closed part
            out.append(("M", [*at]))
        closed = False
        points = [(x + ox, y + oy) for x, y in zip(v[::2], v[1::2], strict=False)] if kind in "CSQT" else []
        mirror = (2 * at[0] - held[1][0], 2 * at[1] - held[1][1]) if held and held[0] == {"S": "C", "T": "Q"}.get(kind) else at
        if kind == "M":
            start = end
            out.append(("M", [*end]))
        elif kind in "CS":
            c = points if kind == "C" else [mirror, *points]
            out.append(("C", [x for p in c for x in p]))
            held = ("C", c[1])
        elif kind in "QT":
            q = points[0] if kind == "Q" else mirror
            out.append(("Q", [*q, *end]))
            held = ("Q", q)
        elif kind == "A":
            out += arc(*at, v[0], v[1], v[2], v[3] != 0, v[4] != 0, *end)
        else:
            out.append(("L", [*end]))
        if kind not in "CSQT":
            held = None
        at = end
    return out


def placed(verbs: list[Verb], m: Matrix) -> list[Verb]:
    return [(v, [x for a, b in zip(p[::2], p[1::2], strict=True) for x in moved(m, a, b)]) for v, p in verbs]


def points_of(verbs: list[Verb]) -> list[tuple[list[tuple[float, float]], bool]]:
    """(points, closed) of each part; curves become chords within half a place."""
    parts: list[tuple[list, bool]] = []
    for v, p in verbs:
        q = list(zip(p[::2], p[1::2], strict=True))
        if v == "M":
            parts.append((q, False))
        elif v == "Z":
            parts[-1] = parts[-1][0], True
        elif v == "L":
            parts[-1][0].extend(q)
        else:
            at = parts[-1][0][-1]
            if v == "Q":
                third = lambda a, b: (a[0] + (b[0] - a[0]) * 2 / 3, a[1] + (b[1] - a[1]) * 2 / 3)
                q = [third(at, q[0]), third(q[1], q[0]), q[1]]
            parts[-1][0].extend(cubic([at, *q])[1:])
    return parts


def outlines(d: str) -> list[tuple[list[tuple[float, float]], bool]]:
    """(points, closed) of each part of path data."""
    return points_of(verbs_of(d))


def _shape(e: ElementTree.Element, dpi: float) -> list[Verb]:
    """A shape's outline in its own units."""
    tag = e.tag.rpartition("}")[2]
    n = lambda k, d=0.0: _length(e.get(k), dpi, d)
    if tag == "path":
        return verbs_of(e.get("d", ""))
    if tag == "rect":
        x, y, w, h = (n(k) for k in ("x", "y", "width", "height"))
        rx, ry = n("rx", n("ry")), n("ry", n("rx"))
        rx, ry = min(max(rx, 0.0), w / 2), min(max(ry, 0.0), h / 2)
        if w <= 0 or h <= 0:
            return []
        if not rx or not ry:
            return [("M", [x, y]), ("L", [x + w, y]), ("L", [x + w, y + h]), ("L", [x, y + h]), ("Z", [])]
        out: list[Verb] = [("M", [x + rx, y])]
        for px, py, qx, qy in ((x + w - rx, y, x + w, y + ry), (x + w, y + h - ry, x + w - rx, y + h), (x + rx, y + h, x, y + h - ry), (x, y + ry, x + rx, y)):
            out += [("L", [px, py]), *arc(px, py, rx, ry, 0, False, True, qx, qy)]
        return [*out, ("Z", [])]
    if tag in ("circle", "ellipse"):
        cx, cy, rx, ry = n("cx"), n("cy"), n("r") if tag == "circle" else n("rx"), n("r") if tag == "circle" else n("ry")
        if rx <= 0 or ry <= 0:
            return []
        return [("M", [cx + rx, cy]), *arc(cx + rx, cy, rx, ry, 0, False, True, cx - rx, cy), *arc(cx - rx, cy, rx, ry, 0, False, True, cx + rx, cy), ("Z", [])]
    if tag == "line":
        return [("M", [n("x1"), n("y1")]), ("L", [n("x2"), n("y2")])]
    if tag in ("polyline", "polygon"):
        v = [float(x) for x in re.findall(NUMBER, e.get("points", ""))]
        q = list(zip(v[::2], v[1::2], strict=False))
        return [("M" if k == 0 else "L", [*p]) for k, p in enumerate(q)] + ([("Z", [])] if tag == "polygon" and q else [])
    return []


def _walk(e: ElementTree.Element, m: Matrix, style: dict[str, str], opacity: float, depth: int):
    """(shape, matrix, style, opacity) of all shapes below, in order."""
    if depth > MAX_DEPTH:
        raise SvgError("groups are nested too deep")
    for x in e:
        if not isinstance(x.tag, str):
            continue
        own = dict(p.split(":", 1) for p in x.get("style", "").replace(" ", "").split(";") if ":" in p)
        get = lambda k, d=None: own.get(k, x.get(k, d))  # noqa: B023, E731
        if get("display") == "none":
            continue
        at = product(m, transform(x.get("transform", "")))
        have = style | {k: get(k) for k in INHERITED if get(k) is not None}
        alpha = opacity * float(get("opacity", "1"))
        if x.tag.rpartition("}")[2] in ("g", "a"):
            yield from _walk(x, at, have, alpha, depth + 1)
        elif have.get("visibility") != "hidden":
            yield x, at, have, alpha


def _root(data: bytes, dpi: float) -> tuple[ElementTree.Element, tuple[int, int]]:
    if not (math.isfinite(dpi) and 0 < dpi <= 2400):
        raise SvgError("dpi must be positive and at most 2400")
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if b"<!ENTITY" in data:
        raise SvgError("entities are not read")
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise SvgError(str(e)) from e
    box = [float(x) for x in re.findall(r"[-+0-9.eE]+", root.get("viewBox", ""))]
    w, h = _length(root.get("width"), dpi, box[2] if len(box) == 4 else 0.0), _length(root.get("height"), dpi, box[3] if len(box) == 4 else 0.0)
    if round(w) <= 0 or round(h) <= 0:
        raise SvgError("the drawing has no size")
    return root, (round(w), round(h))


def _inks(style: dict[str, str], opacity: float, dpi: float, scale: float) -> dict:
    fill = colour(style.get("fill"), opacity * float(style.get("fill-opacity", "1")), (0.0, 0.0, 0.0, min(1.0, opacity)))
    stroke = colour(style.get("stroke"), opacity * float(style.get("stroke-opacity", "1")), CLEAR)
    return {"fill": fill, "stroke": stroke, "width": _length(style.get("stroke-width"), dpi, 1.0) * scale if stroke[3] else 0.0}


def curves(data: bytes, dpi: float = 96.0) -> tuple[tuple[int, int], list[dict]]:
    """((width, height), paths in order): verbs with all transforms applied, fill, stroke, width."""
    root, size = _root(data, dpi)
    out = []
    for e, m, style, opacity in _walk(root, UNIT, {}, 1.0, 0):
        verbs = placed(_shape(e, dpi), m)
        if len(verbs) > 1:
            out.append({"verbs": verbs} | _inks(style, opacity, dpi, math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))))
    return size, out


def parse(data: bytes, dpi: float = 96.0) -> tuple[tuple[int, int], list[dict]]:
    """((width, height), paths in order): vertices in whole places, closed, fill, stroke, width."""
    root, size = _root(data, dpi)
    out = []
    for e, m, style, opacity in _walk(root, UNIT, {}, 1.0, 0):
        tag = e.tag.rpartition("}")[2]
        n = lambda k, d=0.0: _length(e.get(k), dpi, d)  # noqa: B023, E731
        if m == UNIT and tag == "rect":
            x, y, rw, rh = (math.floor(n(k) + 0.5) for k in ("x", "y", "width", "height"))
            shapes = [(rounded_rectangle(x, y, rw, rh, n("rx")) if n("rx") > 0 else rectangle(x, y, rw, rh), True)] if rw > 0 and rh > 0 else []
        elif m == UNIT and tag in ("circle", "ellipse"):
            rx, ry = (n("r"), n("r")) if tag == "circle" else (n("rx"), n("ry"))
            shapes = [(ellipse(n("cx"), n("cy"), rx, ry), True)] if rx > 0 and ry > 0 else []
        else:
            shapes = [(_whole(p), c) for p, c in points_of(placed(_shape(e, dpi), m))]
        inks = _inks(style, opacity, dpi, math.sqrt(abs(m[0] * m[3] - m[1] * m[2])))
        out += [{"vertices": v, "closed": c} | inks for v, c in shapes if len(v) >= 2]
    return size, out
