"""Connected-region operators.

Candidates come from a filter; tiles are labelled by a kernel, and parts that touch across tile
borders are united in rounds, each kept in the shared folder, whose number grows with the logarithm of the parts. Places lie within 2^30 of the origin.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata.functions.blend import blend_pixel
from tilestrata.functions.color import limit, linear_distance_sq, perceptual_distance_sq
from tilestrata.operators.raster import RGBA, named, pixel
from tilestrata.operators.tiles import Rect, grid, read_rect, stored, tile_of
from tilestrata.scratch import settled


def _seed(px: DataFrame, x: int, y: int) -> list[float]:
    row = px.filter((F.col("x") == x) & (F.col("y") == y)).select(*RGBA).first()
    return [float(v) for v in row] if row else [0.0] * 4


def _lits(v: list[float]) -> list[Column]:
    return [F.lit(float(c)) for c in v]


def select_by_color(px: DataFrame, colour: list[float], tolerance: float, rect: Rect) -> DataFrame:
    """(x, y, cov) of all places of rect within the perceptual tolerance of a colour."""
    d = perceptual_distance_sq(pixel(), _lits(colour))
    return read_rect(px, rect).filter(d <= tolerance * tolerance).select("x", "y", F.lit(1.0).alias("cov"))


FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def labels(x: np.ndarray, y: np.ndarray, steps: tuple[tuple[int, int], ...] = FOUR) -> np.ndarray:
    """Labels of places, equal where steps connect them, by repeated minimum over neighbours."""
    x0, y0 = int(x.min()), int(y.min())
    on = np.zeros((int(y.max()) - y0 + 3, int(x.max()) - x0 + 3), bool)
    at = y - y0 + 1, x - x0 + 1
    on[at] = True
    label = np.where(on, np.arange(on.size).reshape(on.shape), on.size)
    while True:
        new = np.minimum.reduce([label, *(np.roll(label, s, (0, 1)) for s in steps)])
        new = np.where(on, new, on.size)
        flat = np.append(new.ravel(), on.size)
        new = np.where(on, flat[flat[new]], on.size)  # follow labels to theirs
        if (new == label).all():
            return label[at].astype(np.int64)
        label = new


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf[["x", "y"]].iloc[0]
    return pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "tx": int(first["x"]) >> 8, "ty": int(first["y"]) >> 8, "part": labels(pdf["x"].to_numpy(), pdf["y"].to_numpy())})


def united(links: DataFrame) -> DataFrame:
    """(u, v) of every node u but the roots: v is the smallest node that links (a, b) reach. Rounds grow with the logarithm of the nodes."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = settled(near.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges
        before = now


def component_of(places: DataFrame, x: int, y: int) -> DataFrame:
    """Of places (x, y), those four-connected with (x, y): parts within tiles by a kernel, then the parts that touch across tiles united."""
    part = (F.col("tx").cast("long") + (1 << 22)) * (1 << 40) + (F.col("ty").cast("long") + (1 << 22)) * (1 << 17) + F.col("part")
    tiled = places.select("x", "y").groupBy(tile_of(F.col("x")), tile_of(F.col("y"))).applyInPandas(_label_tile, "x int, y int, tx int, ty int, part long")
    tiled = settled(tiled.select("x", "y", part.alias("id")))
    seed = tiled.filter((F.col("x") == x) & (F.col("y") == y)).select("id").first()
    if seed is None:
        return tiled.limit(0).select("x", "y")
    edge = tiled.filter("(x & 255) in (0, 255) or (y & 255) in (0, 255)")
    step = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    near = edge.withColumn("s", F.explode(step)).select(F.col("id").alias("a"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    roots = united(near.join(edge.withColumnRenamed("id", "b"), ["x", "y"]).filter("a <> b").select("a", "b"))
    own = roots.filter(F.col("u") == seed["id"]).select("v").first()
    root = own["v"] if own else seed["id"]
    return tiled.join(roots.filter(F.col("v") == root).select(F.col("u").alias("id")), "id", "left_semi").unionByName(tiled.filter(F.col("id") == root)).select("x", "y")


def magic_wand(px: DataFrame, x: int, y: int, tolerance: float, rect: Rect, contiguous: bool = True, radius: int | None = None) -> DataFrame:
    """(x, y, cov): places like the seed's colour, by perceptual distance, connected with it and within radius."""
    if not (rect.x <= x < rect.right and rect.y <= y < rect.bottom):
        return select_by_color(px, [0.0] * 4, -1.0, rect).limit(0)
    if radius is not None:  # no place beyond the circle's box can be like the seed
        rect = rect.intersect(Rect(x, y, 1, 1).expand(abs(radius)))
    like = select_by_color(px, _seed(px, x, y), max(0.0, tolerance), rect)
    if radius is not None:
        dx, dy = F.col("x").cast("long") - x, F.col("y").cast("long") - y
        like = like.filter(dx * dx + dy * dy <= radius * radius)
    return component_of(like, x, y).withColumn("cov", F.lit(1.0)) if contiguous else like


def region_grow(px: DataFrame, x: int, y: int, tolerance: float, rect: Rect, radius: int | None) -> DataFrame:
    return magic_wand(px, x, y, tolerance, rect, True, radius)


def quick_select(px: DataFrame, seeds: list[tuple[int, int]], tolerance: float, rect: Rect, radius: int) -> DataFrame:
    """Union of the regions grown from all seeds."""
    out = None
    for x, y in seeds:
        own = region_grow(px, x, y, tolerance, rect, radius)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def bucket_fill(px: DataFrame, x: int, y: int, colour: tuple[float, ...], tolerance: float, canvas: Rect, sel: DataFrame | None = None) -> DataFrame:
    """Edits of a fill by linear RGBA distance; the outer half of the tolerance fades, and only selected places are passed."""
    seed, tol = _lits(_seed(px, x, y)), max(0.0, tolerance)
    dense = read_rect(px, canvas)
    dense = dense.withColumn("cov", F.lit(1.0)) if sel is None else dense.join(sel.filter("cov > 0"), ["x", "y"])
    dense = dense.withColumn("d", linear_distance_sq(pixel(), seed)).filter(F.col("d") <= tol * tol)
    inner = tol * 0.5
    fade = F.when(F.sqrt("d") <= inner, 1.0).otherwise(limit((tol - F.sqrt("d")) / (tol - inner))) if tol > 0 else F.lit(1.0)
    hit = dense.join(component_of(dense, x, y), ["x", "y"]).withColumn("cov", fade * F.col("cov")).filter("cov > 0")
    return hit.select("x", "y", *named(blend_pixel("normal", pixel(), _lits(list(colour)), F.col("cov"))))


def border(px: DataFrame, rect: Rect) -> DataFrame:
    """Dense pixels of a rectangle's border with the number of border lines they lie on (corners count twice)."""
    inner = rect.shrink(1)
    dense = read_rect(px, rect)
    dense = dense if inner.empty else dense.filter(~inner.contains())
    lines = [F.col("x") == rect.x, F.col("x") == rect.right - 1, F.col("y") == rect.y, F.col("y") == rect.bottom - 1]
    return dense.withColumn("n", sum((c.cast("int") for c in lines), F.lit(0)))


def _mean(n: Column) -> list[Column]:
    """Weighted means of r, g and b; black where nothing is left."""
    return [F.coalesce(F.sum(F.col(c) * n) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)).alias("m" + c) for c in "rgb"]


def _apart(names: str, colour: list[Column]) -> Column:
    return sum(((F.col(c) - m) * (F.col(c) - m) for c, m in zip(names, colour, strict=True)), F.lit(0.0))


def detect_solid(px: DataFrame, rect: Rect, tolerance: float = 0.2, share: float = 0.9, rounds: int = 4) -> DataFrame:
    """One row (r, g, b, covered, solid): the border's mean colour, trimmed in rounds to what lies within tolerance (linear RGB)."""
    edge = border(px, rect).select("r", "g", "b", "n")
    dist = _apart("rgb", [F.col("m" + c) for c in "rgb"])
    mean = edge.agg(*_mean(F.col("n")))
    for _ in range(rounds):  # one-row means meet every border pixel
        mean = edge.join(F.broadcast(mean)).agg(*_mean(F.when(dist <= tolerance * tolerance, F.col("n")).otherwise(0)))
    near = F.sum(F.when(dist <= tolerance * tolerance, F.col("n")).otherwise(0))
    out = edge.join(F.broadcast(mean)).agg(*[F.max("m" + c).alias(c) for c in "rgb"], (near / F.sum("n")).alias("covered"))
    return out.withColumn("solid", F.coalesce(F.col("covered") >= share, F.lit(False)))


def two_means(rows: DataFrame, rounds: int = 8, weight: str | None = None) -> DataFrame:
    """Two mean colours (k, r, g, b, n) of rows (r, g, b): starts at the least and the greatest r + g + b, ties go to cluster 0;
    a cluster that loses all its rows keeps its colour, with n = 0."""
    n = F.col(weight) if weight else F.lit(1)
    rows = rows.select("r", "g", "b", n.cast("long").alias("n"))
    p, key = F.struct("r", "g", "b"), F.struct(F.col("r") + F.col("g") + F.col("b"), "r", "g", "b")
    ends = rows.agg(F.min_by(p, key).alias("c0"), F.max_by(p, key).alias("c1")).first()
    if not ends["c0"]:
        return rows.limit(0).select(F.lit(0).alias("k"), "r", "g", "b", "n")
    centre = [[*ends["c0"], 0], [*ends["c1"], 0]]
    for _ in range(rounds):
        d = [_apart("rgb", [F.lit(v) for v in m[:3]]) for m in centre]
        own = rows.withColumn("k", F.when(d[0] <= d[1], 0).otherwise(1))
        got = own.groupBy("k").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"], F.sum("n").alias("n"))
        centre = [[*c[:3], 0] for c in centre]
        for r in got.collect():  # two rows
            centre[r["k"]] = [r["r"], r["g"], r["b"], r["n"]]
    return rows.sparkSession.createDataFrame([(k, *c) for k, c in enumerate(centre)], "k int, r double, g double, b double, n long")


def detect_checker(px: DataFrame, rect: Rect, tolerance: float = 0.2, share: float = 0.95) -> dict | None:
    """Colours (even, odd), cell size and origin of a checkerboard along the border, or None. Border lines and counts only reach the driver as one row each."""
    edge = border(px, rect).cache()
    try:
        c = [[r["r"], r["g"], r["b"]] for r in two_means(edge, weight="n").orderBy("k").collect()]
        if len(c) < 2 or sum((a - b) ** 2 for a, b in zip(*c, strict=True)) <= tolerance * tolerance:
            return None
        kind = F.when(_apart("rgb", [F.lit(v) for v in c[0]]) <= _apart("rgb", [F.lit(v) for v in c[1]]), 0).otherwise(1)
        lines = edge.filter(F.col("y") == rect.y).select(F.lit("x").alias("line"), F.col("x").alias("at"), kind.alias("kind"))
        lines = lines.unionByName(edge.filter(F.col("x") == rect.x).select(F.lit("y").alias("line"), F.col("y").alias("at"), kind.alias("kind")))
        turns = transitions(lines)
        first = {r["line"]: r["at"] for r in turns.groupBy("line").agg(F.min("at").alias("at")).collect()}
        gaps = turns.filter("gap is not null").groupBy("gap").count().agg(F.max_by("gap", F.struct("count", -F.col("gap"))).alias("gap")).first()["gap"]
        if gaps is None or len(first) < 2:
            return None
        even = _even(first["x"], first["y"], gaps)
        votes = edge.agg(F.sum(F.when(even == (kind == 0), F.col("n")).otherwise(-F.col("n"))).alias("v")).first()["v"]
        key = {"even": tuple(c[0] if votes >= 0 else c[1]), "odd": tuple(c[1] if votes >= 0 else c[0]), "cell": int(gaps), "x": first["x"], "y": first["y"]}
        ok = edge.agg((F.sum(F.when(_apart("rgb", key_colour(key)) <= tolerance * tolerance, F.col("n")).otherwise(0)) / F.sum("n")).alias("s")).first()["s"]
        return key if ok >= share else None
    finally:
        edge.unpersist()


def transitions(lines: DataFrame) -> DataFrame:
    """(line, at, gap) where kind differs from the place before on the line; gap: how far the change before lies."""
    w = Window.partitionBy("line").orderBy("at")
    turns = lines.withColumn("before", F.lag("kind").over(w)).filter("before <> kind").select("line", "at")
    return turns.withColumn("gap", F.col("at") - F.lag("at").over(w))


def _even(x: int, y: int, cell: int) -> Column:
    return F.pmod(F.floor((F.col("x") - x) / cell) + F.floor((F.col("y") - y) / cell), F.lit(2)) == 0


def key_colour(key: dict | tuple[float, ...]) -> list[Column]:
    """The matte's colour at (x, y): a solid one or a checkerboard's."""
    if isinstance(key, tuple):
        return [F.lit(float(v)) for v in key[:3]]
    return [F.when(_even(key["x"], key["y"], key["cell"]), float(a)).otherwise(float(b)) for a, b in zip(key["even"], key["odd"], strict=True)]


def unmix(px: list[Column], matte: tuple[float, ...], lo: float, hi: float) -> list[Column]:
    """Colour to alpha: coverage ramps with the distance from the matte, and the matte's share is taken out."""
    d = F.sqrt(sum(((c - m) * (c - m) for c, m in zip(px[:3], matte, strict=True)), F.lit(0.0)))
    cov = limit((d - lo) / max(hi - lo, 1e-6))
    out = [F.when(cov > 0, limit((c - m * (1.0 - cov)) / F.nullif(cov, F.lit(0.0)))).otherwise(0.0) for c, m in zip(px[:3], matte, strict=True)]
    return [*out, px[3] * cov]


def unmix_key(px: list[Column], key: list[Column]) -> list[Column]:
    """The pixel that gives px over the key's colour: the largest share that any channel needs; what the key can't explain stays."""

    def share(p: Column, k: Column) -> Column:
        return F.when((p < k) & (k > 0), (k - p) / F.nullif(k, F.lit(0.0))).when((p > k) & (k < 1), (p - k) / F.nullif(1.0 - k, F.lit(0.0))).otherwise(0.0)

    a = limit(F.greatest(*[share(p, k) for p, k in zip(px[:3], key, strict=True)]))
    far = sum(((p - k) * (p - k) for p, k in zip(px[:3], key, strict=True)), F.lit(0.0)) > EPSILON
    out = [F.when(a > 0, (p - k) / F.nullif(a, F.lit(0.0)) + k) for p, k in zip(px[:3], key, strict=True)]
    return [*[o.otherwise(F.when(far, p).otherwise(0.0)) for o, p in zip(out, px[:3], strict=True)], F.when(a > 0, px[3] * a).otherwise(F.when(far, px[3]).otherwise(0.0))]


#: Fixed values of matte removal.
SPECK, SPECK_TOLERANCE, OPAQUE, RAMP, EPSILON = 64, 1.6, 1.0 - 1e-4, 0.05, 1.1920929e-07


def specks(candidates: DataFrame, region: DataFrame, most: int = SPECK) -> DataFrame:
    """(x, y) of the eight-connected parts of candidates with at most `most` + 1 places that touch the region.

    Such a part reaches at most that far, so each tile decides with a halo of that width; a part cut off by the halo is too large anyway.
    """
    halo = most + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[~pdf["cleared"]].reset_index(drop=True)
        if not len(mine):
            return pd.DataFrame({"x": [], "y": []})
        x, y = mine["x"].to_numpy(), mine["y"].to_numpy()
        part = pd.factorize(labels(x, y, EIGHT))[0]
        size = np.bincount(part)
        there = pdf.loc[pdf["cleared"], ["x", "y"]].to_numpy().astype(np.int64)
        keys = np.unique(there[:, 0] * (1 << 32) + there[:, 1])
        beside = np.zeros(len(size), bool)
        for dx, dy in EIGHT:
            near = (x.astype(np.int64) + dx) * (1 << 32) + y + dy
            beside[part[np.isin(near, keys)]] = True
        return mine.loc[(size[part] <= most + 1) & beside[part] & mine["core"].to_numpy(), ["x", "y"]]

    near = lambda c: F.explode(F.array_distinct(F.array(*[tile_of(F.col(c) + d) for d in (-halo, 0, halo)])))
    rows = candidates.select("x", "y", F.lit(False).alias("cleared")).unionByName(region.select("x", "y", F.lit(True).alias("cleared")))
    rows = rows.withColumn("tx", near("x")).withColumn("ty", near("y"))
    rows = rows.withColumn("core", (F.col("tx") == tile_of(F.col("x"))) & (F.col("ty") == tile_of(F.col("y"))))
    return rows.groupBy("tx", "ty").applyInPandas(run, "x int, y int")


def flooded(places: DataFrame, rect: Rect) -> DataFrame:
    """Of places inside rect, those four-connected with its border."""
    outside = rect.expand(1)
    ring = grid(places.sparkSession, outside).filter(~rect.contains())
    return component_of(places.select("x", "y").unionByName(ring), outside.x, outside.y).filter(rect.contains())


def _steps(places: DataFrame, steps: tuple[tuple[int, int], ...] = FOUR) -> DataFrame:
    """Places one step away."""
    s = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    return places.select("x", "y", F.explode(s).alias("s")).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).distinct()


def remove_matte(px: DataFrame, rect: Rect, tolerance: float = 0.2, softness: float = 0.55, enclosed: bool = False) -> DataFrame:
    """px without its matte, a solid or checkered background found along rect's border (px's bounds); raises ValueError where none is found.

    The matte floods in from the border through pixels within tolerance (with `enclosed`, from everywhere); small parts of nearly its
    colour that touch it go too. Pixels on the way from matte to subject, up to 1 + round(2 softness) steps deep, and the
    flood's own soft rim are unmixed from the matte's colour; all others stay as they are.
    """
    found = detect_solid(px, rect, tolerance).first()
    key = tuple(found[c] for c in "rgb") if found["solid"] else detect_checker(px, rect, tolerance)
    if key is None:
        raise ValueError("no solid or checkered background on the border")
    k = key_colour(key)
    dense = settled(read_rect(px, rect).withColumn("d", _apart("rgb", k)))
    opaque = F.col("a") >= OPAQUE
    like = dense.filter(opaque & (F.col("d") <= tolerance * tolerance)).select("x", "y")
    region = settled(like if enclosed else flooded(like, rect))
    rest = dense.join(region, ["x", "y"], "left_anti")
    cleared = settled(region.unionByName(specks(rest.filter(opaque & (F.col("d") <= (SPECK_TOLERANCE * tolerance) ** 2)), region)))
    subject = dense.join(cleared, ["x", "y"], "left_anti")
    solid = subject.filter(opaque).select("x", "y", "d")
    s = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in FOUR])
    highest = solid.select("x", "y", "d", F.explode(s).alias("s")).groupBy((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).agg(F.max("d").alias("top"))
    ramp = settled(solid.join(highest, ["x", "y"]).filter(F.col("top") > F.col("d") + RAMP).select("x", "y"))
    fringe = frontier = ramp.join(_steps(cleared), ["x", "y"], "left_semi")
    for _ in range(math.floor(2.0 * max(0.0, softness) + 0.5)):  # a bounded number of rounds
        frontier = settled(_steps(frontier).join(ramp, ["x", "y"], "left_semi").join(fringe, ["x", "y"], "left_anti"))
        fringe = fringe.unionByName(frontier)
    rim = cleared.join(_steps(subject.select("x", "y")), ["x", "y"], "left_semi").withColumn("soft", F.lit(True))
    rim = dense.join(rim, ["x", "y"]).filter(F.col("d") > tolerance * tolerance).select("x", "y")
    soft = fringe.unionByName(rim).withColumn("soft", F.lit(True))
    out = px.select("x", "y", *RGBA).join(cleared.join(rim, ["x", "y"], "left_anti"), ["x", "y"], "left_anti").join(soft, ["x", "y"], "left")
    new = unmix_key(pixel(), k)
    return stored(out.select("x", "y", *[F.when(F.col("soft"), n).otherwise(o).alias(c) for c, n, o in zip(RGBA, new, pixel(), strict=True)]))
