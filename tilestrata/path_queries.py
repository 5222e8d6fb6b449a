"""Queries over curved paths and strokes made of all events' places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata import fixtures as fx
from tilestrata import queries as base
from tilestrata.operators import arclength, coverage
from tilestrata.oracles import R, w

Query = Callable[[SparkSession, str], DataFrame]
TOLERANCE, STEP = 0.05, 2.5


def outlines(s: SparkSession, d: str) -> DataFrame:
    """A closed smooth outline through all samples of a stroke, at a quarter of their places."""
    samples = fx.strokes(s, d).withColumns({"px": F.col("px") / 4.0, "py": F.col("py") / 4.0})
    drawn = arclength.curves(samples)
    verb = lambda v, *p: F.struct(F.lit(v).alias("v"), F.array(*[F.col(c) for c in p]).alias("p"))
    rows = drawn.select("stroke_id", "seq", verb("C", "x1", "y1", "x2", "y2", "x3", "y3").alias("s")).unionByName(samples.filter("seq = 1").select("stroke_id", F.lit(0).alias("seq"), verb("M", "px", "py").alias("s")))
    verbs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda e: e["s"])
    end = F.array(F.struct(F.lit("Z").alias("v"), F.array().cast("array<double>").alias("p")))
    return rows.groupBy(F.col("stroke_id").alias("path")).agg(F.concat(verbs, end).alias("verbs"))


def _ink(s: SparkSession, d: str) -> DataFrame:
    colour = lambda r, g, b, a: F.struct(*[F.lit(v).alias(c) for v, c in zip((r, g, b, a), "rgba", strict=True)])
    paths = outlines(s, d).withColumns({"fill": colour(0.2, 0.4, 0.6, 1.0), "stroke": colour(0.9, 0.1, 0.3, 1.0), "width": F.lit(0.5) + (F.col("path") % 3)})
    return coverage.rasterize(paths, TOLERANCE, join="round", cap="round").select("path", "x", "y", *[base.rounded(F.col(c)).alias(c) for c in "rgba"])


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["path_coverage"] = lambda s, d: coverage.coverage(coverage.fill_edges(outlines(s, d), TOLERANCE)).select("path", "x", "y", base.rounded(F.col("cov")).alias("cov"))
    q["pen_selection"] = lambda s, d: coverage.selection(outlines(s, d), TOLERANCE).select("x", "y", base.rounded(F.col("cov")).alias("cov"))
    q["path_ink"] = _ink
    q["stroke_resampled"] = lambda s, d: arclength.resampled(fx.strokes(s, d), STEP).select("stroke_id", "seq", "i", *[base.rounded(F.col(c)).alias(c) for c in ("x", "y", "pressure")])
    q["stroke_even"] = lambda s, d: arclength.even(fx.strokes(s, d).withColumnsRenamed({"px": "x", "py": "y"}), STEP).select("stroke_id", "n", *[base.rounded(F.col(c)).alias(c) for c in "xy"])
    return q


def _curves_sql(samples: str) -> str:
    """CTE cv: the cubics of samples (stroke_id, seq, px, py, pressure)."""
    over = "(PARTITION BY stroke_id ORDER BY seq)"
    near = f"SELECT stroke_id, seq, pressure AS p0, lead(pressure) OVER {over} AS p1, " + ", ".join(f"{c} AS {a}0, lead({c}) OVER {over} AS {a}3, lag({c}) OVER {over} AS {a}b, lead({c}, 2) OVER {over} AS {a}n" for a, c in (("x", "px"), ("y", "py"))) + f" FROM {samples}"
    bend = ", ".join(f"{a}0 + ({a}3 - coalesce({a}b, 2 * {a}0 - {a}3)) / 6.0 AS {a}1, {a}3 - (coalesce({a}n, 2 * {a}3 - {a}0) - {a}0) / 6.0 AS {a}2" for a in "xy")
    return f"cv AS (SELECT *, {bend} FROM ({near}) WHERE x3 IS NOT NULL)"


def _at(t: str, a: str) -> str:
    return f"(pow(1 - {t}, 3) * {a}0 + 3 * pow(1 - {t}, 2) * {t} * {a}1 + 3 * (1 - {t}) * {t} * {t} * {a}2 + pow({t}, 3) * {a}3)"


_BEND = "greatest(sqrt(pow(x0 - 2 * x1 + x2, 2) + pow(y0 - 2 * y1 + y2, 2)), sqrt(pow(x1 - 2 * x2 + x3, 2) + pow(y1 - 2 * y2 + y3, 2)))"
OUTLINE_SQL = [
    f"st AS (SELECT stroke_id, seq, px / 4.0 AS px, py / 4.0 AS py, pressure FROM ({fx.STROKES_SQL}))",
    _curves_sql("st"),
    "ch AS (SELECT stroke_id AS path, " + ", ".join(f"{_at(t, a)} AS {n}" for n, t, a in (("ax", "(k / n)", "x"), ("ay", "(k / n)", "y"), ("bx", "((k + 1) / n)", "x"), ("by2", "((k + 1) / n)", "y")))
    + f" FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT)))::DOUBLE AS k FROM (SELECT *, greatest(ceil(sqrt({_BEND} * {0.75 / TOLERANCE}) - 1e-9), 1.0) AS n FROM cv)))",
    "cl AS (SELECT stroke_id AS path, arg_max(px, seq) AS ax, arg_max(py, seq) AS ay, arg_min(px, seq) AS bx, arg_min(py, seq) AS by2 FROM st GROUP BY 1)",
    "ed AS (SELECT path, ax, ay, bx, by2 FROM ch UNION ALL SELECT * FROM cl)",
    "rw AS (SELECT *, CAST(y AS INT) AS yy, greatest(least(ay, by2), y) AS lo, least(greatest(ay, by2), y + 1) AS hi FROM (SELECT *, unnest(range(CAST(floor(least(ay, by2)) AS BIGINT), CAST(ceil(greatest(ay, by2)) AS BIGINT))) AS y FROM ed WHERE ay <> by2))",
    "bb AS (SELECT path, CAST(floor(min(least(ax, bx))) AS BIGINT) AS x0, CAST(ceil(max(greatest(ax, bx))) AS BIGINT) AS x1 FROM ed GROUP BY 1)",
    "uv AS (SELECT path, x, yy, sign(by2 - ay) * (hi - lo) AS h, x + 1 - (ax + (lo - ay) * (bx - ax) / (by2 - ay)) AS u, x + 1 - (ax + (hi - ay) * (bx - ax) / (by2 - ay)) AS v FROM rw JOIN bb USING (path), LATERAL (SELECT unnest(range(x0, x1)) AS x))",
    "ar AS (SELECT path, x, yy AS y, abs(sum(h * CASE WHEN abs(u - v) < 1e-9 THEN least(greatest(u, 0.0), 1.0) ELSE (CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN u - 0.5 ELSE u * u / 2 END - CASE WHEN v <= 0 THEN 0 WHEN v >= 1 THEN v - 0.5 ELSE v * v / 2 END) / (u - v) END)) AS c FROM uv GROUP BY 1, 2, 3)",
]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["path_coverage"] = w(*OUTLINE_SQL) + f"SELECT path, CAST(x AS INT) AS x, y, {R('least(c, 1.0)', 'cov')} FROM ar WHERE c > 1e-9"
    q["pen_selection"] = w(*OUTLINE_SQL) + f"SELECT CAST(x AS INT) AS x, y, {R('max(e)', 'cov')} FROM (SELECT *, 1 - abs(1 - (c - 2 * floor(c / 2))) AS e FROM ar JOIN (SELECT path FROM (SELECT stroke_id AS path, count(*) AS n FROM st GROUP BY 1) WHERE n >= 3) USING (path)) WHERE e > 1e-9 GROUP BY 1, 2"
    d = {a: f"(3 * pow(1 - t, 2) * ({a}1 - {a}0) + 6 * (1 - t) * t * ({a}2 - {a}1) + 3 * t * t * ({a}3 - {a}2))" for a in "xy"}
    nodes = ", ".join(f"({t!r}::DOUBLE, {k!r}::DOUBLE)" for t, k in zip(arclength.NODES, arclength.WEIGHTS, strict=True))
    q["stroke_resampled"] = (
        w(f"s0 AS ({fx.STROKES_SQL})", _curves_sql("s0"), f"ln AS (SELECT stroke_id, seq, sum(wt * sqrt(pow({d['x']}, 2) + pow({d['y']}, 2))) AS len FROM cv, (VALUES {nodes}) q(t, wt) GROUP BY 1, 2)")
        + f"SELECT stroke_id, seq, CAST(i AS INT) AS i, {R(_at('(i / n)', 'x'), 'x')}, {R(_at('(i / n)', 'y'), 'y')}, {R('p0 + (p1 - p0) * i / n', 'pressure')} FROM (SELECT *, unnest(range(CASE WHEN rn = 1 THEN 0 ELSE 1 END, CAST(n AS BIGINT) + 1))::DOUBLE AS i FROM (SELECT cv.*, greatest(ceil(len / {STEP} - 1e-6), 1.0) AS n, row_number() OVER (PARTITION BY stroke_id ORDER BY seq) AS rn FROM cv JOIN ln USING (stroke_id, seq) WHERE len > 0))"
    )
    over = "(PARTITION BY stroke_id ORDER BY seq)"
    q["stroke_even"] = (
        w(f"s0 AS ({fx.STROKES_SQL})", f"nx AS (SELECT *, lead(px) OVER {over} AS bx, lead(py) OVER {over} AS by2 FROM s0)", "ln AS (SELECT *, coalesce(sqrt(pow(bx - px, 2) + pow(by2 - py, 2)), 0.0) AS len FROM nx)", "cu AS (SELECT *, sum(len) OVER (PARTITION BY stroke_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM ln)")
        + f"SELECT stroke_id, n, {R(f'px + (bx - px) * (n * {STEP} - (upto - len)) / len', 'x')}, {R(f'py + (by2 - py) * (n * {STEP} - (upto - len)) / len', 'y')} FROM (SELECT *, unnest(range(CAST(ceil((upto - len) / {STEP} - 1e-9) AS BIGINT), CAST(ceil(upto / {STEP} - 1e-9) AS BIGINT))) AS n FROM cu WHERE len > 0)"
    )
    return q
