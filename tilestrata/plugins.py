"""User code: tile filters, batch scripts, and their discovery."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestrata.operators.raster import RGBA
from tilestrata.operators.tiles import TILE, tile_of
from tilestrata.plans.history import Command, batch

MANIFEST_BYTES = 64 << 10
TileFilter = Callable[[np.ndarray, dict], np.ndarray]

_filters: dict[str, TileFilter] = {}


def register(name: str, f: TileFilter) -> None:
    """f gets a (256, 256, 4) array and parameters, and returns one of the same shape."""
    _filters[name] = f


def apply_tile_filter(px: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    """px through a registered filter, tile by tile and without a halo; a result of another shape raises."""
    f, params = _filters[name], params or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["x"].iloc[0]) >> 8 << 8, int(pdf["y"].iloc[0]) >> 8 << 8
        tile = np.zeros((TILE, TILE, 4))
        tile[pdf["y"] - y0, pdf["x"] - x0] = pdf[list(RGBA)]
        out = np.asarray(f(tile, params))
        if out.shape != tile.shape:
            raise ValueError(f"filter {name} returned shape {out.shape}")
        y, x = np.nonzero((out != 0).any(axis=2))
        return pd.DataFrame({"x": (x + x0).astype(np.int32), "y": (y + y0).astype(np.int32)} | {c: out[y, x, i] for i, c in enumerate(RGBA)})

    return px.select("x", "y", *RGBA).groupBy(tile_of(F.col("x")), tile_of(F.col("y"))).applyInPandas(run, "x int, y int, r double, g double, b double, a double")


def script(name: str, steps: list[Command]) -> Command:
    """A script's commands as one entry of the log: all apply or none."""
    return batch(name, steps)


@dataclass(frozen=True)
class PluginInfo:
    name: str
    version: str
    kind: str
    entry: str
    error: str | None = None


def discover(folder: str) -> list[PluginInfo]:
    """Plug-ins of a folder by directory name; broken ones are reported with their error."""
    out = []
    for d in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
        try:
            f = d / "plugin.toml"
            if f.stat().st_size > MANIFEST_BYTES:
                raise ValueError("the manifest is too long")
            m = tomllib.loads(f.read_text())
            entry = (d / m["entry"]).resolve()
            if not entry.is_relative_to(d.resolve()) or not entry.is_file():
                raise ValueError("the entry is no file of the plug-in")
            out.append(PluginInfo(m["name"], m["version"], m["kind"], str(entry)))
        except (OSError, ValueError, KeyError) as e:
            out.append(PluginInfo(d.name, "", "", "", str(e)))
    return out
