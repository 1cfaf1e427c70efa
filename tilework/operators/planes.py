"""Planes: one row a tile, its pixels an array row by row. Large mosaics stay many rows; a plane is as large as a camera's image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of parameters is broadcast; larger ones are joined by shuffle.
PARAMETER_ROWS = 100_000


def planes_of(px: DataFrame, keys: list[str], y: str = "y", x: str = "x", v: str = "v") -> DataFrame:
    """keys, h, w, v (array<float>) of pixels; every plane is a full rectangle that starts at 0, 0."""
    rows = px.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.col(v).cast("float").alias("v")))).alias("p"))
    size = [(F.col("p")[F.size("p") - 1][c] + 1).cast("int").alias(n) for c, n in (("y", "h"), ("x", "w"))]
    return rows.select(*keys, *size, F.transform("p", lambda e: e["v"]).alias("v"))


def with_parameters(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a table of parameters: broadcast if it is counted to be small, else by shuffle."""
    small = right.limit(PARAMETER_ROWS + 1).count() <= PARAMETER_ROWS
    return left.join(F.broadcast(right) if small else right, on, "left")


def image(v, h: int, w: int) -> np.ndarray:
    return np.asarray(v, np.float64).reshape(int(h), int(w))


def box_mean(plane: np.ndarray, k: int) -> np.ndarray:
    """Means over 2k x 2k windows at offsets -(k - 1)..k, the border repeated."""
    if k < 1:
        return plane.astype(float)
    out = np.pad(plane.astype(float), k, mode="edge")
    for axis in (0, 1):
        total = np.insert(np.cumsum(out, axis=axis), 0, 0.0, axis=axis)
        n = plane.shape[axis]
        out = np.take(total, np.arange(2 * k + 1, 2 * k + 1 + n), axis) - np.take(total, np.arange(1, n + 1), axis)
    return out / (4 * k * k)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation; 0 for planes without contrast."""
    a, b = a - a.mean(), b - b.mean()
    size = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / size) if size > 1e-9 else 0.0


def stretched(field: np.ndarray, h: int, w: int) -> np.ndarray:
    """A coarse field at h x w points: corners on corners, linear between."""
    def along(values: np.ndarray, n: int) -> np.ndarray:
        at = np.linspace(0, len(values) - 1, n)
        low = np.minimum(at.astype(int), max(0, len(values) - 2))
        part = (at - low)[:, None]
        return values[low] * (1 - part) + values[np.minimum(low + 1, len(values) - 1)] * part

    return along(along(field, h).T, w).T


def sampled(plane: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Bilinear samples at ys x xs, the border repeated outside."""
    def ends(at: np.ndarray, n: int):
        at = np.clip(at, 0, n - 1)
        low = np.clip(np.floor(at).astype(int), 0, max(0, n - 2))
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = ends(ys, plane.shape[0])
    x0, x1, fx = ends(xs, plane.shape[1])
    rows = plane[y0] * (1 - fy)[:, None] + plane[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def exploded(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels keys, gy, gx, v of blocks(keys, gy0, gx0, w, v: array)."""
    at: Column = F.col("at")
    return blocks.select(*keys, "gy0", "gx0", "w", F.posexplode("v").alias("at", "v")).select(*keys, (F.col("gy0") + F.floor(at / F.col("w"))).cast("int").alias("gy"), (F.col("gx0") + at % F.col("w")).cast("int").alias("gx"), "v")


def frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.strip().split(" ")[0] for f in schema.split(", ")])
