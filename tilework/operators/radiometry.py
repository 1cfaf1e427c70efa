"""Brightness corrections between overlapping tiles: robust line fits an edge, gates, and a model a mosaic.

Fits run many edges at once; the graph solve runs a mosaic a group. A mosaic gets gains and offsets if enough edges pass the gates
of the line fit, else offsets alone if enough pass those of the offset, else nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.operators import graph
from tilework.operators.tables import settled

ROUNDS = 6
#: Samples that are fitted at once.
BATCH = 1 << 19
FALLING = "non-positive overlap covariance"
# The gates, in the order they are tried.
GATES = {"samples": 1024, "saturation": 0.05, "dynamic": 0.012, "signal": 0.05, "correlation": 0.72, "inlier": 0.60, "slope": (0.80, 1.25), "intercept": 0.05}
FIT = "mosaic int, a long, b long, n long, slope double, intercept double, correlation double, inlier double, offset double, mad double, reason string"


def weighted_tls(y: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[float, float, float, float]:
    """(slope, intercept, correlation, inlier share) of the orthogonal line y = slope * x + intercept, reweighted by Huber's
    rule around the median residual. Points that do not rise together raise an error."""
    found, rising = weighted_lines(np.asarray(y, float)[None], np.asarray(x, float)[None], rounds)
    if not rising[0]:
        raise ValueError(FALLING)
    return tuple(map(float, found[0]))


def weighted_lines(y: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """weighted_tls of each row of y and x: its four numbers, and whether the points of the row rise together."""
    out, rising = np.zeros((len(x), 4)), np.ones(len(x), bool)
    rows, w = np.arange(len(x)), np.ones(x.shape)
    for _ in range(rounds):
        total = w.sum(axis=1)
        dx, dy = (v - ((v * w).sum(axis=1) / total)[:, None] for v in (x, y))
        xx, xy, yy = ((w * p * q).sum(axis=1) / total for p, q in ((dx, dx), (dx, dy), (dy, dy)))
        good = xy > 1e-12
        if not good.all():
            rising[rows[~good]] = False
            rows, x, y, xx, xy, yy = (v[good] for v in (rows, x, y, xx, xy, yy))
        if not len(rows):
            return out, rising
        direction = np.linalg.eigh(np.stack([xx, xy, xy, yy], axis=1).reshape(-1, 2, 2))[1][:, :, 1]  # the axis of the larger variance
        slope = direction[:, 1] / direction[:, 0]
        rest = y - slope[:, None] * x
        intercept = np.median(rest, axis=1)
        off = (rest - intercept[:, None]) / np.hypot(1.0, slope)[:, None]
        off = np.abs(off - np.median(off, axis=1)[:, None])
        scale = np.maximum(1e-6, 1.4826 * np.median(off, axis=1))[:, None]
        w = np.minimum(1.0, 2.5 * scale / np.maximum(off, 1e-9))
    correlation = xy / np.maximum(1e-12, np.sqrt(xx * yy))
    out[rows] = np.stack([slope, intercept, correlation, (off <= 3 * scale).mean(axis=1)], axis=1)
    return out, rising


def line_fit(a: np.ndarray, b: np.ndarray, gates: dict | None = None) -> tuple[list, str, int]:
    """a as slope times b plus intercept, both as shares of the full scale: slope, intercept, correlation, inlier share, offset,
    deviation; the first gate that fails, or nothing; and the number of valid samples. Values that are not finite, negative or
    saturated take no part."""
    numbers, reasons, n = line_fits(np.asarray(a, float), np.asarray(b, float), np.array([len(a)]), gates)
    return numbers[0].tolist(), reasons[0], int(n[0])


def line_fits(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, gates: dict | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """line_fit of many edges, whose samples lie one after the other, sizes of each: edges of as many valid samples are fitted at once."""
    g = GATES | (gates or {})
    edges = len(sizes)
    of = np.repeat(np.arange(edges), sizes)
    count = lambda where: np.bincount(of[where], minlength=edges)
    known = np.isfinite(a) & np.isfinite(b)
    full_ = known & ((a >= 1) | (b >= 1))
    saturation = count(full_) / np.maximum(sizes, 1)
    use = known & ~full_ & (a >= 0) & (b >= 0)
    n = count(use)
    a, b, first = a[use], b[use], np.cumsum(n) - n
    out, reasons = np.tile([1.0, 0.0, 0.0, 0.0, 0.0, 0.0], (edges, 1)), np.full(edges, "", object)
    for m in np.unique(n):
        same = np.flatnonzero(n == m)
        step = max(1, BATCH // max(int(m), 1))
        for at in (same[k : k + step] for k in range(0, len(same), step)):
            place = first[at][:, None] + np.arange(m)
            out[at], reasons[at] = _fits_of_rows(a[place], b[place], saturation[at], g)
    return out, reasons.tolist(), n


def _fits_of_rows(a: np.ndarray, b: np.ndarray, saturation: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and reasons of edges with as many valid samples, a row each."""
    out, reason = np.tile([1.0, 0.0, 0.0, 0.0, 0.0, 0.0], (len(a), 1)), np.full(len(a), "", object)
    if a.shape[1]:
        out[:, 4] = np.median(a - b, axis=1)
        out[:, 5] = 1.4826 * np.median(np.abs(a - b - out[:, 4:5]), axis=1)
    if a.shape[1] < g["samples"]:
        return out, np.full(len(a), "too_few_samples", object)
    reason[saturation > g["saturation"]] = "saturated_overlap"
    left = np.flatnonzero(reason == "")
    if len(left) and a.shape[1]:
        both = np.stack([a[left], b[left]])
        low = np.percentile(both, 5, axis=2)
        dynamic = np.percentile(both, 95, axis=2) - low
        above = (both > (low + 0.1 * dynamic)[:, :, None]).any(axis=0)
        dull = (dynamic.min(axis=0) < g["dynamic"]) | (above.mean(axis=1) < g["signal"])
        reason[left[dull]] = "low_information"
        left = left[~dull]
        found, rising = weighted_lines(a[left], b[left])
        reason[left[~rising]] = FALLING
        left, found = left[rising], found[rising]
        out[left, :4] = found
        reason[left[(np.abs(found[:, 1]) > g["intercept"]) | ~((found[:, 0] >= g["slope"][0]) & (found[:, 0] <= g["slope"][1]))]] = "affine_fit_out_of_bounds"
        reason[left[(found[:, 2] < g["correlation"]) | (found[:, 3] < g["inlier"])]] = "unstable_affine_fit"
    return out, reason


def pair_fits(overlaps: DataFrame, gates: dict | None = None, full: float = 255.0) -> DataFrame:
    """overlaps(mosaic, a, b, va, vb), a row a pixel -> the line_fit of each edge; n counts its valid samples."""
    both = F.collect_list(F.struct(F.col("va").cast("double").alias("va"), F.col("vb").cast("double").alias("vb")))
    return sample_fits(overlaps.groupBy("mosaic", "a", "b").agg(both.alias("o")).selectExpr("mosaic", "a", "b", "o.va AS va", "o.vb AS vb"), gates, full)


def sample_fits(samples: DataFrame, gates: dict | None = None, full: float = 255.0) -> DataFrame:
    """pair_fits of samples(mosaic, a, b, va, vb), a row an edge, its samples arrays. A batch of edges is fitted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = (batch.column(c) for c in ("va", "vb"))
            numbers, reasons, n = line_fits(*(v.flatten().to_numpy(zero_copy_only=False) / full for v in (va, vb)), va.value_lengths().to_numpy(zero_copy_only=False), gates)
            rounded = [pa.array([round(x, 6) for x in c], pa.float64()) for c in numbers.T.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("mosaic", "a", "b")), pa.array(n, pa.int64()), *rounded, pa.array(reasons, pa.string())], names=[f.split()[0] for f in FIT.split(", ")])

    arrays = [F.col(c).cast("array<double>").alias(c) for c in ("va", "vb")]
    return samples.select(F.col("mosaic").cast("int").alias("mosaic"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), *arrays).mapInArrow(run, FIT)


def model(fits: DataFrame, steady: float = 0.05) -> DataFrame:
    """mosaic, node, gain, offset, kind of the fits of pair_fits, which are made once."""
    fits = settled(fits, "fits")
    tiles = fits.select("mosaic", F.col("a").alias("node")).union(fits.select("mosaic", F.col("b"))).distinct()
    good = F.col("reason") == ""
    still = F.col("mad") <= steady
    counts = tiles.groupBy("mosaic").agg(F.count("*").alias("tiles")).join(fits.groupBy("mosaic").agg(F.sum(good.cast("int")).alias("lines"), F.sum(still.cast("int")).alias("shifts")), "mosaic")
    kind = F.when(F.col("lines") >= F.col("tiles") - 1, "affine").when(F.col("shifts") >= F.col("tiles") - 1, "offset").otherwise("identity")
    kinds = counts.select("mosaic", kind.alias("kind"))
    chosen = fits.join(kinds, "mosaic").withColumn("weight", F.lit(1.0))
    gains = graph.scalar_solve(chosen.where((F.col("kind") == "affine") & good).select("mosaic", "a", "b", F.log("slope").alias("d"), "weight"))
    shifts = graph.scalar_solve(chosen.where(((F.col("kind") == "affine") & good) | ((F.col("kind") == "offset") & still)).select("mosaic", "a", "b", F.when(F.col("kind") == "affine", F.col("intercept")).otherwise(F.col("offset")).alias("d"), "weight"))
    out = tiles.join(kinds, "mosaic").join(gains.withColumnRenamed("value", "g"), ["mosaic", "node"], "left").join(shifts.withColumnRenamed("value", "o"), ["mosaic", "node"], "left")
    # a = slope * b + intercept: b times its gain, plus its offset, comes to the level of a
    return out.select("mosaic", "node", F.round(F.exp(F.coalesce("g", F.lit(0.0))), 6).alias("gain"), F.round(F.coalesce("o", F.lit(0.0)), 6).alias("offset"), "kind")
