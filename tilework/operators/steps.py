"""The step between neighbouring tiles of a well: candidates from strips, votes of all pairs, fractions of a pixel.

Correlating strips and scoring a shift are small functions on the two planes of one pair; everything that compares candidates
(rivals, ranks, votes, medians, fall-backs) is joins, windows and aggregates on the relation of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.operators.planes import box_mean, correlation, frame, image, sampled
from tilework.operators.registration import phase_shift

# Shares of a tile that strips take, the least score of a measured step, the lead over a rival as a share of the
# score, how near two shifts are the same (px), candidates kept, the range of plausible overlaps, the search in fractions.
STRIPS = (0.12, 0.20, 0.30, 0.45, 0.60)
LEAST_SCORE = 0.15
LEAD = 0.12
SAME = 6
KEPT = 6
OVERLAPS = (0.03, 0.75)
SPAN, POINTS = 1.0, 21
#: Scores are taken on every HALF-th pixel; a scored overlap has at least LEAST_SIDE of these a side and LEAST_AREA of all.
HALF, LEAST_SIDE, LEAST_AREA = 2, 16, 0.01
#: The least side of an overlap on which fractions are searched.
FINE_SIDE = 32

CANDIDATE = "a int, b int, axis string, dy int, dx int, score double, h int, w int"
FINE = "a int, b int, axis string, dy double, dx double, score double"


def strip_shifts(a: np.ndarray, b: np.ndarray, axis: str) -> set[tuple[int, int]]:
    """Shifts (dy, dx) of b from a that strips along their common side suggest. A strip's peak wraps at the strip, so the shifts
    one strip before and behind it are candidates too."""
    n = a.shape[1] if axis == "x" else a.shape[0]
    out = set()
    for share in STRIPS:
        k = max(8, min(n - 1, int(n * share)))
        dy, dx, _ = phase_shift(b[:, :k], a[:, n - k :]) if axis == "x" else phase_shift(b[:k], a[n - k :])
        for turn in (-1, 0, 1):
            out.add((dy, n - k + dx + turn * k) if axis == "x" else (n - k + dy + turn * k, dx))
    return out


def sharpened(plane: np.ndarray) -> np.ndarray:
    """A small copy without low frequencies: shading is alike in all tiles and must not score."""
    small = plane[::HALF, ::HALF]
    return small - box_mean(small, max(2, min(small.shape) // 16))


def shared(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """Both planes where b, laid dy and dx from a, overlaps it."""
    (h, w), (bh, bw) = a.shape, b.shape
    y0, x0, y1, x1 = max(0, dy), max(0, dx), min(h, dy + bh), min(w, dx + bw)
    if y1 <= y0 or x1 <= x0:
        return np.zeros((0, 0)), np.zeros((0, 0))
    return a[y0:y1, x0:x1], b[y0 - dy : y1 - dy, x0 - dx : x1 - dx]


def scored(a: np.ndarray, b: np.ndarray, axis: str) -> list[tuple[int, int, float]]:
    """(dy, dx, score) of the candidates that are steps forward with enough overlap."""
    h, w = a.shape
    small = sharpened(a), sharpened(b)
    out = []
    for dy, dx in sorted(strip_shifts(a, b, axis)):
        if not 0 < (dx if axis == "x" else dy) <= (w if axis == "x" else h):
            continue
        pa, pb = shared(*small, round(dy / HALF), round(dx / HALF))
        if min(pa.shape) >= LEAST_SIDE and pa.size >= LEAST_AREA * small[0].size:
            out.append((dy, dx, correlation(pa, pb)))
    return out


def refined(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> tuple[float, float, float]:
    """(dy, dx, score) to fractions of a pixel: the best correlation with bilinear samples of b, first along y, then along x;
    score 0 where the overlap is too small."""
    pa, _ = shared(a, b, dy, dx)
    if min(pa.shape, default=0) < FINE_SIDE:
        return float(dy), float(dx), 0.0
    ys, xs = max(0, dy) + np.arange(pa.shape[0]), max(0, dx) + np.arange(pa.shape[1])
    best = (correlation(pa, sampled(b, ys - dy, xs - dx)), 0.0, 0.0)
    for axis in (1, 2):
        for part in np.linspace(-SPAN, SPAN, POINTS):
            fy, fx = (part, best[2]) if axis == 1 else (best[1], part)
            score = correlation(pa, sampled(b, ys - dy - fy, xs - dx - fx))
            if score > best[0]:
                best = (score, float(fy), float(fx))
    return dy + best[1], dx + best[2], best[0]


def pairs(tiles: DataFrame, planes: DataFrame) -> DataFrame:
    """well, a, b, axis, h, w, va, vb: neighbours whose planes are both there. tiles(well, tile, row, col), planes(well, tile, h, w, v)."""
    step = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit("y").alias("axis"), F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    a = tiles.select("well", F.col("tile").alias("a"), "row", "col", step.alias("s")).select("well", "a", "s.axis", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    ends = a.join(tiles.select("well", F.col("tile").alias("b"), "row", "col"), ["well", "row", "col"]).select("well", "a", "b", "axis")
    side = lambda t, v: planes.select("well", F.col("tile").alias(t), *(["h", "w"] if t == "a" else [F.col("h").alias("bh"), F.col("w").alias("bw")]), F.col("v").cast("array<float>").alias(v))
    both = ends.join(side("a", "va"), ["well", "a"]).join(side("b", "vb"), ["well", "b"])
    return both.select("well", "a", "b", "axis", "h", "w", "bh", "bw", "va", "vb")


def candidates(pairs: DataFrame) -> DataFrame:
    """well, a, b, axis, dy, dx, score, h, w: a row a candidate of each pair."""
    schema = f"well {pairs.schema['well'].dataType.simpleString()}, " + CANDIDATE

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part.itertuples(index=False):
                found = scored(image(p.va, p.h, p.w), image(p.vb, p.bh, p.bw), p.axis)
                yield frame([(p.well, p.a, p.b, p.axis, dy, dx, s, p.h, p.w) for dy, dx, s in found], schema)

    return pairs.mapInPandas(run, schema)


def _pair(*more: str) -> list[str]:
    return ["well", "axis", "a", "b", *more]


def ranked(found: DataFrame) -> DataFrame:
    """candidates with rank (from 1, by score; of equals the smaller shift), the pair's best shift, and ambiguous: a rival
    more than SAME px from the best comes within LEAD of its score."""
    pair = Window.partitionBy(*_pair())
    order = pair.orderBy(F.desc("score"), "dy", "dx")
    best = found.withColumn("rank", F.row_number().over(order)).withColumn("best", F.first(F.struct("dy", "dx", "score")).over(order))
    far = (F.abs(F.col("dy") - F.col("best.dy")) > SAME) | (F.abs(F.col("dx") - F.col("best.dx")) > SAME)
    rival = best.withColumn("rival", F.max(F.when(far, F.col("score"))).over(pair))
    close = (F.col("best.score") > 0) & (F.col("best.score") - F.col("rival") < LEAD * F.col("best.score"))
    return rival.withColumn("ambiguous", F.coalesce(close, F.lit(False)))


def voting(ranks: DataFrame) -> DataFrame:
    """The candidates that vote: the first KEPT of pairs that are not ambiguous, with a plausible overlap."""
    side, along = F.when(F.col("axis") == "x", F.col("w")).otherwise(F.col("h")), F.when(F.col("axis") == "x", F.col("dx")).otherwise(F.col("dy"))
    low, high = OVERLAPS
    return ranks.where(~F.col("ambiguous") & (F.col("rank") <= KEPT)).where((along >= side * (1 - high)) & (along <= side * (1 - low)))


def _near(votes: DataFrame, centre: DataFrame, keys: list[str]) -> DataFrame:
    """Votes within SAME px of each centre(keys, cy, cx) of their well and axis. Both are dealt into squares of SAME + 1 px, so
    only neighbouring squares meet, by equality."""
    side = SAME + 1
    cell = lambda c: F.floor(F.col(c) / side)
    around = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    c = centre.withColumn("sy", around).withColumn("sx", around).withColumn("sy", cell("cy") + F.col("sy")).withColumn("sx", cell("cx") + F.col("sx"))
    v = votes.select("well", "axis", F.col("a").alias("va"), F.col("b").alias("vb"), "dy", "dx", "score", cell("dy").alias("sy"), cell("dx").alias("sx"))
    return c.join(v, ["well", "axis", "sy", "sx"]).where((F.abs(F.col("dy") - F.col("cy")) <= SAME) & (F.abs(F.col("dx") - F.col("cx")) <= SAME)).select(*keys, "cy", "cx", "va", "vb", "dy", "dx", "score")


def consensus(votes: DataFrame) -> DataFrame:
    """well, axis, dy, dx, score, pairs: the shift that most pairs support, then the highest sum of scores, then the first
    pair's best. The step is the median of what supports it, cut to whole pixels; score is the mean over supporting pairs."""
    keys = ["well", "axis", "a", "b", "rank"]
    centres = votes.select(*keys, F.col("dy").alias("cy"), F.col("dx").alias("cx"))
    support = _near(votes, centres, keys).groupBy(*keys, "cy", "cx", "va", "vb").agg(F.max("score").alias("s"))
    total = support.groupBy(*keys, "cy", "cx").agg(F.count("*").alias("n"), F.sum("s").alias("total"))
    first = Window.partitionBy("well", "axis").orderBy(F.desc("n"), F.desc("total"), "a", "b", "rank")
    won = total.withColumn("at", F.row_number().over(first)).where("at = 1").select("well", "axis", "cy", "cx", "n", "total")
    agree = _near(votes, won, ["well", "axis", "n", "total"])
    top = F.max("score").over(Window.partitionBy("well", "axis", "va", "vb"))
    agree = agree.withColumn("top", top).where("score = top")
    middle = lambda c: F.percentile(c, 0.5).cast("int").alias(c)
    return agree.groupBy("well", "axis", "n", "total").agg(middle("dy"), middle("dx")).select("well", "axis", "dy", "dx", (F.col("total") / F.col("n")).alias("score"), F.col("n").alias("pairs"))


def with_fallback(wells: DataFrame, measured: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """A row each well(well, h, w) and axis: dy, dx, score, source. Steps of too low a score give way to the prior(well, axis,
    py, px), and where that is missing to tiles laid side by side."""
    both = wells.withColumn("axis", F.explode(F.array(F.lit("x"), F.lit("y"))))
    out = both.join(measured.withColumnRenamed("dy", "my").withColumnRenamed("dx", "mx"), ["well", "axis"], "left")
    out = out.join(prior, ["well", "axis"], "left") if prior is not None else out.withColumn("py", F.lit(None).cast("int")).withColumn("px", F.lit(None).cast("int"))
    good, known = F.col("score") >= LEAST_SCORE, F.col("py").isNotNull()

    def pick(mine: str, other: str, side: Column) -> Column:
        return F.when(good, F.col(mine)).when(known, F.col(other)).otherwise(side).cast("int")

    beside = lambda axis, side: F.when(F.col("axis") == axis, F.col(side)).otherwise(0)
    source = F.when(good, F.lit("measured")).when(known, F.lit("plate")).otherwise("abut")
    return out.select("well", "axis", pick("my", "py", beside("y", "h")).alias("dy"), pick("mx", "px", beside("x", "w")).alias("dx"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("pairs", F.lit(0)).alias("pairs"), source.alias("source"), "py", "px")


def fine_steps(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """well, a, b, axis, dy, dx, score: the best shift of each pair that is not ambiguous, to fractions of a pixel."""
    best = ranks.where("rank = 1 and not ambiguous").select("well", "a", "b", "dy", "dx", "score")
    schema = f"well {pairs.schema['well'].dataType.simpleString()}, " + FINE

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part.itertuples(index=False):
                dy, dx, score = refined(image(p.va, p.h, p.w), image(p.vb, p.bh, p.bw), int(p.dy), int(p.dx))
                rows.append((p.well, p.a, p.b, p.axis, dy, dx, score) if score > 0 else (p.well, p.a, p.b, p.axis, p.dy, p.dx, p.score))
            yield frame(rows, schema)

    return pairs.join(best, ["well", "a", "b"]).mapInPandas(run, schema)
