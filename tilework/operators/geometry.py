"""Geometry of a mosaic: neighbour shifts measured on overlaps, one robust position a tile, and a summary.

Tiles and edges are relations. Only the strips that two neighbours may share leave a plane; each edge is then a group of its
own. The graph of a mosaic has a few numbers a tile and is solved a mosaic a group; mosaics are independent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.operators import graph
from tilework.operators.registration import REACH, phase_residual, plane_block_mean, plane_laplacian

# What an accepted edge needs, and the least side over which two planes are compared.
LEAST_NCC, LEAST_PSR, COMPARED_SIDE = 0.08, 4.0, 32
ROUNDS = 8
STRIP = "mosaic int, a long, b long, axis string, stage_dy double, stage_dx double, h int, w int, side int, oy int, ox int, sh int, sw int, v array<float>"
EDGE = "mosaic int, a long, b long, axis string, stage_dy double, stage_dx double, dy double, dx double, ncc double, psr double, margin double, texture double, accepted boolean, reason string, weight double"
PLACED = "mosaic int, tile long, row int, col int, y double, x double, stage_y double, stage_x double"
CHECKED = EDGE + ", residual_dy double, residual_dx double"


def expected_edges(tiles: DataFrame) -> DataFrame:
    """tiles(mosaic, tile, row, col, stage_y, stage_x, h, w) -> mosaic, a, b, axis, stage_dy, stage_dx, h, w: right and lower
    neighbours with the stage's shift of b against a."""
    step = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit("y").alias("axis"), F.lit(1).alias("r"), F.lit(0).alias("c"))))
    a = tiles.select("mosaic", F.col("tile").alias("a"), "row", "col", F.col("stage_y").alias("ay"), F.col("stage_x").alias("ax"), "h", "w", step.alias("s"))
    a = a.select("*", "s.axis", (F.col("row") + F.col("s.r")).alias("br"), (F.col("col") + F.col("s.c")).alias("bc"))
    b = tiles.select("mosaic", F.col("tile").alias("b"), F.col("row").alias("br"), F.col("col").alias("bc"), F.col("stage_y").alias("by"), F.col("stage_x").alias("bx"))
    return a.join(b, ["mosaic", "br", "bc"]).select("mosaic", "a", "b", "axis", (F.col("by") - F.col("ay")).alias("stage_dy"), (F.col("bx") - F.col("ax")).alias("stage_dx"), "h", "w")


def _overlap(h: int, w: int, dy: int, dx: int) -> tuple[int, int, int, int]:
    """Rows y0..y1 and columns x0..x1 of a plane that one of the same size, laid dy and dx further on, covers."""
    return max(0, dy), min(h, h + dy), max(0, dx), min(w, w + dx)


def _strips(reach: float):
    """Of planes joined with their edges: the part that the neighbour may share, with reach to spare."""

    def run(batches):
        for group in batches:
            out = []
            for r in group.itertuples(index=False):
                sign = 1 if r.side == 0 else -1
                y0, y1, x0, x1 = _overlap(r.h, r.w, sign * round(r.stage_dy), sign * round(r.stage_dx))
                spare = int(np.ceil(reach)) + 1
                y0, y1, x0, x1 = max(0, y0 - spare), min(r.h, y1 + spare), max(0, x0 - spare), min(r.w, x1 + spare)
                part = np.asarray(r.v, np.float32).reshape(r.h, r.w)[y0 : max(y0, y1), x0 : max(x0, x1)]
                out.append((r.mosaic, r.a, r.b, r.axis, r.stage_dy, r.stage_dx, r.h, r.w, r.side, y0, x0, *part.shape, part.ravel()))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in STRIP.split(", ")])

    return run


def _ncc(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (plane_block_mean(plane_laplacian(p), 2) for p in (a, b))
    a, b = a - a.mean(), b - b.mean()
    size = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / size) if size > 1e-8 else 0.0


def confidence(ncc: float, psr: float, margin: float) -> float:
    """The weight of an accepted edge: agreement, sharpness of the peak and its lead, each from a floor to 1."""
    terms = (((ncc - 0.04) / 0.45, 0.0), (psr / 12.0, 0.15), ((margin + 0.02) / 0.25, 0.20))
    return max(0.02, float(np.prod([min(1.0, max(low, x)) for x, low in terms])))


def _edge(reach: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        e = group.iloc[0]
        planes = {r.side: (np.asarray(r.v, float).reshape(r.sh, r.sw), r.oy, r.ox) for r in group.itertuples(index=False)}

        def shared(dy: float, dx: float):
            """Both planes' pixels where b, laid dy and dx from a, overlaps it; empty if a plane is missing."""
            dy, dx = round(dy), round(dx)
            y0, y1, x0, x1 = _overlap(e["h"], e["w"], dy, dx)
            if len(planes) < 2 or y1 <= y0 or x1 <= x0:
                return np.zeros((0, 0)), np.zeros((0, 0))
            (a, ay, ax), (b, by, bx) = planes[0], planes[1]
            return a[y0 - ay : y1 - ay, x0 - ax : x1 - ax], b[y0 - dy - by : y1 - dy - by, x0 - dx - bx : x1 - dx - bx]

        sdy, sdx = float(e["stage_dy"]), float(e["stage_dx"])
        found = phase_residual(*shared(sdy, sdx), reach)
        dy, dx, ncc, reason = sdy, sdx, 0.0, found.reason
        if not reason:
            dy, dx = round(sdy) + found.dy, round(sdx) + found.dx
            pa, pb = shared(dy, dx)
            ncc = _ncc(pa, pb) if pa.shape == pb.shape and min(pa.shape) >= COMPARED_SIDE else 0.0
            reason = "" if ncc >= LEAST_NCC and found.psr >= LEAST_PSR else "weak_match"
        weight = confidence(ncc, found.psr, found.margin) if not reason else 0.0
        row = (e["mosaic"], e["a"], e["b"], e["axis"], sdy, sdx, dy, dx, ncc, found.psr, found.margin, found.texture, not reason, reason, weight)
        return pd.DataFrame([row], columns=[f.split()[0] for f in EDGE.split(", ")])

    return run


def measure_edges(tiles: DataFrame, planes: DataFrame, reach: float = REACH) -> DataFrame:
    """Every expected edge of tiles, measured on planes(mosaic, tile, v: array of h * w numbers). Edges of unreadable (missing)
    planes are there with a reason."""
    ends = expected_edges(tiles).withColumn("end", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("tile")), F.struct(F.lit(1).alias("side"), F.col("b").alias("tile")))))
    ends = ends.select("mosaic", "a", "b", "axis", "stage_dy", "stage_dx", "h", "w", "end.side", "end.tile")
    whole = planes.select("mosaic", "tile", F.col("v").cast("array<float>").alias("v"))
    strips = ends.join(whole, ["mosaic", "tile"]).drop("tile").mapInPandas(_strips(reach), STRIP)
    measured = strips.groupBy("mosaic", "a", "b").applyInPandas(_edge(reach), EDGE)
    key = ["mosaic", "a", "b"]
    lost = expected_edges(tiles).join(measured.select(*key), key, "left_anti")
    zero = [F.lit(0.0).alias(c) for c in ("ncc", "psr", "margin", "texture")]
    return measured.unionByName(lost.select(*key, "axis", "stage_dy", "stage_dx", F.col("stage_dy").alias("dy"), F.col("stage_dx").alias("dx"), *zero, F.lit(False).alias("accepted"), F.lit("read_error").alias("reason"), F.lit(0.0).alias("weight")))


def lattice_fit(place: np.ndarray, stage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of stage (y, x) on 1, row and column: fitted places and the three coefficients."""
    design = np.column_stack([np.ones(len(place)), place])
    found = np.linalg.lstsq(design, stage, rcond=None)[0]
    return design @ found, found


def calibrated(place: np.ndarray, stage: np.ndarray, axis: np.ndarray, shift: np.ndarray, accepted: np.ndarray) -> np.ndarray:
    """Where tiles are before the solve: a lattice of the median accepted step of each axis (the stage's, if there is none),
    plus what the stage differs from its own lattice."""
    fit, found = lattice_fit(place, stage)
    steps = [np.median(shift[m], axis=0) if (m := accepted & (axis == name)).any() else found[k] for k, name in ((1, "y"), (2, "x"))]
    return (place - place.min(axis=0)) @ np.array(steps) + stage - fit


def _solved(tiles: pd.DataFrame, edges: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Positions of one mosaic's tiles, and its edges with residuals and those taken out as inconsistent."""
    tiles = tiles.sort_values(["row", "col"]).reset_index(drop=True)
    edges = edges.sort_values(["a", "b"]).reset_index(drop=True)
    at = {t: k for k, t in enumerate(tiles["tile"])}
    a, b = (edges[c].map(at).to_numpy(int) for c in ("a", "b"))
    place, stage = tiles[["row", "col"]].to_numpy(float), tiles[["stage_y", "stage_x"]].to_numpy(float)
    shift, accepted, weight, axis = edges[["dy", "dx"]].to_numpy(float), edges["accepted"].to_numpy(bool).copy(), edges["weight"].to_numpy(float).copy(), edges["axis"].to_numpy()
    reason = edges["reason"].to_numpy(object).copy()

    def solve() -> np.ndarray:
        prior = calibrated(place, stage, axis, shift, accepted)
        return graph.solve(a[accepted], b[accepted], shift[accepted], weight[accepted], prior) if accepted.any() else prior

    x = solve()
    for _ in range(ROUNDS):
        live = np.flatnonzero(accepted)
        if len(live) < 3:
            break
        far = np.linalg.norm(x[b[live]] - x[a[live]] - shift[live], axis=1)
        middle = np.median(far)
        spread = max(0.15, 1.4826 * np.median(np.abs(far - middle)))
        worst = int(far.argmax())
        if far[worst] <= min(5.0, max(2.5, middle + 6 * spread)):
            break
        accepted[live[worst]], weight[live[worst]], reason[live[worst]] = False, 0.0, "global_inconsistent"
        x = solve()
    low = x.min(axis=0)
    x, stage = x - low, stage - low
    residual = np.where(accepted[:, None], x[b] - x[a] - shift, np.nan)
    nodes = tiles[["mosaic", "tile", "row", "col"]].assign(y=x[:, 0], x=x[:, 1], stage_y=stage[:, 0], stage_x=stage[:, 1])
    checked = edges.assign(accepted=accepted, weight=weight, reason=reason, residual_dy=residual[:, 0], residual_dx=residual[:, 1])
    return nodes, checked


def _solve(part: int, schema: str, tiles: DataFrame, edges: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _solved(left, right)[part][names] if len(left) else pd.DataFrame(columns=names)

    return tiles.groupBy("mosaic").cogroup(edges.groupBy("mosaic")).applyInPandas(run, schema)


def origins(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """mosaic, tile, row, col, y, x (least 0), stage_y, stage_x (moved alike) of tiles and their measured edges."""
    return _solve(0, PLACED, tiles, edges)


def checked_edges(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with residuals; those that contradict the others are no longer accepted."""
    return _solve(1, CHECKED, tiles, edges).withColumn("residual_dy", F.nanvl("residual_dy", F.lit(None))).withColumn("residual_dx", F.nanvl("residual_dx", F.lit(None)))


def summary(tiles: DataFrame, placed: DataFrame, checked: DataFrame) -> DataFrame:
    """One row a mosaic: extent, counts of edges, residuals, corrections of the stage, connected parts and warnings."""
    size = tiles.groupBy("mosaic").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.count("*").alias("tiles"))
    extent = placed.join(size, "mosaic").groupBy("mosaic", "tiles").agg(F.ceil(F.max(F.col("y") + F.col("h") - 0.5)).cast("int").alias("height"), F.ceil(F.max(F.col("x") + F.col("w") - 0.5)).cast("int").alias("width"), *_quantiles(F.hypot(F.col("y") - F.col("stage_y"), F.col("x") - F.col("stage_x")), "stage_correction", False))
    good = F.when(F.col("accepted"), F.hypot("residual_dy", "residual_dx"))
    counted = checked.groupBy("mosaic").agg(F.count("*").alias("expected"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("reason") == "global_inconsistent").alias("inconsistent"), *_quantiles(good, "residual", True))
    parts = graph.components(checked.where("accepted").select("mosaic", "a", "b")).groupBy("mosaic").agg(F.count("*").alias("linked"), F.count_distinct("comp").alias("linked_parts"))
    out = extent.join(counted, "mosaic", "left").join(parts, "mosaic", "left")
    out = out.withColumn("parts", F.col("tiles") - F.coalesce("linked", F.lit(0)) + F.coalesce("linked_parts", F.lit(0))).drop("linked", "linked_parts")
    warn = lambda when, name: F.when(when, F.lit(name))
    some = F.col("accepted") > 0
    names = F.array_compact(F.array(warn(~some, "stage_only"), warn(some & (F.col("parts") > 1), "disconnected"), warn(some & (F.col("accepted") / F.col("expected") < 0.5), "few_verified_seams"), warn(F.col("residual_p95") > 2.0, "residual_p95_over_2px"), warn(F.col("residual_max") > 5.0, "residual_over_5px"), warn(F.col("inconsistent") > 0, "inconsistent_seams_excluded")))
    return out.withColumn("warnings", names)


def _quantiles(value, name: str, most: bool) -> list:
    out = [F.percentile(value, 0.5).alias(f"{name}_median"), F.percentile(value, 0.95).alias(f"{name}_p95")]
    return out + [F.max(value).alias(f"{name}_max")] if most else out
