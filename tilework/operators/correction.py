"""Corrections of a mosaic's brightness, and their proofs: a common additive field, gains and offsets of tiles, or offsets alone.

Both are estimated on small copies of the tiles and applied only if every gate is passed; what fails says why. Samples of
an edge are taken by one task from two small copies; everything about many edges (held-out edges, medians an axis, gates,
fall-backs) is windows, joins and aggregates, a mosaic a row. A mosaic's graph is one group.

tiles(mosaic, tile, row, col, oy, ox, h, w) with origins to fractions of a pixel; planes(mosaic, tile, v); edges(mosaic, a, b, axis),
those that geometry verified (geometry.eligible_edges)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.operators import graph
from tilework.operators.planes import frame, image, sampled, stretched
from tilework.operators.radiometry import line_fit
from tilework.operators.registration import plane_block_mean
from tilework.operators.tables import settled

# Fixed values. Samples of an overlap: pixels left out at a tile's edge, the most samples.
MARGIN, MOST_SAMPLES = 2.0, 30_000
# The field: tiles in all and in a half, agreement of halves, least and largest amplitude, held-out edges, improvement of seams,
# tolerances of a seam (share, DN), new clipping.
FIELD_TILES, HALF_TILES = 24, 12
AGREEMENT, DISAGREEMENT = 0.93, 0.20
LEAST_SPAN, SCALE_SHARE, DYNAMIC_SHARE = 0.5, 0.02, 0.25
HELD_OUT, IMPROVEMENT, WORSE, WORSE_DN, CLIPPED = 12, 0.20, 1.02, 0.25, 1e-4
# Gains and offsets: edges from which on each fifth is held out, priors, the largest gain, tiles of a part that may be corrected.
HOLD_FROM, PRIORS, OFFSET_PRIORS, MOST_GAIN = 12, (0.04, 0.08, 0.12, 0.20, 0.30, 0.50, 1.0), (0.04, 0.08, 0.12, 0.20, 0.30, 0.50, 1.0, 2.0), 1.10
PART_TILES, PART_FROM, SMALL_PART = 8, 24, 2
OFFSET_SAMPLES, VALIDATION_SAMPLES = 512, 256


def field_downsample(tile_h: int, tile_w: int) -> int:
    return max(1, -(-max(tile_h, tile_w) // 128))


def radiometric_downsample(tile_h: int, tile_w: int) -> int:
    return 4 if min(tile_h, tile_w) >= 256 else max(1, min(tile_h, tile_w) // 64)


def gaussian(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along both axes, cut at four sigma, the border repeated."""
    k = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    weight /= weight.sum()
    out = plane.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(k, k) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = sum(w * np.take(padded, np.arange(i, i + plane.shape[axis]), axis) for i, w in enumerate(weight))
    return out


def small_planes(tiles: DataFrame, planes: DataFrame, f: int) -> DataFrame:
    """(mosaic, tile, row, col, oy, ox, h, w, v) of block means; origins in pixels of the small copies."""
    kinds = {c.name: c.dataType.simpleString() for c in tiles.schema}
    schema = f"mosaic {kinds['mosaic']}, tile {kinds['tile']}, row int, col int, oy double, ox double, h int, w int, v array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part.itertuples(index=False):
                small = plane_block_mean(image(t.v, t.h, t.w), f)
                rows.append((t.mosaic, t.tile, t.row, t.col, t.oy / f, t.ox / f, *small.shape, small.ravel().astype(np.float32)))
            yield frame(rows, schema)

    both = tiles.select("mosaic", "tile", "row", "col", "oy", "ox", "h", "w").join(planes.select("mosaic", "tile", F.col("v").cast("array<float>").alias("v")), ["mosaic", "tile"])
    return both.mapInPandas(run, schema)


def _grid(a: float, b: float, n: int, m: int) -> np.ndarray:
    """Places along an axis that two tiles of n and m pixels at a and b share, half way between the phases of their pixels, so
    that both are blurred alike and the edge may be turned round."""
    apart = b - a
    phase = a + 0.5 * (apart - round(apart))
    first = np.ceil(max(a, b) + MARGIN - phase)
    last = np.floor(min(a + n, b + m) - 1 - MARGIN - phase)
    return np.arange(first, last + 1) + phase


def samples_of(a: tuple, b: tuple, most: int = MOST_SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Both planes' samples at shared places; a and b are (plane, oy, ox). Strided to about `most`."""
    (pa, ay, ax), (pb, by, bx) = a, b
    ys, xs = _grid(ay, by, pa.shape[0], pb.shape[0]), _grid(ax, bx, pa.shape[1], pb.shape[1])
    if not len(ys) or not len(xs):
        return np.zeros((0, 0)), np.zeros((0, 0))
    step = max(1, int(np.ceil(np.sqrt(len(ys) * len(xs) / most))))
    ys, xs = ys[::step], xs[::step]
    return sampled(pa, ys - ay, xs - ax), sampled(pb, ys - by, xs - bx)


def common_samples(small: DataFrame, edges: DataFrame, fields: DataFrame | None = None, most: int = MOST_SAMPLES) -> DataFrame:
    """edges with n_y, n_x, va, vb: what both tiles show at shared places. fields(mosaic[, name], field_h, field_w, field) is taken
    off first; edges with a column name take the field of that name. Edges without common places have empty arrays."""
    kinds = {c.name: c.dataType.simpleString() for c in edges.schema}
    extra = [c for c in edges.columns]
    side = lambda t: small.select("mosaic", F.col("tile").alias(t), *[F.col(c).alias(t + c) for c in ("oy", "ox", "h", "w", "v")])
    both = edges.join(side("a"), ["mosaic", "a"]).join(side("b"), ["mosaic", "b"])
    if fields is not None:
        both = both.join(fields, [c for c in ("mosaic", "name") if c in fields.columns and c in edges.columns], "left")
    else:
        both = both.selectExpr("*", "cast(null as int) AS field_h", "cast(null as int) AS field_w", "cast(null as array<double>) AS field")
    schema = ", ".join(f"{c} {kinds[c]}" for c in extra) + ", n_y int, n_x int, va array<double>, vb array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for e in part.itertuples(index=False):
                pa, pb = image(e.av, e.ah, e.aw), image(e.bv, e.bh, e.bw)
                if e.field is not None:
                    field = image(e.field, e.field_h, e.field_w)
                    pa, pb = pa - stretched(field, *pa.shape), pb - stretched(field, *pb.shape)
                va, vb = samples_of((pa, e.aoy, e.aox), (pb, e.boy, e.box), most)
                rows.append((*(getattr(e, c) for c in extra), *va.shape, va.ravel(), vb.ravel()))
            yield frame(rows, schema)

    return both.mapInPandas(run, schema)


def dynamic_ranges(small: DataFrame) -> DataFrame:
    """(mosaic, dynamic): the median over tiles of the span from the 1st to the 99th percentile."""
    kind = small.schema["mosaic"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            good = [(m, v[np.isfinite(v)]) for m, v in zip(part["mosaic"], map(np.asarray, part["v"]))]
            yield frame([(m, float(np.subtract(*np.percentile(v, (99, 1))))) for m, v in good if len(v)], "mosaic, span")

    return small.select("mosaic", "v").mapInPandas(run, f"mosaic {kind}, span double").groupBy("mosaic").agg(F.percentile("span", 0.5).alias("dynamic"))


SEAM = "mosaic {m}, axis string, raw_bias double, corrected_bias double, raw_mad double, corrected_mad double, raw_p95 double, corrected_p95 double"


def seam_record(raw: np.ndarray, corrected: np.ndarray) -> tuple:
    """Bias, deviation and 95th percentile of a seam before and after."""
    middle = [float(np.median(d)) for d in (raw, corrected)]
    mad = [1.4826 * float(np.median(np.abs(d - m))) for d, m in zip((raw, corrected), middle)]
    return abs(middle[0]), abs(middle[1]), *mad, float(np.percentile(np.abs(raw), 95)), float(np.percentile(np.abs(corrected), 95))


def seams_improve(records: DataFrame) -> DataFrame:
    """(mosaic, seams, raw_bias, corrected_bias, safe): medians an axis; no axis may get worse, and one has to gain by IMPROVEMENT."""
    names = [c for c in records.columns if c.startswith(("raw_", "corrected_"))]
    axes = records.groupBy("mosaic", "axis").agg(F.count("*").alias("n"), *[F.percentile(c, 0.5).alias(c) for c in names])
    worse = F.lit(False)
    for c in ("bias", "mad", "p95"):
        worse = worse | (F.col(f"corrected_{c}") > WORSE * F.col(f"raw_{c}") + WORSE_DN)
    better = (F.col("raw_bias") >= WORSE_DN) & (F.col("corrected_bias") <= (1 - IMPROVEMENT) * F.col("raw_bias"))
    judged = axes.groupBy("mosaic").agg(F.max(worse).alias("worse"), F.max(better).alias("better"))
    whole = records.groupBy("mosaic").agg(F.count("*").alias("seams"), *[F.percentile(c, 0.5).alias(c) for c in ("raw_bias", "corrected_bias")])
    return whole.join(judged, "mosaic").select("mosaic", "seams", "raw_bias", "corrected_bias", (~F.col("worse") & F.col("better")).alias("safe"))


def new_clipping(tiles: DataFrame, planes: DataFrame, full: float, fields: DataFrame | None, gains: DataFrame | None) -> DataFrame:
    """(mosaic, clipped): the share of pixels inside the range that a correction would push out of it."""
    kind = tiles.schema["mosaic"].dataType.simpleString()
    both = tiles.select("mosaic", "tile", "h", "w").join(planes.select("mosaic", "tile", F.col("v").cast("array<float>").alias("v")), ["mosaic", "tile"])
    both = both.join(fields, "mosaic", "left") if fields is not None else both.selectExpr("*", "cast(null as int) AS field_h", "cast(null as int) AS field_w", "cast(null as array<double>) AS field")
    both = both.join(gains.select("mosaic", "tile", "gain", "offset"), ["mosaic", "tile"]) if gains is not None else both.selectExpr("*", "1D AS gain", "0D AS offset")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part.itertuples(index=False):
                plane = image(t.v, t.h, t.w)
                out = (plane if t.field is None else plane - stretched(image(t.field, t.field_h, t.field_w), *plane.shape)) * t.gain + t.offset
                inside = np.isfinite(plane) & (plane > 0) & (plane < full)
                rows.append((t.mosaic, int((inside & ((out < 0) | (out > full))).sum()), int(inside.sum())))
            yield frame(rows, "mosaic, lost, inside")

    lost = both.mapInPandas(run, f"mosaic {kind}, lost long, inside long")
    return lost.groupBy("mosaic").agg((F.sum("lost") / F.greatest(F.lit(1), F.sum("inside"))).alias("clipped"))


# ---- the common field


HALVES = ("row0", "row1", "col0", "col1")


def half_fields(small: DataFrame) -> DataFrame:
    """(mosaic, name, tiles, field_h, field_w, field): the smoothed median over the tiles of even and odd rows and columns, each less
    its own median. Tiles are cut into rows, and rows of one height meet."""
    kind = small.schema["mosaic"].dataType.simpleString()
    halves = F.explode(F.array(F.concat(F.lit("row"), F.pmod("row", F.lit(2))), F.concat(F.lit("col"), F.pmod("col", F.lit(2)))))
    schema = f"mosaic {kind}, name string, y int, r array<double>"

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for t in part.itertuples(index=False):
                plane = image(t.v, t.h, t.w)
                plane = plane - np.median(plane)
                yield frame([(t.mosaic, t.name, y, r) for y, r in enumerate(plane)], schema)

    def middle(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return frame([(first["mosaic"], first["name"], first["y"], np.median(np.stack(group["r"].to_list()), axis=0), len(group))], "mosaic, name, y, r, n")

    cut = small.withColumn("name", halves).select("mosaic", "name", "h", "w", "v").mapInPandas(lines, schema)
    rows = cut.groupBy("mosaic", "name", "y").applyInPandas(middle, schema + ", n long")
    whole = rows.groupBy("mosaic", "name").agg(F.max("n").alias("tiles"), F.sort_array(F.collect_list(F.struct("y", "r"))).alias("rows"))
    whole = whole.select("mosaic", "name", "tiles", F.size("rows").alias("field_h"), F.size(F.col("rows")[0]["r"]).alias("field_w"), F.flatten(F.transform("rows", lambda e: e["r"])).alias("field"))
    out = f"mosaic {kind}, name string, tiles long, field_h int, field_w int, field array<double>"

    def smooth(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for p in part.itertuples(index=False):
                field = gaussian(image(p.field, p.field_h, p.field_w), max(1.5, min(p.field_h, p.field_w) / 20))
                done.append((p.mosaic, p.name, p.tiles, p.field_h, p.field_w, (field - np.median(field)).ravel()))
            yield frame(done, out)

    return whole.mapInPandas(smooth, out)


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(correlation, disagreement: their distance over their mean span) of two fields."""
    corr = float(np.corrcoef(a.ravel(), b.ravel())[0, 1]) if min(a.std(), b.std()) >= 1e-8 else 0.0
    span = max(LEAST_SPAN, float(np.mean([np.subtract(*np.percentile(f, (95, 5))) for f in (a, b)])))
    return corr, float(np.sqrt(((a - b) ** 2).mean()) / span)


COMMON = "mosaic {m}, row_corr double, col_corr double, row_off double, col_off double, p01 double, p05 double, p95 double, p99 double, least_half long, field_h int, field_w int, field array<double>"


def _joined_halves(schema: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = {r.name: image(r.field, r.field_h, r.field_w) for r in group.itertuples(index=False)}
        first = group.iloc[0]
        if len(got) < len(HALVES):
            return frame([(first["mosaic"], *[0.0] * 8, 0, None, None, None)], schema)
        (rc, ro), (cc, co) = agreement(got["row0"], got["row1"]), agreement(got["col0"], got["col1"])
        field = np.median(np.stack([got[h] for h in HALVES]), axis=0)
        field = gaussian(field, max(1.0, min(field.shape) / 28))
        field = field - np.median(field)
        return frame([(first["mosaic"], rc, cc, ro, co, *map(float, np.percentile(field, (1, 5, 95, 99))), int(group["tiles"].min()), *field.shape, field.ravel())], schema)

    return run


def spatial_field(tiles: DataFrame, planes: DataFrame, edges: DataFrame, tile_shape: tuple[int, int], full: float = 255.0) -> tuple[DataFrame, DataFrame]:
    """(verdicts, fields). verdicts(mosaic, status, reason, row_corr, col_corr, row_off, col_off, dynamic, seams, raw_bias,
    corrected_bias, clipped): status is applied or identity, reason the first gate that failed. fields(mosaic, field_h, field_w,
    field) has the fields that are to be taken off."""
    kind = tiles.schema["mosaic"].dataType.simpleString()
    small = settled(small_planes(tiles, planes, field_downsample(*tile_shape)), "small")
    halves = settled(half_fields(small), "halves")
    common = settled(halves.groupBy("mosaic").applyInPandas(_joined_halves(COMMON.format(m=kind)), COMMON.format(m=kind)), "common")
    counts = tiles.groupBy("mosaic").agg(F.count("*").alias("tiles"))
    axes = edges.groupBy("mosaic").agg(F.count_distinct("axis").alias("axes"))
    span, amplitude = F.col("p95") - F.col("p05"), F.least(F.lit(SCALE_SHARE * full), F.greatest(F.lit(LEAST_SPAN), DYNAMIC_SHARE * F.col("dynamic")))
    early = [
        (F.col("tiles") < FIELD_TILES, "too_few_tiles"),
        (F.coalesce("axes", F.lit(0)) < 2, "one_orientation"),
        (F.col("least_half") < HALF_TILES, "too_few_tiles_in_a_half"),
        ((F.least("row_corr", "col_corr") < AGREEMENT) | (F.greatest("row_off", "col_off") > DISAGREEMENT), "halves_differ"),
        (span < LEAST_SPAN, "below_measurable_amplitude"),
        (F.col("p99") - F.col("p01") > amplitude, "above_safe_amplitude"),
    ]
    base = settled(counts.join(axes, "mosaic", "left").join(common, "mosaic", "left").join(dynamic_ranges(small), "mosaic", "left").withColumn("early", _first(early)), "early")
    on = base.where("early is null").select("mosaic")
    # an edge is judged by the field of the other half: across columns by rows, across rows by columns
    place = tiles.select("mosaic", F.col("tile").alias("a"), "row", "col")
    parity = lambda c: F.concat(F.lit(c), 1 - F.pmod(c, F.lit(2)))
    judged = edges.join(on, "mosaic", "left_semi").join(place, ["mosaic", "a"]).select("mosaic", "a", "b", "axis", F.when(F.col("axis") == "x", parity("row")).otherwise(parity("col")).alias("name"))
    raw = common_samples(small, judged).select("mosaic", "a", "b", "axis", "va", "vb")
    after = common_samples(small, judged, halves.drop("tiles")).select("mosaic", "a", "b", F.col("va").alias("ca"), F.col("vb").alias("cb"))
    schema = SEAM.format(m=kind)

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pairs = [(e, np.asarray(e.va) - np.asarray(e.vb), np.asarray(e.ca) - np.asarray(e.cb)) for e in part.itertuples(index=False) if len(e.va)]
            yield frame([(e.mosaic, e.axis, *seam_record(r, c)) for e, r, c in pairs], schema)

    seams = seams_improve(raw.join(after, ["mosaic", "a", "b"]).mapInPandas(records, schema))
    clip = new_clipping(tiles.join(on, "mosaic", "left_semi"), planes, full, base.select("mosaic", "field_h", "field_w", "field"), None)
    done = base.join(seams, "mosaic", "left").join(clip, "mosaic", "left")
    late = [(F.coalesce("seams", F.lit(0)) < HELD_OUT, "too_few_held_out_edges"), (~F.coalesce("safe", F.lit(False)), "seams_not_better"), (F.col("clipped") > CLIPPED, "clipping")]
    done = settled(done.withColumn("reason", F.coalesce("early", _first(late), F.lit(""))), "field")
    verdicts = done.select("mosaic", F.when(F.col("reason") == "", "applied").otherwise("identity").alias("status"), "reason", "row_corr", "col_corr", "row_off", "col_off", "dynamic", "seams", "raw_bias", "corrected_bias", "clipped")
    return verdicts, done.where("reason = ''").select("mosaic", "field_h", "field_w", "field")


def _first(gates: list[tuple[Column, str]]) -> Column:
    out = F.when(gates[0][0], gates[0][1])
    for when, name in gates[1:]:
        out = out.when(when, name)
    return out


# ---- gains and offsets


LINE = "samples int, slope double, intercept double, correlation double, inlier double, reason string"
OFFSET = "n_train int, n_held int, block int, offset double, held_offset double, train_mad double, held_mad double, reason string"


def line_fits(samples: DataFrame, full: float = 255.0) -> DataFrame:
    """mosaic, a, b, axis and the line that takes b's values to a's, of each edge of common_samples."""
    kinds = {c.name: c.dataType.simpleString() for c in samples.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("mosaic", "a", "b", "axis")) + ", " + LINE

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for e in part.itertuples(index=False):
                numbers, reason, n = line_fit(np.asarray(e.va) / full, np.asarray(e.vb) / full)
                rows.append((e.mosaic, e.a, e.b, e.axis, n, *map(float, numbers[:4]), reason))
            yield frame(rows, schema)

    return samples.select("mosaic", "a", "b", "axis", "va", "vb").mapInPandas(run, schema)


def checker(shape: tuple[int, int]) -> tuple[np.ndarray, int]:
    """Squares of a checkerboard that train (the others are held out), and their side."""
    side = max(4, min(12, min(shape) // 6))
    y, x = np.indices(shape)
    return (y // side + x // side) % 2 == 0, side


def offset_fit(a: np.ndarray, b: np.ndarray, full: float) -> tuple:
    """n_train, n_held, block, the median difference of a and b on training squares and on the others, both deviations, and the
    first gate that fails."""
    nothing = (0.0, 0.0, 0.0, 0.0)
    if min(a.shape, default=0) < 8:
        return 0, 0, 0, *nothing, "offset_overlap_too_small"
    known = np.isfinite(a) & np.isfinite(b)
    valid = known & (a >= 0) & (b >= 0) & (a < full) & (b < full)
    train, side = checker(a.shape)
    parts = [(a - b)[valid & train], (a - b)[valid & ~train]]
    sizes = [len(p) for p in parts]
    if min(sizes) < OFFSET_SAMPLES:
        return *sizes, side, *nothing, "too_few_offset_samples"
    if (known & ((a >= full) | (b >= full))).mean() > 0.05:
        return *sizes, side, *nothing, "saturated_overlap"
    middle = [float(np.median(p)) for p in parts]
    mad = [1.4826 * float(np.median(np.abs(p - m))) for p, m in zip(parts, middle)]
    apart = abs(middle[0] - middle[1]) > max(0.5, 0.25 * sum(mad))
    return *sizes, side, *middle, *mad, "offset_split_disagreement" if apart else ""


def offset_fits(samples: DataFrame, full: float = 255.0) -> DataFrame:
    kinds = {c.name: c.dataType.simpleString() for c in samples.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("mosaic", "a", "b", "axis")) + ", " + OFFSET

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield frame([(e.mosaic, e.a, e.b, e.axis, *offset_fit(image(e.va, e.n_y, e.n_x), image(e.vb, e.n_y, e.n_x), full)) for e in part.itertuples(index=False)], schema)

    return samples.select("mosaic", "a", "b", "axis", "n_y", "n_x", "va", "vb").mapInPandas(run, schema)


def held_out(fits: DataFrame, tiles: DataFrame) -> DataFrame:
    """fits with held: in mosaics of HOLD_FROM edges or more, each fifth edge of an axis, from its third, in the order of places."""
    place = lambda t: tiles.select("mosaic", F.col("tile").alias(t), F.struct("row", "col").alias(t + "_at"))
    order = Window.partitionBy("mosaic", "axis").orderBy(F.least("a_at", "b_at"), F.greatest("a_at", "b_at"))
    out = fits.join(place("a"), ["mosaic", "a"]).join(place("b"), ["mosaic", "b"])
    out = out.withColumn("n", F.count("*").over(Window.partitionBy("mosaic"))).withColumn("k", F.row_number().over(order) - 1)
    return out.withColumn("held", (F.col("n") >= HOLD_FROM) & (F.col("k") % 5 == 2)).drop("a_at", "b_at", "n", "k")


def parts_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of nodes in each node's part of a graph."""
    part = np.arange(n)
    while True:
        low = part.copy()
        np.minimum.at(low, a, part[b])
        np.minimum.at(low, b, part[a])
        low = low[low]
        if (low == part).all():
            return np.bincount(part, minlength=n)[part]
        part = low


SOLVED = "mosaic {m}, tile {t}, gain double, offset double, prior double, kept boolean"


def _graph_solution(schema: str, full: float, offsets_only: bool):
    """Gains and offsets of a mosaic with the least prior that keeps all within bounds (none: no rows); small parts stay as they are."""

    def run(tiles: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if not len(tiles) or not len(fits):
            return frame([], schema)
        tiles = tiles.sort_values(["row", "col"]).reset_index(drop=True)
        fits = fits.sort_values(["a", "b"])
        at = {t: k for k, t in enumerate(tiles["tile"])}
        a, b = (fits[c].map(at).to_numpy(int) for c in ("a", "b"))
        n, weight, bound = len(tiles), fits["weight"].to_numpy(float), float(tiles["bound"].iloc[0])

        def solved(values: np.ndarray, prior: float) -> np.ndarray:
            return graph.solve(a, b, values[:, None], weight, np.zeros((n, 1)), hold=prior, anchor=0.0, limit=graph.scalar_limit(values), signed=True)[:, 0]

        for prior in OFFSET_PRIORS if offsets_only else PRIORS:
            if offsets_only:
                logs, offsets = np.zeros(n), solved(fits["offset"].to_numpy(float), prior)
            else:
                logs = solved(np.log(fits["slope"].to_numpy(float)), prior)
                offsets = solved(np.exp(logs[a]) * fits["intercept"].to_numpy(float) * full, prior)
            if np.abs(logs).max() <= np.log(MOST_GAIN) and np.abs(offsets).max() <= bound:
                break
        else:
            return frame([], schema)
        kept = parts_of(n, a, b) >= (PART_TILES if n >= PART_FROM else SMALL_PART)
        rows = zip(tiles["mosaic"], tiles["tile"], np.where(kept, np.exp(logs), 1.0), np.where(kept, offsets, 0.0), [prior] * n, kept)
        return frame(list(rows), schema)

    return run


def _validated(samples: DataFrame, gains: DataFrame, squares: bool) -> DataFrame:
    """Seam records of samples before and after gains; squares: on held-out squares alone."""
    kind = samples.schema["mosaic"].dataType.simpleString()
    schema = SEAM.format(m=kind)
    side = lambda t: gains.select("mosaic", F.col("tile").alias(t), F.col("gain").alias(t + "g"), F.col("offset").alias(t + "o"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for e in part.itertuples(index=False):
                a, b = image(e.va, e.n_y, e.n_x), image(e.vb, e.n_y, e.n_x)
                use = np.isfinite(a) & np.isfinite(b)
                if squares and a.size:
                    use &= ~checker(a.shape)[0]
                if use.sum() >= VALIDATION_SAMPLES:
                    a, b = a[use], b[use]
                    rows.append((e.mosaic, e.axis, *seam_record(a - b, e.ag * a + e.ao - e.bg * b - e.bo)))
            yield frame(rows, schema)

    return samples.join(side("a"), ["mosaic", "a"]).join(side("b"), ["mosaic", "b"]).mapInPandas(run, schema)


def _attempt(tiles: DataFrame, planes: DataFrame, samples: DataFrame, training: DataFrame, judged: DataFrame, fields: DataFrame | None, full: float, mode: str) -> tuple[DataFrame, DataFrame]:
    """(gains, verdicts) of one mode: solve, validate, and look for clipping."""
    kinds = {c.name: c.dataType.simpleString() for c in tiles.schema}
    schema = SOLVED.format(m=kinds["mosaic"], t=kinds["tile"])
    gains = settled(tiles.groupBy("mosaic").cogroup(training.groupBy("mosaic")).applyInPandas(_graph_solution(schema, full, mode == "offset"), schema), mode)
    tested = samples.join(judged.select("mosaic", "a", "b"), ["mosaic", "a", "b"], "left_semi")
    seams = seams_improve(_validated(tested, gains, mode == "offset"))
    clip = new_clipping(tiles.join(gains.select("mosaic").distinct(), "mosaic", "left_semi"), planes, full, fields, gains)
    solved = gains.groupBy("mosaic").agg(F.first("prior").alias("prior"), F.count_if(~F.col("kept")).alias("left_alone"), F.max((F.abs(F.col("gain") - 1) > 1e-4) | (F.abs("offset") > 1e-3)).alias("moved"))
    some = training.groupBy("mosaic").agg(F.count("*").alias("edges"))
    out = tiles.select("mosaic").distinct().join(some, "mosaic", "left").join(solved, "mosaic", "left").join(seams, "mosaic", "left").join(clip, "mosaic", "left")
    reason = _first([(F.col("edges").isNull(), "no_accepted_edges"), (F.col("prior").isNull(), "no_bounded_solution"), (F.col("seams").isNull(), "no_validation"), (~F.col("safe"), "seams_not_better"), (F.col("clipped") > CLIPPED, "clipping")])
    return gains, settled(out.withColumn("reason", F.coalesce(reason, F.lit(""))), mode + "_verdict")


def radiometric_model(tiles: DataFrame, planes: DataFrame, edges: DataFrame, tile_shape: tuple[int, int], fields: DataFrame | None = None, full: float = 255.0) -> tuple[DataFrame, DataFrame]:
    """(verdicts, gains). Gains and offsets where lines fit, else offsets alone where they are steady, else nothing.

    verdicts(mosaic, mode, affine_reason, offset_reason, edges, prior, left_alone, seams, raw_bias, corrected_bias, clipped): mode is
    affine, offset or identity. gains(mosaic, tile, gain, offset) has a row each tile of the mosaics that are corrected; fields of
    spatial_field are taken off first."""
    small = settled(small_planes(tiles, planes, radiometric_downsample(*tile_shape)), "radiometric")
    samples = settled(common_samples(small, edges.select("mosaic", "a", "b", "axis"), fields), "samples")
    bound = dynamic_ranges(small).select("mosaic", F.least(F.lit(SCALE_SHARE * full), F.greatest(F.lit(1.0), DYNAMIC_SHARE * F.col("dynamic"))).alias("bound"))
    bounded = settled(tiles.select("mosaic", "tile", "row", "col", "h", "w").join(bound, "mosaic"), "bounds")
    lines = line_fits(samples, full).where("reason = ''")
    confidence = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("correlation") ** 2 * F.col("inlier") * F.least(F.lit(1.0), F.col("samples") / 4096)))
    lines = settled(held_out(lines, tiles).withColumn("weight", confidence), "lines")
    any_held = lines.groupBy("mosaic").agg(F.max("held").alias("any_held"))
    judged = lines.join(any_held, "mosaic").where(F.col("held") | ~F.col("any_held"))
    gains, affine = _attempt(bounded, planes, samples, lines.where("not held"), judged, fields, full, "affine")
    failed = bounded.join(affine.where("reason <> ''").select("mosaic"), "mosaic", "left_semi")
    steady = offset_fits(samples.join(failed.select("mosaic").distinct(), "mosaic", "left_semi"), full).where("reason = ''").join(bound, "mosaic").where(F.abs("offset") <= 2 * F.col("bound")).drop("bound")
    stability = F.least(F.lit(1.0), F.col("n_train") / 4096) / (1 + F.abs(F.col("offset") - F.col("held_offset")) + 0.15 * F.col("held_mad"))
    steady = settled(steady.withColumn("weight", F.greatest(F.lit(0.05), stability)), "steady")
    shifts, offset = _attempt(failed, planes, samples, steady, steady, fields, full, "offset")
    names = ["edges", "prior", "left_alone", "seams", "raw_bias", "corrected_bias", "clipped"]
    second = offset.select("mosaic", F.col("reason").alias("offset_reason"), F.col("moved").alias("offset_moved"), *[F.col(c).alias("o_" + c) for c in names])
    both = affine.withColumnRenamed("reason", "affine_reason").join(second, "mosaic", "left")
    mode = F.when((F.col("affine_reason") == "") & F.col("moved"), "affine").when((F.col("offset_reason") == "") & F.col("offset_moved"), "offset").otherwise("identity")
    pick = [F.when(F.col("affine_reason") == "", F.col(c)).otherwise(F.col("o_" + c)).alias(c) for c in names]
    verdicts = settled(both.select("mosaic", mode.alias("mode"), "affine_reason", "offset_reason", *pick), "radiometry")
    take = lambda df, name: df.join(verdicts.where(F.col("mode") == name).select("mosaic"), "mosaic", "left_semi").select("mosaic", "tile", "gain", "offset")
    return verdicts, take(gains, "affine").unionByName(take(shifts, "offset"))
