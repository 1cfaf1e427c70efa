"""Stitching of wells and plates: stacks are reduced, shading is divided out, steps measured and mosaics rendered.

A plate's wells are worked on side by side. What the wells before have measured reaches a well by a window over the ordered
wells, not by a loop: measured steps do not depend on what is inherited, so a running median gives each well its prior, and
a well that finds none takes the whole plate's in a second pass, which is a join. A well without a readable reference plane is
a row with the status failed; no well fails another.

slices(well, channel, tile, row, col, z, h, w, v): a row a file; v is null where it can't be read. A task holds one tile's stack,
or the rows of all tiles of a well at one height, or one plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.operators import render, steps
from tilework.operators.planes import box_mean, frame, image
from tilework.operators.registration import plane_laplacian
from tilework.operators.tables import settled

# The channel that geometry is measured on, the half window of sharpness, tiles that a flat field needs, its
# smoothing as a share of a side, its range, the turnover of content that shading needs to be told from specimen.
REFERENCE = "CH4"
FOCUS = 5
FLAT_TILES, FLAT_SHARE, FLAT_RANGE = 4, 0.12, (0.2, 5.0)
TURNOVER = 0.4
MODES = ("max", "mean", "focus", "middle")


def fused(stack: list[np.ndarray], mode: str) -> np.ndarray:
    """One plane of a stack in order of z, cut to the size that all slices have."""
    h, w = (min(s.shape[k] for s in stack) for k in (0, 1))
    cube = np.stack([s[:h, :w] for s in stack])
    if mode == "max":
        return cube.max(axis=0)
    if mode == "mean":
        return cube.mean(axis=0)
    if mode == "middle" or len(stack) == 1:
        return cube[len(stack) // 2]
    sharp = np.stack([box_mean(plane_laplacian(s) ** 2, FOCUS) for s in cube])
    return np.take_along_axis(cube, sharp.argmax(axis=0)[None], 0)[0]


def reduced(slices: DataFrame, mode: str = "max") -> DataFrame:
    """planes(well, channel, tile, row, col, h, w, v, slices) of the readable slices of each tile."""
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")
    kinds = {f.name: f.dataType.simpleString() for f in slices.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("well", "channel", "tile", "row", "col")) + ", h int, w int, v array<float>, slices int"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("z")
        out = fused([image(s.v, s.h, s.w) for s in group.itertuples(index=False)], mode)
        first = group.iloc[0]
        return frame([(*first[["well", "channel", "tile", "row", "col"]], *out.shape, out.ravel().astype(np.float32), len(group))], schema)

    good = slices.where("v is not null").select("well", "channel", "tile", "row", "col", "z", "h", "w", F.col("v").cast("array<float>").alias("v"))
    return good.groupBy("well", "channel", "tile").applyInPandas(run, schema)


def every_nth(slices: DataFrame, n: int) -> DataFrame:
    """Each n-th z of a well, from its first."""
    zs = slices.select("well", "z").distinct().withColumn("at", F.row_number().over(Window.partitionBy("well").orderBy("z")) - 1).where(F.col("at") % max(1, n) == 0)
    return slices.join(zs.select("well", "z"), ["well", "z"], "left_semi")


def flat_fields(planes: DataFrame) -> DataFrame:
    """(well, channel, field_h, field_w, field): shading to divide by, of channels with FLAT_TILES planes or more.

    Tiles are cut into rows; rows of one height meet, and give both quartiles of each pixel. Bright objects on dark ground
    (mean above median) leave the ground to the lower one, dark objects to the upper. The profile is smoothed, has mean 1 and is
    kept in FLAT_RANGE; a profile without light is 1."""
    kinds = {f.name: f.dataType.simpleString() for f in planes.schema}
    lead = f"well {kinds['well']}, channel {kinds['channel']}, "
    common = planes.groupBy("well", "channel").agg(F.min("h").alias("ch"), F.min("w").alias("cw"), F.count("*").alias("tiles")).where(F.col("tiles") >= FLAT_TILES)
    rows = planes.join(common, ["well", "channel"]).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ch") - 1)))
    rows = rows.select("well", "channel", "y", F.slice("v", F.col("y") * F.col("w") + 1, F.col("cw")).alias("r"))
    low_high = lead + "y int, low array<double>, high array<double>, total double, n long, counts array<struct<v:double,n:long>>"

    def quartiles(group: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack(group["r"].to_list()).astype(float)
        low, high = np.percentile(stack, (25, 75), axis=0)
        values, counts = np.unique(stack, return_counts=True)
        first = group.iloc[0]
        return frame([(first["well"], first["channel"], first["y"], low, high, float(stack.sum()), stack.size, [{"v": float(v), "n": int(n)} for v, n in zip(values, counts)])], low_high)

    lines = settled(rows.groupBy("well", "channel", "y").applyInPandas(quartiles, low_high), "quartiles")
    median = lines.select("well", "channel", F.explode("counts").alias("c")).groupBy("well", "channel").agg(F.percentile("c.v", 0.5, F.col("c.n")).alias("median"))
    profile = lines.groupBy("well", "channel").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sort_array(F.collect_list(F.struct("y", "low", "high"))).alias("lines")).join(median, ["well", "channel"])
    profile = profile.select("well", "channel", F.size("lines").alias("field_h"), F.size(F.col("lines")[0]["low"]).alias("field_w"), F.flatten(F.transform("lines", lambda e: F.when(F.col("mean") > F.col("median"), e["low"]).otherwise(e["high"]))).alias("field"))
    schema = lead + "field_h int, field_w int, field array<double>"

    def smooth(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for p in part.itertuples(index=False):
                field = box_mean(image(p.field, p.field_h, p.field_w), max(3, int(min(p.field_h, p.field_w) * FLAT_SHARE)))
                mean = field.mean()
                field = np.clip(field / mean, *FLAT_RANGE) if np.isfinite(mean) and mean > 1e-6 else np.ones(field.shape)
                out.append((p.well, p.channel, p.field_h, p.field_w, field.ravel()))
            yield frame(out, schema)

    return profile.mapInPandas(smooth, schema)


def flattened(planes: DataFrame, fields: DataFrame) -> DataFrame:
    """planes divided by their channel's field. Field entries that are not finite and positive, and fields of another size, count as 1."""
    both = planes.join(fields, ["well", "channel"], "left")
    safe = lambda f: F.when(f.isNotNull() & ~F.isnan(f) & (f > 0) & (f < float("inf")), f).otherwise(1.0)
    fits = (F.col("field_h") == F.col("h")) & (F.col("field_w") == F.col("w"))
    v = F.when(fits, F.zip_with("v", "field", lambda v, f: (v / safe(f)).cast("float"))).otherwise(F.col("v"))
    return both.withColumn("v", v).withColumn("flat", F.col("field").isNotNull()).drop("field", "field_h", "field_w")


def reference_channel(slices: DataFrame) -> DataFrame:
    """(well, channel): the reference channel, or the first by name."""
    named = F.struct(F.upper("channel") != REFERENCE, F.col("channel").alias("channel"))
    return slices.groupBy("well").agg(F.min(named)["channel"].alias("channel"))


def plate_steps(measured: DataFrame) -> DataFrame:
    """(plate, axis, py, px, n, spread): the median of the confident steps of a plate's wells, and how far they scatter."""
    good = measured.where(F.col("score") >= steps.LEAST_SCORE)
    middle = lambda c, name: F.percentile(c, 0.5).cast("int").alias(name)
    return good.groupBy("plate", "axis").agg(middle("dy", "py"), middle("dx", "px"), F.count("*").alias("n"), F.greatest(F.stddev_pop("dy"), F.stddev_pop("dx")).alias("spread"))


def inherited(wells: DataFrame, measured: DataFrame) -> DataFrame:
    """well, axis, py, px for wells(well, plate): the median of the confident steps of the plate's wells before it; where a
    well would have to lay tiles side by side on either axis, that of all its wells on both. Ordered by plate, a plate's wells
    in one task."""
    both = wells.select("well", "plate").withColumn("axis", F.explode(F.array(F.lit("x"), F.lit("y")))).join(measured.select("well", "axis", "dy", "dx", "score"), ["well", "axis"], "left")
    good = F.col("score") >= steps.LEAST_SCORE
    before = Window.partitionBy("plate", "axis").orderBy("well").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("plate", "axis")
    middle = lambda c, over: F.percentile(F.when(good, F.col(c)), 0.5).over(over).cast("int")
    out = both.select("well", "axis", good.alias("good"), *[middle(c, w).alias(n) for c, w, n in (("dy", before, "by"), ("dx", before, "bx"), ("dy", whole, "ay"), ("dx", whole, "ax"))])
    lacks = F.max(~F.coalesce("good", F.lit(False)) & F.col("by").isNull()).over(Window.partitionBy("well"))
    return out.withColumn("deferred", lacks).select("well", "axis", F.when(F.col("deferred"), F.col("ay")).otherwise(F.col("by")).alias("py"), F.when(F.col("deferred"), F.col("ax")).otherwise(F.col("bx")).alias("px"), "deferred")


def lattice(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """tiles(well, tile, row, col) with oy, ox: multiples of their well's steps, moved so that the least is 0."""
    per = found.groupBy("well").agg(*[F.max(F.when(F.col("axis") == a, F.col(c))).alias(a + c) for a in "xy" for c in ("dy", "dx")])
    well = Window.partitionBy("well")
    i, j = F.col("col") - F.min("col").over(well), F.col("row") - F.min("row").over(well)
    placed = tiles.join(per, "well").withColumn("oy", i * F.col("xdy") + j * F.col("ydy")).withColumn("ox", i * F.col("xdx") + j * F.col("ydx"))
    low = [(F.col(c) - F.min(c).over(well)).cast("double").alias(c) for c in ("oy", "ox")]
    return placed.select("well", "tile", "row", "col", *low)


class Stitched:
    """A plate's geometry and what is made of it. Nothing is held but the names of tables."""

    def __init__(self, slices: DataFrame, mode: str = "max", flat: bool = True, fine: bool = True, plate: Column | None = None, z_step: int = 1):
        """plate: an expression on slices that names a well's plate; all are one without it. mode "stack" measures on the
        sharpest pixels of each z_step-th slice and renders these slices; the others render one reduced plane."""
        self.stack = mode == "stack"
        named = slices.withColumn("plate", F.lit("") if plate is None else plate)
        self.plates = named.groupBy("well").agg(F.min("plate").alias("plate"))
        self.slices = every_nth(slices, z_step) if self.stack else slices
        planes = settled(reduced(self.slices, "focus" if self.stack else mode), "planes")
        self.fields = settled(flat_fields(planes), "fields") if flat else None
        self.planes = settled(flattened(planes, self.fields), "flat") if flat else planes.withColumn("flat", F.lit(False))
        self.chosen = reference_channel(slices)
        ref = self.planes.join(self.chosen, ["well", "channel"])
        self.pairs = steps.pairs(ref.select("well", "tile", "row", "col"), ref.select("well", "tile", "h", "w", "v"))
        self.ranks = settled(steps.ranked(steps.candidates(self.pairs)), "candidates")
        self.measured = settled(steps.consensus(steps.voting(self.ranks)), "steps")
        self.sizes = ref.groupBy("well").agg(F.min("h").alias("h"), F.min("w").alias("w"), F.count("*").alias("tiles"))
        read = self.plates.join(self.sizes, "well")
        prior = inherited(read, self.measured)
        self.steps = settled(steps.with_fallback(read.select("well", "h", "w"), self.measured, prior), "geometry")
        self.tiles = settled(lattice(slices.select("well", "tile", "row", "col").distinct(), self.steps), "tiles")
        self.fine = steps.fine_steps(self.pairs, self.ranks) if fine else self.ranks.where("rank = 1 and not ambiguous").select("well", "a", "b", "axis", F.col("dy").cast("double"), F.col("dx").cast("double"), "score")

    def mosaics(self, block: int = render.BLOCK, depth: tuple[float, float] | None = (0, 255)) -> DataFrame:
        """Blocks of each well and channel (and z, of stacks) that was read. Slices that can't be read are blank."""
        if not self.stack:
            at = self.planes.select("well", "channel", "tile", "h", "w").join(self.tiles, ["well", "tile"])
            return render.render(at, self.planes, keys=("well", "channel"), block=block, depth=depth)
        good = self.slices.where("v is not null").select("well", "channel", "tile", "z", "h", "w", F.col("v").cast("array<float>").alias("v"))
        if self.fields is not None:
            good = flattened(good, self.fields)
        at = good.select("well", "channel", "tile", "z", "h", "w").join(self.tiles, ["well", "tile"])
        return render.render(at, good, keys=("well", "channel", "z"), block=block, depth=depth)

    def report(self) -> DataFrame:
        """A row a well: status, steps and where they come from, overlaps, what could not be read, how well the edges agree, and
        the differences that ask for a second look."""
        wide = self.steps.groupBy("well").agg(*[F.max(F.when(F.col("axis") == a, F.col(c))).alias(n) for a in "xy" for c, n in (("dy", f"step_{a}_dy"), ("dx", f"step_{a}_dx"), ("score", f"peak_{a}"), ("source", f"source_{a}"), ("py", f"prior_{a}_dy"), ("px", f"prior_{a}_dx"))])
        bad = self.slices.groupBy("well").agg(F.count_if(F.col("v").isNull()).alias("unreadable"))
        flat = self.planes.groupBy("well").agg(F.max("flat").alias("flatfield"))
        extent = self.tiles.join(self.sizes, "well").groupBy("well").agg((F.max("oy") + F.max("h")).cast("int").alias("height"), (F.max("ox") + F.max("w")).cast("int").alias("width"))
        edge = self.fine.join(self.steps.select("well", "axis", F.col("dy").alias("sy"), F.col("dx").alias("sx")), ["well", "axis"])
        off = F.hypot(F.col("dy") - F.col("sy"), F.col("dx") - F.col("sx"))
        edges = edge.groupBy("well").agg(F.count("*").alias("edges"), F.round(F.percentile(off, 0.5), 2).alias("residual_median"), F.round(F.percentile(off, 0.95), 2).alias("residual_p95"), F.round(F.max(off), 2).alias("residual_max"), F.round(F.percentile("score", 0.5), 3).alias("ncc_median"), F.round(F.min("score"), 3).alias("ncc_min"))
        pairs = self.pairs.groupBy("well").agg(F.count("*").alias("pairs"))
        out = self.plates
        for more in (self.sizes, wide, bad, flat, extent, edges, pairs):
            out = out.join(more, "well", "left")
        away = F.greatest(*[F.abs(F.col(f"step_{a}_{c}") - F.col(f"prior_{a}_{c}")) for a in "xy" for c in ("dy", "dx")])
        sure = (F.col("source_x") == "measured") & (F.col("source_y") == "measured")
        return out.withColumn("status", F.when(F.col("tiles").isNull(), F.lit("failed")).otherwise("ok")).withColumn("edges", F.coalesce("edges", F.lit(0))).withColumn("ambiguous_edges", F.coalesce("pairs", F.lit(0)) - F.col("edges")).withColumn("overlap_x", F.col("w") - F.abs("step_x_dx")).withColumn("overlap_y", F.col("h") - F.abs("step_y_dy")).withColumn("step_deviation", F.when(F.col("prior_x_dx").isNotNull(), F.round(away.cast("double"), 1))).withColumn("shading_identifiable", F.abs("step_x_dx") / F.greatest(F.lit(1), F.col("w")) >= TURNOVER).withColumn("low_confidence", ~sure).drop("pairs", "prior_x_dy", "prior_x_dx", "prior_y_dy", "prior_y_dx")


def stitch_plate(slices: DataFrame, **how) -> Stitched:
    return Stitched(slices, **how)
