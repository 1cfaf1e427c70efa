"""Operators on pixel relations as DataFrame functions: blends, stencils, projections through a stack, block reductions.

Pixels are rows (tile keys, y, x, v); images as large as they like stay distributed by tile or output block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.sources.tiles import PITCH, SIDE


def feather_weight(y: Column, x: Column, h: int = SIDE, w: int = SIDE) -> Column:
    """Distance to the nearest edge, from 1."""
    return F.least(y + 1, F.lit(h) - y, x + 1, F.lit(w) - x).cast("double")


def on_canvas(px: DataFrame, pitch: int = PITCH) -> DataFrame:
    """Adds canvas coordinates gy, gx and the feather weight w."""
    return px.withColumn("gy", F.col("trow") * pitch + F.col("y")).withColumn("gx", F.col("tcol") * pitch + F.col("x")).withColumn("w", feather_weight(F.col("y"), F.col("x")))


def feather_blend(px: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean per canvas pixel, rounded half to even; one aggregation, partial before the shuffle."""
    good = F.when(F.col("v").isNotNull(), F.col("w"))
    mean = F.sum(good * F.col("v")) / F.sum(good)
    return px.groupBy(*keys).agg(F.coalesce(F.rint(mean), F.lit(0)).cast("int").alias("v"))


def nearest_blend(px: DataFrame, keys: list[str], order: str = "vec_id") -> DataFrame:
    """The value of the tile with the largest weight; the first tile wins ties."""
    return px.groupBy(*keys).agg(F.max_by("v", F.struct(F.col("w"), -F.col(order))).alias("v"))


def blocks_of_tiles(tiles: DataFrame, block: int) -> DataFrame:
    """tiles(oy, ox, h, w) by the output blocks they touch: a range join as an explode and an equality join."""
    def covered(start: str, size: str) -> Column:
        return F.sequence(F.floor(F.col(start) / block), F.floor((F.col(start) + F.col(size) - 1) / block))

    return tiles.withColumn("by", F.explode(covered("oy", "h"))).withColumn("bx", F.explode(covered("ox", "w")))


def laplacian(px: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Five-point Laplacian, zero on the border."""
    rows, columns = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    inner = F.lag(v).over(rows) + F.lead(v).over(rows) + F.lag(v).over(columns) + F.lead(v).over(columns) - 4 * F.col(v)
    return px.withColumn("lap", F.coalesce(inner, F.lit(0)))


def box_sum(px: DataFrame, keys: list[str], k: int, v: str = "v", h: int = SIDE, w: int = SIDE) -> DataFrame:
    """Sums over 2k x 2k windows at offsets -(k-1)..k with replicated edges, one axis after the other: each pixel is sent to
    the window centres it belongs to, with its multiplicity there, so no window needs its neighbours' rows."""

    def spread(df: DataFrame, axis: str, n: int, value: str) -> DataFrame:
        centre = F.sequence(F.greatest(F.col(axis) - k, F.lit(0)), F.least(F.col(axis) + k - 1, F.lit(n - 1)))
        centre = F.when(F.col(axis) == 0, F.sequence(F.lit(0), F.least(F.lit(k - 1), F.lit(n - 1)))).when(F.col(axis) == n - 1, F.sequence(F.greatest(F.lit(n - 1 - k), F.lit(0)), F.lit(n - 1))).otherwise(centre)
        out = df.withColumn("c", F.explode(centre))
        low = F.greatest(F.lit(0), k - 1 - F.col("c")) * (F.col(axis) == 0).cast("int")
        high = F.greatest(F.lit(0), F.col("c") + k - (n - 1)) * (F.col(axis) == n - 1).cast("int")
        other = "x" if axis == "y" else "y"
        return out.groupBy(*keys, other, F.col("c").alias("_c")).agg(F.sum(F.col(value) * (1 + low + high)).alias("s")).withColumnRenamed("_c", axis)

    return spread(spread(px, "x", w, v), "y", h, "s")


def focus_fusion(px: DataFrame, keys: list[str], window: int = 2) -> DataFrame:
    """Per pixel the slice with the most smoothed Laplacian energy; the earliest slice wins ties."""
    energy = laplacian(px, [*keys, "z"]).withColumn("e", F.col("lap") * F.col("lap"))
    score = box_sum(energy, [*keys, "z"], window, "e").withColumnRenamed("s", "score")
    best = F.struct("score", -F.col("z"))
    return px.join(score, [*keys, "z", "y", "x"]).groupBy(*keys, "y", "x").agg(F.max_by("v", best).alias("v"), F.max_by("z", best).alias("z"))


def block_mean(px: DataFrame, keys: list[str], f: int, h: int = SIDE, w: int = SIDE) -> DataFrame:
    """Means of f x f blocks with the last row and column replicated into partial blocks, rounded half to even."""
    def times(axis: str, n: int) -> Column:
        return F.when(F.col(axis) == n - 1, F.lit(1 + (-n) % f)).otherwise(1)

    m = times("y", h) * times("x", w)
    return px.groupBy(*keys, F.expr(f"y div {f}").cast("int").alias("by"), F.expr(f"x div {f}").cast("int").alias("bx")).agg(F.rint(F.sum(F.col("v") * m) / (f * f)).cast("int").alias("v"))


def neighbours(tiles: DataFrame) -> DataFrame:
    """(a, b, axis) for tiles(id, row, col): right and lower neighbours; an equality self-join."""
    b = tiles.select(F.col("id").alias("b"), F.col("row").alias("r"), F.col("col").alias("c"))
    step = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit("y").alias("axis"), F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    a = tiles.select(F.col("id").alias("a"), "row", "col", step.alias("s")).select("a", (F.col("row") + F.col("s.dr")).alias("r"), (F.col("col") + F.col("s.dc")).alias("c"), "s.axis")
    return a.join(b, ["r", "c"]).select("a", "b", "axis")


def overlaps(px: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, axis, gy, gx, va, vb): pixels that two neighbours share, met on canvas coordinates."""
    a = px.select(F.col("vec_id").alias("a"), "gy", "gx", F.col("v").alias("va"))
    b = px.select(F.col("vec_id").alias("b"), "gy", "gx", F.col("v").alias("vb"))
    return edges.join(a, "a").join(b, ["b", "gy", "gx"])


def plane_overlaps(planes: DataFrame, pitch: int = PITCH, side: int = SIDE) -> DataFrame:
    """overlaps of planes(id, row, col, v), a row an edge: (a, b, axis, va, vb) with arrays of the shared pixels. Of each plane only
    the strips that neighbours share are sent, and they meet once, by place."""
    v, n = F.col("v"), side - pitch
    strip = lambda axis, r, c, of: F.struct(F.lit(axis).alias("axis"), r.alias("r"), c.alias("c"), of.alias("v"))
    row, col = F.col("row"), F.col("col")
    a = F.array(strip("x", row, col + 1, F.filter(v, lambda e, p: p % side >= pitch)), strip("y", row + 1, col, F.slice(v, pitch * side + 1, n * side)))
    b = F.array(strip("x", row, col, F.filter(v, lambda e, p: p % side < n)), strip("y", row, col, F.slice(v, 1, n * side)))
    ends = [planes.select(F.col("id").alias(t), F.explode(s).alias("s")).select(t, "s.axis", "s.r", "s.c", F.col("s.v").alias("v" + t)) for t, s in (("a", a), ("b", b))]
    shared = F.least(F.size("va"), F.size("vb"))  # a plane that ends early lacks its last pixels
    return ends[0].join(ends[1], ["axis", "r", "c"]).where(shared > 0).select("a", "b", "axis", F.slice("va", 1, shared).alias("va"), F.slice("vb", 1, shared).alias("vb"))
