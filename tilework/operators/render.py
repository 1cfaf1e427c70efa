"""Rendering of mosaics in blocks: tiles at fractional origins, corrected by gain, offset and field, blended.

A tile is cut by the blocks that it touches in the task that holds it, so of its pixels each block is sent only those that
it shows; blocks then gather their pieces (as many as tiles overlap there) and blend them. Neither a mosaic nor a row of
blocks is ever in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.operators.planes import frame, image, sampled, stretched, with_parameters
from tilework.operators.registration import plane_block_mean

BLOCK = 256
PIECE = "by int, bx int, tile {t}, y0 int, x0 int, h int, w int, v array<double>, k array<double>"
DONE = "by int, bx int, gy0 int, gx0 int, h int, w int, v array<double>"


def _support(origin: float, n: int, f: int) -> tuple[int, int]:
    """The output pixels along an axis that a tile of n pixels shows: those whose centres lie in its pixels' squares."""
    return max(0, int(np.ceil((origin - 0.5) / f))), int(np.ceil((origin + n - 0.5) / f))


def _pieces(keys: list[str], block: int, kind: str, f: int, schema: str):
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for t in part.itertuples(index=False):
                plane = plane_block_mean(image(t.v, t.h, t.w), f)
                sh, sw = plane.shape
                (top, bottom), (left, right) = _support(t.oy, t.h, f), _support(t.ox, t.w, f)
                field = None if kind == "nearest" or t.field is None else stretched(image(t.field, t.field_h, t.field_w), sh, sw)
                rows = []
                for by in range(top // block, (bottom - 1) // block + 1):
                    for bx in range(left // block, (right - 1) // block + 1):
                        y0, x0 = max(top, by * block), max(left, bx * block)
                        ys = np.arange(y0, min(bottom, (by + 1) * block)) - t.oy / f
                        xs = np.arange(x0, min(right, (bx + 1) * block)) - t.ox / f
                        if kind == "nearest":
                            v = plane[np.ix_(*(np.clip(np.floor(c + 0.5).astype(int), 0, n - 1) for c, n in ((ys, sh), (xs, sw))))]
                        else:
                            v = sampled(plane, ys, xs)
                            if field is not None:
                                v = v - sampled(field, ys, xs)
                            v = v * t.gain + t.offset
                        weight = np.minimum(np.minimum(ys + 1, sh - ys)[:, None], np.minimum(xs + 1, sw - xs)) / max(1.0, min(sh, sw) / 2)
                        rows.append((*(getattr(t, k) for k in keys), by, bx, t.tile, y0, x0, *v.shape, v.ravel(), weight.ravel()))
                yield frame(rows, schema)

    return cut


def _blended(keys: list[str], kind: str, low: float | None, high: float | None, schema: str):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("tile")
        y0, x0 = int(pieces["y0"].min()), int(pieces["x0"].min())
        h, w = int((pieces["y0"] + pieces["h"]).max()) - y0, int((pieces["x0"] + pieces["w"]).max()) - x0
        total, weight = np.zeros((h, w)), np.full((h, w), -1.0 if kind == "nearest" else 0.0)
        for p in pieces.itertuples(index=False):
            at = np.s_[p.y0 - y0 : p.y0 - y0 + p.h, p.x0 - x0 : p.x0 - x0 + p.w]
            v, k = image(p.v, p.h, p.w), image(p.k, p.h, p.w)
            good = np.isfinite(v)
            if kind == "nearest":
                better = good & (k > weight[at])
                total[at] = np.where(better, v, total[at])
                weight[at] = np.where(better, k, weight[at])
            else:
                total[at] += np.where(good, v * k, 0.0)
                weight[at] += np.where(good, k, 0.0)
        out = total if kind == "nearest" else np.divide(total, weight, out=np.zeros((h, w)), where=weight > 0)
        if low is not None:
            out = np.clip(np.rint(out), low, high)
        first = pieces.iloc[0]
        return frame([(*first[keys], first["by"], first["bx"], y0, x0, h, w, out.ravel())], schema)

    return run


def render(tiles: DataFrame, planes: DataFrame, *, keys: tuple[str, ...] = ("mosaic",), block: int = BLOCK, kind: str = "feather", downsample: int = 1, gains: DataFrame | None = None, fields: DataFrame | None = None, depth: tuple[float, float] | None = (0, 255)) -> DataFrame:
    """Blocks (keys, by, bx, gy0, gx0, h, w, v) of the mosaics of tiles(keys, tile, oy, ox, h, w) with
    planes(keys, tile, v); keys tell mosaics apart. A block's rectangle is what its tiles cover; where none does, there is
    no block.

    kind: "feather" (bilinear samples, weighted by the distance to the tile's edge) or "nearest" (the source's own values, of the
    tile whose edge is farthest; the first tile of equals; never corrected). gains(keys, tile, gain, offset) default to 1 and 0;
    fields(keys, field_h, field_w, field: array) is subtracted first, stretched over each tile. Both are broadcast if
    counted to be small. Values that are not finite have no part; pixels without any are 0. depth: the range that values are
    rounded and clipped to; None leaves them as they are. Tiles without a plane are left out."""
    if kind not in ("feather", "nearest"):
        raise ValueError(f"kind: {kind}")
    keys = list(keys)
    rows = tiles.select(*keys, "tile", "oy", "ox", "h", "w")
    if gains is not None and kind == "feather":
        rows = with_parameters(rows, gains.select(*keys, "tile", "gain", "offset"), [*keys, "tile"])
    else:
        rows = rows.withColumn("gain", F.lit(1.0)).withColumn("offset", F.lit(0.0))
    rows = rows.withColumn("gain", F.coalesce(F.col("gain").cast("double"), F.lit(1.0))).withColumn("offset", F.coalesce(F.col("offset").cast("double"), F.lit(0.0)))
    if fields is not None and kind == "feather":
        rows = with_parameters(rows, fields.select(*keys, "field_h", "field_w", "field"), keys)
    else:
        rows = rows.selectExpr("*", "cast(null as int) AS field_h", "cast(null as int) AS field_w", "cast(null as array<double>) AS field")
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema}
    lead = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", "
    piece, done = lead + PIECE.format(t=kinds["tile"]), lead + DONE
    cut = rows.join(planes.select(*keys, "tile", F.col("v").cast("array<double>").alias("v")), [*keys, "tile"]).mapInPandas(_pieces(keys, block, kind, downsample, piece), piece)
    low, high = depth or (None, None)
    return cut.groupBy(*keys, "by", "bx").applyInPandas(_blended(keys, kind, low, high, done), done)
