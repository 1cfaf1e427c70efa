"""Rendering against planted ramps: fractional origins, gain, offset, field, gaps and block sizes."""

import numpy as np
import pytest

from tilework.operators import planes as P
from tilework.operators import render

ORIGINS = {0: (0.0, 0.25), 1: (0.375, 30.5), 2: (25.75, 0.0), 3: (26.5, 31.125)}
H, W = 40, 48


def scene(y, x):
    return 40 + 1.5 * y[:, None] + 0.75 * x[None, :]


def frames(spark, change=lambda tile, v: v, origins=ORIGINS):
    tiles = spark.createDataFrame([("m", t, oy, ox, H, W, "clash") for t, (oy, ox) in origins.items()], "mosaic string, tile int, oy double, ox double, h int, w int, gain string")
    rows = [("m", t, [float(e) for e in change(t, scene(np.arange(H) + oy, np.arange(W) + ox)).ravel()]) for t, (oy, ox) in origins.items()]
    return tiles, spark.createDataFrame(rows, "mosaic string, tile int, v array<double>")


def whole(blocks):
    rows = blocks.collect()
    out = np.full((max(r.gy0 + r.h for r in rows), max(r.gx0 + r.w for r in rows)), np.nan)
    for r in rows:
        out[r.gy0 : r.gy0 + r.h, r.gx0 : r.gx0 + r.w] = P.image(r.v, r.h, r.w)
    return out


def test_ramp_with_gain_offset_and_field(spark):
    gains = {0: (1.1, -3.0), 1: (0.9, 4.0), 3: (1.25, 0.5)}  # the second row's first tile has none
    coarse = np.array([[0.0, 2.0, 4.0], [1.0, -1.0, 0.0]])
    field = P.stretched(coarse, H, W)
    tiles, planes = frames(spark, lambda t, v: (v - gains.get(t, (1, 0))[1]) / gains.get(t, (1, 0))[0] + field)
    g = spark.createDataFrame([("m", t, *v) for t, v in gains.items()], "mosaic string, tile int, gain double, offset double")
    f = spark.createDataFrame([("m", 2, 3, coarse.ravel().tolist())], "mosaic string, field_h int, field_w int, field array<double>")
    for block in (16, 1000):
        out = whole(render.render(tiles, planes, block=block, gains=g, fields=f))
        assert out.shape == (66, 79)
        truth = scene(np.arange(66), np.arange(79))
        assert np.abs(out - truth)[1:-1, 1:-1].max() < 1
    raw = whole(render.render(tiles, planes, gains=g, fields=f, depth=None))
    assert np.abs(raw - truth)[1:-1, 1:-1].max() < 0.2


def test_nearest_keeps_source_values_and_ignores_corrections(spark):
    tiles, planes = frames(spark, lambda t, v: np.full(v.shape, 10.0 * t + 1))
    g = spark.createDataFrame([("m", 0, 9.0, 9.0)], "mosaic string, tile int, gain double, offset double")
    out = whole(render.render(tiles, planes, kind="nearest", gains=g))
    assert set(np.unique(out[:, :-1])) == {1.0, 11.0, 21.0, 31.0}
    assert out[0, 0] == 1 and out[-1, -1] == 31 and out[0, -1] == 0  # no tile ends in the last corner
    same = {0: (0.0, 0.0), 1: (0.0, 0.0)}  # equal weights: the first tile wins
    tiles, planes = frames(spark, lambda t, v: np.full(v.shape, 7.0 + t), same)
    assert set(np.unique(whole(render.render(tiles, planes, kind="nearest")))) == {7.0}
    with pytest.raises(ValueError):
        render.render(tiles, planes, kind="other")


def test_gaps_and_missing_planes(spark):
    def gap(t, v):
        v = v.copy()
        v[:, 20:22] = np.nan
        return v

    tiles, planes = frames(spark, gap, {0: (0.0, 0.0)})
    out = whole(render.render(tiles, planes))
    assert (out[:, 20:22] == 0).all() and (out[:, :19] > 0).all() and (out[:, 23:] > 0).all()
    tiles, planes = frames(spark)
    out = whole(render.render(tiles, planes.where("tile <> 3")))
    assert (out[45:, 55:] != out[45:, 55:]).all() or (out[45:, 55:] == 0).all()
    assert render.render(tiles, planes.where("false")).count() == 0


def test_downsampled(spark):
    tiles, planes = frames(spark)
    out = whole(render.render(tiles, planes, downsample=4, depth=None))
    y, x = (np.arange(n) * 4 + 1.5 for n in out.shape)
    assert np.abs(out - scene(y, x))[1:-1, 1:-1].max() < 3
