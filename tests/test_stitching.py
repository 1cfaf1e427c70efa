"""Steps, wells and plates against planted truth and plain replays."""

import random
from statistics import median

import numpy as np
import pytest

from tilework.operators import planes as P
from tilework.operators import steps, wells


def texture(h, w, seed=1, cells=3):
    """Smooth random grey values from 20 to 230."""
    rng = np.random.default_rng(seed)
    coarse = rng.normal(size=(h // cells + 4, w // cells + 4))
    fine = P.stretched(coarse, h, w)
    return 20 + 210 * (fine - fine.min()) / (fine.max() - fine.min())


def at(scene, oy, ox, h, w):
    return P.sampled(scene, oy + np.arange(h), ox + np.arange(w))


def test_fractions_of_a_pixel_and_rivals(spark):
    scene = texture(200, 240)
    a, b, c = at(scene, 10, 5, 96, 128), at(scene, 12.4, 84.7, 96, 128), at(scene, 70.3, 3.2, 96, 128)
    ramp = 100 + 80 * np.sin(np.arange(240) * 2 * np.pi / 8)[None, :] * np.ones((96, 1))  # stripes: every eighth shift fits
    ramp = np.rint(ramp + np.random.default_rng(1).normal(size=ramp.shape))
    rows = [("w", 0, 1, "x", a, b), ("w", 0, 2, "y", a, c), ("w", 5, 6, "x", ramp[:, :128], ramp[:, 80:208])]
    frame = spark.createDataFrame([(w, i, j, axis, 96, 128, 96, 128, p.ravel().tolist(), q.ravel().tolist()) for w, i, j, axis, p, q in rows], "well string, a int, b int, axis string, h int, w int, bh int, bw int, va array<double>, vb array<double>")
    ranks = steps.ranked(steps.candidates(frame)).cache()
    fine = {(r.a, r.b): r for r in steps.fine_steps(frame, ranks).collect()}
    assert set(fine) == {(0, 1), (0, 2)}
    assert abs(fine[0, 1].dy - 2.4) <= 0.11 and abs(fine[0, 1].dx - 79.7) <= 0.11
    assert abs(fine[0, 2].dy - 60.3) <= 0.11 and abs(fine[0, 2].dx + 1.8) <= 0.11
    assert {r.a for r in steps.voting(ranks).collect()} == {0}
    assert all(r.ambiguous for r in ranks.where("a = 5").collect())


def test_step_forms():
    scene = texture(150, 200, 3)
    a, b = at(scene, 0, 0, 80, 100), at(scene, 1, 60, 80, 100)
    best = max(steps.scored(a, b, "x"), key=lambda s: s[2])
    assert abs(best[0] - 1) <= 1 and abs(best[1] - 60) <= 1
    assert all(0 < dx <= 100 for _, dx, _ in steps.scored(a, b, "x"))
    assert steps.refined(a[:30], b[:30], 0, 90)[2] == 0.0  # too small an overlap
    assert P.correlation(np.ones((4, 4)), scene[:4, :4]) == 0.0


def replay_consensus(cands):
    """cands: for each pair its (dy, dx, score), best first."""
    best = None
    for mine in cands:
        for vy, vx, _ in mine:
            hits = [[c for c in other if abs(c[0] - vy) <= 6 and abs(c[1] - vx) <= 6] for other in cands]
            tops = [max(s for _, _, s in h) for h in hits if h]
            agree = [c for h in hits if h for c in h if c[2] == max(s for _, _, s in h)]
            if best is None or (len(tops), round(sum(tops), 9)) > best[:2]:
                best = (len(tops), round(sum(tops), 9), agree)
    return int(median(c[0] for c in best[2])), int(median(c[1] for c in best[2])), best[0]


def test_consensus_against_a_replay(spark):
    rng = random.Random(8)
    rows, wanted = [], {}
    for well in range(12):
        cands = []
        for pair in range(rng.randint(1, 9)):
            some = {(rng.choice([-20, 0, 3, 40]) + rng.randint(-4, 4), rng.choice([60, 66, 110]) + rng.randint(-5, 5)) for _ in range(rng.randint(1, 6))}
            mine = sorted(((dy, dx, rng.randint(1, 2**20) / 2**20) for dy, dx in some), key=lambda c: -c[2])
            cands.append(mine)
            rows += [(well, pair, pair + 1, "x", dy, dx, s, k + 1, 128, 128, False) for k, (dy, dx, s) in enumerate(mine)]
        wanted[well] = replay_consensus(cands)
    frame = spark.createDataFrame(rows, "well int, a int, b int, axis string, dy int, dx int, score double, rank int, h int, w int, ambiguous boolean")
    assert {r.well: (r.dy, r.dx, r.pairs) for r in steps.consensus(steps.voting(frame)).collect()} == wanted


def replay_plate(order, measured):
    """The two passes over a plate's wells, one after the other."""
    def middle(seen, axis):
        good = [s[axis] for s in seen if axis in s and s[axis][2] >= steps.LEAST_SCORE]
        return tuple(int(median(g[k] for g in good)) for k in (0, 1)) if good else None

    def stitch(well, prior):
        out = {}
        for axis in "xy":
            got = measured[well].get(axis)
            out[axis] = ("measured", got[:2]) if got and got[2] >= steps.LEAST_SCORE else ("plate", prior[axis]) if prior[axis] else ("abut", (0, 70) if axis == "x" else (50, 0))
        return out

    seen, result, later = [], {}, []
    prior = {"x": None, "y": None}
    for well in order:
        result[well] = stitch(well, prior)
        seen.append(measured[well])
        prior = {axis: middle(seen, axis) for axis in "xy"}
        if any(s == "abut" for s, _ in result[well].values()):
            later.append(well)
    for well in later:
        result[well] = stitch(well, prior)
    return result


def test_priors_of_a_plate_against_a_replay(spark):
    rng = random.Random(4)
    for _ in range(3):
        measured = {f"A{k:02d}": {axis: (rng.randint(-5, 60), rng.randint(-5, 60), rng.choice([0.01, 0.1499, 0.15, 0.7])) for axis in "xy" if rng.random() < 0.7} for k in range(14)}
        frame = spark.createDataFrame([(w, axis, *m) for w, axes in measured.items() for axis, m in axes.items()], "well string, axis string, dy int, dx int, score double").selectExpr("*", "1 AS pairs")
        names = spark.createDataFrame([(w, "p", 50, 70) for w in measured], "well string, plate string, h int, w int")
        got = steps.with_fallback(names.select("well", "h", "w"), frame, wells.inherited(names, frame)).collect()
        wanted = replay_plate(sorted(measured), measured)
        assert {(r.well, r.axis): (r.source, (r.dy, r.dx)) for r in got} == {(w, axis): v for w, axes in wanted.items() for axis, v in axes.items()}


def slices_of(spark, rows):
    return spark.createDataFrame([(w, c, t, r, k, z, *p.shape, p.ravel().tolist()) if p is not None else (w, c, t, r, k, z, None, None, None) for w, c, t, r, k, z, p in rows], "well string, channel string, tile int, row int, col int, z int, h int, w int, v array<double>")


def plate(spark, shading=1.0):
    scene, rows = np.rint(texture(300, 330, 9)), []
    h, w = 128, 160
    for well in ("A01", "A02", "A03", "B01"):
        for tile in range(6):
            row, col = divmod(tile, 2)
            view = scene[row * 80 : row * 80 + h, col * 100 : col * 100 + w]
            shown = {"A01": np.full((h, w), 30.0), "A02": view, "A03": None, "B01": np.flipud(view) * 0 + view}[well]
            rows.append((well, "CH4", tile, row, col, 0, None if shown is None else shown * shading))
            rows.append((well, "CH1", tile, row, col, 0, (255 - view) * shading))
    return slices_of(spark, rows), scene


def test_plate_with_an_empty_and_an_unreadable_well(spark):
    slices, scene = plate(spark)
    done = wells.stitch_plate(slices, flat=False)
    report = {r.well: r for r in done.report().collect()}
    assert {w: (r.status, r.source_x, r.source_y) for w, r in report.items()} == {"A01": ("ok", "plate", "plate"), "A02": ("ok", "measured", "measured"), "A03": ("failed", None, None), "B01": ("ok", "measured", "measured")}
    for well in ("A01", "A02", "B01"):
        r = report[well]
        assert abs(r.step_x_dx - 100) <= 1 and abs(r.step_x_dy) <= 1 and abs(r.step_y_dy - 80) <= 1 and abs(r.step_y_dx) <= 1
    assert report["A02"].residual_median <= 1 and report["A02"].edges == 7 and report["A01"].ncc_median == 0 and report["A03"].unreadable == 6
    assert report["A01"].low_confidence and not report["B01"].low_confidence and report["B01"].step_deviation <= 1 and report["A02"].step_deviation is None
    blocks = done.mosaics(block=100).where("channel = 'CH4' and well <> 'A01'").collect()
    assert {b.well for b in blocks} == {"A02", "B01"}
    worst = max(np.abs(P.image(b.v, b.h, b.w) - scene[b.gy0 : b.gy0 + b.h, b.gx0 : b.gx0 + b.w]).max() for b in blocks)
    assert worst <= 1


def test_modes_of_a_stack_and_ragged_slices(spark):
    rng = np.random.default_rng(5)
    stack = [rng.integers(0, 255, (20, 24)).astype(float) for _ in range(3)]
    ragged = [stack[0], stack[1][:18], stack[2][:, :22]]
    slices = slices_of(spark, [("w", "CH1", 0, 0, 0, z, p) for z, p in enumerate(ragged)] + [("w", "CH1", 0, 0, 0, 9, None)])
    cut = np.stack([p[:18, :22] for p in ragged])
    for mode, want in (("max", cut.max(0)), ("mean", cut.mean(0)), ("middle", cut[1])):
        r = wells.reduced(slices, mode).first()
        assert (r.h, r.w, r.slices) == (18, 22, 3) and np.allclose(P.image(r.v, r.h, r.w), want, atol=1e-4)
    flat, sharp = np.full((30, 30), 9.0), np.full((30, 30), 9.0)
    sharp[:, :12] = rng.integers(0, 255, (30, 12))
    other = flat.copy()
    other[:, 18:] = rng.integers(0, 255, (30, 12))
    r = wells.reduced(slices_of(spark, [("w", "c", 0, 0, 0, 0, sharp), ("w", "c", 0, 0, 0, 1, other)]), "focus").first()
    fused = P.image(r.v, 30, 30)
    assert (fused[:, :9] == sharp[:, :9]).all() and (fused[:, 21:] == other[:, 21:]).all()
    with pytest.raises(ValueError):
        wells.reduced(slices, "best")


def test_flat_fields_against_numpy(spark):
    rng = np.random.default_rng(6)
    for bright in (True, False):
        tiles = []
        for _ in range(6):
            p = np.full((30, 40), 100.0)
            y, x = rng.integers(0, 20), rng.integers(0, 30)
            p[y : y + 9, x : x + 9] = 220 if bright else 10
            tiles.append(np.rint(p * (1 + 0.01 * np.arange(40))))
        frame = spark.createDataFrame([("w", "c", t, 0, t, 30, 40, p.ravel().tolist()) for t, p in enumerate(tiles)] + [("w", "few", 0, 0, 0, 30, 40, [0.0] * 1200)], "well string, channel string, tile int, row int, col int, h int, w int, v array<float>")
        got = wells.flat_fields(frame).collect()
        assert [r.channel for r in got] == ["c"]
        cube = np.stack(tiles)
        profile = np.percentile(cube, 25 if cube.mean() > np.median(cube) else 75, axis=0)
        padded = np.pad(profile, 3, mode="edge")
        smooth = np.array([[padded[y + 1 : y + 7, x + 1 : x + 7].mean() for x in range(40)] for y in range(30)])
        wanted = np.clip(smooth / smooth.mean(), 0.2, 5)
        field = P.image(got[0].field, 30, 40)
        assert np.allclose(field, wanted)
        out = wells.flattened(frame, wells.flat_fields(frame)).where("tile = 2 and channel = 'c'").first()
        assert out.flat and np.allclose(P.image(out.v, 30, 40), tiles[2] / wanted, rtol=1e-6)
        assert not wells.flattened(frame, wells.flat_fields(frame)).where("channel = 'few'").first().flat


def test_stack_pages_share_one_geometry(spark):
    scene = np.rint(texture(140, 160, 2))
    rows = []
    for tile in range(4):
        row, col = divmod(tile, 2)
        for z in range(5):
            view = scene[row * 50 : row * 50 + 90, col * 60 : col * 60 + 100] * (1 - 0.1 * abs(z - 2))
            rows.append(("w", "CH4", tile, row, col, z, None if (tile, z) == (0, 4) else view))
    done = wells.stitch_plate(slices_of(spark, rows), mode="stack", z_step=2, flat=False, fine=False)
    blocks = done.mosaics(block=512, depth=None).collect()
    assert sorted(b.z for b in blocks) == [0, 2, 4]
    for b in blocks:
        page = np.zeros((140, 160))
        page[b.gy0 : b.gy0 + b.h, b.gx0 : b.gx0 + b.w] = P.image(b.v, b.h, b.w)
        good = page > 0
        assert np.abs(page - scene * (1 - 0.1 * abs(b.z - 2)))[good].max() < 0.01
        assert good[:48, :58].any() == (b.z < 4) and good.sum() > 10000
