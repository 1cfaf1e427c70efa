"""Planted truths for operators that SQL does not express, and edges of those it does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import graph, raster, registration, rules


def grid_edges(rows, cols, wild=()):
    out = []
    for r in range(rows):
        for c in range(cols):
            a = r * cols + c
            for b, dy, dx in ((a + 1, 0.0, 10.0), (a + cols, 8.0, 0.0)):
                if (b == a + 1 and c + 1 == cols) or b >= rows * cols:
                    continue
                far = 30.0 if (a, b) in wild else 0.0
                out.append((0, a, b, dy + far, dx - far, 1.0))
    return out


@pytest.mark.parametrize("wild", [(), ((5, 6),)])
def test_pose_solve_finds_the_lattice(spark, wild):
    edges = spark.createDataFrame(grid_edges(4, 5, wild), "mosaic int, a long, b long, dy double, dx double, weight double")
    got = graph.pose_solve(edges, reject=True).orderBy("node").collect()
    expected = np.array([(8.0 * (k // 5), 10.0 * (k % 5)) for k in range(20)])
    assert np.abs(np.array([(r["y"], r["x"]) for r in got]) - expected).max() < 0.6


def test_components_of_two_chains(spark):
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(30)] + [(0, 100, 101)], "mosaic int, a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(edges).collect()}
    assert {got[k] for k in range(31)} == {0} and got[101] == 100


def test_phase_shift_of_a_moved_plane():
    a = np.random.default_rng(3).normal(size=(32, 48))
    assert registration.phase_shift(a, np.roll(a, (5, -7), (0, 1)))[:2] == (5, -7)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_box_sums_replicate_edges(spark, k):
    plane = np.random.default_rng(k).integers(0, 99, (8, 8))
    px = spark.createDataFrame([(0, y, x, int(plane[y, x])) for y in range(8) for x in range(8)], "t int, y int, x int, v int")
    got = {(r["y"], r["x"]): r["s"] for r in raster.box_sum(px, ["t"], k).collect()}
    at = lambda i: min(7, max(0, i))
    for y in range(8):
        for x in range(8):
            assert got[y, x] == sum(plane[at(y + i), at(x + j)] for i in range(1 - k, k + 1) for j in range(1 - k, k + 1))


def test_blend_is_invariant_under_translation(spark):
    px = spark.createDataFrame([(t, 0, t, y, x, t * 7 + y * 3 + x) for t in range(3) for y in range(8) for x in range(8)], "vec_id long, trow int, tcol int, y int, x int, v int")
    one = {(r["gy"], r["gx"]): r["v"] for r in raster.feather_blend(raster.on_canvas(px), ["gy", "gx"]).collect()}
    moved = raster.on_canvas(px).withColumn("gy", F.col("gy") + 11)
    two = {(r["gy"] - 11, r["gx"]): r["v"] for r in raster.feather_blend(moved, ["gy", "gx"]).collect()}
    assert one == two


def test_empty_relations(spark):
    px = spark.createDataFrame([], "vec_id long, trow int, tcol int, y int, x int, v int")
    assert raster.feather_blend(raster.on_canvas(px), ["gy", "gx"]).count() == 0
    assert raster.laplacian(px, ["vec_id"]).count() == 0


def test_phase_residual_and_its_reasons():
    a = np.random.default_rng(1).normal(size=(64, 64))
    found = registration.phase_residual(a, np.roll(a, (3, -4), (0, 1)))
    assert abs(found.dy + 3) < 0.35 and abs(found.dx - 4) < 0.35 and found.psr > 4 and found.margin > 0 and found.reason == ""
    assert registration.phase_residual(a[:47], a[:47]).reason == "overlap_too_small"
    assert registration.phase_residual(a * 0, a).reason == "low_information"
    edge = registration.phase_residual(a, np.roll(a, (6, 0), (0, 1)), 6)
    assert edge.reason == "search_boundary" and (edge.dy, edge.dx) == (0, 0)
    large = np.random.default_rng(2).normal(size=(300, 280))
    smooth = (large + np.roll(large, 1, 0) + np.roll(large, 1, 1) + np.roll(large, (1, 1), (0, 1))) / 4
    half = registration.phase_residual(smooth, np.roll(smooth, (-8, 10), (0, 1)))
    assert abs(half.dy - 8) < 0.7 and abs(half.dx + 10) < 0.7


def planted_mosaic(spark, truth, wrong=None, seed=11):
    """A 2 x 3 mosaic of 100 x 110 tiles cut from one scene; the stage is off by a few pixels. wrong: a tile of another scene."""
    rng = np.random.default_rng(seed)
    scene, tiles, planes = rng.normal(size=(260, 380)) * 20 + 100, [], []
    scene = (scene + np.roll(scene, 1, 0) + np.roll(scene, 1, 1)) / 3
    for k, (y, x) in enumerate(truth):
        r, c = divmod(k, 3)
        plane = scene[y : y + 100, x : x + 110] if k != wrong else rng.normal(size=(100, 110)) * 20
        tiles.append((7, k, r, c, y + float(rng.integers(-4, 5)), x + float(rng.integers(-4, 5)), 100, 110))
        planes.append((7, k, [float(v) for v in plane.ravel()]))
    return spark.createDataFrame(tiles, "mosaic int, tile long, row int, col int, stage_y double, stage_x double, h int, w int"), spark.createDataFrame(planes, "mosaic int, tile long, v array<double>")


TRUTH = [(10, 10), (12, 68), (9, 130), (50, 11), (51, 70), (49, 131)]


def test_geometry_finds_planted_places(spark):
    from tilework.operators import geometry

    tiles, planes = planted_mosaic(spark, TRUTH)
    edges = geometry.measure_edges(tiles, planes).cache()
    assert edges.count() == 7 and edges.where("accepted").count() == 7
    got = {r["tile"]: (r["y"], r["x"]) for r in geometry.origins(tiles, edges).collect()}
    low = np.min(TRUTH, axis=0)
    for k, place in enumerate(TRUTH):
        assert np.abs(np.array(got[k]) - place + low).max() < 0.35, (k, got[k])
    report = geometry.summary(tiles, geometry.origins(tiles, edges), geometry.checked_edges(tiles, edges)).first()
    assert (report["accepted"], report["expected"], report["parts"], report["warnings"]) == (7, 7, 1, []) and report["residual_max"] < 0.5
    assert (report["height"], report["width"]) == (142, 231)


def test_geometry_leaves_out_what_contradicts(spark):
    from tilework.operators import geometry

    tiles, planes = planted_mosaic(spark, TRUTH)
    edges = geometry.measure_edges(tiles, planes).withColumn("dx", F.expr("if(a = 0 and b = 1, dx + 25, dx)"))
    checked = {(r["a"], r["b"]): r for r in geometry.checked_edges(tiles, edges).collect()}
    assert checked[0, 1]["reason"] == "global_inconsistent" and checked[0, 1]["residual_dx"] is None
    assert sum(r["accepted"] for r in checked.values()) == 6
    lost = geometry.measure_edges(tiles, planes.where("tile <> 4"))
    assert {(r["a"], r["b"]) for r in lost.where("reason = 'read_error' or reason = 'overlap_too_small'").collect()} == {(1, 4), (3, 4), (4, 5)}
    tiles, planes = planted_mosaic(spark, TRUTH, wrong=5)
    report = geometry.summary(tiles, *(f(tiles, geometry.measure_edges(tiles, planes)) for f in (geometry.origins, geometry.checked_edges))).first()
    assert report["parts"] == 2 and "disconnected" in report["warnings"]


def test_line_fit_is_orthogonal_and_robust():
    from tilework.operators import radiometry

    rng = np.random.default_rng(4)
    x = rng.uniform(0.1, 0.8, 3000)
    y = 1.1 * x + 0.02 + rng.normal(size=3000) * 0.005
    y[::20] += 0.5
    slope, intercept, _, inlier = radiometry.weighted_tls(y, x)
    assert abs(slope - 1.1) < 0.01 and abs(intercept - 0.02) < 0.01 and 0.9 < inlier < 1
    with pytest.raises(ValueError):
        radiometry.weighted_tls(1 - x, x)


def test_radiometric_model_finds_planted_gains(spark):
    from tilework.operators import radiometry

    rng = np.random.default_rng(5)
    gain = {0: 1.0, 1: 1.1, 2: 0.95}
    rows = [(0, a, b, float(v * gain[a]), float(v * gain[b])) for a, b in ((0, 1), (1, 2)) for v in rng.uniform(40, 180, 1500)]
    fits = radiometry.pair_fits(spark.createDataFrame(rows, "mosaic int, a long, b long, va double, vb double"))
    got = {r["node"]: r for r in radiometry.model(fits).collect()}
    assert {r["kind"] for r in got.values()} == {"affine"}
    assert abs(got[0]["gain"] / got[1]["gain"] - 1.1) < 0.02 and abs(got[0]["gain"] / got[2]["gain"] - 0.95) < 0.02


def test_tables_written_together(spark, tmp_path):
    from tilework.sources import sinks

    a, b = spark.range(5), spark.range(3).withColumnRenamed("id", "k")
    sinks.write_together({"a": a, "b": b}, str(tmp_path))
    sinks.write_together({"a": a.limit(2)}, str(tmp_path))
    assert {k: v.count() for k, v in sinks.read_together(spark, str(tmp_path)).items()} == {"a": 2}


def test_containers_that_are_none(spark):
    from tilework.sources import containers, dataset

    files = spark.createDataFrame([("a", b"KTL2"), ("b", b""), ("c", containers.encode(np.full((1, 5, 7), 9, np.uint8), 4, 2000.0))], "path string, content binary")
    got = {r["path"]: r for r in containers.headers(files).collect()}
    assert got["a"]["error"] and got["b"]["error"] and (got["c"]["width"], got["c"]["height"], got["c"]["calibration_nm"]) == (7, 5, 2000.0)
    assert containers.pixels_of(files).where("v = 9").count() == 35
    assert dataset.facts(files.where("path = 'a'")).first()["kind"] == "error"


def test_numbers_of_any_length_in_names_and_versions(spark):
    big = "9" * 40
    names = ["a10", "A2", "a" + big, "a1" + "0" * 40, "a007", "b", "", "a2b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(rules.natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in rows] == ["", "A2", "a2b", "a007", "a10", "a" + big, "a1" + "0" * 40, "b"]
    pairs = [("v1.2.99999999999", "1.2.3"), ("1." + big + ".0", "1." + "8" * 40), ("2.0", "1.99.99"), ("1.0.0", "0.9"), ("1.0.1", "1.0.x")]
    got = spark.createDataFrame(pairs, "a string, b string").select((rules.version_key(F.col("a")) > rules.version_key(F.col("b"))).alias("newer"), (rules.version_key(F.col("a")) == rules.version_key(F.concat(F.lit(" V"), "a", F.lit("-rc1+7")))).alias("same")).collect()
    assert all(r["newer"] and r["same"] for r in got)


def test_a_needle_that_ends_in_a_digit_again_and_again(spark):
    texts = ["a12", "a12120", "a1212", "A1212b", "a123", "a12123 12", "", None, "12\n3", "x111", "x1110"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rules.text_filter(F.col("t"), "12"), rules.text_filter(F.col("t"), "11"), rules.text_filter(F.col("t"), r"\E2")).collect()]
    assert [g[0] for g in got] == [True, False, True, True, False, True, False, None, True, False, False]
    assert [g[1] for g in got[-2:]] == [True, False] and not any(g[2] for g in got)
    assert spark.range(1).select(rules.text_filter(F.lit(r"a\e2b"), r"\E2")).first()[0]


def test_edges_fitted_together_are_fitted_alike(spark, monkeypatch):
    """Edges of a batch have the fits that they have alone, and whatever is shared is found on planes as on pixels."""
    from tilework.operators import radiometry

    rng = np.random.default_rng(8)
    gates, edges = {"samples": 8, "inlier": 0.3}, []
    for k in range(60):
        a = rng.uniform(20, 200, 12 + k % 3 * 20)
        b = a * rng.uniform(0.7, 1.4) + rng.normal(size=len(a)) * (k % 5) if k % 7 else 255 - a
        for odd in range(k % 4):
            a[odd], b[-1 - odd] = (np.nan, -3.0, 255.0)[odd], (255.0, np.inf, np.nan)[odd]
        edges.append((a / 255, b / 255) if k % 11 else (a[:0], b[:0]))
    edges += [(np.full(20, 0.4), np.full(20, 0.4)), (np.full(20, 1.0), np.full(20, 0.5))]
    monkeypatch.setattr(radiometry, "BATCH", 100)
    numbers, reasons, n = radiometry.line_fits(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)), np.array([len(e[0]) for e in edges]), gates)
    for e, x, reason, m in zip(edges, numbers, reasons, n):
        alone = radiometry.line_fit(*e, gates)
        assert (reason, m) == alone[1:] and np.allclose(x, alone[0], rtol=1e-12, atol=1e-15)
    assert {"", "too_few_samples", "saturated_overlap", "low_information", radiometry.FALLING} <= set(reasons)

    tiles = [(r * 3 + c, r, c, rng.integers(0, 250, 64 - 5 * (r == c)).tolist()) for r in range(3) for c in range(3)]
    planes = spark.createDataFrame(tiles, "id long, row int, col int, v array<int>")
    px = planes.selectExpr("id AS vec_id", "row AS trow", "col AS tcol", "posexplode(v) AS (p, v)").selectExpr("*", "cast(p div 8 as int) AS y", "p % 8 AS x")
    slow = {}
    for r in raster.overlaps(raster.on_canvas(px), raster.neighbours(planes)).collect():
        slow.setdefault((r["a"], r["b"], r["axis"]), []).append((r["va"], r["vb"]))
    fast = {(r["a"], r["b"], r["axis"]): list(zip(r["va"], r["vb"])) for r in raster.plane_overlaps(planes).collect()}
    assert {k: sorted(v) for k, v in fast.items()} == {k: sorted(v) for k, v in slow.items()} and len(fast) == 12


def test_a_model_makes_its_fits_once(spark):
    from tilework.operators import radiometry

    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [(0, a, a + 1, 2000, 1.0 + a / 50, 0.0, 0.9, 0.9, 0.0, 0.01, "") for a in range(5)]
    fits = spark.createDataFrame(rows, radiometry.FIT).mapInPandas(counted, radiometry.FIT)
    assert radiometry.model(fits).count() == 6 and seen.value == 5
