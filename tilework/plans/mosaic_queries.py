"""Queries of rendering, stitching and region reads; places and parameters are planted, so their SQL knows the truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.functions.dialect import duck_sql
from tilework.operators import planes as P
from tilework.operators import correction, render, tables, wells
from tilework.sources.tiles import DUCK_PX, duck_scenes, pixels, scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = "WITH " + duck_sql(DUCK_PX + ", " + oracle)
        return f

    return put


# Origins in eighths of a pixel, gains in 64ths, offsets and fields in eighths: sums are exact, so both engines round alike.
PLACED = """k AS (SELECT vec_id, any_value(trow) AS trow, any_value(tcol) AS tcol FROM px GROUP BY vec_id),
t AS (SELECT vec_id, trow * 6 + (vec_id * 5 % 8) / 8.0::DOUBLE AS oy, tcol * 6 + (vec_id * 3 % 8) / 8.0::DOUBLE AS ox,
  CASE WHEN vec_id % 7 = 0 THEN 1.0::DOUBLE ELSE 1 + (vec_id % 5 - 2) / 64.0::DOUBLE END AS gain,
  CASE WHEN vec_id % 7 = 0 THEN 0.0::DOUBLE ELSE (vec_id % 3 - 1)::DOUBLE END AS shift FROM k),
g AS (SELECT t.*, CAST(ceil(oy - 0.5) AS INT) + i AS gy, CAST(ceil(ox - 0.5) AS INT) + j AS gx FROM t, range(8) a(i), range(8) b(j)),
p AS (SELECT *, gy - oy AS yy, gx - ox AS xx, greatest(0, least(7, gy - oy)) AS cy, greatest(0, least(7, gx - ox)) AS cx FROM g),
q AS (SELECT *, CAST(least(6, floor(cy)) AS INT) AS iy, CAST(least(6, floor(cx)) AS INT) AS ix FROM p),
s AS (SELECT q.*, least(yy + 1, 8 - yy, xx + 1, 8 - xx) / 4 AS w, abs(1 - abs(n.y - cy)) * abs(1 - abs(n.x - cx)) AS k, n.v, (2 * n.y - n.x) / 8.0::DOUBLE AS f
  FROM q JOIN px n ON n.vec_id = q.vec_id AND n.y BETWEEN iy AND iy + 1 AND n.x BETWEEN ix AND ix + 1),
"""


def _placed(px: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tiles at fractional origins, their gains (a seventh has none), a field, and planes."""
    tiles = px.select("vec_id", "trow", "tcol").distinct().selectExpr("0 AS mosaic", "vec_id AS tile", "trow * 6 + (vec_id * 5 % 8) / 8D AS oy", "tcol * 6 + (vec_id * 3 % 8) / 8D AS ox", "8 AS h", "8 AS w")
    gains = tiles.where("tile % 7 <> 0").selectExpr("mosaic", "tile", "1 + (tile % 5 - 2) / 64D AS gain", "cast(tile % 3 - 1 as double) AS offset")
    fields = tiles.sparkSession.range(1).selectExpr("0 AS mosaic", "8 AS field_h", "8 AS field_w", "transform(sequence(0, 63), p -> (2 * (p div 8) - p % 8) / 8D) AS field")
    planes = P.planes_of(px, ["vec_id"]).selectExpr("0 AS mosaic", "vec_id AS tile", "v")
    return tiles, gains, fields, planes


@query("render_corrected", PLACED + """c AS (SELECT vec_id, gy, gx, w, (sum(v * k) - sum(f * k)) * any_value(gain) + any_value(shift) AS v FROM s GROUP BY vec_id, gy, gx, w)
SELECT gy, gx, CAST(greatest(0, least(255, RINT[sum(w * v) / sum(w)])) AS INT) AS v FROM c GROUP BY gy, gx""")
def render_corrected(spark, sf_dir):
    """The mosaic of all tiles at fractional origins, with gain, offset and field."""
    tiles, gains, fields, planes = _placed(pixels(spark, sf_dir))
    blocks = render.render(tiles, planes, block=48, gains=gains, fields=fields)
    # blocks are rectangles; pixels that no tile covers are not part of the answer
    return covered(P.exploded(blocks, ["mosaic"]), tiles).select("gy", "gx", F.col("v").cast("int").alias("v"))


def covered(px: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels (gy, gx) that a tile shows: tiles lie in cells of 8, so a pixel meets the tiles of its own cell only."""
    cell = tiles.withColumn("gy", F.explode(F.sequence(F.ceil(F.col("oy") - 0.5), F.ceil(F.col("oy") + F.col("h") - 1.5)))).withColumn("gx", F.explode(F.sequence(F.ceil(F.col("ox") - 0.5), F.ceil(F.col("ox") + F.col("w") - 1.5))))
    return px.join(cell.select(F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx")).distinct(), ["gy", "gx"], "left_semi")


@query("render_nearest", PLACED + """n AS (SELECT q.*, least(yy + 1, 8 - yy, xx + 1, 8 - xx) AS w, px.v FROM q JOIN px ON px.vec_id = q.vec_id AND px.y = greatest(0, least(7, floor(yy + 0.5))) AND px.x = greatest(0, least(7, floor(xx + 0.5))))
SELECT gy, gx, MAXBY[v;ROWS[w;-vec_id]] AS v FROM n GROUP BY gy, gx""")
def render_nearest(spark, sf_dir):
    tiles, _, _, planes = _placed(pixels(spark, sf_dir))
    blocks = render.render(tiles, planes, block=48, kind="nearest")
    return covered(P.exploded(blocks, ["mosaic"]), tiles).select("gy", "gx", F.col("v").cast("int").alias("v"))


# A plate: each scene of 12 x 12 vectors is a well of 2 x 2 tiles of 64 x 64 with steps (2, 30) and (30, -2), two channels and two
# slices. Of every four wells the first has an empty reference channel and the third can't be read.
SCENE = 12
WELL_TILES = "f AS (SELECT t AS tile, t // 2 AS row, t % 2 AS col, t // 2 * 30 + t % 2 * 2 AS oy, t % 2 * 30 - t // 2 * 2 + 2 AS ox FROM range(4) r(t))"


def plate_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = scenes(pixels(spark, sf_dir), SCENE)
    tile = F.explode(F.sequence(F.lit(0), F.lit(3)))
    cut = image.withColumn("tile", tile).withColumn("row", F.expr("cast(tile div 2 as int)")).withColumn("col", F.expr("tile % 2"))
    cut = cut.withColumn("y", F.expr("gy - row * 30 - col * 2")).withColumn("x", F.expr("gx - col * 30 + row * 2 - 2")).where("y between 0 and 63 and x between 0 and 63")
    reference = F.when(F.col("scene") % 4 == 0, 50).otherwise(F.col("v"))
    both = cut.withColumn("channel", F.explode(F.array(F.lit("CH2"), F.lit("CH4")))).withColumn("z", F.explode(F.array(F.lit(0), F.lit(1))))
    shown = both.withColumn("v", F.when(F.col("channel") == "CH4", reference).otherwise(255 - F.col("v")) - F.when(F.col("z") == (F.col("scene") + F.col("tile")) % 2, 0).otherwise(7))
    planes = P.planes_of(shown, ["scene", "channel", "tile", "row", "col", "z"])
    lost = (F.col("scene") % 4 == 2) & (F.col("channel") == "CH4")
    return planes.select(F.col("scene").alias("well"), "channel", "tile", "row", "col", "z", "h", "w", F.when(~lost, F.col("v")).alias("v"))


PLATE = duck_scenes(SCENE) + """, w AS (SELECT DISTINCT scene AS well, scene % 4 AS kind FROM sc), y AS (SELECT count(*) FILTER (kind IN (1, 3)) > 0 AS seen FROM w),
s AS (SELECT well, kind, kind <> 2 AND (seen OR kind <> 0) AS found FROM w, y)"""


@query("plate_report", PLATE + """ SELECT CAST(well AS INT) AS well, CASE WHEN kind = 2 THEN 'failed' ELSE 'ok' END AS status,
CASE WHEN kind <> 2 THEN CASE WHEN found THEN 2 ELSE 0 END END::INT AS step_x_dy, CASE WHEN kind <> 2 THEN CASE WHEN found THEN 30 ELSE 64 END END::INT AS step_x_dx,
CASE WHEN kind <> 2 THEN CASE WHEN found THEN 30 ELSE 64 END END::INT AS step_y_dy, CASE WHEN kind <> 2 THEN CASE WHEN found THEN -2 ELSE 0 END END::INT AS step_y_dx,
CASE kind WHEN 2 THEN NULL WHEN 0 THEN CASE WHEN found THEN 'plate' ELSE 'abut' END ELSE 'measured' END AS source_x,
CASE WHEN kind <> 2 THEN CASE WHEN found THEN 96 ELSE 128 END END::INT AS height, CASE WHEN kind = 2 THEN 8 ELSE 0 END::BIGINT AS unreadable, CASE kind WHEN 2 THEN NULL ELSE kind = 0 END AS low_confidence FROM s""")
def plate_report(spark, sf_dir):
    """Steps, sources and failures of a plate's wells."""
    done = wells.stitch_plate(plate_slices(spark, sf_dir), mode="max", flat=False, fine=False)
    return done.report().select("well", "status", "step_x_dy", "step_x_dx", "step_y_dy", "step_y_dx", "source_x", "height", "unreadable", "low_confidence")


MOSAIC = PLATE + ", " + WELL_TILES + """, c AS (SELECT s.*, ch FROM s, (SELECT unnest(['CH2', 'CH4']) AS ch) WHERE kind <> 2),
p AS (SELECT c.well, c.kind, c.ch, c.found, f.*, gy - f.oy AS py, gx - f.ox AS px_, v FROM c JOIN sc ON sc.scene = c.well JOIN f ON gy BETWEEN f.oy AND f.oy + 63 AND gx BETWEEN f.ox AND f.ox + 63),
e AS (SELECT well, ch, kind, tile, CASE WHEN found THEN oy ELSE row * 64 END + py AS gy, CASE WHEN found THEN ox ELSE col * 64 END + px_ AS gx, least(py + 1, 64 - py, px_ + 1, 64 - px_) AS w, CASE WHEN ch = 'CH2' THEN 255 - v WHEN kind = 0 THEN 50 ELSE v END AS v FROM p)
"""


@query("plate_mosaics", MOSAIC + "SELECT CAST(well AS INT) AS well, ch AS channel, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, CAST(RINT[sum(w * v)::DOUBLE / sum(w)] AS INT) AS v FROM e GROUP BY well, ch, gy, gx")
def plate_mosaics(spark, sf_dir):
    """The mosaics of all wells and channels, of the brighter slice of each tile."""
    return _shown(wells.stitch_plate(plate_slices(spark, sf_dir), mode="max", flat=False, fine=False), ["well", "channel"])


def _shown(done: wells.Stitched, keys: list[str]) -> DataFrame:
    px = P.exploded(done.mosaics(block=64), keys).select(*keys, "gy", "gx", F.col("v").cast("int").alias("v"))
    cover = done.tiles.withColumn("gy", F.explode(F.expr("sequence(cast(oy as int), cast(oy as int) + 63)"))).withColumn("gx", F.explode(F.expr("sequence(cast(ox as int), cast(ox as int) + 63)")))
    return px.join(cover.selectExpr("well", "gy", "gx").distinct(), ["well", "gy", "gx"], "left_semi")


@query("stack_pages", MOSAIC + ", d AS (SELECT e.*, z, e.v - CASE WHEN z = (well + tile) % 2 THEN 0 ELSE 7 END AS u FROM e, range(2) r(z)) SELECT CAST(well AS INT) AS well, ch AS channel, CAST(z AS INT) AS z, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, CAST(RINT[sum(w * u)::DOUBLE / sum(w)] AS INT) AS v FROM d GROUP BY well, ch, z, gy, gx")
def stack_pages(spark, sf_dir):
    """A page a slice, all on the geometry of the sharpest pixels."""
    return _shown(wells.stitch_plate(plate_slices(spark, sf_dir), mode="stack", flat=False, fine=False), ["well", "channel", "z"])


# Corrections: scenes of 12 x 12 vectors in 2 x 2 tiles, of 19 x 19 in 7 x 7.
def _cut(image: DataFrame, across: int, size: int, step: int, grey) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiles, planes, edges) of scenes: across x across tiles of a size at a step; grey is what a tile shows of v."""
    tile = F.explode(F.sequence(F.lit(0), F.lit(across * across - 1)))
    cut = image.withColumn("tile", tile).withColumn("row", F.expr(f"cast(tile div {across} as int)")).withColumn("col", F.expr(f"tile % {across}"))
    cut = cut.withColumn("y", F.expr(f"gy - row * {step}")).withColumn("x", F.expr(f"gx - col * {step}")).where(f"y between 0 and {size - 1} and x between 0 and {size - 1}").withColumn("v", grey)
    planes = P.planes_of(cut.withColumnRenamed("scene", "mosaic"), ["mosaic", "tile", "row", "col"])
    tiles = planes.select("mosaic", "tile", "row", "col", (F.col("row") * step).cast("double").alias("oy"), (F.col("col") * step).cast("double").alias("ox"), "h", "w")
    edge = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.lit(1).alias("next")), F.struct(F.lit("y").alias("axis"), F.lit(across).alias("next"))))
    edges = tiles.select("mosaic", F.col("tile").alias("a"), "row", "col", edge.alias("e")).where(f"(e.axis = 'x' and col < {across - 1}) or (e.axis = 'y' and row < {across - 1})").selectExpr("mosaic", "a", "a + e.next AS b", "e.axis AS axis")
    return tiles, planes.select("mosaic", "tile", "v"), edges


@query("overlap_samples", duck_scenes(SCENE) + """, m AS (SELECT DISTINCT scene FROM sc),
o AS (SELECT scene, t AS tile, t // 2 * 30 AS cy, t % 2 * 30 AS cx, t // 2 * 30 + (scene * 3 + t * 5) % 8 / 8.0::DOUBLE AS oy, t % 2 * 30 + (scene * 5 + t * 3) % 8 / 8.0::DOUBLE AS ox FROM m, range(4) r(t)),
e AS (SELECT a.scene, a.tile AS a, b.tile AS b, a.cy AS acy, a.cx AS acx, b.cy AS bcy, b.cx AS bcx, a.oy AS ay, a.ox AS ax, b.oy AS by_, b.ox AS bx_, a.oy + 0.5 * (b.oy - a.oy - RINT[b.oy - a.oy]) AS py, a.ox + 0.5 * (b.ox - a.ox - RINT[b.ox - a.ox]) AS px_
  FROM o a JOIN o b ON b.scene = a.scene AND ((b.tile = a.tile + 1 AND a.tile % 2 = 0) OR b.tile = a.tile + 2)),
k AS (SELECT e.*, py + i AS y, px_ + j AS x FROM e, range(-100, 200) r(i), range(-100, 200) s(j) WHERE py + i >= greatest(ay, by_) + 2 AND py + i <= least(ay, by_) + 61 AND px_ + j >= greatest(ax, bx_) + 2 AND px_ + j <= least(ax, bx_) + 61),
s AS (SELECT scene, a, b, y, x, 0 AS side, acy AS cy, acx AS cx, y - ay AS sy, x - ax AS sx FROM k UNION ALL SELECT scene, a, b, y, x, 1, bcy, bcx, y - by_, x - bx_ FROM k),
v AS (SELECT s.scene, a, b, s.y, s.x, side, sum(sc.v * (1 - abs(sc.gy - cy - sy)) * (1 - abs(sc.gx - cx - sx))) AS v FROM s JOIN sc ON sc.scene = s.scene AND sc.gy - cy BETWEEN CAST(floor(sy) AS INT) AND CAST(floor(sy) AS INT) + 1 AND sc.gx - cx BETWEEN CAST(floor(sx) AS INT) AND CAST(floor(sx) AS INT) + 1 GROUP BY s.scene, a, b, s.y, s.x, side)
SELECT CAST(scene AS INT) AS mosaic, CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(count(*) / 2 AS BIGINT) AS n, sum(CASE side WHEN 0 THEN v END) AS va, sum(CASE side WHEN 1 THEN v END) AS vb, sum(CASE side WHEN 0 THEN v * v END) AS vaa FROM v GROUP BY scene, a, b""")
def overlap_samples(spark, sf_dir):
    """What two tiles at fractional origins show at shared places: number and sums of the samples of each edge."""
    tiles, planes, edges = _cut(scenes(pixels(spark, sf_dir), SCENE), 2, 64, 30, F.col("v"))
    tiles = tiles.withColumn("oy", F.expr("oy + (mosaic * 3 + tile * 5) % 8 / 8D")).withColumn("ox", F.expr("ox + (mosaic * 5 + tile * 3) % 8 / 8D"))
    got = correction.common_samples(correction.small_planes(tiles, planes, 1), edges)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), f)
    return got.select("mosaic", "a", "b", F.size("va").cast("long").alias("n"), total("va", lambda s, e: s + e).alias("va"), total("vb", lambda s, e: s + e).alias("vb"), total("va", lambda s, e: s + e * e).alias("vaa"))


@query("radiometric_gates", duck_scenes(SCENE) + " SELECT DISTINCT CAST(scene AS INT) AS mosaic, 'affine' AS mode, CAST(4 AS BIGINT) AS edges, TRUE AS level, TRUE AS better FROM sc")
def radiometric_gates(spark, sf_dir):
    """Every other tile is darker by a factor of 1.06 and two grey values: the model levels them, with all its gates."""
    grey = F.when((F.col("row") + F.col("col")) % 2 == 1, F.col("v") / 1.06 - 2).otherwise(F.col("v").cast("double"))
    tiles, planes, edges = _cut(scenes(pixels(spark, sf_dir), SCENE), 2, 64, 30, grey)
    verdicts, gains = correction.radiometric_model(tiles, planes, edges, (64, 64))
    mean = lambda odd: F.avg(F.when(F.col("tile").isin(1, 2) == F.lit(odd), F.col("gain")))
    level = gains.groupBy("mosaic").agg((F.abs(mean(True) / mean(False) - 1.06) < 0.015).alias("level"))
    return verdicts.join(level, "mosaic", "left").select("mosaic", "mode", "edges", "level", (F.col("corrected_bias") < 0.3 * F.col("raw_bias")).alias("better"))


@query("spatial_field_gates", duck_scenes(19) + " SELECT DISTINCT CAST(scene AS INT) AS mosaic, CASE WHEN scene % 2 = 0 THEN 'applied' ELSE 'identity' END AS status, CASE WHEN scene % 2 = 0 THEN '' ELSE 'above_safe_amplitude' END AS reason, CASE WHEN scene % 2 = 0 THEN TRUE END AS near FROM sc")
def spatial_field_gates(spark, sf_dir):
    """A ramp that all tiles share is found and taken off; where it is too strong it stays."""
    ramp = (F.col("y") - 15.5) * 0.06 + (F.col("x") - 15.5) * 0.05
    grey = 100 + (F.col("v") - 100) / 4 + ramp * F.when(F.col("scene") % 2 == 0, 1.0).otherwise(6.0)
    tiles, planes, edges = _cut(scenes(pixels(spark, sf_dir), 19), 7, 32, 20, grey)
    verdicts, fields = correction.spatial_field(tiles, planes, edges, (32, 32))
    apart = fields.select("mosaic", F.posexplode("field").alias("p", "f")).groupBy("mosaic").agg((F.avg(F.abs(F.col("f") - ((F.floor(F.col("p") / 32) - 15.5) * 0.06 + (F.col("p") % 32 - 15.5) * 0.05))) < 0.3).alias("near"))
    return verdicts.join(apart, "mosaic", "left").select("mosaic", "status", "reason", "near")


# Manifests: a well of 25 tiles is a grid of 5 x 5; all but each eighth well breaks one rule.
@query("dataset_refusals", """w AS (SELECT well, count(DISTINCT vec_id) AS n FROM px GROUP BY well),
r AS (SELECT well, CASE WHEN well % 8 = 2 THEN 'no_enabled_grid' WHEN well % 8 = 5 AND n = 25 THEN 'outside_grid' WHEN well % 8 = 4 AND n > 5 THEN 'tag_twice' WHEN well % 8 = 1 AND n > 6 THEN 'missing_files' WHEN n < 25 THEN 'partial_grid' WHEN well % 8 = 3 THEN 'sizes_differ' WHEN well % 8 = 6 THEN 'pixel_sizes_differ' WHEN well % 8 = 7 THEN 'stage_conflict' END AS rule FROM w)
SELECT CAST(well AS INT) AS well, rule, CAST(CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS BIGINT) AS bad_rows, CAST(CASE WHEN rule IS NULL THEN 25 ELSE 0 END AS BIGINT) AS tiles FROM r""")
def dataset_refusals(spark, sf_dir):
    """The first broken rule of each manifest, or how many tiles it loads."""
    import pandas as pd

    from tilework.sources import dataset

    tiles = pixels(spark, sf_dir).select("well", "ty", "tx", "vec_id").distinct()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        well, kind, entries = int(group["well"].iloc[0]), int(group["well"].iloc[0]) % 8, []
        for t in group.sort_values("vec_id").itertuples(index=False):
            entries.append((2 * len(entries), int(t.ty), 7 if kind == 5 and t.ty == t.tx == 4 else int(t.tx), f"t{t.vec_id}_CH1.tif"))
            if kind == 7:
                entries.append((2 * len(entries), int(t.ty), int(t.tx), f"t{t.vec_id}_CH2.ome.tif"))
        if kind == 4 and len(group) > 5:
            entries.append((999, 1, 0, f"again{group['vec_id'].min()}_CH1.tif"))
        return pd.DataFrame({"path": [str(well)], "content": [dataset.encode(5, 5, entries, enabled="false" if kind == 2 else "true")]})

    known = dataset.facts(tiles.groupBy("well").applyInPandas(pack, "path string, content binary"))
    known = tables.settled(known, "facts")
    place = tiles.select(F.col("well").cast("string").alias("path"), (F.col("well") % 8).alias("kind"), "ty", "tx", "vec_id")
    named = dataset.entries(known).join(place.withColumnRenamed("ty", "row").withColumnRenamed("tx", "col"), ["path", "row", "col"], "left")
    odd = lambda kind, row, col: (F.col("kind") == kind) & (F.col("row") == row) & (F.col("col") == col)
    channel = F.expr("array(struct(0 AS page, 'uint8' AS dtype, tag AS label, '' AS color))")
    sources = named.where(~F.coalesce(odd(1, 1, 1), F.lit(False))).select("path", "file", F.when(odd(3, 2, 2), 9).otherwise(8).alias("h"), F.lit(8).alias("w"), F.when(odd(6, 3, 3), 2.5).otherwise(2.0).alias("pixel_y"), F.lit(2.0).alias("pixel_x"), channel.alias("channels"))
    stages = named.select("path", "file", (F.col("col") * 1000 + F.when(odd(7, 2, 1) & (F.col("tag") == "CH2"), 1).otherwise(0)).alias("x"), (F.col("row") * 1000).alias("y"), F.lit(5).cast("long").alias("z"))
    got = dataset.load(known, sources, stages)
    loaded = got.tiles.groupBy("path").agg(F.count("*").alias("tiles"))
    out = known.select("path").distinct().join(got.refusals, "path", "left").join(loaded, "path", "left")
    return out.select(F.col("path").cast("int").alias("well"), "rule", F.coalesce("rows", F.lit(0)).alias("bad_rows"), F.coalesce("tiles", F.lit(0)).alias("tiles"))
