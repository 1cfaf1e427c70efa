"""All queries by name, and the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.functions.dialect import duck_sql, spark_sql
from tilework.operators import graph, raster, registration
from tilework.plans import mosaic_queries, rule_queries
from tilework.plans.statements import CANDIDATES, EDGES, STATEMENTS
from tilework.sources.tiles import DUCK_PX, mosaic_planes, pixels, scenes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_px(sql: str) -> str:
    if not re.search(r"\bpx\b", sql):
        return duck_sql(sql)
    rest = ", " + sql[4:].lstrip() if sql.startswith("WITH") else " " + sql
    return duck_sql("WITH " + DUCK_PX + rest)


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)}
        sql = re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r"|px)\b(?= (?!AS\b|[a-z]+ ON\b|[a-z] JOIN)|\b)", lambda m: f"{m[1]} {{{m[2]}}} AS {m[2]}" if not re.match(r" [a-z] (ON|JOIN)", text[m.end() :]) else f"{m[1]} {{{m[2]}}}", text)
        if re.search(r"\bpx\b", text):
            used["px"] = pixels(spark, sf_dir)
        return spark.sql(spark_sql(sql), **used)

    return run


for _name, _text in STATEMENTS.items():
    QUERIES[_name] = _statement(_text)
    ORACLES[_name] = _with_px(_text)


def query(name: str, oracle: str = ""):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = _with_px(oracle)
        return f

    return put


# The same as its SQL by cells of equal shifts: a vector's votes depend on its shift alone, and shifts are few (what v % 7 and
# v % 9 leave), so what the join makes grows with the pairs and not with their square.
QUERIES["shift_consensus"] = _statement("WITH " + CANDIDATES + """,
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s DESC, vec_id) AS k FROM c) q WHERE k <= 6),
d AS (SELECT pair, dy, dx, max(s) AS s FROM t GROUP BY pair, dy, dx),
p AS (SELECT dy + y AS fy, dx + x AS fx, pair, max(s) AS m FROM d LATERAL VIEW explode(array(-1, 0, 1)) a AS y LATERAL VIEW explode(array(-1, 0, 1)) b AS x GROUP BY dy + y, dx + x, pair),
v AS (SELECT fy, fx, count(*) AS votes, sum(m) AS total FROM p GROUP BY fy, fx),
w AS (SELECT t.vec_id, fy, fx, votes, total FROM t JOIN v ON t.dy = v.fy AND t.dx = v.fx ORDER BY votes DESC, round(total, 6) DESC, vec_id LIMIT 1)
SELECT max(w.vec_id) AS winner, max(w.votes) AS votes, round(max(w.total / w.votes), 6) AS score, CAST(floor(median(o.dy)) AS INT) AS dy, CAST(floor(median(o.dx)) AS INT) AS dx
FROM w JOIN p ON p.fy = w.fy AND p.fx = w.fx JOIN t o ON o.pair = p.pair AND o.s = p.m AND abs(o.dy - w.fy) <= 1 AND abs(o.dx - w.fx) <= 1""")


CANVAS = "g AS (SELECT vec_id, trow * 6 + y AS gy, tcol * 6 + x AS gx, v, CAST(least(y + 1, 8 - y, x + 1, 8 - x) AS DOUBLE) AS w FROM px)"


@query("mosaic_feather_b3", "WITH " + CANVAS + " SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, CAST(RINT[sum(w * v) / sum(w)] AS INT) AS v FROM g GROUP BY gy, gx")
def mosaic_feather(spark, sf_dir):
    return raster.feather_blend(raster.on_canvas(pixels(spark, sf_dir)), ["gy", "gx"])


@query("mosaic_nearest_b3", "WITH " + CANVAS + " SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, MAXBY[v;ROWS[w;-vec_id]] AS v FROM g GROUP BY gy, gx")
def mosaic_nearest(spark, sf_dir):
    return raster.nearest_blend(raster.on_canvas(pixels(spark, sf_dir)), ["gy", "gx"])


@query("render_block_range_join", "WITH t AS (SELECT DISTINCT vec_id, trow * 6 AS oy, tcol * 6 AS ox FROM px), b AS (SELECT DISTINCT IDIV[(trow * 6 + y);16] AS by_, IDIV[(tcol * 6 + x);16] AS bx_ FROM px) SELECT CAST(by_ AS BIGINT) AS by, CAST(bx_ AS BIGINT) AS bx, count(*) AS tiles FROM b JOIN t ON t.oy < by_ * 16 + 16 AND t.oy + 8 > by_ * 16 AND t.ox < bx_ * 16 + 16 AND t.ox + 8 > bx_ * 16 GROUP BY by_, bx_")
def render_blocks(spark, sf_dir):
    tiles = pixels(spark, sf_dir).select("vec_id", (F.col("trow") * 6).alias("oy"), (F.col("tcol") * 6).alias("ox")).distinct().withColumn("h", F.lit(8)).withColumn("w", F.lit(8))
    return raster.blocks_of_tiles(tiles, 16).groupBy("by", "bx").agg(F.count("*").alias("tiles"))


LAP = "SELECT a.vec_id, a.y, a.x, CAST(coalesce(lag(a.v) OVER c + lead(a.v) OVER c + lag(a.v) OVER r + lead(a.v) OVER r - 4 * a.v, 0) AS INT) AS lap FROM px a WINDOW r AS (PARTITION BY a.vec_id, a.y ORDER BY a.x), c AS (PARTITION BY a.vec_id, a.x ORDER BY a.y)"


@query("laplacian", LAP)
def laplacian(spark, sf_dir):
    return raster.laplacian(pixels(spark, sf_dir), ["vec_id"]).select("vec_id", "y", "x", F.col("lap").cast("int").alias("lap"))


def _box(k: int, source: str, value: str, keys: str = "vec_id") -> str:
    return f"SELECT {keys}, y, x, sum(b) AS s FROM (SELECT a.*, b.{value} AS b FROM (SELECT {keys}, y, x, greatest(0, least(7, y + dy)) AS cy, greatest(0, least(7, x + dx)) AS cx FROM {source}, (SELECT unnest(range({1 - k}, {k + 1})) AS dy), (SELECT unnest(range({1 - k}, {k + 1})) AS dx)) a JOIN {source} b ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in keys.split(','))} AND a.cy = b.y AND a.cx = b.x) q GROUP BY {keys}, y, x"


@query("box_mean_k2", f"SELECT vec_id, y, x, CAST(s AS DOUBLE) / 16 AS m FROM ({_box(2, 'px', 'v')})")
def box_mean(spark, sf_dir):
    return raster.box_sum(pixels(spark, sf_dir), ["vec_id"], 2).select("vec_id", "y", "x", (F.col("s").cast("double") / 16).alias("m"))


FOCUS = "WITH l AS (" + LAP.replace("SELECT a.vec_id,", "SELECT a.vec_id, a.well2, a.pos, a.ch, a.z, a.v,") + "), e AS (SELECT *, lap * lap AS e FROM l), s AS (" + _box(2, "e", "e") + "), j AS (SELECT e.*, s.s FROM e JOIN s ON e.vec_id = s.vec_id AND e.y = s.y AND e.x = s.x) "


@query("z_focus", FOCUS + "SELECT well2, pos, ch, y, x, MAXBY[v;ROWS[s;-z]] AS v FROM j GROUP BY well2, pos, ch, y, x")
def z_focus(spark, sf_dir):
    return raster.focus_fusion(pixels(spark, sf_dir), ["well2", "pos", "ch"]).select("well2", "pos", "ch", "y", "x", "v")


@query("z_focus_index", FOCUS + "SELECT well2, pos, ch, y, x, MAXBY[z;ROWS[s;-z]] AS z FROM j GROUP BY well2, pos, ch, y, x")
def z_focus_index(spark, sf_dir):
    return raster.focus_fusion(pixels(spark, sf_dir), ["well2", "pos", "ch"]).select("well2", "pos", "ch", "y", "x", "z")


@query("block_mean_f2", "SELECT vec_id, CAST(IDIV[y;2] AS INT) AS by, CAST(IDIV[x;2] AS INT) AS bx, CAST(RINT[sum(v) / CAST(4 AS DOUBLE)] AS INT) AS v FROM px GROUP BY vec_id, IDIV[y;2], IDIV[x;2]")
def block_mean(spark, sf_dir):
    return raster.block_mean(pixels(spark, sf_dir), ["vec_id"], 2)


@query("block_mean_f3_edge", "SELECT vec_id, CAST(IDIV[y;3] AS INT) AS by, CAST(IDIV[x;3] AS INT) AS bx, CAST(RINT[sum(v * CASE WHEN y = 7 THEN 2 ELSE 1 END * CASE WHEN x = 7 THEN 2 ELSE 1 END) / CAST(9 AS DOUBLE)] AS INT) AS v FROM px GROUP BY vec_id, IDIV[y;3], IDIV[x;3]")
def block_mean_edge(spark, sf_dir):
    return raster.block_mean(pixels(spark, sf_dir), ["vec_id"], 3)


def _edges(spark, sf_dir) -> DataFrame:
    tiles = pixels(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("trow").alias("row"), F.col("tcol").alias("col")).distinct()
    return raster.neighbours(tiles)


@query("neighbour_edges", "WITH " + EDGES + " SELECT a, b, axis FROM e")
def neighbour_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("overlap_pairs", "WITH " + EDGES + " SELECT a, b, axis, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, va, vb FROM o")
def overlap_pairs(spark, sf_dir):
    return raster.overlaps(raster.on_canvas(pixels(spark, sf_dir)), _edges(spark, sf_dir)).select("a", "b", "axis", "gy", "gx", "va", "vb")


def _measured(spark, sf_dir) -> DataFrame:
    """Edges of mosaics of five rows, with planted steps of 6 px, a wobble of the pixels' and a few wild ones."""
    px = raster.on_canvas(pixels(spark, sf_dir))
    means = raster.overlaps(px, _edges(spark, sf_dir)).groupBy("a", "b", "axis").agg(F.avg(F.col("va") - F.col("vb")).alias("d"), F.count("*").alias("n"))
    wild = F.when((F.col("a") * 7 + F.col("b")) % 41 == 0, 9.0).otherwise(0.0)
    along, across = 6 + F.col("d") / 100 + wild, F.col("d") / 100
    edges = means.withColumn("mosaic", F.expr("cast(a div 125 as int)")).where("a div 125 = b div 125")
    return edges.select("mosaic", "a", "b", F.when(F.col("axis") == "y", along).otherwise(across).alias("dy"), F.when(F.col("axis") == "x", along).otherwise(across).alias("dx"), "d", F.lit(1.0).alias("weight"))


@query("pose_solve_irls")
def pose_solve(spark, sf_dir):
    return graph.pose_solve(_measured(spark, sf_dir), step=(6.0, 6.0, 25))


@query("outlier_rejection")
def outlier_rejection(spark, sf_dir):
    return graph.pose_solve(_measured(spark, sf_dir), reject=True, step=(6.0, 6.0, 25))


@query("scalar_graph_solve")
def scalar_solve(spark, sf_dir):
    return graph.scalar_solve(_measured(spark, sf_dir))


@query("components")
def components(spark, sf_dir):
    """Tiles that edges join whose overlaps correlate by 0.08 or more."""
    px = raster.on_canvas(pixels(spark, sf_dir))
    seams = raster.overlaps(px, _edges(spark, sf_dir)).groupBy("a", "b").agg(F.try_divide(F.covar_pop("va", "vb"), F.stddev_pop("va") * F.stddev_pop("vb")).alias("ncc"), F.least(F.stddev_pop("va"), F.stddev_pop("vb")).alias("spread"))
    accepted = seams.where("spread >= 1e-9 AND ncc >= 0.08 AND a div 125 = b div 125")
    return graph.components(accepted.select(F.expr("cast(a div 125 as int)").alias("mosaic"), "a", "b"))


ORACLES["components"] = duck_sql("WITH RECURSIVE " + DUCK_PX + ", " + EDGES + """,
k AS (SELECT a // 125 AS mosaic, a, b FROM o WHERE a // 125 = b // 125 GROUP BY a, b
  HAVING stddev_pop(va) >= 1e-9 AND stddev_pop(vb) >= 1e-9 AND corr(va::DOUBLE, vb::DOUBLE) >= 0.08),
n AS (SELECT mosaic, a, b FROM k UNION ALL SELECT mosaic, b, a FROM k),
r(mosaic, node, root) AS (SELECT DISTINCT mosaic, a, a FROM n UNION SELECT n.mosaic, n.b, r.root FROM r JOIN n ON n.a = r.node)
SELECT CAST(mosaic AS INTEGER) AS mosaic, node, min(root) AS comp FROM r GROUP BY mosaic, node""")


@query("phase_correlation")
def phase_correlation(spark, sf_dir):
    """Each tile against itself moved by one row and two columns: the move is found again."""
    px = pixels(spark, sf_dir)
    a = px.select("vec_id", "y", "x", F.col("v").alias("va"))
    b = px.select("vec_id", ((F.col("y") + 1) % 8).alias("y"), ((F.col("x") + 2) % 8).alias("x"), F.col("v").alias("vb"))
    pairs = a.join(b, ["vec_id", "y", "x"]).select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), "y", "x", "va", "vb")
    return registration.phase_correlate(pairs)


def _containers(spark, sf_dir) -> DataFrame:
    """A container a plate well of 25 tiles: an image of 40 x 40, in tiles of 16."""
    import numpy as np
    import pandas as pd

    from tilework.sources import containers

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((1, 40, 40), np.uint8)
        image[0, group["gy"], group["gx"]] = group["v"]
        return pd.DataFrame({"path": [f"Cap_A{group['well'].iloc[0]:02d}_CH1.ktf"], "content": [containers.encode(image, 16, 2000.0)]})

    px = pixels(spark, sf_dir).select("well", (F.col("ty") * 8 + F.col("y")).alias("gy"), (F.col("tx") * 8 + F.col("x")).alias("gx"), "v")
    return px.groupBy("well").applyInPandas(encode, "path string, content binary")


# all of each image; places without a vector are 0
KTF_IMAGES = "k AS (SELECT w.well, y.y, x.x, coalesce(p.v, 0) AS v FROM (SELECT DISTINCT well FROM px) w CROSS JOIN range(40) y(y) CROSS JOIN range(40) x(x) LEFT JOIN (SELECT well, ty * 8 + y AS gy, tx * 8 + x AS gx, v FROM px) p ON p.well = w.well AND p.gy = y.y AND p.gx = x.x)"


@query("ktf_roundtrip", "WITH " + KTF_IMAGES + " SELECT CAST(well AS INT) AS well, CAST(y AS INT) AS gy, CAST(x AS INT) AS gx, CAST(v AS INT) AS v FROM k")
def ktf_roundtrip(spark, sf_dir):
    from tilework.sources import containers

    got = containers.pixels_of(_containers(spark, sf_dir))
    return got.select(F.regexp_extract("path", r"_A(\d+)_", 1).cast("int").alias("well"), F.col("y").alias("gy"), F.col("x").alias("gx"), "v")


@query("ktf_region", "WITH " + KTF_IMAGES + " SELECT CAST(well AS INT) AS well, CAST(IDIV[(y - 5);3] AS INT) AS oy, CAST(IDIV[(x - 7);3] AS INT) AS ox, CAST(v AS INT) AS v FROM k WHERE y >= 5 AND y < 31 AND x >= 7 AND x < 38 AND (y - 5) % 3 = 0 AND (x - 7) % 3 = 0")
def ktf_region(spark, sf_dir):
    """A rectangle of each container, every third pixel, read from files through the data source."""
    from tilework.operators.tables import new_folder
    from tilework.sources import sinks, tiled

    folder = new_folder(spark)
    sinks.write_files(_containers(spark, sf_dir).select(F.col("path").alias("name"), "content"), folder).write.format("noop").mode("overwrite").save()
    got = tiled.region(spark, folder, 5, 7, 31, 38, stride=3)
    return got.select(F.regexp_extract("path", r"_A(\d+)_", 1).cast("int").alias("well"), "oy", "ox", "v")


@query("ktf_region_tiles", "WITH r AS (SELECT DISTINCT CAST(well AS INT) AS well, well % 30 AS y0, well % 7 * 4 AS x0 FROM px) SELECT well, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, CAST((ty * 3 + tx) * 256 AS BIGINT) AS tile_offset FROM r, range(3) a(ty), range(3) b(tx) WHERE ty * 16 < y0 + 9 AND ty * 16 + 16 > y0 AND tx * 16 < x0 + 11 AND tx * 16 + 16 > x0")
def ktf_region_tiles(spark, sf_dir):
    """The tiles of the index that a rectangle of each container touches."""
    from tilework.sources import containers

    files = _containers(spark, sf_dir)
    regions = files.select("path", F.regexp_extract("path", r"_A(\d+)_", 1).cast("int").alias("region")).selectExpr("region", "path", "region % 30 AS y0", "region % 7 * 4 AS x0", "region % 30 + 9 AS y1", "region % 7 * 4 + 11 AS x1")
    got = containers.tiles_of_regions(containers.tiles_of(files), regions, 16)
    return got.select(F.col("region").alias("well"), "ty", "tx", F.col("offset").alias("tile_offset"))


@query("ktf_headers", "SELECT DISTINCT CAST(well AS INT) AS well, CAST(40 AS INT) AS width, CAST(9 AS INT) AS n_tiles, CAST(2000 AS DOUBLE) AS calibration_nm, CAST(9 AS BIGINT) AS patch_count, CAST(256 AS BIGINT) AS tile_bytes FROM px")
def ktf_headers(spark, sf_dir):
    from tilework.sources import containers

    got = containers.headers(_containers(spark, sf_dir)).where("error is null")
    return got.select(F.regexp_extract("path", r"_A(\d+)_", 1).cast("int").alias("well"), "width", "n_tiles", "calibration_nm", "patch_count", "tile_bytes")


@query("gci_manifest_roundtrip", "SELECT DISTINCT well, ty AS row, tx AS col, concat('t', CAST(vec_id AS VARCHAR), '.tif') AS file FROM px")
def manifest_roundtrip(spark, sf_dir):
    import pandas as pd

    from tilework.sources import dataset

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        entries = [(n, int(r), int(c), f"t{k}.tif") for n, (r, c, k) in enumerate(zip(group["ty"], group["tx"], group["vec_id"]))]
        return pd.DataFrame({"path": [str(group["well"].iloc[0])], "content": [dataset.encode(5, 5, entries)]})

    tiles = pixels(spark, sf_dir).select("well", "ty", "tx", "vec_id").distinct()
    got = dataset.entries(dataset.facts(tiles.groupBy("well").applyInPandas(pack, "path string, content binary")))
    return got.select(F.col("path").cast("int").alias("well"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "file")


def _arriving(spark, sf_dir) -> DataFrame:
    """The table of vectors as a stream of its files."""
    path = f"{sf_dir}/embeddings.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    one_file = table.inputFiles()[0].rstrip("/").endswith("embeddings.parquet")
    return reader.option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir) if one_file else reader.parquet(path)


@query("stream_z_max", "SELECT well2, pos, ch, y, x, max(v) AS v FROM px GROUP BY well2, pos, ch, y, x")
def stream_z_max(spark, sf_dir):
    from tilework.sources.tiles import pixels_from
    from tilework.streaming import folds

    return folds.drained(spark, folds.running_max(pixels_from(spark, _arriving(spark, sf_dir)), ["well2", "pos", "ch", "y", "x"]))


@query("stream_z_focus", FOCUS + "SELECT well2, pos, ch, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(MAXBY[v;ROWS[s;-z]] AS INT) AS v, CAST(MAXBY[z;ROWS[s;-z]] AS INT) AS z FROM j GROUP BY well2, pos, ch, y, x")
def stream_z_focus(spark, sf_dir):
    """The sharpest pixels of stacks whose slices arrive, folded with state."""
    from tilework.operators.tables import new_folder
    from tilework.streaming import folds

    keys, folder = ["well2", "pos", "ch"], new_folder(spark)
    place = [f"cast(vec_id {e} as int) AS {n}" for e, n in (("div 60", "well2"), ("% 60 div 10", "pos"), ("% 60 div 5 % 2", "ch"), ("% 5", "z"))]
    slices = _arriving(spark, sf_dir).selectExpr(*place, "1 AS generation", "8 AS h", "8 AS w", "transform(embedding, e -> cast(rint((cast(e as double) + 1) * 100) as float)) AS v")
    folds.kept(folds.focus_fold(slices, keys, 2), folder).awaitTermination()
    flat = folds.latest(spark, folder, keys).select(*keys, F.posexplode(F.arrays_zip("v", "z")).alias("p", "e"))
    return flat.selectExpr(*keys, "cast(p div 8 as int) AS y", "p % 8 AS x", "cast(e.v as int) AS v", "e.z AS z")


def _mosaics(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Mosaics of 2 x 2 tiles of 104 x 104, cut 48 apart from scenes of 19 x 19 vectors; the stage is off by up to three
    pixels."""
    image = scenes(pixels(spark, sf_dir), 19).withColumnRenamed("scene", "mosaic")
    tile = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    cut = image.select("*", tile.alias("tile")).withColumn("y", F.expr("gy - tile div 2 * 48")).withColumn("x", F.expr("gx - tile % 2 * 48")).where("y between 0 and 103 and x between 0 and 103")
    planes = cut.groupBy("mosaic", "tile").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p")).select("mosaic", "tile", F.expr("transform(p, e -> cast(e.v as float))").alias("v"))
    tiles = image.select("mosaic").distinct().select("mosaic", tile.alias("tile")).selectExpr("mosaic", "tile", "cast(tile div 2 as int) AS row", "cast(tile % 2 as int) AS col", "cast(tile div 2 * 48 + tile * 5 % 7 - 3 as double) AS stage_y", "cast(tile % 2 * 48 + tile * 3 % 5 - 2 as double) AS stage_x", "104 AS h", "104 AS w")
    return tiles, planes


# the last scene is filled up with the first vectors
SCENES = "m AS (SELECT DISTINCT CAST(IDIV[vec_id;361] AS INT) AS mosaic FROM px)"


@query("edge_phase_residual", "WITH " + SCENES + ", t AS (SELECT 0 AS a, 1 AS b UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 3 UNION ALL SELECT 2, 3) SELECT mosaic, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(48 * (IDIV[b;2] - IDIV[a;2]) AS INT) AS dy, CAST(48 * (b % 2 - a % 2) AS INT) AS dx, TRUE AS accepted FROM m JOIN t ON 1 = 1")
def edge_phase_residual(spark, sf_dir):
    """The shifts of neighbouring tiles, measured on their overlaps, in whole pixels."""
    from tilework.operators import geometry

    return geometry.measure_edges(*_mosaics(spark, sf_dir)).select("mosaic", "a", "b", F.rint("dy").cast("int").alias("dy"), F.rint("dx").cast("int").alias("dx"), "accepted")


@query("geometry_origins", "WITH " + SCENES + ", t AS (SELECT 0 AS tile UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) SELECT mosaic, CAST(tile AS BIGINT) AS tile, CAST(48 * IDIV[tile;2] AS INT) AS y, CAST(48 * (tile % 2) AS INT) AS x FROM m JOIN t ON 1 = 1")
def geometry_origins(spark, sf_dir):
    from tilework.operators import geometry

    tiles, planes = _mosaics(spark, sf_dir)
    placed = geometry.origins(tiles, geometry.measure_edges(tiles, planes))
    return placed.select("mosaic", "tile", F.rint("y").cast("int").alias("y"), F.rint("x").cast("int").alias("x"))


@query("geometry_summary", "WITH " + SCENES + " SELECT mosaic, CAST(152 AS INT) AS height, CAST(152 AS INT) AS width, CAST(4 AS BIGINT) AS accepted, CAST(4 AS BIGINT) AS expected, CAST(1 AS BIGINT) AS parts, CAST(0 AS INT) AS warnings FROM m")
def geometry_summary(spark, sf_dir):
    from tilework.operators import geometry

    tiles, planes = _mosaics(spark, sf_dir)
    edges = geometry.measure_edges(tiles, planes)
    report = geometry.summary(tiles, geometry.origins(tiles, edges), geometry.checked_edges(tiles, edges))
    return report.select("mosaic", "height", "width", "accepted", "expected", "parts", F.size("warnings").alias("warnings"))


def _fits(spark, sf_dir) -> DataFrame:
    from tilework.operators import radiometry

    planes = mosaic_planes(spark, sf_dir).withColumnsRenamed({"vec_id": "id", "trow": "row", "tcol": "col"})
    pairs = raster.plane_overlaps(planes).withColumn("mosaic", F.expr("cast(a div 125 as int)")).where("a div 125 = b div 125")
    edges = pairs.groupBy("mosaic", "a", "b").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("va", "vb")])  # an id may have several planes
    return radiometry.sample_fits(edges, {"samples": 8, "correlation": -1.0, "inlier": 0.3})


@query("radiometric_pair_fits")
def radiometric_pair_fits(spark, sf_dir):
    return _fits(spark, sf_dir)


@query("radiometric_model")
def radiometric_model(spark, sf_dir):
    from tilework.operators import radiometry

    return radiometry.model(_fits(spark, sf_dir), steady=1.0)


# rules with parameters; SQL over px is written with it
RESIZED = "WITH w AS (SELECT t, c, greatest(0, 1 - abs(t * 7.0::DOUBLE / {0} - c)) AS w FROM range({1}) a(t), range(8) b(c)) SELECT * FROM w WHERE w > 0"
rule_queries.ORACLES["field_resize"] = "WITH " + duck_sql(DUCK_PX) + f", wy AS ({RESIZED.format(4, 5)}), wx AS ({RESIZED.format(10, 11)}) SELECT vec_id, wy.t::INT AS y, wx.t::INT AS x, round(sum(v * wy.w * wx.w), 5) AS v FROM px JOIN wy ON wy.c = px.y JOIN wx ON wx.c = px.x GROUP BY vec_id, wy.t, wx.t"
QUERIES |= rule_queries.QUERIES
ORACLES |= rule_queries.ORACLES
QUERIES |= mosaic_queries.QUERIES
ORACLES |= mosaic_queries.ORACLES
