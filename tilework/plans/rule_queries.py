"""Queries of operators.rules over the given tables, and SQL written for each on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.operators import rules
from tilework.sources.tiles import pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return put


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("auto_downsample", "WITH p AS (SELECT p_partkey AS k, p_size * 900 AS w, p_size * 700 + p_partkey % 97 AS h FROM part) SELECT k, min(CAST(2 AS BIGINT) ** e)::BIGINT AS ds FROM p, range(20) t(e) WHERE CAST(2 AS DOUBLE) ** e >= sqrt(w::DOUBLE * h / 1e6 / 16) GROUP BY k")
def auto_downsample(spark, sf_dir):
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size * 900 AS w", "p_size * 700 + p_partkey % 97 AS h")
    return p.select("k", rules.overview_downsample(F.col("w"), F.col("h")).alias("ds"))


@query("detail_downsample", """WITH p AS (SELECT p_partkey AS k, p_size * 800 AS w, p_size * 500 AS h, (1 + p_partkey % 8) / 8.0::DOUBLE AS m, 8 AS o FROM part)
SELECT k, CASE WHEN max(m) * 8 > 1.05 THEN min(CASE WHEN d >= greatest(1, round_even(1 / m, 0)) AND (w // d) * (h // d) <= 6000000 THEN d END) END::BIGINT AS ds FROM p, range(1, 100) t(d) GROUP BY k""")
def detail_downsample(spark, sf_dir):
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size * 800 AS w", "p_size * 500 AS h", "(1 + p_partkey % 8) / 8D AS m")
    return p.select("k", rules.detail_downsample(F.col("w"), F.col("h"), F.col("m"), F.lit(8)).alias("ds"))


@query("power_of_two_snap", "SELECT p_partkey AS k, max(1 << e)::BIGINT AS ds FROM part, range(12) t(e) WHERE (1 << e) <= p_size * 3 AND (512 >> (p_partkey % 4)) % (1 << e) = 0 GROUP BY p_partkey")
def power_of_two_snap(spark, sf_dir):
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size * 3 AS want", "shiftright(512, cast(p_partkey % 4 AS int)) AS tile")
    return p.select("k", rules.snapped_downsample(F.col("want"), F.col("tile")).alias("ds"))


@query("scale_bar_choice", "WITH m AS (SELECT p_partkey AS k, p_retailprice::DOUBLE * p_size * p_size / 10000 AS most FROM part) SELECT k, round(max(v * CASE WHEN e < 0 THEN 1 / (10.0::DOUBLE ** (-e)) ELSE 10.0::DOUBLE ** e END), 6) AS um, CASE WHEN max(v * 10.0::DOUBLE ** e) >= 1000 THEN 'mm' ELSE 'um' END AS unit FROM m, range(-4, 7) t(e), (VALUES (1), (2), (5)) s(v) WHERE v * CASE WHEN e < 0 THEN 1 / (10.0::DOUBLE ** (-e)) ELSE 10.0::DOUBLE ** e END <= most GROUP BY k")
def scale_bar_choice(spark, sf_dir):
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "cast(p_retailprice AS double) * p_size * p_size / 10000 AS most").withColumn("bar", rules.scale_bar(F.col("most")))
    return p.select("k", F.round("bar", 6).alias("um"), F.when(F.col("bar") >= 1000, "mm").otherwise("um").alias("unit"))


@query("visible_rectangle", "WITH p AS (SELECT p_partkey AS k, p_size - 25 AS px, 10 - p_size AS py, (1 + p_partkey % 6) / 4.0::DOUBLE AS z, p_size * 200 AS w, p_size * 100 AS h FROM part) SELECT k, floor(greatest(0, least(-px / z * 4, w)))::BIGINT AS x0, floor(greatest(0, least(-py / z * 4, h)))::BIGINT AS y0, ceil(greatest(0, least((1280 - px) / z * 4, w)))::BIGINT AS x1, ceil(greatest(0, least((720 - py) / z * 4, h)))::BIGINT AS y1 FROM p")
def visible_rectangle(spark, sf_dir):
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size - 25 AS px", "10 - p_size AS py", "(1 + p_partkey % 6) / 4D AS z", "p_size * 200 AS w", "p_size * 100 AS h")
    return p.select("k", rules.visible_rectangle(F.col("px"), F.col("py"), F.col("z"), F.lit(4), (1280, 720), F.col("w"), F.col("h")).alias("r")).select("k", "r.*")


@query("packed_double", "SELECT p_partkey AS k, round((p_retailprice::DOUBLE - 1000) * p_size, 6) AS v FROM part")
def packed_double(spark, sf_dir):
    """Doubles taken apart into two halves, and put together again."""
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "cast((cast(p_retailprice AS double) - 1000) * p_size AS double) AS v")
    p = p.withColumn("size", F.abs("v")).withColumn("e", F.when(F.col("v") != 0, F.floor(F.log2("size"))))
    p = p.withColumn("e", F.when(F.pow(F.lit(2.0), F.col("e")) > F.col("size"), F.col("e") - 1).when(F.pow(F.lit(2.0), F.col("e") + 1) <= F.col("size"), F.col("e") + 1).otherwise(F.col("e")))
    p = p.withColumn("f", ((F.col("size") / F.pow(F.lit(2.0), F.col("e")) - 1) * 2.0**52).cast("long"))
    high = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.when(F.col("v") < 0, F.lit(2**31)).otherwise(F.lit(0)) + (F.col("e") + 1023) * 2**20 + F.shiftright("f", 32)).cast("long")
    return p.select("k", F.round(rules.packed_double(F.coalesce(F.col("f").bitwiseAND(F.lit(2**32 - 1)), F.lit(0)), high), 6).alias("v"))


@query("field_resize", "")
def field_resize(spark, sf_dir):
    return rules.resized_field(pixels(spark, sf_dir).select("vec_id", "y", "x", "v"), ["vec_id"], (8, 8), (5, 11)).select("vec_id", "y", "x", F.round("v", 5).alias("v"))


@query("safe_name", "WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN ' lpt' || (p_size % 12) WHEN p_partkey % 5 = 1 THEN '..' || p_name || '? ' ELSE p_name || ':' || p_type || '/' || p_brand || '. ' || repeat('x', p_size) END AS n FROM part), r AS (SELECT k, trim(regexp_replace(trim(n), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' .') AS n FROM s) SELECT k, substr(CASE WHEN regexp_full_match(upper(n), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN n || '_' ELSE n END, 1, 80) AS name FROM r")
def safe_name(spark, sf_dir):
    n = F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat(' lpt', p_size % 12) WHEN p_partkey % 5 = 1 THEN concat('..', p_name, '? ') ELSE concat(p_name, ':', p_type, '/', p_brand, '. ', repeat('x', p_size)) END")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), rules.safe_name(n).alias("name"))


@query("natural_sort", "WITH k AS (SELECT c_custkey AS k, c_nationkey AS g, 'Well ' || c_mktsegment || (c_custkey * 7919 % 120) || '_z' || (c_custkey % 13) AS name FROM customer) SELECT k, name, row_number() OVER (PARTITION BY g ORDER BY lower(regexp_extract(name, '^(\\D+)', 1)), regexp_extract(name, '(\\d+)_z', 1)::INT, regexp_extract(name, '(\\d+)$', 1)::INT, k)::INT AS place FROM k")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window

    c = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_nationkey AS g", "concat('Well ', c_mktsegment, c_custkey * 7919 % 120, '_z', c_custkey % 13) AS name")
    return c.select("k", "name", F.row_number().over(Window.partitionBy("g").orderBy(rules.natural_key(F.col("name")), "k")).alias("place"))


@query("version_compare", "WITH v AS (SELECT p_partkey AS k, p_size % 4 AS a, p_partkey % 250 AS b, p_partkey % 3 AS c FROM part) SELECT k, (a > 2 OR (a = 2 AND (b > 101 OR (b = 101 AND c > 1))))::INT AS newer FROM v")
def version_compare(spark, sf_dir):
    v = F.expr("concat(' v', p_size % 4, '.', p_partkey % 250, '.', p_partkey % 3, if(p_partkey % 2 = 0, '-rc1', '+b7.9'))")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (rules.version_key(v) > rules.version_key(F.lit("2.101.1"))).cast("int").alias("newer"))


@query("text_filter_digit_boundary", "SELECT c_custkey AS k, c_name FROM customer WHERE regexp_matches(lower(c_name) || ' ', '12[^0-9]')")
def text_filter(spark, sf_dir):
    return _table(spark, sf_dir, "customer").where(rules.text_filter(F.col("c_name"), "12")).select(F.col("c_custkey").alias("k"), "c_name")


@query("path_key", "SELECT c_custkey AS k, '/d' || c_nationkey || '/' || c_mktsegment AS path FROM customer")
def path_key(spark, sf_dir):
    p = F.expr("concat('/d', c_nationkey, CASE c_custkey % 4 WHEN 0 THEN '/./' WHEN 1 THEN '/x/../' WHEN 2 THEN '//' ELSE '/x/y/../../' END, c_mktsegment, if(c_custkey % 3 = 0, '/', ''))")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), rules.path_key(p).alias("path"))


@query("save_suffix", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_brand || '.OME.tif' WHEN 1 THEN p_brand || '.png.ome.tif' WHEN 2 THEN p_brand || '.TIF' ELSE p_brand || '.ome.tif' END AS name FROM part")
def save_suffix(spark, sf_dir):
    n = F.expr("concat(p_brand, CASE p_partkey % 4 WHEN 0 THEN '.OME.tif' WHEN 1 THEN '.png' WHEN 2 THEN '.TIF' ELSE '' END)")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), rules.save_name(n, F.lit(".ome.tif"), [".tif", ".ome.tif"]).alias("name"))


@query("error_names", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'read_only' WHEN 1 THEN 'no_permission' WHEN 2 THEN 'disk_full' WHEN 3 THEN 'cannot open ' || p_brand || '.tif' ELSE 'no_permission' END AS name FROM part")
def error_names(spark, sf_dir):
    t = F.expr("CASE p_partkey % 5 WHEN 0 THEN '[Errno 30] Read-only file system' WHEN 1 THEN 'Permission denied: x' WHEN 2 THEN concat('No space left on ', p_brand) WHEN 3 THEN concat('cannot open ', p_brand, '.part.tif') ELSE 'oops' END")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), rules.failure(t, F.expr("if(p_partkey % 5 = 4, 13, null)")).alias("name"))


@query("pdf_name", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'A_B' ELSE 'cap' || c_nationkey END || '_plate.pdf' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'A_B' ELSE 'cap' || c_nationkey END || '_plate_series.pdf' END AS name FROM customer")
def pdf_name(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "if(c_custkey % 2 = 0, array(concat('/x/cap', c_nationkey)), array(concat('/x/cap', c_nationkey), '/x/z')) AS paths", "if(c_custkey % 3 = 0, 'A/B. ', '') AS label")
    return c.select("k", rules.plate_pdf_name(F.col("paths"), F.col("label")).alias("name"))


@query("unique_labels", "WITH p AS (SELECT c_custkey AS place, '/r/g' || c_custkey || '/n' || c_nationkey || '/' || c_mktsegment AS path, c_nationkey AS n, c_mktsegment AS m FROM customer) SELECT place, path, CASE WHEN row_number() OVER (PARTITION BY n, m ORDER BY place) = 1 THEN 'n' || n || '/' || m ELSE 'g' || place || '/n' || n || '/' || m END AS label FROM p")
def unique_labels(spark, sf_dir):
    return rules.unique_labels(_table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS long) AS place", "concat('/r/g', c_custkey, '/n', c_nationkey, '/', c_mktsegment) AS path"))


PATHS = "SELECT '/d' || (o_custkey % 40) || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '/e' || (o_orderkey % 6) || CASE WHEN o_orderkey % 3 = 0 THEN '/sub' ELSE '' END END AS dir, o_orderkey AS k FROM orders"


@query("discover_outermost", f"WITH f AS ({PATHS}), d AS (SELECT DISTINCT dir FROM f) SELECT dir FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE d.dir LIKE b.dir || '/%')")
def discover_outermost(spark, sf_dir):
    return rules.outermost(_table(spark, sf_dir, "orders").select(F.expr("concat('/d', o_custkey % 40, if(o_orderkey % 9 = 0, '', concat('/e', o_orderkey % 6, if(o_orderkey % 3 = 0, '/sub', ''))))").alias("dir")))


@query("column_order", "SELECT c_nationkey AS plate, col, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN regexp_full_match(col, '[0-9]+') THEN col::INT ELSE 0 END, col)::INT AS place FROM (SELECT DISTINCT c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey % 3 ELSE (c_custkey % 24)::VARCHAR END AS col FROM customer)")
def column_order(spark, sf_dir):
    return rules.ordered_columns(_table(spark, sf_dir, "customer").selectExpr("c_nationkey AS plate", "if(c_custkey % 7 = 0, concat('x', c_custkey % 3), cast(c_custkey % 24 AS string)) AS col"))


SERIES = "SELECT c_nationkey AS list, c_custkey AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer"


@query("series_reorder", f"WITH s AS ({SERIES}), c AS (SELECT list, count(*) AS n FROM s GROUP BY list), t AS (SELECT s.*, 2 + list % 3 AS here, n FROM s JOIN c USING (list)) SELECT list, key, CASE WHEN here > n OR here + 2 > n THEN place WHEN place = here THEN here + 2 WHEN place IN (here + 1, here + 2) THEN place - 1 ELSE place END::INT AS new_place FROM t")
def series_reorder(spark, sf_dir):
    from pyspark.sql import Window

    s = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("list"), F.col("c_custkey").alias("key"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("place"))
    return rules.moved(s.withColumn("chosen", F.expr("place = 2 + list % 3")), 2).select("list", "key", "new_place")


@query("series_add_remove", """WITH e AS (SELECT o_orderkey AS step, '/p' || o_custkey % 50 AS key, o_orderkey % 3 <> 0 AS inc FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY step DESC) AS r FROM e),
off AS (SELECT key, max(step) AS at FROM e WHERE NOT inc GROUP BY key) SELECT l.key, min(e.step) AS added FROM l JOIN e ON e.key = l.key LEFT JOIN off ON off.key = l.key WHERE l.r = 1 AND l.inc AND e.step > coalesce(off.at, -1) GROUP BY l.key""")
def series_add_remove(spark, sf_dir):
    return rules.series_after(_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS step", "concat('/p', o_custkey % 50, if(o_orderkey % 2 = 0, '/', '')) AS path", "o_orderkey % 3 <> 0 AS included"))


@query("capture_groups", "WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'n' || c_nationkey END AS grp, CASE WHEN c_custkey % 4 = 0 THEN 'root / XY' || c_custkey ELSE 'c' || c_custkey || '/XY1' END AS label FROM customer) SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY k)::INT AS place FROM p")
def capture_groups(spark, sf_dir):
    p = _table(spark, sf_dir, "customer").selectExpr("if(c_custkey % 4 = 0, concat('/data/root/XY', c_custkey), concat('/data/root/n', c_nationkey, '/c', c_custkey, '/XY1')) AS path")
    return rules.capture_groups(p, "/data/root").select("grp", "label", "place")


@query("capture_facts", "WITH i AS (SELECT c_nationkey AS capture, c_custkey AS place, (c_custkey % 3) * 100 AS w, (c_custkey % 4) * 70 AS h, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 11 ELSE 0 END::DOUBLE AS um FROM customer) SELECT capture, CASE WHEN max(greatest(w, h)) > 0 THEN max(greatest(w, h)) ELSE 1600 END::BIGINT AS largest, round(coalesce(arg_min(h / w, place) FILTER (w > 0 AND h > 0), 1), 6) AS aspect, coalesce(arg_min(um, place) FILTER (um > 0), 0) AS um FROM i GROUP BY capture")
def capture_facts(spark, sf_dir):
    i = _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS capture", "c_custkey AS place", "(c_custkey % 3) * 100 AS width", "(c_custkey % 4) * 70 AS height", "cast(if(c_custkey % 5 = 0, c_custkey % 11, 0) AS double) AS um")
    return rules.capture_facts(i).select("capture", F.col("largest").cast("long").alias("largest"), F.round("aspect", 6).alias("aspect"), "um")


@query("manifest_choice", "SELECT '/d' || c_nationkey AS dir, CASE WHEN count(*) FILTER (c_custkey % 29 = 0) = 1 THEN max('m' || c_custkey || '.GCI') FILTER (c_custkey % 29 = 0) END AS manifest, CASE WHEN count(*) FILTER (c_custkey % 29 = 0) = 0 THEN 'none' WHEN count(*) FILTER (c_custkey % 29 = 0) > 1 THEN 'several' END AS error FROM customer GROUP BY c_nationkey")
def manifest_choice(spark, sf_dir):
    return rules.only_manifest(_table(spark, sf_dir, "customer").selectExpr("concat('/d', c_nationkey) AS dir", "if(c_custkey % 29 = 0, concat('m', c_custkey, '.GCI'), concat('t', c_custkey, '.tif')) AS name"))


@query("page_names", "SELECT p_partkey AS file, i::INT AS page, CASE WHEN i = 0 AND p_partkey % 2 = 0 THEN p_brand ELSE 'CH' || p_size || '[' || i || ']' END AS name FROM part, range(3) t(i)")
def page_names(spark, sf_dir):
    return rules.page_names(_table(spark, sf_dir, "part").selectExpr("p_partkey AS file", "concat('CH', p_size) AS channel", "3 AS n_pages", "if(p_partkey % 2 = 0, array(p_brand, ''), array('')) AS names"))


@query("pixel_size", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size / 8.0 END::DOUBLE AS um FROM part")
def pixel_size(spark, sf_dir):
    d = F.expr("CASE p_partkey % 3 WHEN 0 THEN if(p_size > 20, null, '<Pixels/>') ELSE concat('<Pixels PhysicalSizeX=\"', p_size / 8D, '\" SizeX=\"9\"/>') END")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), rules.pixel_size(d).alias("um"))


@query("unusable_wells", "SELECT DISTINCT c_nationkey AS plate, c_custkey % 30 AS well FROM customer EXCEPT SELECT c_nationkey, c_custkey % 30 FROM customer WHERE c_acctbal > 0")
def unusable_wells(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS plate", "c_custkey % 30 AS well", "c_acctbal > 0 AS fine")
    return rules.unusable(c, c.where("fine"), ["plate", "well"])
