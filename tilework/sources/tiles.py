"""Tiles as relations: each vector of 64 numbers is an 8 x 8 tile of whole grey values.

px has vec_id, y, x, v and the places of the tile in three layouts: a plate (well, tx, ty), a stack (well2, pos, ch, z) and a
mosaic (trow, tcol; pitch 6, so neighbours overlap by 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
PITCH = 6
PLACES = """vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v,
  CAST(IDIV[vec_id;25] AS INT) AS well, CAST(vec_id % 5 AS INT) AS tx, CAST(IDIV[(vec_id % 25);5] AS INT) AS ty,
  CAST(IDIV[vec_id;60] AS INT) AS well2, CAST(IDIV[(vec_id % 60);10] AS INT) AS pos, CAST(IDIV[(vec_id % 60);5] % 2 AS INT) AS ch,
  CAST(vec_id % 5 AS INT) AS z, CAST(IDIV[vec_id;25] AS INT) AS trow, CAST(vec_id % 25 AS INT) AS tcol"""
DUCK_PX = f"""px AS (SELECT {PLACES} FROM (
  SELECT vec_id, p // 8 AS y, p % 8 AS x, CAST(round_even((CAST(embedding[p + 1] AS DOUBLE) + 1) * 100, 0) AS INTEGER) AS v
  FROM embeddings, range(64) t(p)))"""


def pixels_from(spark: SparkSession, tiles: DataFrame) -> DataFrame:
    """px of tiles(vec_id, embedding), a table or a stream."""
    from tilework.functions.dialect import spark_sql

    grey = F.rint((F.col("e").cast("double") + 1) * 100).cast("int")
    flat = tiles.select("vec_id", F.posexplode("embedding").alias("p", "e")).select("vec_id", F.expr(f"p div {SIDE}").alias("y"), F.expr(f"p % {SIDE}").alias("x"), grey.alias("v"))
    return flat.selectExpr(*_columns(spark_sql(PLACES)))


def _columns(places: str) -> list[str]:
    """The entries of a select list whose commas lie outside parentheses."""
    out, depth = [""], 0
    for c in places:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels_from(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def mosaic_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, trow, tcol, v): the tiles of px in the mosaic's layout, a row each, v their pixels row by row."""
    from tilework.functions.dialect import spark_sql

    grey = F.transform(F.slice("embedding", 1, SIDE * SIDE), lambda e: F.rint((e.cast("double") + 1) * 100).cast("int"))
    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) > 0")
    return tiles.select("vec_id", *[F.expr(c) for c in _columns(spark_sql(PLACES)) if c.endswith((" trow", " tcol"))], grey.alias("v"))


def scenes(px: DataFrame, across: int) -> DataFrame:
    """(scene, gy, gx, v): images of across x across vectors in a row. The last scene is filled up with the first vectors, as
    often as it takes, so that every vector is in a scene."""
    size = across * across
    vectors = px.agg(F.max("vec_id") + 1).first()[0] or 0
    last = -(-vectors // size) * size - 1
    place = F.explode(F.sequence(F.col("vec_id"), F.lit(last), F.lit(vectors))) if vectors else F.col("vec_id")
    at = px.select("y", "x", "v", place.alias("at"))
    return at.selectExpr(f"cast(at div {size} as int) AS scene", f"cast(at % {size} div {across} * {SIDE} + y as int) AS gy", f"cast(at % {across} * {SIDE} + x as int) AS gx", "v")


def duck_scenes(across: int) -> str:
    """sc(scene, gy, gx, v) after px, for DuckDB."""
    size = across * across
    return f"""vn AS (SELECT max(vec_id) + 1 AS n FROM px), va AS (SELECT a AS slot, a % n AS vec_id FROM vn, (SELECT unnest(range(((n + {size - 1}) // {size}) * {size})) AS a FROM vn)),
sc AS (SELECT slot // {size} AS scene, slot % {size} // {across} * 8 + y AS gy, slot % {across} * 8 + x AS gx, v FROM va JOIN px USING (vec_id))"""
