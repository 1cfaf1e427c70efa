"""Line dedup by site-relative frequency: a line goes if more than RATIO of its site's pages hold it.

Counting explodes hashes of each page's distinct lines and aggregates them before the shuffle, so a line or site with a
third of all rows is a few partial counts. A site's boilerplate has at most (mean distinct lines a page) / RATIO entries;
these sets are joined to pages by site, by broadcast up to a checked number of entries, else by shuffle.

Lines are compared without white space at either end, by 64-bit hashes: a line is dropped wrongly with a chance of its site's
boilerplate entries / 2**64. Defined results: blank lines never go; lines of sites with fewer pages than would make
MIN_PAGES never go; a null text has no lines and stays null; a null site is a site; a page whose lines all go keeps an
empty text; repeated rows are pages of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import WS_CHARS, staged, table

RATIO = 0.1
MIN_PAGES = 5
BROADCAST_ENTRIES = 500_000


def _trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def boilerplate(docs: DataFrame, site: str = "source", ratio: float = RATIO) -> DataFrame:
    """(site, lines): hashes of the lines that go, by site."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\\n"), lambda x: _trimmed(x) != ""), lambda x: F.xxhash64(_trimmed(x))))
    pages = docs.select(F.col(site).cast("string").alias("site"), lines.alias("lines"))
    # the null line of each page counts pages: one pass, one shuffle
    counts = pages.select("site", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce("lines", F.array().cast("array<long>")))).alias("line"))
    counts = staged(counts.groupBy("site", "line").agg(F.count("*").alias("n")).where(f"line is null or n >= {MIN_PAGES}"), "lines")
    total = counts.where("line is null").select(F.col("site").alias("s"), F.col("n").alias("pages"))
    often = counts.where("line is not null").join(total, F.col("site").eqNullSafe(F.col("s"))).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, site: str = "source", ratio: float = RATIO) -> DataFrame:
    """docs with text rid of boilerplate lines, and with n_lines and n_dropped."""
    rules = staged(boilerplate(docs, site, ratio).select(F.col("site").alias("_site"), F.col("lines").alias("_boiler")), "boilerplate")
    entries = rules.agg(F.coalesce(F.sum(F.size("_boiler")), F.lit(0))).first()[0]
    rules = F.broadcast(rules) if entries <= BROADCAST_ENTRIES else rules
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]  # clashing extra columns give way
    df = docs.select(*own).join(rules, F.col(site).cast("string").eqNullSafe(F.col("_site")), "left")
    df = df.withColumn("_all", F.split("text", "\\n"))
    # which of the site's lines does this page hold: one hashed intersection, then a short list to look into
    df = df.withColumn("_hit", F.when(F.col("_boiler").isNotNull(), F.array_intersect(F.transform("_all", lambda x: F.xxhash64(_trimmed(x))), "_boiler")))
    some = F.coalesce(F.size("_hit") > 0, F.lit(False))
    df = df.withColumn("_kept", F.when(some, F.filter("_all", lambda x: (_trimmed(x) == "") | ~F.array_contains("_hit", F.xxhash64(_trimmed(x))))))
    return df.select(
        *[F.when(some, F.array_join("_kept", "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in own],
        F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(some, F.size("_all") - F.size("_kept")).otherwise(0).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


SQL = f"""
WITH pages AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), held AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS line
  FROM pages
), counts AS (
  SELECT source, line, count(*) AS n FROM held GROUP BY source, line
), sites AS (
  SELECT source, count(*) AS pages FROM pages GROUP BY source
), boiler AS (
  SELECT c.source, list(c.line) AS gone FROM counts c JOIN sites s ON c.source IS NOT DISTINCT FROM s.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO}::DOUBLE * s.pages GROUP BY c.source
), kept AS (
  SELECT p.doc_id, p.source, p.lines,
    list_filter(p.lines, lambda x: NOT list_contains(coalesce(b.gone, []), trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS left_lines
  FROM pages p LEFT JOIN boiler b ON p.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(left_lines), 0)::BIGINT AS n_dropped,
  md5(array_to_string(left_lines, chr(10))) AS kept_md5
FROM kept
"""
