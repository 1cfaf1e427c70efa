"""Mixing sources to target weights by nested hash thresholds; DataFrame functions only.

Each document has a fixed 60-bit hash. A source's budget is met by whole copies of all its documents and, for the rest, by
the documents whose hash lies below a threshold. The threshold is found by histograms: words by source and hash bucket,
cumulated inside a source (4096 buckets at most), give the bucket in which the budget is passed; only documents in that
bucket are summed again, by the next 12 bits, and so on. Nothing is sorted by document and no document is ranked.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source, the last in order; rows
with the same id and text share their fate; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.llm.common import joined, staged, table, words

BITS = 12
LEVELS = 5
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size, ...) with the rank of each source by code point, null last, from 0. Ranges of sources
    are numbered apart and then offset, so no task holds all sources."""
    parts = staged(sizes.repartitionByRange(16, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "start")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parts.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "start", "at")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds target: shares of all words by weight, at most MOST_COPIES times the source's size, the excess reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sized = staged(ranked_sources(sizes).withColumn("weight", weight), "weights")
    cap = MOST_COPIES * F.col("source_size")
    level, full = None, F.lit(False)
    for _ in range(64):  # each round fills more sources; rounds follow the spread of ratios, not the number of sources
        row = sized.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("filled"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        new = ((row["all"] or 0) - (row["filled"] or 0)) / row["open"] if row["open"] else 0.0
        if level is not None and (new == level or not row["open"]):
            break
        level = new
        full = cap <= F.lit(level) * F.col("weight")
    else:
        raise RuntimeError("the level of the targets did not settle")
    return sized.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def _thresholds(slim: DataFrame, budgets: DataFrame, n: int, nearest: bool) -> DataFrame:
    """(source, below, left): hashes from `over` up to below are taken once more, of documents of at most `cap` words; left
    is what that leaves of the budget. budgets(source, left, over, cap). nearest: take the last bucket if that comes nearer."""
    state = budgets.withColumn("base", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        part = joined(slim, state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), rows=n).where("size <= cap and hash >= over")
        if level:
            part = part.where(F.shiftright("hash", shift + BITS) == F.shiftright("base", shift + BITS))
        hist = part.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"), *[F.first(c).alias(c) for c in ("left", "over", "cap")])
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("words").over(w))
        # the bucket in which the budget is passed, or the end of all buckets
        entry = F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "words", "docs", "over", "cap")
        found = hist.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("left"), entry)).alias("b"), F.max(entry).alias("e"))
        state = staged(found.select("source", F.coalesce("b", "e").alias("b"), F.col("b").isNull().alias("all")).select("source", "all", "b.left", F.shiftleft("b.bucket", shift).alias("base"), "b.words", "b.docs", "b.over", "b.cap"), f"thresholds{level}")
        if level == LEVELS - 1 or not state.where("docs > 1 and left > 0 and not all").limit(1).count():
            take = F.col("all") | (F.lit(nearest) & (2 * F.col("left") >= F.col("words")))
            return state.select("source", F.when(take, F.col("base") + (1 << shift)).otherwise(F.col("base")).alias("below"), F.when(take, F.col("left") - F.col("words")).otherwise(F.col("left")).alias("left"))
        state = state.select("source", "left", "over", "cap", "base")
    raise AssertionError


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - BITS * LEVELS)


def _size() -> Column:
    return F.size(words(F.col("text").cast("string"))).cast("long")


def plan(docs: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame, int]:
    """(slim, rules, number of rules): slim has doc_id, source, size, hash of every row of docs(doc_id, text, source); rules
    has by source (column s) source_size, target, whole, below, cap, below2."""
    # the one pass over texts; all that follows reads this narrow table
    slim = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), _hash(seed).alias("hash")), "sizes")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rules = staged(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("whole", whole), "targets")
    n = rules.count()
    budgets = rules.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).where(f"left > 0 and whole < {MOST_COPIES}")
    first = staged(_thresholds(slim, budgets.select("source", "left", F.lit(0).cast("long").alias("over"), F.lit(2**62).alias("cap")), n, False), "first")
    cap = F.greatest(F.lit(1), F.floor(F.col("left") / 4))
    second = _thresholds(slim, first.where("left >= 1").select("source", "left", F.col("below").alias("over"), cap.alias("cap")), n, True)
    second = first.where("left >= 1").select(F.col("source").alias("s1"), cap.alias("cap")).join(second.select(F.col("source").alias("s2"), F.col("below").alias("below2")), F.col("s1").eqNullSafe(F.col("s2")))
    rules = rules.join(first.select(F.col("source").alias("s0"), "below"), F.col("source").eqNullSafe(F.col("s0")), "left").join(second, F.col("source").eqNullSafe(F.col("s1")), "left")
    rules = rules.select(F.col("source").alias("s"), "source_size", "target", "whole", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("below", "cap", "below2")])
    return slim, staged(rules, "rules"), n


def _copies() -> Column:
    more = (F.col("hash") < F.col("below")) | ((F.col("size") <= F.col("cap")) & (F.col("hash") < F.col("below2")))
    return (F.col("whole") + more.cast("long")).cast("long")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs(doc_id, text, source)."""
    slim, rules, n = plan(docs, seed)
    out = joined(slim, rules, F.col("source").eqNullSafe(F.col("s")), rows=n).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix takes it (rows without words: not at all)."""
    _, rules, n = plan(docs, seed)
    inner = [c for c in docs.columns if c in ("doc_id", "text", "source")]
    row = docs.select(F.struct(*docs.columns).alias("row"), *inner)
    row = row.select("row", F.col("source").cast("string").alias("source"), _size().alias("size"), _hash(seed).alias("hash")).where("size > 0")
    out = joined(row, rules, F.col("source").eqNullSafe(F.col("s")), rows=n).withColumn("copies", _copies()).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
