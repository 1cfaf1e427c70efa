"""Quality rules with a hashed n-gram log-likelihood ratio; DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated windows of five. The model is a pair of multinomials
over hash buckets of 1- and 2-grams: the raw one counts every document, the trusted one every document that is labelled good,
but for one fold in FOLDS. The number of buckets grows with the square root of the n-grams, as vocabularies do. Up to ARRAY
buckets are looked up in an array, the result of a scalar subquery, so scoring needs no shuffle; more are a table, whose most frequent rows are joined by broadcast and the others by shuffle.

A document's score is the mean over its n-grams of log(trusted / raw), in steps of 1 / PARTS. It is kept if the score is at
least the cut that best tells all good documents of the fold left out from all that are labelled bad.

Defined results: null and blank texts have no words, fail the base rules and score 0; without labels the ratio is 0
everywhere; without held-out good or without bad labels there is no cut, and only the base rules decide; very long texts are
scored whole, in one row; repeated rows are judged alike; an empty table gives an empty result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import BROADCAST_ROWS, WS_CHARS, joined, staged, table, words
from tilework.llm.url_filter import GRID, _threshold

MIN_BUCKETS = 1 << 16
GROWTH = 24
ARRAY = 1 << 22
#: Ratios of an array that one group holds on the way.
CHUNK = 4096
FOLDS = 5
#: Ratios are whole numbers of these parts from -LIMIT to LIMIT: a byte each, and sums do not depend on their order.
PARTS = 32
LIMIT = 127
#: Counts added to a bucket, spread as the raw corpus is.
PRIOR = 1.0
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20  # per cent
SYMBOLS = r"[^#*$%&|<>]+"


def _hashes(df: DataFrame) -> DataFrame:
    """Adds w (words), n_words, h (hashes of words) and g (hashes of pairs of neighbours)."""
    df = df.withColumn("w", words(F.col("text").cast("string"))).withColumn("n_words", F.size("w").cast("long")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    return df.withColumn("g", F.when(F.size("h") > 1, F.zip_with(_part(1, 1), _part(2, 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>")))


def _part(start: int, less: int, of: str = "h") -> Column:
    """of[start:], with as many entries as h has, less so many."""
    return F.slice(of, start, F.greatest(F.size("h") - less, F.lit(0)))


def bucket_count(n: int) -> int:
    """The least power of two that is GROWTH times the root of n n-grams."""
    return max(MIN_BUCKETS, 1 << max(0, math.isqrt(n) * GROWTH - 1).bit_length())


def _bucket(x: Column, buckets: int) -> Column:
    return F.pmod(x, F.lit(buckets)).cast("long")


def _labelled(labels: DataFrame, which: Column, name: str) -> DataFrame:
    """All ids of such labels."""
    return labels.where("doc_id is not null").where(which).select(F.col("doc_id").alias(name)).distinct()


def _good(held: bool) -> Column:
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)) == 0
    return F.expr("quality = 1 and coalesce(toxic, 0) = 0") & (fold if held else ~fold)


class Model:
    """log(trusted / raw) by bucket of the n-grams of docs."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        n = docs.select(F.size(words(F.col("text").cast("string"))).alias("n")).agg(F.coalesce(F.sum(F.greatest(2 * F.col("n") - 1, F.lit(0)).cast("long")), F.lit(0))).first()[0]
        self.buckets = bucket_count(n)
        good = _labelled(labels, _good(False), "good_id")
        marked = joined(docs.select("doc_id", "text"), good, F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().cast("long").alias("trusted"))
        grams = _hashes(marked).select("trusted", F.explode(F.concat("h", "g")).alias("x")).select("trusted", _bucket(F.col("x"), self.buckets).alias("bucket"))
        counts = staged(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good")), "buckets")
        self.trusted = m = counts.agg(F.coalesce(F.sum("good"), F.lit(0))).first()[0]
        share = F.col("raw") / F.lit(float(max(n, 1)))
        ratio = F.log((F.col("good") + PRIOR * self.buckets * share) / F.lit(m + PRIOR * self.buckets) / share) if m else F.lit(0.0)
        self.table = counts.select("bucket", "raw", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.round(ratio * PARTS))).cast("long").alias("parts"))
        # fewer than BROADCAST_ROWS buckets hold so many; without them no bucket of the shuffled join is hot
        self.frequent = n // BROADCAST_ROWS + 1
        self.array = self._array() if self.buckets <= ARRAY else None
        self.cut = self._calibrated(docs, labels)

    def _array(self) -> DataFrame:
        """One row: the parts of all buckets (ARRAY bytes at most) in their order. As a subquery's result they stand in no plan."""
        every = self.table.sparkSession.range(self.buckets).withColumnRenamed("id", "bucket").join(self.table, "bucket", "left")
        chunk = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("parts", F.lit(0)).cast("tinyint").alias("parts"))))
        chunks = every.groupBy(F.floor(F.col("bucket") / CHUNK).alias("at")).agg(F.transform(chunk, lambda e: e["parts"]).alias("of"))
        return staged(chunks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "of"))), lambda e: e["of"])).alias("ratios")), "ratios")

    def _calibrated(self, docs: DataFrame, labels: DataFrame) -> float:
        """The least score that is kept."""
        held = _labelled(labels, _good(True), "held_id").withColumn("of_good", F.lit(1))
        bad = _labelled(labels, F.expr("quality = 0"), "held_id").withColumn("of_good", F.lit(0))
        # an id that is labelled both ways tells nothing
        ids = held.union(bad).groupBy("held_id").agg(F.min("of_good").alias("of_good"), F.max("of_good").alias("most")).where("of_good = most").drop("most")
        found = joined(docs.select("doc_id", "text"), ids, F.col("doc_id") == F.col("held_id")).select("text", "of_good")
        scored = self.scored(_hashes(found).where(F.col("n_words") >= MIN_WORDS))
        steps = scored.groupBy(F.floor(F.col("score") * GRID).alias("step")).agg(F.sum("of_good").alias("good"), F.count("*").alias("n")).orderBy("step").collect()
        return _threshold([(r["step"], r["good"], r["n"] - r["good"]) for r in steps])

    def scored(self, df: DataFrame) -> DataFrame:
        """df(text, h, g, ...) with score."""
        if self.array is not None:
            # the subquery is a column of its own: higher-order functions take none, but the optimizer puts it where it is used
            mean = self._total(F.concat("h", "g")) / (F.size("h") + F.size("g")) / PARTS
            df = df.withColumn("ratios", self.array.scalar())
            return df.withColumn("score", F.when(F.size("h") > 0, mean).otherwise(0.0)).drop("ratios")
        # a score depends on the text alone, and repeated texts leave its mean as it is
        key = F.xxhash64(F.col("text").cast("string"))
        grams = df.select(key.alias("text_key"), F.explode(F.concat("h", "g")).alias("x")).select("text_key", _bucket(F.col("x"), self.buckets).alias("bucket"))
        often = self.table.where(F.col("raw") >= self.frequent).select("bucket", "parts")
        seldom = self.table.where(F.col("raw") < self.frequent).select("bucket", "parts")
        sums = [F.sum("parts").alias("parts"), F.count("*").alias("n")]
        near = grams.join(F.broadcast(often), "bucket").groupBy("text_key").agg(*sums)
        far = grams.join(F.broadcast(often.select("bucket")), "bucket", "left_anti").join(seldom.hint("merge"), "bucket").groupBy("text_key").agg(*sums)
        scores = staged(near.union(far).groupBy("text_key").agg((F.sum("parts") / F.sum("n") / PARTS).alias("mean")), "scores")
        df = joined(df.withColumn("text_key", key), scores, "text_key", "left")
        return df.withColumn("score", F.coalesce("mean", F.lit(0.0))).drop("text_key", "mean")

    def _total(self, of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + F.get("ratios", _bucket(x, self.buckets).cast("int")))


def _repeated_words() -> tuple[Column, Column, Column]:
    """Of a text whose windows of five (column five) are not all distinct: the windows sorted by hash and place, the sorted
    places of those found twice, and the words that these cover."""
    by_hash = F.array_sort(F.transform("five", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twice = F.expr("filter(transform(ordered, (e, j) -> if((j > 0 and ordered[j - 1].x = e.x) or (j < size(ordered) - 1 and ordered[j + 1].x = e.x), e.i, null)), e -> e is not null)")
    steps = F.zip_with("places", F.expr("slice(places, 2, size(places))"), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return by_hash, F.array_sort(twice), F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    names = ("w", "n_words", "h", "g", "five", "ordered", "places", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "text_key", "mean", "ratios")
    kept_columns = [c for c in docs.columns if c not in names]  # a clashing extra column gives way to the result's
    model = Model(docs, labels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = _hashes(docs.select(*kept_columns))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    four = F.zip_with(_part(1, 3, "g"), _part(3, 3, "g"), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(F.slice(four, 1, F.greatest(F.size("h") - 4, F.lit(0))), _part(5, 4), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("five", F.when(F.size("h") >= WINDOW, five).otherwise(F.array().cast("array<long>")))
    by_hash, places, covered = _repeated_words()
    df = df.withColumn("ordered", F.when(F.size("five") > F.size(F.array_distinct("five")), by_hash)).withColumn("places", places)

    df = df.select(
        *kept_columns,
        "n_words",
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "h",
        "g",
    )
    # always true, but filters on the results are not pushed below it: there they would repeat all the work above, by word
    df = model.scored(df).drop("h", "g").withColumn("score", F.when(F.spark_partition_id() >= 0, F.col("score")))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.cut))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
