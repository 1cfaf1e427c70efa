"""URL filters: host and path rules, and where none fits a ratio of two character language models.

Each model is a variable-order Markov model over the bytes of host and path, smoothed by interpolation from order 0 to
ORDER: P_k(c | k bytes before) = (n_k(context c) + STRENGTH * P_(k-1)(c)) / (n_k(context) + STRENGTH). One is counted on
all URLs that a rule allows, the other on all that a rule blocks, but for one fold in FOLDS that calibrates the threshold
on the log-likelihood difference per byte (the highest mean of both classes' shares judged right). Contexts and grams are counted by 64-bit hashes of their bytes and order, each by itself: m of them
share a count with a chance of m * m / 2**65. The most frequent counts, fewer than HEAD rows, are broadcast; where there are
more, the grams of the distinct URLs that are not among them are joined with the rest.

Defined results: a null URL or one without :// has an empty host and path; an empty string scores 0; if the rules decide
nothing, or all one way, every other URL is allowed; repeated rows are judged alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import kernels as K
from tilework.llm.common import staged, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 5
#: Rows of counts that are broadcast.
HEAD = 1_000_000
CODES = 2 * (ORDER + 1)
STRENGTH = 4.0
FOLDS = 5
GRID = 200  # steps of the score per nat, for calibration; scores are held within 10 nats


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


_FACTORS = K.mix(np.arange(101, 101 + ORDER + 1, dtype=K.U)) | K.U(1)


def _grams(batch: pa.RecordBatch):
    """Per byte: row; place in its string; hashes of context and gram for each order, a column each."""
    data, offsets = K.column(batch, "s")
    sizes = np.diff(offsets)
    n = int(sizes.sum()) + ORDER * batch.num_rows
    row = np.repeat(np.arange(batch.num_rows), sizes)
    at = np.arange(len(row)) + (row + 1) * ORDER
    padded = np.full(n, 2, np.uint8)  # each string follows ORDER start marks
    padded[at] = data[offsets[0] : offsets[-1]]
    values = padded.astype(K.U) + K.U(1)
    context = np.zeros(len(at), K.U)
    keys = np.zeros((len(at), CODES), np.int64)
    for k in range(ORDER + 1):
        if k:
            context = context + values[at - k] * _FACTORS[k]
        keys[:, 2 * k] = K.mix(context + K.U(k)).view(np.int64)
        keys[:, 2 * k + 1] = K.mix(context + values[at] * _FACTORS[0] + K.U(k + 50)).view(np.int64)
    return row, np.arange(len(row)) - (offsets[:-1] - offsets[0])[row], keys


def _count(batches):
    """Sums by batch: (key, bad, good)."""
    for b in batches:
        row, _, keys = _grams(b)
        side = np.asarray(b.column(b.schema.get_field_index("good"))).astype(np.int64)[row]
        for code in range(CODES):
            found, at = np.unique(keys[:, code], return_inverse=True)
            bad, good = (np.bincount(at[side == k], minlength=len(found)).astype(np.int64) for k in (0, 1))
            for i in range(0, len(found), 100_000):
                x = [pa.array(x[i : i + 100_000]) for x in (found, bad, good)]
                yield pa.RecordBatch.from_arrays(x, ["key", "bad", "good"])


def _places(keys: np.ndarray, known: np.ndarray):
    """Where known (sorted) has each key, and whether it does."""
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return at, known[at] == keys if len(known) else np.zeros(keys.shape, bool)


def _others(head):
    """(u, at, key) of the contexts and grams that are not in the head; at numbers byte and code."""

    def run(batches):
        known = head.value[0]
        for b in batches:
            row, place, keys = _grams(b)
            byte, code = np.nonzero(~_places(keys, known)[1])
            u = np.asarray(b.column(b.schema.get_field_index("u")))
            for i in range(0, len(byte), 100_000):
                x, c = byte[i : i + 100_000], code[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(u[row[x]]), pa.array(place[x] * CODES + c), pa.array(keys[x, c])], ["u", "at", "key"])

    return run


def _score(head):
    def run(batches):
        known, *sides = head.value
        for b in batches:
            row, place, keys = _grams(b)
            at, hit = _places(keys, known)
            rest = b.column(b.schema.get_field_index("rest")) if "rest" in b.schema.names else None
            logs = []
            for side, head_counts in enumerate(sides):
                counts = np.where(hit, head_counts[at], 0) if len(known) else np.zeros(keys.shape)
                if rest is not None and len(flat := rest.flatten()):
                    of = np.repeat(np.arange(b.num_rows), rest.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    first = np.searchsorted(row, of)
                    counts.reshape(-1)[first * CODES + flat.field("at").to_numpy()] = flat.field(("bad", "good")[side]).to_numpy()
                p = np.full(len(row), 1 / 256)
                for k in range(ORDER + 1):
                    p = (counts[:, 2 * k + 1] + STRENGTH * p) / (counts[:, 2 * k] + STRENGTH)
                logs.append(np.log(p))
            size = np.maximum(np.bincount(row, minlength=b.num_rows), 1)
            score = np.bincount(row, logs[1] - logs[0], minlength=b.num_rows) / size
            names = [n for n in b.schema.names if n != "rest"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(score)], [*names, "score"])

    return run


def _model(df: DataFrame, known: DataFrame):
    """A function that scores rows with s: counts of known(s, good), the head broadcast, the rest joined to URLs of df."""
    spark = df.sparkSession
    sums = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    counts = staged(known.mapInArrow(_count, "key long, bad long, good long").groupBy("key").agg(*sums), "counts")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum(F.col("bad") + F.col("good")), F.lit(0))).first()
    often = F.col("bad") + F.col("good") >= (total // HEAD + 1 if n > HEAD else 0)  # fewer than HEAD rows hold so many
    top = counts.where(often).toArrow()
    key, bad, good = (top.column(c).to_numpy() for c in ("key", "bad", "good"))
    order = np.argsort(key)
    head = spark.sparkContext.broadcast((key[order], bad[order].astype(float), good[order].astype(float)))
    rest = None
    if n > HEAD:
        others = df.select("s").distinct().select("s", F.xxhash64("s").alias("u")).mapInArrow(_others(head), "u long, at long, key long")
        found = others.join(counts.where(~often).hint("merge"), "key").groupBy("u").agg(F.collect_list(F.struct("at", "bad", "good")).alias("rest"))
        rest = staged(found, "rest")

    def scored(rows: DataFrame, schema: str) -> DataFrame:
        if rest is not None:
            rows = rows.withColumn("u", F.xxhash64("s")).join(rest, "u", "left").drop("u")
        return rows.mapInArrow(_score(head), schema + ", score double")

    return scored


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages(page_id, url)."""
    host, path = host_and_path(F.col("url").cast("string"))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    df = staged(df.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), F.concat("host", "path").alias("s")), "urls")
    fold = F.pmod(F.xxhash64("s", F.lit(3)), F.lit(FOLDS)) == 0
    known = df.where("said is not null").select("s", (F.col("said") == "allow").alias("good"), fold.alias("held"))
    scored = _model(df, known.where("not held").select("s", "good"))
    held = scored(known.where("held").select("s", "good"), "s string, good boolean")
    step = F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("score"))) * GRID)
    steps = held.groupBy(step.alias("step")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n")).orderBy("step").collect()  # 20 * GRID at most
    threshold = _threshold([(r["step"], r["good"], r["n"] - r["good"]) for r in steps])
    out = scored(df, "page_id long, host string, path string, rule string, said string, s string")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")


def _threshold(steps: list[tuple[int, int, int]]) -> float:
    good, bad = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not good or not bad:
        return float("-inf")
    best, at, lost, shut = 0.0, float("-inf"), 0, 0
    for (k, g, b), (after, _, _) in zip(steps, [*steps[1:], (steps[-1][0] + 2, 0, 0)]):
        lost, shut = lost + g, shut + b
        if (right := (good - lost) / good + shut / bad) > best:
            best, at = right, (k + 1 + after) / 2 / GRID  # halfway to the next step that any URL has
    return at


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
