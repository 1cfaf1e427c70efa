"""Work that is stopped by its tag publishes nothing; work that ends publishes all; progress only grows."""

import time

import pytest
from pyspark.sql import functions as F

from tilework.operators import jobs
from tilework.sources import sinks


def slow(spark, rows, seconds):
    def wait(parts):
        for part in parts:
            time.sleep(seconds)
            yield part

    return spark.range(rows, numPartitions=rows).mapInPandas(wait, "id long")


def test_published_work_and_its_progress(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    work = jobs.Work(spark, lambda: {"a": slow(spark, 12, 0.3), "b": spark.range(5)}, path)
    shares = []
    while work._thread.is_alive():
        shares.append(work.progress())
        time.sleep(0.1)
    work.wait(5)
    assert work.progress() == 1.0 and shares == sorted(shares) and any(0 < s < 1 for s in shares)
    assert {n: t.count() for n, t in sinks.read_together(spark, path).items()} == {"a": 12, "b": 5}


def test_a_long_query_ends_by_its_tag_and_is_not_published(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sinks.write_together({"a": spark.range(3)}, path)
    began = time.time()
    work = jobs.Work(spark, lambda: {"a": slow(spark, 160, 1.0)}, path, tag="long-work")
    while work.progress() == 0 and time.time() - began < 60:
        time.sleep(0.2)
    work.cancel()
    with pytest.raises(jobs.Cancelled):
        work.wait(60)
    assert time.time() - began < 240 and work.progress() < 1
    assert sinks.read_together(spark, path)["a"].count() == 3


def test_errors_are_given_to_the_waiter(spark, tmp_path):
    def wrong():
        raise KeyError("x")

    with pytest.raises(KeyError):
        jobs.Work(spark, wrong, f"file://{tmp_path}/out").wait(30)


def test_a_failed_validation_leaves_readers_as_they_were(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sinks.write_together({"a": spark.range(3)}, path)

    def stop():
        raise ValueError("stop")

    for tables, gate in (({"a": spark.range(9), "b": spark.range(2).select(F.raise_error(F.lit("bad")).alias("c"))}, lambda: None), ({"a": spark.range(9)}, stop)):
        with pytest.raises(Exception):
            sinks.write_together(tables, path, gate)
        assert sinks.read_together(spark, path)["a"].count() == 3
