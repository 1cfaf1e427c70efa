"""Long work that can be watched and stopped: its Spark jobs carry a tag, and what it publishes appears whole or not at all."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tilework.sources.sinks import write_together


class Cancelled(RuntimeError):
    """The work was stopped by its tag."""


class Work:
    """Runs make() and publishes the tables that it returns below path, in a thread of its own whose jobs carry the tag.

    progress() is the share of tasks done of the jobs begun so far; it never falls, and is 1 only when all is published. cancel()
    ends all jobs with the tag; nothing is published then, and readers see what was there before."""

    def __init__(self, spark: SparkSession, make: Callable[[], dict[str, DataFrame]], path: str, tag: str | None = None):
        self.spark, self.tag = spark, tag or f"tilework-{uuid.uuid4().hex}"
        self._make, self._path = make, path
        self._error: BaseException | None = None
        self._stopped, self._share = threading.Event(), 0.0
        self._published = False
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup(self.tag, self.tag, interruptOnCancel=True)
        self.spark.addTag(self.tag)
        try:
            write_together(self._make(), self._path, gate=self._check)
            self._published = True
        except BaseException as error:  # given to whoever waits
            self._error = error
        finally:
            self.spark.removeTag(self.tag)

    def _check(self) -> None:
        if self._stopped.is_set():
            raise Cancelled(self.tag)

    def progress(self) -> float:
        if self._published:
            self._share = 1.0
            return 1.0
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                if found := tracker.getStageInfo(stage):
                    done, total = done + found.numCompletedTasks, total + found.numTasks
        self._share = max(self._share, min(0.99, done / total if total else 0.0))
        return self._share

    def cancel(self) -> None:
        """Stops what runs and keeps what has not begun from beginning. Work that is published already stays."""
        self._stopped.set()
        self.spark.interruptTag(self.tag)
        self.spark.sparkContext.cancelJobGroup(self.tag)

    def wait(self, seconds: float | None = None) -> None:
        """Until all is published; raises Cancelled, or what went wrong."""
        self._thread.join(seconds)
        if self._thread.is_alive():
            raise TimeoutError(self.tag)
        if self._error is not None and self._stopped.is_set():
            raise Cancelled(self.tag) from self._error
        if self._error is not None:
            raise self._error
