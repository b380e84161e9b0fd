"""Several actions at once from one driver: a pool of threads whose jobs can be cancelled as a group."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Jobs:
    """Runs driver functions, each of which may start Spark jobs, on ``threads`` threads; executors share the work as the scheduler sees fit."""

    def __init__(self, spark: SparkSession, threads: int = 4):
        self.spark, self.group = spark, f"jobs-{uuid.uuid4().hex[:8]}"
        self.threads, self._open = max(1, threads), True
        self._pool = ThreadPoolExecutor(self.threads)

    def submit(self, f: Callable, *args) -> Future:
        """f(*args) in turn; its result, or the error that it raised, is the future's."""
        if not self._open:
            raise RuntimeError("the pool is shut down")

        def run():
            self.spark.sparkContext.setJobGroup(self.group, self.group, interruptOnCancel=True)
            return f(*args)

        return self._pool.submit(inheritable_thread_target(self.spark)(run))

    def resize(self, threads: int) -> None:
        """More or fewer threads for what is submitted from now on; what is queued still runs."""
        old, self.threads = self._pool, max(1, threads)
        self._pool = ThreadPoolExecutor(self.threads)
        old.shutdown(wait=False)

    def increase(self, by: int = 1) -> None:
        self.resize(self.threads + by)

    def decrease(self, by: int = 1) -> None:
        self.resize(self.threads - by)

    def shutdown(self) -> None:
        """Takes nothing more and waits for what is queued."""
        self._open = False
        self._pool.shutdown(wait=True)

    def emergency_shutdown(self) -> None:
        """Drops what is queued and cancels what runs."""
        self._open = False
        self._pool.shutdown(wait=False, cancel_futures=True)
        self.spark.sparkContext.cancelJobGroup(self.group)

    def __enter__(self) -> Jobs:
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()
