"""Looking after Spark jobs while they run: signs of life, cancellation, time limits."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Interrupted(RuntimeError):
    """The jobs of a block were stopped; ``reason`` says why."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class Watch:
    """Runs the Spark jobs of a block under a tag of their own, and looks in from a thread every ``every`` seconds.

    ``look`` is called each time, whatever the jobs do just then, so it should read files and not run jobs, which might wait for a core; what it returns, or a block that takes longer than
    ``limit`` seconds, is a reason to interrupt the block's jobs, and only those, on all executors. Jobs that the block begins
    afterwards are interrupted as well. A block whose jobs were stopped ends with ``Interrupted``.
    """

    def __init__(self, spark: SparkSession, look: Callable[[], str | None] = lambda: None, every: float = 1.0, limit: float | None = None):
        self.spark, self.look, self.limit = spark, look, limit
        self.every = every if limit is None else min(every, max(limit / 20, 0.02))
        self.tag, self.reason, self._over = f"lodestar-{uuid.uuid4().hex}", None, threading.Event()
        self._thread = threading.Thread(target=self._look_in, daemon=True)

    def _look_in(self) -> None:
        began = time.monotonic()
        while not self._over.wait(self.every):
            if self.reason is None:
                late = self.limit is not None and time.monotonic() - began > self.limit
                try:
                    self.reason = f"it took more than {self.limit:g} seconds" if late else self.look()
                except Exception:  # a look that fails is made up for by the next
                    continue
            if self.reason is not None:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Watch:
        self.spark.sparkContext.addJobTag(self.tag)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._over.set()
        self._thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        if error is not None and self.reason is not None:
            raise Interrupted(self.reason) from error
