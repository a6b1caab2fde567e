"""Cancellation of transactions and of the Spark jobs that they run."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .errors import Cancelled


class Context:
    """Given to a transaction or a batched call: after cancel(), or when the seconds are over, its next read or write raises
    Cancelled, jobs that run under it are stopped, and nothing is committed."""

    def __init__(self, seconds: float | None = None):
        self._until = None if seconds is None else time.monotonic() + seconds
        self._tag, self._lock = f"corvane-{uuid.uuid4().hex}", threading.Lock()
        self._cancelled, self._running = False, 0
        self._spark: SparkSession | None = None

    @property
    def done(self) -> bool:
        return self._cancelled or (self._until is not None and time.monotonic() >= self._until)

    def check(self) -> None:
        if self.done:
            raise Cancelled("cancelled" if self._cancelled else "out of time")

    def cancel(self) -> None:
        with self._lock:
            self._cancelled = True
            if self._running:
                self._spark.sparkContext.cancelJobsWithTag(self._tag)

    @contextmanager
    def running(self, spark: SparkSession) -> Iterator[None]:
        """Tags this thread's jobs. What a stopped job raises comes out as Cancelled."""
        self.check()
        timer = None
        with self._lock:
            self._spark, self._running = spark, self._running + 1
        if self._until is not None:
            timer = threading.Timer(max(0.0, self._until - time.monotonic()), lambda: spark.sparkContext.cancelJobsWithTag(self._tag))
            timer.daemon = True
            timer.start()
        spark.sparkContext.addJobTag(self._tag)
        try:
            yield
        except Cancelled:
            raise
        except Exception as error:
            if self.done:
                raise Cancelled("cancelled while a job ran") from error
            raise
        finally:
            spark.sparkContext.removeJobTag(self._tag)
            if timer is not None:
                timer.cancel()
            with self._lock:
                self._running -= 1
