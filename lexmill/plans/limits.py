"""What a request may cost: seconds of Spark time, and terms its patterns may stand for.

Patterns are not run as automata here (the scan evaluates them), so terms are what is counted.
Time is kept by Spark itself: the jobs of a request carry a tag and are cancelled by it.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

# Fixed value: the default time of a request.
TIMEOUT = 30.0

R = TypeVar("R")


class LimitError(RuntimeError):
    """A request that may not go on."""


class OutOfTimeError(LimitError):
    """The time is up; its jobs have been cancelled."""


class Budget:
    """One request's allowance; ``terms=None`` leaves the number of terms open."""

    def __init__(self, seconds: float = TIMEOUT, terms: int | None = None) -> None:
        self.ends = time.monotonic() + seconds
        self.seconds, self.terms, self.taken = seconds, terms, 0

    def take(self, terms: int) -> None:
        """Books terms that leaves stand for; the compiler calls it before anything is scored."""
        self.taken += terms
        if self.terms is not None and self.taken > self.terms:
            raise LimitError(f"the request stands for {self.taken} terms, allowed are {self.terms}")

    def run(self, spark: SparkSession, action: Callable[[], R]) -> R:
        """An action whose Spark jobs are cancelled when the time is up."""
        tag, context, late = f"lexmill-{uuid.uuid4().hex}", spark.sparkContext, threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        left = self.ends - time.monotonic()
        if left <= 0:
            raise OutOfTimeError(f"more than {self.seconds} seconds")
        timer = threading.Timer(left, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return action()
        except Exception as e:
            if late.is_set():
                raise OutOfTimeError(f"more than {self.seconds} seconds") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
