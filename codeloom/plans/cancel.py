"""Work that can be given up: all Spark jobs begun inside carry a tag, by which another thread ends them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The work was given up before it was done."""


class Handle:
    """What another thread holds to end the work; loops of joins ask it between their rounds."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self._stop = spark, tag, threading.Event()

    def cancel(self) -> None:
        self._stop.set()
        self.spark.interruptTag(self.tag)

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled(self.tag)


@contextmanager
def cancellable(spark: SparkSession, seconds: float | None = None) -> Iterator[Handle]:
    """A handle for the work inside; after `seconds`, if given, it is given up by itself. What fails because of that is raised as Cancelled."""
    handle = Handle(spark, f"work-{uuid.uuid4().hex}")
    timer = threading.Timer(seconds, handle.cancel) if seconds is not None else None
    spark.addTag(handle.tag)
    if timer:
        timer.daemon = True
        timer.start()
    try:
        yield handle
        handle.check()
    except Cancelled:
        raise
    except Exception as e:
        if handle.cancelled:
            raise Cancelled(handle.tag) from e
        raise
    finally:
        if timer:
            timer.cancel()
        spark.removeTag(handle.tag)


def run(spark: SparkSession, work: Callable[[], object], seconds: float) -> object:
    """work(), given up after some seconds."""
    with cancellable(spark, seconds):
        return work()
