"""Progress, cancelling and time limits of long questions (M1, M3).

A ``Progress`` can be given to a fixpoint as its ``report``: it is told of each round and ends the
loop by raising ``Cancelled`` once it, or one above it, was cancelled.  ``limited`` also ends the
Spark jobs that are running when the time is over.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    pass


class Progress:
    """Counts work done of ``total``; ``tell`` is called with (task, done, total) at each change."""

    def __init__(self, task: str = "", total: float = 0, tell: Callable[[str, float, float], None] | None = None, above: Progress | None = None, share: float = 0):
        self.task, self.total, self.done = task, total, 0.0
        self._tell, self._above, self._share, self._cancelled = tell, above, share, False

    @classmethod
    def printing(cls, task: str, total: float) -> Progress:
        return cls(task, total, lambda name, done, all_: print(f"{name}: {done:g} of {all_:g}"))

    def worked(self, amount: float) -> None:
        self.check()
        amount = min(amount, self.total - self.done) if self.total else amount
        self.done += amount
        if self._above and self.total:
            self._above.worked(self._share * amount / self.total)
        if self._tell:
            self._tell(self.task, self.done, self.total)

    def finish(self) -> None:
        if self.total > self.done:
            self.worked(self.total - self.done)

    def part(self, task: str, total: float, share: float) -> Progress:
        """A progress of its own, all of which counts as ``share`` here."""
        return Progress(task, total, None, self, share)

    def cancel(self) -> None:
        self._cancelled = True

    @property
    def cancelled(self) -> bool:
        return self._cancelled or (self._above is not None and self._above.cancelled)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled(self.task)

    def __call__(self, turn: int, rows: int) -> None:
        """As a fixpoint's ``report``: how many rounds there will be is not known, so none count as work."""
        self.check()
        if self._tell:
            self._tell(f"{self.task} round {turn}: {rows} new rows", self.done, self.total)


@contextmanager
def limited(spark: SparkSession, seconds: float, progress: Progress | None = None) -> Iterator[Progress]:
    """Jobs started inside are cancelled after ``seconds``; then ``TimeoutError`` is raised."""
    progress = progress or Progress()
    context, tag, over = spark.sparkContext, f"weft-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        progress.cancel()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield progress
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"not finished after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
