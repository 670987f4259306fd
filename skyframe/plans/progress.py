"""Progress of a run over images: a line for each as its task ends, counted once whatever is retried.

Tasks report ``path -> (brick, sources, seconds, error)`` through an accumulator that merges by path:
a task that runs again, or twice, reports the same paths, and a failed one reports nothing.  The driver
gets one small record an image.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import SparkSession


class _ByPath(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        a.update(b)
        return a


class Progress:
    """A context that says ``[n/total] brick → k sources (s)`` while a job runs."""

    def __init__(self, spark: SparkSession, total: int, say: Callable[[str], None] = print, every: float = 0.5):
        self.total, self.say, self.every = total, say, every
        self.seen = spark.sparkContext.accumulator({}, _ByPath())
        self._said: set[str] = set()
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def lines(self) -> None:
        for path, (brick, sources, seconds, error) in sorted(self.seen.value.copy().items()):
            if path not in self._said:
                self._said.add(path)
                n = f"[{len(self._said):{len(str(self.total))}}/{self.total}]"
                self.say(f"{n} {brick} FAILED: {error}" if error else f"{n} {brick} → {sources} sources ({seconds:.2f} s)")

    def _watch(self) -> None:
        while not self._stop.wait(self.every):
            self.lines()

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self.lines()
