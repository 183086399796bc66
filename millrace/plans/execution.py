"""How much of the machine a block of work may use, and what it took."""

from __future__ import annotations

import os
import time
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import SparkSession


def max_num_threads() -> int:
    return len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else os.cpu_count() or 1


class ExecutionContext:
    """A number of threads, at least one and at most what there is. With a session, its shuffles have as many partitions within the block."""

    def __init__(self, num_threads: int = 1, spark: SparkSession | None = None):
        if not 1 <= num_threads <= max_num_threads():
            raise ValueError(f"num_threads must be from 1 to {max_num_threads()}")
        self.num_threads, self.spark = num_threads, spark

    def __enter__(self) -> ExecutionContext:
        if self.spark:
            self._before = self.spark.conf.get("spark.sql.shuffle.partitions")
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.num_threads))
        return self

    def __exit__(self, *_: object) -> bool:
        if self.spark:
            self.spark.conf.set("spark.sql.shuffle.partitions", self._before)
        return False

    def __repr__(self) -> str:
        return f"ExecutionContext(num_threads={self.num_threads})"


class Stopwatch:
    """Nanoseconds that its blocks took in all."""

    def __init__(self) -> None:
        self.nanoseconds = 0

    @contextmanager
    def running(self) -> Iterator[None]:
        began = time.monotonic_ns()
        try:
            yield
        finally:
            self.nanoseconds += time.monotonic_ns() - began


class Countdown:
    """Whether a time is over. None: it never is."""

    def __init__(self, seconds: float | None):
        self._end = None if seconds is None else time.monotonic() + seconds

    def finished(self) -> bool:
        return self._end is not None and time.monotonic() >= self._end


def peak_memory_bytes() -> int:
    """The process's peak of virtual memory, or -1 where the system doesn't tell."""
    try:
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) * 1024 for x in f if x.startswith("VmPeak:"))
    except (OSError, StopIteration):
        return -1
