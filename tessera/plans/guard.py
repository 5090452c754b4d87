"""Run-time guards: circuit breaker, time limits by job tag, telemetry."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

from pyspark.sql import SparkSession

from ..model import StoreError

#: Documented limits of a serving session.
QUERY_SECONDS, JOIN_RESULTS, TOP_K = 2.0, 5000, 100


class Open(StoreError):
    """The breaker is open: calls are refused until its timeout has passed."""


class TimedOut(StoreError):
    pass


@dataclass
class Breaker:
    """Closed, open after ``failures`` in a row, half open after ``reset_s``, closed again after ``successes``."""

    failures: int = 5
    successes: int = 3
    reset_s: float = 30.0
    timeout_s: float | None = QUERY_SECONDS
    on_change: Callable[[str, str], None] | None = None
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    failed: int = 0
    ok: int = 0
    total: int = 0
    total_failed: int = 0
    opened: float = 0.0
    lock: threading.RLock = field(default_factory=threading.RLock)

    def _to(self, state: str) -> None:
        if state != self.state:
            old, self.state = self.state, state
            self.failed = self.ok = 0
            if state == "open":
                self.opened = self.clock()
            if self.on_change:
                self.on_change(old, state)

    def force_open(self) -> None:
        with self.lock:
            self._to("open")

    def reset(self) -> None:
        with self.lock:
            self._to("closed")
            self.failed = self.ok = self.total = self.total_failed = 0

    @property
    def failure_rate(self) -> float:
        return min(1.0, self.total_failed / self.total) if self.total else 0.0

    def call(self, fn: Callable[[], Any], spark: SparkSession | None = None) -> Any:
        """``fn()`` unless open; with a session its jobs are cancelled when the time is up."""
        with self.lock:
            if self.state == "open":
                if self.clock() - self.opened < self.reset_s:
                    raise Open("the circuit is open")
                self._to("half_open")
        try:
            out = limited(spark, fn, self.timeout_s) if spark is not None and self.timeout_s else fn()
        except BaseException:
            with self.lock:
                self.total += 1
                self.total_failed += 1
                self.failed += 1
                if self.state == "half_open" or self.failed >= self.failures:
                    self._to("open")
            raise
        with self.lock:
            self.total += 1
            self.failed = 0
            self.ok += 1
            if self.state == "half_open" and self.ok >= self.successes:
                self._to("closed")
        return out


def limited(spark: SparkSession, fn: Callable[[], Any], seconds: float) -> Any:
    """``fn()`` with its Spark jobs cancelled after ``seconds``."""
    sc, tag = spark.sparkContext, f"limit-{uuid4().hex}"
    late, over = threading.Event(), threading.Event()

    def watch() -> None:
        if over.wait(seconds):
            return
        late.set()
        while not over.is_set():  # again and again: a job may begin after the first cancellation
            sc.cancelJobsWithTag(tag)
            over.wait(0.2)

    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        out = fn()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"cancelled after {seconds} s") from e
        raise
    finally:
        over.set()
        watcher.join()
        sc.removeJobTag(tag)
    if late.is_set():
        raise TimedOut(f"ended, but after {seconds} s")
    return out


@dataclass
class Event:
    kind: str
    at: float
    data: dict[str, Any]


class Telemetry:
    """Sinks get every event; one that fails doesn't stop the others."""

    def __init__(self) -> None:
        self.sinks: list[Callable[[Event], None]] = []

    def register(self, sink: Callable[[Event], None]) -> None:
        self.sinks.append(sink)

    def emit(self, kind: str, **data: Any) -> None:
        e = Event(kind, time.time(), data)
        for s in self.sinks:
            try:
                s(e)
            except Exception:  # noqa: BLE001, S112
                continue
