"""What a run did, as rows: counts and times of a query or an ingest, appended to any number of sinks. A sink
that fails never fails the run."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

Sink = Callable[[dict], None]
LEVELS = ("debug", "info", "warn", "error")
OUTCOMES = ("success", "partial", "refused", "empty", "error")
SCHEMA = "kind string, at timestamp, knowledge_id string, outcome string, duration_ms long, timings map<string,long>, counts map<string,long>, notes array<string>, error string"


@dataclass
class Run:
    kind: str
    knowledge_id: str | None = None
    at: datetime = field(default_factory=lambda: datetime.now(UTC))
    outcome: str = "success"
    duration_ms: int = 0
    timings: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    error: str | None = None

    @contextmanager
    def timed(self, step: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings[step] = int((time.perf_counter() - began) * 1000)

    def note(self, step: str, level: str, reason: str) -> None:
        self.notes.append(f"{step}:{level}:{reason}")

    def add(self, **counts: int) -> None:
        for k, n in counts.items():
            self.counts[k] = self.counts.get(k, 0) + n


def jsonl_sink(path: str | None = None) -> Sink:
    """Lines of JSON to a file, or to the standard error stream."""

    def write(row: dict) -> None:
        line = json.dumps(row, default=str) + "\n"
        if path is None:
            sys.stderr.write(line)
        else:
            with open(path, "a", encoding="utf-8") as f:
                f.write(line)

    return write


def parquet_sink(spark: SparkSession, path: str) -> Sink:
    return lambda row: spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


class Telemetry:
    def __init__(self, *sinks: Sink):
        self.sinks = sinks

    def write(self, run: Run) -> None:
        for sink in self.sinks:
            try:
                sink(asdict(run))
            except Exception as e:
                sys.stderr.write(f"telemetry: {type(e).__name__}: {e}\n")

    @contextmanager
    def run(self, kind: str, knowledge_id: str | None = None) -> Iterator[Run]:
        """A row is written however the block ends."""
        r, began = Run(kind, knowledge_id), time.perf_counter()
        try:
            yield r
        except Exception as e:
            r.outcome, r.error = "error", f"{type(e).__name__}: {e}"
            raise
        finally:
            r.duration_ms = int((time.perf_counter() - began) * 1000)
            self.write(r)


class Events:
    """Log events from a level on, to sinks."""

    def __init__(self, least: str = "info", *sinks: Sink):
        self.least, self.sinks = LEVELS.index(least), sinks

    def emit(self, level: str, event: str, error: Exception | None = None, **fields) -> None:
        if LEVELS.index(level) < self.least:
            return
        row = {"at": datetime.now(UTC), "level": level, "event": event, **fields}
        if error is not None:
            row |= {"error_type": type(error).__name__, "error": str(error)}
        for sink in self.sinks:
            try:
                sink(row)
            except Exception:
                pass
