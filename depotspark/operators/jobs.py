"""Long work in the background: one handle for each name, with status, progress, cancellation and the result.

The work's Spark jobs share a job group, by which progress is counted and the work is interrupted. It runs in a scope of its
own (see graph.scratch), so work that fails or is cancelled leaves no tables.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from depotspark.operators.errors import NotFound, NotReady
from depotspark.operators.graph import scratch


class Job:
    """status: processing, ready, error or cancelled."""

    def __init__(self, spark: SparkSession, name: str, work: Callable[[], Any]):
        self.name, self.group, self.status, self.error = name, f"{name}-{uuid.uuid4().hex}", "processing", None
        self._spark, self._work, self._value, self._stopped = spark, work, None, threading.Event()
        self._thread = InheritableThread(target=self._run)
        self._thread.start()

    def _run(self) -> None:
        self._spark.sparkContext.setJobGroup(self.group, self.name, interruptOnCancel=True)
        try:
            with scratch(self._spark):
                self._value = self._work()
            self.status = "cancelled" if self._stopped.is_set() else "ready"
        except Exception as e:  # told by status() and result()
            self.status, self.error = ("cancelled", None) if self._stopped.is_set() else ("error", e)

    def progress(self) -> dict[str, int]:
        """Tasks done and known of the work's Spark jobs so far."""
        tracker, done, known = self._spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                done, known = done + (s.numCompletedTasks if s else 0), known + (s.numTasks if s else 0)
        return {"done": done, "known": known}

    def cancel(self) -> None:
        """Interrupts the work and waits until it has let go of its tables. Work that is over stays as it is."""
        if self.status == "processing":
            self._stopped.set()
            while self._thread.is_alive():  # between two of its jobs there is nothing to interrupt
                self._spark.sparkContext.cancelJobGroup(self.group)
                self._thread.join(0.1)

    def wait(self, seconds: float | None = None) -> Job:
        self._thread.join(seconds)
        return self

    def result(self) -> Any:
        if self.status == "error":
            raise self.error
        if self.status != "ready":
            raise NotReady(f"{self.name} is {self.status}")
        return self._value


class Jobs:
    """The background work of a session by name."""

    def __init__(self, spark: SparkSession):
        self._spark, self._jobs, self._lock = spark, {}, threading.Lock()

    def start(self, name: str, work: Callable[[], Any]) -> Job:
        """Starts work, or hands out the handle of the same name that is still running. What work() returns must not read scratch tables of its own."""
        with self._lock:
            job = self._jobs.get(name)
            if job is None or job.status != "processing":
                job = self._jobs[name] = Job(self._spark, name, work)
            return job

    def get(self, name: str) -> Job:
        if name not in self._jobs:
            raise NotFound(f"no work named {name}")
        return self._jobs[name]
