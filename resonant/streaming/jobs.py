"""Background jobs: one worker thread runs jobs in order, each in a Spark job group that can be cancelled and asked for progress."""

from __future__ import annotations

import queue
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Job:
    """A submitted job: status queued, running, finished, failed or cancelled."""

    def __init__(self, spark: SparkSession, work: Callable[[SparkSession], Any]):
        self._spark, self._work = spark, work
        self.group = f"resonant-{uuid.uuid4().hex}"
        self.status, self.error, self._result = "queued", None, None
        self._lock, self._done = threading.Lock(), threading.Event()

    def cancel(self) -> None:
        """Cancel it, before or while it runs; a job that has ended stays as it is."""
        with self._lock:
            if self.status == "queued":
                self.status = "cancelled"
                self._done.set()
            elif self.status == "running":
                self.status = "cancelled"
                self._spark.sparkContext.cancelJobGroup(self.group)

    def progress(self) -> tuple[int, int]:
        """Completed and known tasks of the stages of its active Spark jobs."""
        tracker = self._spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        return done, total

    def wait(self, seconds: float | None = None) -> Any:
        """Its result, once it has ended; raises what it raised, or if it was cancelled or isn't ready in time."""
        if not self._done.wait(seconds):
            raise TimeoutError("the job hasn't ended")
        if self.status == "cancelled":
            raise RuntimeError("the job was cancelled")
        if self.error is not None:
            raise self.error
        return self._result

    def _run(self) -> None:
        with self._lock:
            if self.status != "queued":
                return
            self.status = "running"
        sc = self._spark.sparkContext
        sc.setJobGroup(self.group, "resonant job", interruptOnCancel=True)
        try:
            self._result = self._work(self._spark)
            ended = "finished"
        except Exception as e:  # noqa: BLE001 - it is the caller's to raise
            self.error, ended = e, "failed"
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        with self._lock:
            if self.status == "running":
                self.status = ended
        self._done.set()


class Worker:
    """Runs submitted jobs one after the other."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._jobs: queue.Queue[Job | None] = queue.Queue()
        self._thread = threading.Thread(target=inheritable_thread_target(spark)(self._loop), daemon=True)
        self._thread.start()

    def submit(self, work: Callable[[SparkSession], Any]) -> Job:
        job = Job(self._spark, work)
        self._jobs.put(job)
        return job

    def close(self) -> None:
        """No more jobs; those submitted are run."""
        self._jobs.put(None)
        self._thread.join()

    def _loop(self) -> None:
        while (job := self._jobs.get()) is not None:
            job._run()
