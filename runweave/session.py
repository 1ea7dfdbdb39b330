"""Session settings and run folders."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .sources import logs

T = TypeVar("T")


@dataclass
class Config:
    """What a run sets on its session. Unset fields leave Spark's own settings."""

    name: str = "runweave"
    master: str | None = None
    shuffle_partitions: int | None = None
    shared_dir: str | None = None
    min_executors: int | None = None
    max_executors: int | None = None
    idle_seconds: int = 120
    task_failures: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def settings(self) -> dict[str, str]:
        out = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
        if self.shuffle_partitions is not None:
            out["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        if self.shared_dir is not None:
            out["spark.checkpoint.dir"] = self.shared_dir
        if self.max_executors is not None:
            out |= {"spark.dynamicAllocation.enabled": "true", "spark.dynamicAllocation.minExecutors": str(self.min_executors or 0), "spark.dynamicAllocation.maxExecutors": str(self.max_executors), "spark.dynamicAllocation.executorIdleTimeout": f"{self.idle_seconds}s"}
        if self.task_failures is not None:
            out["spark.task.maxFailures"] = str(self.task_failures)
        return out | self.options


def session(config: Config | None = None) -> SparkSession:
    """The running session, or a new one with the settings."""
    config = config or Config()
    builder = SparkSession.builder.appName(config.name).config(map=config.settings())
    return (builder.master(config.master) if config.master else builder).getOrCreate()


def next_run(spark: SparkSession, folder: str) -> str:
    """A new folder under the given one, named by the number after the greatest so far, with three digits at least.

    It is this run's alone: the folder, or on other stores than local disks a file of its claim, is created only where there is none,
    and another run that comes first leaves the next number.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    number = max([-1, *(int(n) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.isdigit())])
    while True:
        number += 1
        new = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:03d}")
        try:
            if fs.getScheme() == "file":
                jvm.java.nio.file.Files.createDirectory(jvm.java.io.File(new.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                fs.create(jvm.org.apache.hadoop.fs.Path(new, ".claim"), False).close()
            return f"{folder}/{number:03d}"
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise


def limited(spark: SparkSession, action: Callable[[], T], seconds: float) -> tuple[T | None, str | None]:
    """(result, None) of an action that runs jobs, or (None, why) if it fails or takes over so many seconds; then its jobs are cancelled.

    The jobs of the calling thread are tagged while the action runs, so those of others go on. What the driver does between
    jobs ends with the next one.
    """
    tag, done = f"limited-{uuid.uuid4().hex}", threading.Event()
    late = threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.2):
                spark.sparkContext.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        return action(), None
    except Exception as e:
        return None, f"no end after {seconds} s" if late.is_set() else str(e)
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)


def close(spark: SparkSession, queries: tuple = (), name: str = "runweave") -> list[str]:
    """End a run in order: its streams, its log files, the session.

    A stream stops after the micro-batch that its checkpoint knows; the next run goes on from there. Returns what queries, and
    streams still active, failed with; a failed one does not keep the others from ending.
    """
    errors = []
    for query in {q.runId: q for q in (*queries, *spark.streams.active)}.values():
        if query.exception() is not None:
            errors.append(f"{query.name or query.id}: {query.exception()}")
        query.stop()
    logs.stop_logs(name)
    spark.stop()
    return errors
