"""What streams do, as rows: a listener that appends states and batches of all streams of a session to a table."""

from __future__ import annotations

import datetime as dt
import json
import queue
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: run_id is that of the stream's run, task_status_name one of the states of tasks: launched, running (a batch), exec_done, failed.
ROWS = "run_id string, name string, task_status_name string, timestamp timestamp, batch long, rows long, batch_ms long, error string"
_END = object()


class StreamLog(StreamingQueryListener):
    """Appends a row for each start, batch and end of a stream to JSON files of a folder.

    Rows wait in a queue of at most `most`; a thread of its own takes them out, several at a time. If writing is slower than the
    streams for long, the listener waits and Spark's own queue of events grows, as no row is dropped.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 10_000):
        self.spark, self.folder = spark, folder
        self.names: dict[str, str | None] = {}
        self.waiting: queue.Queue = queue.Queue(most)
        self.errors: list[str] = []
        self.writer = threading.Thread(target=self._write, daemon=True)

    def start(self) -> StreamLog:
        self.writer.start()
        self.spark.streams.addListener(self)
        return self

    def stop(self) -> None:
        """Take no more events, and return when all rows are written; an error if some could not be."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.spark.streams.removeListener(self)
        self.waiting.put(_END)
        self.writer.join()
        if self.errors:
            raise RuntimeError("; ".join(self.errors))

    def _tell(self, run: object, state: str, at: str | None = None, batch=None, rows=None, took=None, error=None) -> None:
        time = at or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        row = {"run_id": str(run), "name": self.names.get(str(run)), "task_status_name": state, "timestamp": time, "batch": batch, "rows": rows, "batch_ms": took, "error": error}
        self.waiting.put({k: v for k, v in row.items() if v is not None})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.runId)] = event.name
        self._tell(event.runId, "launched", event.timestamp)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._tell(p.runId, "running", p.timestamp, p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """A stream that waits tells nothing."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._tell(event.runId, "failed" if event.exception else "exec_done", error=event.exception)

    def _write(self) -> None:
        """One file for what has gathered; written by the file system, so that telling of streams runs no jobs beside them."""
        jvm = self.spark._jvm
        while True:
            rows = [self.waiting.get()]
            while rows[-1] is not _END and not self.waiting.empty():
                rows.append(self.waiting.get())
            lines = [json.dumps(r) for r in rows if r is not _END]
            if lines:
                try:
                    to = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{uuid.uuid4().hex}.json")
                    out = to.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(to, False)
                    out.write(("\n".join(lines) + "\n").encode())
                    out.close()
                except Exception as e:
                    self.errors.append(f"{len(lines)} rows not written: {e}")
            if rows[-1] is _END:
                return


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The rows told so far."""
    return spark.read.schema(ROWS).json(folder)
