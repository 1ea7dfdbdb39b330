"""Statuses from workers' messages, as a stateful stream: messages come in any order and at least once, each is told once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("run_id", "task_id", "try_id")
#: The messages that count: a try's row, and its worker's first and last message.
KINDS = ("TRY_INFO", "FIRST", "LAST")
_OUT = "run_id string, task_id long, try_id long, task_status_name string, at long, seq long"
_Told = Row(*[c.split()[0] for c in _OUT.split(", ")])
_STORE, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WorkerStatus(StatefulProcessor):
    """One state for each try: whether its row has come, the first message that waits for it, and the numbers of all messages told.

    With idle_ms a timer forgets a try for which nothing came for so long (processing time); a message that is delivered again after
    that is told again. Without it, the state of every try is kept.

    A message is two numbers, its mark (seq and kind) and its time in microseconds: a try costs few calls, and no frame of its own.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("try", "seen boolean, at long, seq long, told array<long>, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seen, at, seq, told, until = self.state.get() or (False, None, None, [], None)
        known, out = set(told), []
        for mark, ts in sorted(((r["mark"], r["at"]) for r in rows), key=lambda m: m[0]):
            if mark in known:
                continue
            known.add(mark)
            n, kind = divmod(mark, len(KINDS))
            if KINDS[kind] == "TRY_INFO":
                if not seen and seq is not None:
                    out.append(_Told(*key, "running", at, seq))
                seen, at, seq = True, None, None
            elif KINDS[kind] == "FIRST" and not seen:
                at, seq = ts, n
            else:
                out.append(_Told(*key, "running" if KINDS[kind] == "FIRST" else "running_ended", ts, n))
        if self.idle_ms is not None:
            if until is not None:
                self.handle.deleteTimer(until)
            until = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(until)
        if self.idle_ms is not None or len(known) > len(told):
            self.state.update((seen, at, seq, sorted(known), until))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())


def _counted(messages: DataFrame) -> DataFrame:
    """The messages that count; those without key or number can be neither matched nor told from others and are left out."""
    whole = F.col("seq").isNotNull()
    for c in KEY:
        whole &= F.col(c).isNotNull()
    return messages.where(F.col("type").isin(*KINDS) & whole).select(*KEY, "type", "timestamp", "seq")


def worker_status(spark: SparkSession, messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Statuses from workers' FIRST and LAST messages of a stream (run_id, task_id, try_id, type, timestamp, seq).

    A FIRST message that comes before its try's row waits for it; of several that wait the last counts. LAST messages never wait. A
    message that is delivered again (same try, type and seq) is told once. State is kept in RocksDB, on the executors' disks, with
    its changes in the checkpoint; the session's store is set to it. idle_ms bounds it, see WorkerStatus.
    """
    spark.conf.set(_STORE, _ROCKSDB)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("type")) - 1  # a sender numbers its own messages
    marked = _counted(messages).select(*KEY, (F.col("seq") * len(KINDS) + kind).alias("mark"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"))
    told = marked.groupBy(*KEY).transformWithState(WorkerStatus(idle_ms), _OUT, "Append", "None" if idle_ms is None else "ProcessingTime")
    return told.select(*KEY, "task_status_name", F.timestamp_micros("at").alias("timestamp"), "seq")


def worker_status_batch(messages: DataFrame) -> DataFrame:
    """worker_status() over a finished log, in order of seq, as windows by try."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    m = _counted(messages).dropDuplicates([*KEY, "type", "seq"])
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    m = m.withColumns({
        "seen": F.max(F.col("type") == "TRY_INFO").over(before),
        "try_later": F.min(F.when(F.col("type") == "TRY_INFO", F.col("seq"))).over(after),
        "first_later": F.min(F.when(F.col("type") == "FIRST", F.col("seq"))).over(after),
    })
    waits = F.col("try_later").isNotNull() & (F.col("first_later").isNull() | (F.col("first_later") > F.col("try_later")))
    told = m.where((F.col("type") == "LAST") | ((F.col("type") == "FIRST") & (F.col("seen") | waits)))
    return told.select(*KEY, F.when(F.col("type") == "LAST", "running_ended").otherwise("running").alias("task_status_name"), "timestamp", "seq")
