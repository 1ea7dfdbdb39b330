import json
import os

from pyspark.sql import Row
from pyspark.sql import functions as F

from runweave.plans import catalog
from runweave.streaming import ingest, worker_status


def put(folder, name, messages):
    """Write a file aside and rename it into the folder."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/../{name}.tmp", "w") as f:
        f.writelines(json.dumps(m) + "\n" for m in messages)
    os.rename(f"{folder}/../{name}.tmp", f"{folder}/{name}.json")


def message(kind, seq, task=1, payload=None):
    return {"type": kind, "run_id": "r", "task_id": task, "try_id": 0, "seq": seq, "timestamp": f"2024-01-01 00:00:{seq:02d}", "payload": payload if isinstance(payload, str) else json.dumps(payload or {})}


def test_tables(spark, tmp_path):
    folder = str(tmp_path / "new")
    task = {"task_id": 1, "run_id": "r", "task_func_name": "f", "unknown": 5}
    put(folder, "a", [message("TASK_INFO", 1, payload=task), message("NOTHING", 2), message("NODE_INFO", 3, payload="not json")])
    query = ingest.ingest(ingest.read(spark, f"file://{folder}"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert query.awaitTermination(120)
    rows = spark.read.parquet(f"file://{tmp_path}/out/task").collect()
    assert [(r["task_id"], r["task_func_name"], r["task_hashsum"]) for r in rows] == [(1, "f", None)]
    assert spark.read.parquet(f"file://{tmp_path}/out/rejected").count() == 2


def files(folder, log):
    """A file for each message, in the order of the log."""
    for i, m in enumerate(log):
        put(folder, f"f{i}", [m])
        os.utime(f"{folder}/f{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def told(spark, messages, tmp_path, name, n=None, **options):
    """What the stream tells; one with timers does not end by itself and is stopped after n messages."""
    stream = worker_status.worker_status(spark, messages, **options)
    writer = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/cp")
    query = (writer if n else writer.trigger(availableNow=True)).start()
    for _ in range(120):
        if query.awaitTermination(1) or n and sum(p.numInputRows for p in query.recentProgress) >= n:
            break
    query.stop()
    return sorted((r["task_id"], r["task_status_name"], r["seq"]) for r in spark.table(name).collect())


def test_first_message_waits_for_its_try(spark, tmp_path):
    """Messages one by one, each delivered again later on, some of them in a batch of their own."""
    folder = str(tmp_path / "new")
    log = [message("FIRST", 1), message("FIRST", 2), message("LAST", 3), message("FIRST", 1), message("TRY_INFO", 4), message("FIRST", 5), message("FIRST", 6, task=2), message("TRY_INFO", 7, task=3), message("LAST", 8, task=3)]
    files(folder, [*log, *log[::2], message("LAST", 3), {**message("LAST", 9), "task_id": None}])
    got = told(spark, ingest.read(spark, f"file://{folder}", 1), tmp_path, "statuses")
    assert got == [(1, "running", 2), (1, "running", 5), (1, "running_ended", 3), (3, "running_ended", 8)]
    batch = spark.read.schema(ingest.MESSAGE).json(f"file://{folder}")
    assert sorted((r["task_id"], r["task_status_name"], r["seq"]) for r in worker_status.worker_status_batch(batch).collect()) == got


def test_senders_number_their_own_messages(spark, tmp_path):
    folder = str(tmp_path / "new")
    files(folder, [message("FIRST", 1), message("TRY_INFO", 1), message("LAST", 1)])
    assert told(spark, ingest.read(spark, f"file://{folder}", 1), tmp_path, "equal_numbers") == [(1, "running", 1), (1, "running_ended", 1)]


def test_idle_tries_are_forgotten(spark, tmp_path):
    """With a bound of no time at all, the timer of a batch has run before the next one: a replay is told again, a waiting message is lost."""
    folder = str(tmp_path / "new")
    files(folder, [message("LAST", 1), message("FIRST", 2, task=2), message("LAST", 3, task=3), message("LAST", 1), message("TRY_INFO", 4, task=2)])
    got = told(spark, ingest.read(spark, f"file://{folder}", 1), tmp_path, "forgotten", 5, idle_ms=1)
    assert got == [(1, "running_ended", 1), (1, "running_ended", 1), (3, "running_ended", 3)]
    kept = told(spark, ingest.read(spark, f"file://{folder}", 1), tmp_path / "kept", "kept", 5, idle_ms=10_000_000)
    assert kept == [(1, "running_ended", 1), (2, "running", 2), (3, "running_ended", 3)]


def test_a_batch_has_many_files(spark, tmp_path):
    """The rows of a batch are dealt by size, so that no task holds all of them; a batch is still one micro-batch."""
    for key, value in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k"), ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")):
        spark.conf.set(key, value)
    try:
        task = spark.range(0, 30_000, 1, 8).select(F.lit("r").alias("run_id"), F.col("id").alias("task_id"), F.col("id").cast("string").alias("task_func_name"))
        messages = catalog._task_message(task, F.col("task_id"), task_func_name=F.col("task_func_name"))
        stream, appear = catalog._in_files(messages, f"file://{tmp_path}/b", F.col("seq") % 2, 3)
        seen = []
        for k in appear:
            writer = stream.writeStream.foreachBatch(lambda batch, n: seen.append((n, *batch.agg(F.count("*"), F.min(F.col("seq") % 2), F.max(F.col("seq") % 2)).first())))
            writer.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
            assert len([f for f in os.listdir(tmp_path / "b" / "in" / f"k={k}") if f.endswith(".json")]) > 2
    finally:
        for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"):
            spark.conf.unset(key)
    assert seen == [(0, 15_000, 0, 0), (1, 15_000, 1, 1)]


def test_a_try_costs_two_calls_to_its_state():
    """One to read it and one to write it; a batch of replays writes nothing."""
    calls = []

    class Value:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

    each = worker_status.WorkerStatus()
    each.init(Handle())
    rows = [Row(mark=3 * seq + worker_status.KINDS.index(kind), at=at) for seq, kind, at in ((2, "TRY_INFO", 7), (1, "FIRST", 5), (3, "LAST", None), (1, "FIRST", 5))]
    assert [tuple(r) for r in each.handleInputRows(("r", 1, 0), iter(rows), None)] == [("r", 1, 0, "running", 5, 1), ("r", 1, 0, "running_ended", None, 3)]
    assert list(each.handleInputRows(("r", 1, 0), iter(rows[1:]), None)) == []
    assert calls == ["get", "update", "get"]
