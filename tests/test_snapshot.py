"""The kept state against the whole log: any order, replays, merges, plans, writers at once, batches that fail."""

import random
import re

import pytest
from pyspark.sql import functions as F

from runweave.operators import monitoring
from runweave.streaming import ingest, snapshot

LOG = "k string, j long, seq long, a long, b string"


def state_of(spark, folder, buckets=3):
    return snapshot.Snapshot(spark, f"file://{folder}/state", ("k", "j"), ("seq",), buckets)


def log(n, seed=1):
    r = random.Random(seed)
    return [(r.choice("xyz"), r.randrange(15), i, r.choice([None, i]), r.choice([None, f"b{i}"])) for i in range(n)]


def told(rows):
    return sorted(map(tuple, rows.select("k", "j", "a", "b").collect()), key=str)


def test_updates_in_any_order(spark, tmp_path):
    rows = log(200)
    state = state_of(spark, tmp_path)
    random.Random(2).shuffle(rows)
    batches = [rows[i::20] for i in range(20)]
    for n, batch in enumerate(batches):
        state.update(spark.createDataFrame(batch, LOG), n)
        state.update(spark.createDataFrame(batch, LOG), n)  # a replay
        if n in (6, 12, 17):
            state.compact()
            state.update(spark.createDataFrame(batches[n - 3], LOG), n - 3)  # a replay of what is merged
    number, manifest = state.manifest()
    assert number == 23 and sorted(manifest["changes"]) == ["18", "19"] and manifest["through"] == 17
    want = told(monitoring.upsert(spark.createDataFrame(rows, LOG), ["k", "j"], ["seq"]))
    assert told(state.read()) == want
    state.vacuum()
    assert told(state.read()) == want


def test_the_base_is_not_shuffled(spark, tmp_path, capsys):
    state = state_of(spark, tmp_path)
    state.update(spark.createDataFrame(log(100), LOG), 0)
    state.compact()
    state.update(spark.createDataFrame(log(10, 3), LOG), 1)
    state.read().explain()
    plan = capsys.readouterr().out
    base = next(i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines = plan.splitlines()
    above, least = [], depth(lines[base])
    for line in reversed(lines[:base]):
        if depth(line) < least:
            above.append(line)
            least = depth(line)
    assert any("Join" in line for line in above) and not any(re.search("Exchange hash", line) for line in above)


def test_another_session_reads_and_merges(spark, tmp_path):
    state = state_of(spark, tmp_path)
    state.update(spark.createDataFrame([("x", 1, 1, 5, None)], LOG), 0)
    state.compact()
    other = snapshot.Snapshot(spark.newSession(), state.folder, state.keys, state.order)
    spark.sql("DROP TABLE IF EXISTS " + "snapshot_" + __import__("hashlib").md5(state.manifest()[1]["base"].encode()).hexdigest())
    other.update(spark.createDataFrame([("x", 1, 2, None, "late"), ("y", 2, 1, None, None)], LOG), 1)
    assert told(other.read()) == [("x", 1, 5, "late"), ("y", 2, None, None)]
    other.compact()
    assert told(state.read()) == told(other.read())


def test_columns_come_later(spark, tmp_path):
    state = state_of(spark, tmp_path)
    state.update(spark.createDataFrame([("x", 1, 1, 5)], "k string, j long, seq long, a long"), 0)
    state.compact()
    state.update(spark.createDataFrame([("x", 1, 0, 4, "b")], LOG), 1)
    state.update(spark.createDataFrame([], LOG), 2)
    assert told(state.read()) == [("x", 1, 5, "b")]


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """A manifest that another writer has put in place is read again, not replaced."""
    state, other = state_of(spark, tmp_path), state_of(spark, tmp_path)
    state.update(spark.createDataFrame([("x", 1, 1, 5, None)], LOG), 0)
    old = state.manifest()
    asked = iter([old, old])
    monkeypatch.setattr(state, "manifest", lambda: next(asked, None) or snapshot.Snapshot.manifest(state), raising=False)
    other.update(spark.createDataFrame([("x", 1, 2, 6, None)], LOG), 1)
    state.update(spark.createDataFrame([("x", 1, 3, None, "c")], LOG), 2)
    assert told(other.read()) == [("x", 1, 6, "c")] and sorted(other.manifest()[1]["changes"]) == ["0", "1", "2"]


def test_nothing_yet(spark, tmp_path):
    state = state_of(spark, tmp_path)
    state.compact()
    with pytest.raises(ValueError, match="no state"):
        state.read()


def test_failing_batches_are_put_aside(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    done = []

    def write(batch, number):
        if number == 1:
            raise ValueError("bad storage")
        done.append(number)

    messages = spark.createDataFrame([("TASK_INFO", "r", 1)], "type string, run_id string, seq long").select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ingest.MESSAGE.split(", ") if c.split()[0] not in ("type", "run_id", "seq")])
    assert ingest.errors(spark, out).count() == 0
    for n in range(3):
        ingest.isolated(write, out)(messages, n)
    ingest.isolated(write, out)(messages, 1)  # replayed, and failing again
    assert done == [0, 2]
    assert [(r["batch"], r["seq"], "bad storage" in r["error"]) for r in ingest.errors(spark, out).collect()] == [(1, 1, True)]

    class Query:
        def awaitTermination(self):  # noqa: N802
            return True

    with pytest.raises(RuntimeError, match=r"1 \(1 messages\).*bad storage"):
        ingest.finish(Query(), out)
    ingest.finish(Query(), f"file://{tmp_path}/none")


def test_rows_without_key(spark):
    rows = spark.createDataFrame([("NODE_INFO", 1, '{"id": 5}'), ("NODE_INFO", 2, "{}")], "type string, seq long, payload string")
    assert ingest.rows_for(rows, "node").count() == 2
    assert ingest.rows_for(rows.where("seq = 1"), "node", strict=True).first()["id"] == 5
    with pytest.raises(Exception, match="NODE_INFO without id: seq 2"):
        ingest.rows_for(rows, "node", strict=True).collect()
