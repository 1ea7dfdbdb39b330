"""Rows of streams' states: batches, ends, failures, a folder that cannot be written."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from runweave.streaming import progress


def put(tmp_path, n):
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"v": i}) + "\n")
    return f"file://{tmp_path}/in"


def test_states(spark, tmp_path):
    stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).json(put(tmp_path, 3))
    log = progress.StreamLog(spark, f"file://{tmp_path}/log", most=2).start()
    stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/a").trigger(availableNow=True).queryName("good").start().awaitTermination()
    bad = stream.select(F.raise_error(F.lit("odd"))).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/b").trigger(availableNow=True).queryName("bad").start()
    with pytest.raises(StreamingQueryException):
        bad.awaitTermination()
    log.stop()
    rows = progress.states(spark, f"file://{tmp_path}/log").collect()
    good = sorted((r for r in rows if r["name"] == "good"), key=lambda r: (r["batch"] is None, r["batch"] or 0))
    assert [(r["batch"], r["rows"]) for r in good if r["task_status_name"] == "running"][:3] == [(0, 1), (1, 1), (2, 1)]
    assert {r["task_status_name"] for r in good} == {"launched", "running", "exec_done"} and all(r["timestamp"] for r in rows)
    assert [("odd" in r["error"]) for r in rows if r["task_status_name"] == "failed"] == [True] and len({r["run_id"] for r in rows}) == 2


def test_rows_that_cannot_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("")
    log = progress.StreamLog(spark, f"file://{tmp_path}/file/log").start()
    log._tell("r", "launched")
    with pytest.raises(RuntimeError, match="1 rows not written"):
        log.stop()
