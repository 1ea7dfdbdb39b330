"""Operators on small inputs worked out by hand."""

import datetime as dt
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from runweave.functions import scalars
from runweave.operators import dag, decisions, monitoring, rows, timeseries
from runweave.sources import archives, results, schemas


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second) if second is not None else None


@pytest.mark.parametrize(("tasks", "workers", "blocks"), [(14, 48, 1), (1, 1, 1), (100, 1, 20), (47, 48, 1), (48, 48, 1), (49, 48, 2), (149, 50, 3)])
def test_scaling(spark, tasks, workers, blocks):
    row = spark.createDataFrame([(tasks, 0, 0, 20, workers, 1, 1.0, 0, 120, True)], "tasks int, blocks int, min_blocks int, max_blocks int, workers_per_node int, nodes_per_block int, parallelism double, idle_seconds int, max_idletime int, can_shrink boolean")
    assert decisions.scaling_decision(row).first()["change"] == blocks
    after = row.withColumn("blocks", F.lit(blocks))
    assert decisions.scaling_decision(after).first()["change"] == 0


def test_block_failures(spark):
    blocks = spark.createDataFrame([("r", "a", str(i), s) for i, s in enumerate(["RUNNING", "FAILED", "MISSING", "FAILED"])] + [("r", "b", "0", "FAILED")], "run_id string, executor_label string, block_id string, status string")
    assert {r["executor_label"]: r["bad_state"] for r in decisions.windowed_block_failure(blocks, 3).collect()} == {"a": True, "b": False}
    assert {r["executor_label"]: r["bad_state"] for r in decisions.block_failure(blocks, 1).collect()} == {"a": False, "b": True}


def concurrency(tasks):
    """The definition, second by second."""
    starts, ends = [s for _, s, _ in tasks if s is not None], [e for _, _, e in tasks if e is not None]
    low, high = min(starts), max(ends)
    out = {}
    for app, s, e in tasks:
        if s is not None:
            for k in (app, "All"):
                series = out.setdefault(k, [0] * (high - low + 1))
                for j in range(s + 1, (high if e is None else e) + 1):
                    series[j - low] += 1
    return out


def test_concurrency(spark):
    import random

    random.seed(5)
    tasks = [(random.choice("xyz"), random.choice([None, *range(30)]), random.choice([None, *range(20, 60)])) for _ in range(60)]
    given = spark.createDataFrame([("r", a, at(s), at(e)) for a, s, e in tasks], "run_id string, task_func_name string, running timestamp, returned timestamp")
    got = {}
    for r in timeseries.concurrency_per_app(given).collect():
        got.setdefault(r["app"], {})[r["at"]] = r["running"]
    want = concurrency(tasks)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want


def test_latest_status_keeps_ties_and_tasks_without(spark):
    tasks = spark.createDataFrame([("r", 1, "f"), ("r", 2, "f")], "run_id string, task_id long, task_func_name string")
    status = spark.createDataFrame([("r", 1, at(1), "pending"), ("r", 1, at(2), "running"), ("r", 1, at(2), "exec_done")], "run_id string, task_id long, timestamp timestamp, task_status_name string")
    got = sorted((r["task_id"], r["task_status_name"] or "") for r in monitoring.latest_task_status(tasks, status).collect())
    assert got == [(1, "exec_done"), (1, "running"), (2, "")]


@pytest.mark.parametrize(("depends", "reached"), [({2: "1"}, {2: 1}), ({2: "1", 3: "2", 4: "3"}, {2: 1, 3: 2, 4: 3}), ({2: "1", 3: "1,1"}, {2: 1, 3: 1}), ({}, {})])
def test_dependency_failure(spark, depends, reached):
    tasks = spark.createDataFrame([("r", i, depends.get(i)) for i in range(1, 6)], "run_id string, task_id long, task_depends string")
    failed = tasks.where("task_id = 1")
    found = dag.dep_fail_closure(spark, tasks, failed)
    assert {r["task_id"]: r["steps"] for r in found.collect()} == reached
    causes = dag.root_cause(spark, tasks, found, failed).collect()
    assert {r["task_id"]: (r["cause"], r["steps"]) for r in causes} == {k: (1, v) for k, v in reached.items()}


def test_histogram_of_equal_values_is_one_bar(spark):
    r = spark.createDataFrame([("r", 1, 5.0), ("r", 2, 5.0)], "run_id string, task_id long, v double")
    assert [(x["bar"], x["tasks"]) for x in timeseries.distribution(r, r.drop("v"), "v", "max").collect()] == [(0, 2)]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(scalars.zip_archive(F.lit("/a/b.zip/c.zip/d"))) == "/a/b.zip"
    assert value(scalars.zip_member(F.lit("/a/b.zip/c.zip/d"))) == "c.zip/d"
    assert value(scalars.zip_archive(F.lit("/a/b"))) is None
    assert value(scalars.walltime_minutes(F.lit("02:30:59"))) == 150
    assert value(scalars.walltime_seconds(F.lit("00:01:05"))) == 65
    assert value(scalars.dns_label(F.lit("--Foo__Bar!"))) == "foo-bar"
    assert value(scalars.dns_label(F.lit("???"))) is None
    assert value(scalars.url_scheme(F.lit("/x/y"))) == "file"
    assert value(scalars.file_name(F.lit("http://h/x/y.txt"))) == "y.txt"
    assert value(scalars.log_directory(F.lit(123456789))) == "12345"
    key = lambda *a: value(scalars.memo_key(F.lit("f"), F.lit("1"), *a))
    assert key(F.lit(1), F.lit("a")) == key(F.lit(1), F.lit("a")) != key(F.lit(1), F.lit("b"))


def test_schema_conform_and_checks(spark):
    rows_ = spark.createDataFrame([("r", 1, "bogus", 9)], "run_id string, task_id int, task_status_name string, extra int")
    out = schemas.conform(rows_, "status")
    assert out.columns == schemas.TABLES["status"].names and out.first()["try_id"] is None
    assert schemas.unknown_states(out, "status").count() == 1
    assert schemas.duplicate_keys(out.unionByName(out), "status").first()["n"] == 2


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_zip_round_trip(spark, tmp_path, most):
    given = spark.createDataFrame([(a, f"m{i}", bytes([i])) for a, n in (("a", 40), ("b", 1)) for i in range(n)], "archive string, member string, content binary")
    made = archives.to_zips(given, most).collect()
    assert sorted(r["part"] for r in made if r["archive"] == "a") == list(range(sum(r["archive"] == "a" for r in made)))
    for i, r in enumerate(made):
        (tmp_path / f"{i}.zip").write_bytes(r["content"])
        assert 1 <= len(zipfile.ZipFile(tmp_path / f"{i}.zip").namelist()) <= most
    back = archives.read_zip(spark, f"file://{tmp_path}/*.zip").collect()
    assert sorted((r["member"], bytes(r["content"])) for r in back) == sorted((r["member"], bytes(r["content"])) for r in given.collect())


def test_results(spark, tmp_path):
    folder = f"file://{tmp_path}/results"
    results.append(spark.createDataFrame([("h", "old", 1), ("g", "x", 2)], "hash string, result string, seq long"), folder, 1)
    results.append(spark.createDataFrame([("h", "new", 1)], "hash string, result string, seq long"), folder, 2)
    known = results.read(spark, folder)
    assert {r["hash"]: r["result"] for r in known.collect()} == {"h": "new", "g": "x"}
    have, need = results.split(spark.createDataFrame([("h",), ("k",), ("k",)], "hash string"), known)
    assert have.count() == 1 and need.count() == 1
    for run in ("9", "10", "other"):
        (tmp_path / "runs" / run / "checkpoint").mkdir(parents=True)
    assert [p.split("/")[-2] for p in results.all_checkpoints(spark, f"file://{tmp_path}/runs")] == ["10", "9", "other"]
    assert [p.split("/")[-2] for p in results.last_checkpoint(spark, f"file://{tmp_path}/runs")] == ["10"]


def test_map_rows_and_commands(spark):
    given = spark.createDataFrame([(4,), (0,)], "v int")
    got = {r["v"]: (r["w"], r["error"]) for r in rows.map_rows(given, "v", lambda v: 1.0 / v, "w double").collect()}
    assert got[4] == (0.25, None) and got[0][0] is None or math.isnan(got[0][0])
    assert "ZeroDivisionError" in got[0][1]
    out = {r["c"]: (r["exit_code"], r["stdout"]) for r in rows.run_commands(spark.createDataFrame([("echo hi",), ("exit 5",)], "c string"), "c").collect()}
    assert out == {"echo hi": (0, "hi\n"), "exit 5": (5, "")}
    given = spark.createDataFrame([("true", ["/bin/bash", "/no/such/file"]), ("true", None)], "c string, made array<string>")
    assert sorted((r["missing"] for r in rows.run_commands(given, "c", outputs="made").collect()), key=str) == [None, ["/no/such/file"]]


def test_fetch_passes_bodies_on_in_slices(spark):
    import pandas as pd

    from runweave.sources import fetch

    seen = [len(p) for p in rows.in_slices([pd.DataFrame({"v": range(7)})], ["b"], lambda r: (bytes(10),), 30)]
    assert seen == [3, 3, 1]
    urls = spark.createDataFrame([("mem://a",), ("none://b",)], "url string")
    got = {r["url"]: (r["content"], r["error"]) for r in fetch.fetch(urls, readers={"mem": lambda u, t: b"body"}, most_bytes=1).collect()}
    assert bytes(got["mem://a"][0]) == b"body" and got["mem://a"][1] is None and got["none://b"][0] is None and "nothing reads" in got["none://b"][1]


def test_memo_keys_order_maps_and_arguments(spark):
    given = spark.sql("select 'f' f, '1' v, i, if(i = 0, map('b', array(map('y', 1, 'x', 2)), 'a', null), map('a', null, 'b', array(map('x', 2, 'y', if(i < 2, 1, 3))))) m, null n from range(3) t(i)")
    keys = {r["i"]: r["hash"] for r in scalars.memo_keys(given, "f", "v", ["m", "n", "i"], ignore=("i",)).collect()}
    assert keys[0] == keys[1] != keys[2]
    again = {r["i"]: r["hash"] for r in scalars.memo_keys(given, "f", "v", ["n", "m"]).collect()}
    assert again == keys


def test_walltime_ends_slow_rows_only(spark):
    import time

    given = spark.createDataFrame([(0,), (1,), (2,)], "v int")
    got = {r["v"]: (r["w"], r["error"]) for r in rows.map_rows(given, "v", lambda v: time.sleep(20 * (v == 1)) or v, "w int", walltime=1).collect()}
    assert got[0] == (0, None) and got[2] == (2, None) and got[1][0] is None and "TimeoutError" in got[1][1]


def test_zipped_ends_with_the_shortest(spark):
    given = spark.sql("select 1 `a.b`, array(5, 6, 7) x, array('p', 'q') y union all select 2, array(), array('p') union all select 3, null, array('p')")
    assert [tuple(r) for r in rows.zipped(given, ["x", "y"]).orderBy("place").collect()] == [(1, 0, 5, "p"), (1, 1, 6, "q")]


def test_failed_calls_stay_out_of_results(spark, tmp_path):
    results.append(spark.createDataFrame([("h", "x", 1, None), ("g", None, 2, "boom")], "hash string, result string, seq long, error string"), f"file://{tmp_path}/r", 1)
    assert [r["hash"] for r in results.read(spark, f"file://{tmp_path}/r").collect()] == ["h"]


def test_database_table_in_parts(spark):
    url = "jdbc:derby:memory:runs;create=true"
    spark.range(10).selectExpr("id", "id * 2 as twice").write.jdbc(url, "numbers")
    got = schemas.read_jdbc(spark, url, "numbers", "id", (2, 6), 3)
    assert got.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in got.where("twice > 4").collect()) == list(range(3, 10))
