"""Logs: both forms as they are written elsewhere and by this library, records of several lines, blocks of a file."""

import logging

import pytest

from runweave.sources import logs


def put(tmp_path, text, name="a.log"):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_json_records(spark, tmp_path):
    line = '{"created": 1700000000.25, "process": 17, "processName": "MainProcess", "threadName": "T-1", "thread": 139, "name": "a.b", "lineno": 5, "funcname": "go", "levelname": "INFO", "msg": "%s left", "formatted": "3 left", "tool.task": "7"}'
    rows = logs.read_json_log(spark, put(tmp_path, line + '\n[1]\nno json\n{"msg": {"a": 1}}\n')).collect()
    r = rows[0]
    assert (r["created"], r["process"], r["thread"], r["lineno"], r["funcname"], r["msg"], r["formatted"], r["extra"], r["_corrupt_record"]) == (1700000000.25, 17, 139, 5, "go", "%s left", "3 left", {"tool.task": "7"}, None)
    assert [x["_corrupt_record"] for x in rows[1:]] == ["[1]", "no json", None] and rows[3]["msg"] == '{"a":1}'


TEXT = """before any record
1700000000.250000 2023-11-14 22:13:20,250 MainProcess-17 Thread-1 (run)-139 a.b:5 go INFO: started
1700000001.500000 2023-11-14 22:13:21,500 MainProcess-17 MainThread-140 a.c:70 <module> ERROR: failed: a: b
Traceback (most recent call last):
  File "x.py", line 1

ValueError: INFO: 5
1700000002.500000 2023-11-14 22:13:22,500 MainProcess-17 MainThread-140 a.c:71 stop DEBUG:\x20
"""


@pytest.mark.parametrize("block", [10_000, 40, 150])
def test_text_records(spark, tmp_path, block):
    """A record that goes over the end of a block of the file is read as one."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = sorted(logs.read_text_log(spark, put(tmp_path, TEXT)).collect(), key=lambda r: r["created"] or 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["message"] for r in rows] == ["before any record", "started", 'failed: a: b\nTraceback (most recent call last):\n  File "x.py", line 1\n\nValueError: INFO: 5', ""]
    r = rows[1].asDict()
    assert r == {"created": 1700000000.25, "asctime": "2023-11-14 22:13:20,250", "processName": "MainProcess", "process": 17, "threadName": "Thread-1 (run)", "thread": 139, "name": "a.b", "lineno": 5, "funcName": "go", "levelname": "INFO", "message": "started"}
    assert rows[2]["funcName"] == "<module>" and rows[0]["levelname"] is None


def test_other_forms(spark, tmp_path):
    form = "%(levelname)-8s|%(relativeCreated)6.1f [%(name)s] %(message)s (%(lineno)d)"
    rows = logs.read_text_log(spark, put(tmp_path, "INFO    |  12.5 [x.y] a (b) (7)\nmore\nWARNING |1234.5 [z]  (8)\n"), form).collect()
    assert sorted(tuple(r) for r in rows) == [("INFO", 12.5, "x.y", "a (b)\nmore", 7), ("WARNING", 1234.5, "z", "", 8)]


def test_empty_files(spark, tmp_path):
    assert logs.read_text_log(spark, put(tmp_path, "")).count() == 0 and logs.read_json_log(spark, put(tmp_path, "")).count() == 0


@pytest.mark.parametrize("form", ["text", "json"])
def test_forms_read_back(spark, tmp_path, form):
    path = f"{tmp_path}/{form}.log"
    for _ in range(2):
        log = logs.start_log(path, form, name=f"test.{form}", level=logging.DEBUG)
    log.warning("disk %s", "full", extra={"runweave.task": 5, "other": 6})
    try:
        raise ValueError("odd")
    except ValueError:
        log.exception("it broke")
    logs.stop_logs(f"test.{form}")
    read = logs.read_text_log if form == "text" else logs.read_json_log
    rows = sorted(read(spark, f"file://{path}").collect(), key=lambda r: r["created"])
    text = "message" if form == "text" else "formatted"
    assert [(r["name"], r["levelname"]) for r in rows] == [(f"test.{form}", "WARNING"), (f"test.{form}", "ERROR")]
    assert rows[0][text] == "disk full" and rows[1][text].startswith("it broke\nTraceback") and rows[1][text].endswith("ValueError: odd")
    assert form == "text" or (rows[0]["extra"] == {"runweave.task": "5"} and rows[0]["msg"] == "disk %s")
