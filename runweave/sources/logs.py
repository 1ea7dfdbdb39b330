"""Log files as tables: JSON lines, and text whose form is told by a logging format string."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

#: The form of a run's text log, and the keys that each record of its JSON log has.
TEXT_LOG = "%(created)f %(asctime)s %(processName)s-%(process)d %(threadName)s-%(thread)d %(name)s:%(lineno)d %(funcName)s %(levelname)s: %(message)s"
JSON_LOG = "created double, process long, processName string, threadName string, thread long, name string, lineno long, funcname string, levelname string, msg string, formatted string"

#: What a field of a format string looks like, and its type; others are text without line ends.
_FIELD = re.compile(r"%\((\w+)\)[-+ #0]*(\d*)(?:\.\d+)?([sdifr])")
_LOOKS = {"asctime": r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:[,.]\d+)?", "levelname": r"[A-Za-z]+", "name": r"[^\s:]+", "funcName": r"\S+", "message": r".*"}
_KINDS = {"d": (r"-?\d+", "long"), "i": (r"-?\d+", "long"), "f": (r"-?\d+(?:\.\d+)?", "double")}


def form_of(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The pattern that a record's first line matches, as Java and Python read it, and the names and types of its groups.

    text is a format string with %(name)s fields; fields may have flags, a width and a precision.
    """
    pattern, fields, at = "^", [], 0
    for m in _FIELD.finditer(text):
        name, width, kind = m.groups()
        looks, type_ = _KINDS.get(kind, (_LOOKS.get(name, ".*?"), "string"))
        pad = r"\s*" if width else ""
        pattern += f"{re.escape(text[at : m.start()])}{pad}({looks}){pad}"
        fields.append((name, type_))
        at = m.end()
    return f"{pattern}{re.escape(text[at:])}$", fields


def _records(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    """Lines of blocks of files (file, block, value) as records: part is 1 for lines before a block's first head, 2 for its last record, else 0."""
    head = re.compile(pattern)
    place, held, headed = None, [], False
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "block", "part", "value"])

    for lines in batches:
        for file, block, value in zip(*(c.to_pylist() for c in lines.columns), strict=True):
            begins = head.match(value) is not None
            if (file, block) != place or begins:
                if held:
                    out.append((*place, (2 if (file, block) != place else 0) if headed else 1, "\n".join(held)))
                place, held, headed = (file, block), [], begins
            held.append(value)
        if len(out) >= 5_000:
            yield batch()
            out = []
    if held:
        out.append((*place, 2 if headed else 1, "\n".join(held)))
    if out:
        yield batch()


def records(spark: SparkSession, path: str, text: str = TEXT_LOG) -> DataFrame:
    """Rows (file, record) of text logs, one for each line that has the form and the lines up to the next such line, as of a traceback.

    Files are read in blocks side by side. A record that goes on in the next blocks is put together from what each of them has of it;
    those are two rows a block. Lines before a file's first record are one record.
    """
    pattern, _ = form_of(text)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    found, _ = materialize(spark, lines.mapInArrow(lambda batches: _records(batches, pattern), "file string, block long, part int, value string"), "records")
    border = found.where("part > 0")
    order = Window.partitionBy("file").orderBy("block", "part")
    group = F.sum((F.col("part") == 2).cast("int")).over(order)
    parts = border.withColumn("group", group).groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "part", "value"))).alias("x"))
    whole = parts.select("file", F.array_join(F.transform("x", lambda x: x["value"]), "\n").alias("record"))
    return found.where("part = 0").select("file", F.col("value").alias("record")).unionByName(whole)


def read_text_log(spark: SparkSession, path: str, text: str = TEXT_LOG) -> DataFrame:
    """A column for each field of the form, from records(); what follows the first line is part of the message (or of the last field).

    Lines that belong to no record have nulls but in message.
    """
    pattern, fields = form_of(text)
    mark = "\x01"
    first = F.regexp_extract("record", r"^[^\n]*", 0)
    more = F.substring(F.col("record"), F.length(first) + 1, F.length("record"))
    groups = mark.join(f"${i}" for i in range(1, len(fields) + 1))
    cut = F.when(first.rlike(pattern), F.split(F.regexp_replace(first, pattern, groups), mark, len(fields)))
    rows = records(spark, path, text).select("record", more.alias("more"), cut.alias("x"))
    last = "message" if any(n == "message" for n, _ in fields) else fields[-1][0]
    columns = []
    for i, (name, kind) in enumerate(fields):
        value = F.concat(F.col("x")[i], F.col("more")) if name == last else F.col("x")[i]
        columns.append((F.coalesce(value, F.col("record")) if name == last else value.try_cast(kind)).alias(name))
    return rows.select(*columns)


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log with one JSON object in each line: the columns of JSON_LOG, other keys in the map extra; msg is as it was given, formatted is its text.

    Lines that are no JSON object have nulls and their text in _corrupt_record.
    """
    names = [c.split()[0] for c in JSON_LOG.split(", ")]
    lines = spark.read.text(path).select("value", F.from_json("value", JSON_LOG).alias("r"), F.from_json("value", "map<string,string>").alias("all"))
    extra = F.map_filter("all", lambda k, _: ~k.isin(names))
    return lines.select("r.*", extra.alias("extra"), F.when(F.col("all").isNull(), F.col("value")).alias("_corrupt_record"))


class JsonLines(logging.Formatter):
    """A record as one JSON object in a line, as read_json_log() reads it; attributes whose names begin with the prefix are added as text."""

    def __init__(self, prefix: str = "runweave."):
        super().__init__()
        self.prefix = prefix

    def format(self, record: logging.LogRecord) -> str:
        own = {n: getattr(record, {"funcname": "funcName"}.get(n, n)) for n in (c.split()[0] for c in JSON_LOG.split(", ")) if n != "formatted"}
        more = {k: str(v) for k, v in record.__dict__.items() if k.startswith(self.prefix)}
        return json.dumps(own | {"formatted": super().format(record)} | more, default=str)


#: How lines of a log file are written: as read_text_log() and read_json_log() read them.
FORMS = {"text": logging.Formatter(TEXT_LOG), "json": JsonLines()}


def start_log(path: str, form: str = "text", name: str = "runweave", level: int = logging.INFO) -> logging.Logger:
    """The driver's logger of that name, writing to the file; a file is opened once a process, whoever asks again."""
    log = logging.getLogger(name)
    if not any(isinstance(h, logging.FileHandler) and h.get_name() == path for h in log.handlers):
        handler = logging.FileHandler(path)
        handler.set_name(path)
        handler.setFormatter(FORMS[form])
        log.addHandler(handler)
    log.setLevel(level)
    return log


def stop_logs(name: str = "runweave") -> None:
    log = logging.getLogger(name)
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
