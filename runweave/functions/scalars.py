"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how dates are written in texts.
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def date_text(time: Column) -> Column:
    return F.date_format(time, DATE_FORMAT)


def text_seconds(text: Column) -> Column:
    """Whole seconds since 1970 of a date text in the session's time zone; null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(DATE_FORMAT)))


def try_name(task_id: Column, try_id: Column, between: str = "-") -> Column:
    """A try's name in plots ('-') and in logs ('.'); joins use both columns as the key."""
    return F.concat_ws(between, task_id, try_id)


def zip_archive(path: Column) -> Column:
    """The archive of a path into a zip file: up to the first '.zip' before a slash; null if there is none."""
    found = F.regexp_extract(path, r"^(.*?\.zip)/", 1)
    return F.when(found != "", found)


def zip_member(path: Column) -> Column:
    """The member behind the archive; null if there is none."""
    archive = zip_archive(path)
    return F.when(archive.isNotNull(), F.substr(path, F.length(archive) + 2))


def walltime_minutes(text: Column) -> Column:
    """Whole minutes of HH:MM:SS."""
    part = F.split(text, ":")
    return part[0].cast("int") * 60 + part[1].cast("int")


def walltime_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS."""
    return walltime_minutes(text) * 60 + F.split(text, ":")[2].cast("int")


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps, as text; '-' if either is missing."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.coalesce(F.floor(micros / 1_000_000).cast("long").cast("string"), F.lit("-"))


def dns_label(text: Column) -> Column:
    """RFC 1123 label: lower case, runs of other characters as one hyphen, 63 characters, no hyphen at the ends; null if nothing is left."""
    out = F.trim(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, 63), F.lit("-"))
    return F.when(out != "", out)


def url_scheme(url: Column) -> Column:
    """Scheme of a file URL; 'file' without one."""
    found = F.regexp_extract(url, "^([a-z][a-z0-9+.-]*):", 1)
    return F.when(found == "", "file").otherwise(found)


def url_path(url: Column) -> Column:
    return F.regexp_replace(url, "^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")


def file_name(url: Column) -> Column:
    return F.substring_index(url_path(url), "/", -1)


def log_directory(task_id: Column) -> Column:
    """Directory of a task's log files: 10,000 tasks each, four digits at least."""
    n = F.floor(task_id / 10_000).cast("string")
    return F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)


def memo_key(function: Column, version: Column, *arguments: Column) -> Column:
    """MD5 over a text of a call: function, version and the JSON of the arguments; the keys' values are this library's own.

    Maps keep the order of their entries here; memo_keys() brings them into one.
    """
    return F.md5(F.concat_ws("\x1f", function, version, *[F.coalesce(F.to_json(F.struct(a.alias("v"))), F.lit("null")) for a in arguments]).cast("binary"))


def canonical(value: Column, kind: T.DataType) -> Column:
    """value with each map in it, at any depth, as its entries in the order of their keys."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(canonical(e["key"], kind.keyType).alias("key"), canonical(e["value"], kind.valueType).alias("value"))
        return F.sort_array(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: canonical(v, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[canonical(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return value


def memo_keys(calls: DataFrame, function: str, version: str, arguments: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """calls with the column hash: equal calls have equal keys, whatever the order of the arguments and of entries in their maps.

    Arguments in ignore, such as paths of logs, do not count.
    """
    told = [canonical(F.col(f"`{a}`"), calls.schema[a].dataType) for a in sorted(set(arguments) - set(ignore))]
    return calls.withColumn("hash", memo_key(F.col(function), F.col(version), *told))
