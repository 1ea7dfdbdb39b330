"""Functions of rows that columns cannot express, in Arrow batches."""

from __future__ import annotations

import os
import signal
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Bits of monotonically_increasing_id() that count a partition's rows.
_ROW_BITS = (1 << 33) - 1


def zipped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each position of the array columns, up to the shortest one, with the position as `place`; in place of the arrays."""
    least = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    kept = [c for c in rows.columns if c not in columns]
    whole = rows.where(least > 0).select(*[F.col(f"`{c}`") for c in kept], F.posexplode(F.arrays_zip(*[F.slice(c, 1, least).alias(c) for c in columns])).alias("place", "_at"))
    return whole.select(*[F.col(f"`{c}`") for c in kept], "place", *[F.col("_at").getField(c).alias(c) for c in columns])


def positions(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows with the column position: 0, 1, ... in the order of their partitions, and within each in its order.

    The rows are written where they are, with their number in their partition, and the partitions' counts are summed up: nothing is
    sorted, and no task gets more than its partition, or than a row a partition. A table sorted by orderBy() keeps that order.
    """
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("number"))
    written, _ = materialize(spark, own, "positions")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return written.join(F.broadcast(starts), "part").select("own.*", (F.col("start") + F.col("number")).alias("position"))


def zipped_tables(spark: SparkSession, *tables: DataFrame) -> DataFrame:
    """The tables row beside row by position, up to the end of the shortest; columns must have different names."""
    placed = [positions(spark, t) for t in tables]
    out = placed[0]
    for other in placed[1:]:
        out = out.join(other, "position")
    return out


def within(f: Callable, seconds: float) -> Callable:
    """f, ended by a TimeoutError after the seconds. For the main thread, in which Python workers run."""

    def end(*_):
        raise TimeoutError(f"no end after {seconds} s")

    def run(*args):
        before = signal.signal(signal.SIGALRM, end)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return f(*args)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return run


def in_slices(batches: Iterator[pd.DataFrame], columns: list[str], f: Callable[[dict], tuple], most_bytes: int) -> Iterator[pd.DataFrame]:
    """The rows with the columns that f returns for each, passed on whenever their values reach most_bytes."""
    for pdf in batches:
        done, first, size = [], 0, 0
        for i, row in enumerate(pdf.to_dict("records"), 1):
            done.append(f(row))
            size += sum(len(v) for v in done[-1] if isinstance(v, (bytes, str)))
            if size >= most_bytes or i == len(pdf):
                part = pdf.iloc[first:i]
                yield part.assign(**{c: pd.Series([d[k] for d in done], index=part.index, dtype=object) for k, c in enumerate(columns)})
                done, first, size = [], i, 0


def map_rows(rows: DataFrame, column: str | list[str], f: Callable, result: str, walltime: float | None = None) -> DataFrame:
    """rows with the columns result (of the type given as 'name type') and error: f of the column's value (of the columns' values), or why it failed.

    The order of rows is kept in each partition; a failing row does not end the job, nor does one that takes over walltime seconds.
    """
    f = within(f, walltime) if walltime else f
    name, given = result.split()[0], [column] if isinstance(column, str) else list(column)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema) + f", {result}, error string"

    def run(batches):
        for pdf in batches:
            values, errors = [], []
            for v in zip(*(pdf[c] for c in given), strict=True):
                try:
                    values.append(f(*v))
                    errors.append(None)
                except Exception as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{name: pd.Series(values, index=pdf.index, dtype=object), "error": errors})

    return rows.mapInPandas(run, schema)


def map_tables(spark: SparkSession, f: Callable, result: str, *tables: DataFrame, walltime: float | None = None) -> DataFrame:
    """Rows (position, result, error): f of the first rows' first columns, of the second rows', ... up to the end of the shortest table.

    position tells the order of the inputs, whatever tasks the calls run in. A call that fails gives its error.
    """
    named = [t.select(F.col(f"`{t.columns[0]}`").alias(f"argument{i}")) for i, t in enumerate(tables)]
    called = map_rows(zipped_tables(spark, *named), [f"argument{i}" for i in range(len(tables))], f, result, walltime)
    return called.select("position", result.split()[0], "error")


def run_commands(rows: DataFrame, column: str, timeout: float = 60, outputs: str | None = None, inputs: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """rows with exit_code, stdout and stderr of the shell command in the column, run on the executor; null if it timed out.

    With outputs, the name of a column of paths, `missing` lists those that do not exist after the command. With inputs, another such
    column, a command does not run while one of them is not there: exit_code is null and stderr tells which. Commands may run
    again when a task is retried. A task holds about most_bytes of output, and that of one command more.
    """
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema) + ", exit_code int, stdout string, stderr string, missing array<string>"

    def one(row: dict) -> tuple:
        absent = [] if inputs is None or row[inputs] is None else [p for p in row[inputs] if not os.path.exists(p)]
        told = (None, None, "no input " + ", ".join(absent)) if absent else run_one(row[column])
        paths = row[outputs] if outputs else None
        return *told, None if paths is None else [p for p in paths if not os.path.exists(p)]

    def run_one(command: str) -> tuple:
        try:
            p = subprocess.run(["/bin/bash", "-c", command], capture_output=True, text=True, timeout=timeout)
            return p.returncode, p.stdout, p.stderr
        except subprocess.TimeoutExpired:
            return None, None, f"no end after {timeout} s"

    def run(batches):
        return in_slices(batches, ["exit_code", "stdout", "stderr", "missing"], one, most_bytes)

    return rows.mapInPandas(run, schema)
