"""Schemas of the seven monitoring tables, their keys, and the domains of task and block states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Task states and block states.
TASK_STATES = ("pending", "running", "exec_done", "failed", "dep_fail", "launched", "fail_retryable", "memo_done", "joining", "running_ended")
BLOCK_STATES = ("UNKNOWN", "PENDING", "RUNNING", "CANCELLED", "COMPLETED", "FAILED", "TIMEOUT", "HELD", "MISSING", "SCALED_IN")

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampNTZType()}


def _table(text: str) -> T.StructType:
    """Fields from words name:kind, with ? behind where null is allowed."""
    return T.StructType([T.StructField(w.split(":")[0], _KINDS[w.split(":")[1][0]], w.endswith("?")) for w in text.split()])


TABLES = {
    "workflow": _table("run_id:s workflow_name:s? workflow_version:s? time_began:t time_completed:t? host:s user:s rundir:s tasks_failed_count:i tasks_completed_count:i"),
    "task": _table("task_id:l run_id:s task_depends:s? task_func_name:s task_memoize:s task_hashsum:s? task_inputs:s? task_outputs:s? task_stdin:s? task_stdout:s? task_stderr:s? task_time_invoked:t? task_time_returned:t? task_fail_count:i task_fail_cost:d"),
    "try": _table("try_id:l task_id:l run_id:s block_id:s? hostname:s? task_executor:s task_try_time_launched:t? task_try_time_running:t? task_try_time_returned:t? task_fail_history:s? task_joins:s?"),
    "status": _table("task_id:l task_status_name:s timestamp:t run_id:s try_id:l"),
    "node": _table("id:l run_id:s hostname:s uid:s block_id:s cpu_count:i total_memory:l active:b worker_count:i python_v:s timestamp:t last_heartbeat:t"),
    "block": _table("run_id:s executor_label:s block_id:s job_id:s? timestamp:t status:s"),
    "resource": _table(
        "try_id:l task_id:l run_id:s timestamp:t resource_monitoring_interval:d? psutil_process_pid:i? psutil_process_memory_percent:d? psutil_process_children_count:d? psutil_process_time_user:d? psutil_process_time_system:d? "
        "psutil_process_memory_virtual:d? psutil_process_memory_resident:d? psutil_process_disk_read:d? psutil_process_disk_write:d? psutil_process_status:s? psutil_cpu_num:s? psutil_process_num_ctx_switches_voluntary:d? psutil_process_num_ctx_switches_involuntary:d?"
    ),
}
KEYS = {
    "workflow": ("run_id",),
    "task": ("task_id", "run_id"),
    "try": ("try_id", "task_id", "run_id"),
    "status": ("task_id", "run_id", "task_status_name", "timestamp"),
    "node": ("id",),
    "block": ("run_id", "block_id", "executor_label", "timestamp"),
    "resource": ("try_id", "task_id", "run_id", "timestamp"),
}


def conform(rows: DataFrame, name: str) -> DataFrame:
    """rows with the table's columns in its types: unknown columns are dropped, missing ones are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])


def duplicate_keys(rows: DataFrame, name: str) -> DataFrame:
    """Key values that more than one row has, with the number of rows."""
    return rows.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).where("n > 1")


def unknown_states(rows: DataFrame, name: str) -> DataFrame:
    """Rows of status or block whose state is not in the domain."""
    column, domain = {"status": ("task_status_name", TASK_STATES), "block": ("status", BLOCK_STATES)}[name]
    return rows.where(~F.col(column).isin(*domain) | F.col(column).isNull())


def reflect(spark: SparkSession, folder: str, name: str) -> T.StructType:
    """The columns of a stored table as its files have them: those of this library first, then what others have added, in any of the files."""
    stored = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}").schema
    own = [T.StructField(f.name, f.dataType) for f in TABLES[name]]
    return T.StructType([*own, *(f for f in stored if f.name not in TABLES[name].names)])


def create(spark: SparkSession, folder: str) -> None:
    """Make each table that folder does not have yet, empty."""
    for name, schema in TABLES.items():
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        spark.createDataFrame([], nullable).write.mode("ignore").parquet(f"{folder}/{name}")


def insert(rows: DataFrame, folder: str, name: str, more: tuple[str, ...] = ()) -> None:
    """Append rows to a table of the folder, in its columns and those named in `more`, which the table has from then on."""
    have, own = set(rows.columns), TABLES[name]
    columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in own]
    rows.select(*columns, *[c for c in more if c not in own.names]).write.mode("append").parquet(f"{folder}/{name}")


def table(spark: SparkSession, folder: str, name: str, reflected: bool = False) -> DataFrame:
    """A table of the folder in this library's columns; reflected: with those that others have added, null in rows without."""
    return spark.read.schema(reflect(spark, folder, name) if reflected else TABLES[name]).parquet(f"{folder}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 16, **options: str) -> DataFrame:
    """A table (or a query in brackets with a name) of a database. With a number column, as parts that are read at a time.

    bounds say where the column's parts lie, not what is read. Filters and columns are pushed to the database.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
