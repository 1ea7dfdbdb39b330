"""Structured Streaming ingest of monitoring messages, in any order and at least once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import KEYS, TABLES

#: Message types, and the table that each goes to.
TYPES = {"WORKFLOW_INFO": "workflow", "TASK_INFO": "task", "TRY_INFO": "try", "RESOURCE_INFO": "resource", "NODE_INFO": "node", "BLOCK_INFO": "block"}
#: A message is one JSON object in a line: seq orders the messages of a sender, payload is the JSON of the table's row.
MESSAGE = "type string, run_id string, task_id long, try_id long, seq long, timestamp timestamp, payload string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100, bytes_per_trigger: str | None = None) -> DataFrame:
    """Messages of the files that appear in a folder; writers rename finished files into it.

    A micro-batch takes so many files, or, where bytes_per_trigger is given ('1g'), files of about so many bytes.
    """
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.schema(MESSAGE).option(*limit).json(folder)


def rows_for(messages: DataFrame, name: str, strict: bool = False) -> DataFrame:
    """Rows of one table from the messages of its type: unknown keys are dropped, missing ones are null.

    With strict, a row without a value in one of the table's key columns is an error.
    """
    kind = next(t for t, n in TYPES.items() if n == name)
    body = F.from_json("payload", TABLES[name])
    rows = messages.where(F.col("type") == kind).select("seq", body.alias("r")).select("seq", "r.*")
    whole = lambda k: F.when(F.col(k).isNotNull(), F.col(k)).otherwise(F.raise_error(F.concat(F.lit(f"{kind} without {k}: seq "), F.coalesce(F.col("seq").cast("string"), F.lit("null")))))
    return rows.withColumns({k: whole(k) for k in KEYS[name]}) if strict else rows


def rejected(messages: DataFrame) -> DataFrame:
    """Messages of unknown type, or whose payload is no JSON object."""
    return messages.where(~F.coalesce(F.col("type").isin(*TYPES, "FIRST", "LAST"), F.lit(False)) | (F.col("type").isin(*TYPES) & F.from_json("payload", "map<string,string>").isNull()))


def isolated(write: Callable[[DataFrame, int], None], target: str) -> Callable[[DataFrame, int], None]:
    """write(batch, number), but for batches that fail: these go to target/failed with the error, and the stream goes on.

    The error is that of the batch, be it of a message or of the storage; what a failing batch had written before stays, to be
    replaced if the batch is written again. See errors() and finish().
    """

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except Exception as e:
            batch.withColumn("error", F.lit(str(e)[:2000])).write.mode("overwrite").parquet(f"{target}/failed/batch={number}")

    return guarded


def errors(spark: SparkSession, target: str) -> DataFrame:
    """Messages of the batches that failed, with batch and error; none if there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/failed")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{MESSAGE}, error string, batch int")
    return spark.read.schema(f"{MESSAGE}, error string, batch int").option("basePath", f"{target}/failed").parquet(f"{target}/failed")


def finish(query, target: str) -> None:
    """Wait for the stream's end; an error if any of its batches failed, after all of them."""
    query.awaitTermination()
    bad = errors(SparkSession.active(), target).groupBy("batch").agg(F.first("error").alias("error"), F.count("*").alias("n")).orderBy("batch").take(20)
    if bad:
        raise RuntimeError("batches failed: " + "; ".join(f"{r['batch']} ({r['n']} messages): {r['error']}" for r in bad))


def ingest(messages: DataFrame, target: str, checkpoint: str, once: bool = True, strict: bool = False, isolate: bool = False):
    """Append each message's row to target/<table>, and rejected messages to target/rejected.

    A micro-batch writes to folders of its own number, so a replayed batch replaces what it wrote before; it writes only the
    tables that it has messages for. Tables are append-only logs; operators.monitoring.upsert() gives their latest state, and
    streaming.snapshot keeps it. With strict, rows without key are an error; with isolate, a batch that fails is put aside.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            there = {r["type"] for r in batch.where(F.col("type").isin(*TYPES)).select("type").distinct().collect()}
            for kind, name in TYPES.items():
                if kind in there:
                    rows_for(batch, name, strict).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
            rejected(batch).write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
        finally:
            batch.unpersist()

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(isolated(write, target) if isolate else write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
