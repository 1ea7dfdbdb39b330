"""Results of earlier runs: by memo key in an append-only table, and of whole DataFrames by their plan."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(results: DataFrame, folder: str, run: int) -> None:
    """Add results (hash, result, seq) of a run. Where there is a column error, calls that have one stay out: they run again."""
    if "error" in results.columns:
        results = results.where(F.col("error").isNull())
    results.select("hash", "result", "seq").write.mode("append").parquet(f"{folder}/run={run:06d}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The latest result of each hash over all runs: later runs win, then later entries."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    return rows.groupBy("hash").agg(F.max_by("result", F.struct(F.col("run").cast("int"), "seq")).alias("result"))


def split(calls: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (with a hash) that have a result, with it, and the distinct ones to compute."""
    return calls.join(known, "hash"), calls.join(known.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def _runs(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "checkpoint")))


def all_checkpoints(spark: SparkSession, folder: str) -> list[str]:
    """Checkpoint folders of the runs in folder, by their names as text."""
    return [f"{r}/checkpoint" for r in _runs(spark, folder)]


def last_checkpoint(spark: SparkSession, folder: str) -> list[str]:
    """The checkpoint folder of the run with the greatest number, as a list; empty if there is none. Runs not named by numbers are skipped."""
    numbered = [r for r in _runs(spark, folder) if r.rsplit("/", 1)[-1].isdigit()]
    return [f"{max(numbered, key=lambda r: int(r.rsplit('/', 1)[-1]))}/checkpoint"] if numbered else []


def plan_key(df: DataFrame) -> str | None:
    """A key that two DataFrames share if they do the same with the same files; None where that cannot be told.

    It is a hash of the optimised plan in canonical form, of the names and types of the columns, and of path, length and time of all files
    read. None for plans with functions of other languages, with chance, or that read anything but files or a range.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    found = plan.collectLeaves()
    leaves = [found.apply(i) for i in range(found.size())]
    text = re.sub(r'"jvmId":"[^"]*"', "", plan.canonicalized().toJSON())
    if not plan.deterministic() or not all(map(_of_files, leaves)) or re.search(r"PythonUDF|ScalaUDF|UserDefined|InPandas|InArrow|MapGroups|MapElements|MapPartitions", text):
        return None
    read = [(r.fileFormat().toString(), r.options().toString(), r.dataSchema().json()) for r in (leaf.relation() for leaf in leaves if not _is(leaf, "Range"))]
    jvm, folders, stamps = spark._jvm, {}, []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        folder = path.getParent().toString()
        if folder not in folders:
            listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path.getParent())
            folders[folder] = {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in listed}
        stamps.append((f, folders[folder].get(path.getName())))
    return hashlib.sha256(json.dumps([text, df.schema.json(), read, stamps]).encode()).hexdigest()


def _is(node, name: str) -> bool:
    return node.getClass().getSimpleName() == name


def _of_files(leaf) -> bool:
    """Whether a leaf of a plan reads files, or is a range."""
    return _is(leaf, "Range") or _is(leaf, "LogicalRelation") and _is(leaf.relation(), "HadoopFsRelation")


def _stored(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def has_plan(df: DataFrame, folder: str) -> bool:
    """Whether the folder has the result of df's plan."""
    key = plan_key(df)
    return key is not None and _stored(df.sparkSession, f"{folder}/{key}")


def by_plan(df: DataFrame, folder: str) -> DataFrame:
    """df's result, from the folder if an equal plan over the same files was asked for before; else computed and stored there.

    No job runs where there is one. A result is written aside and renamed when it is whole; of two writers at once one result stays.
    A plan without a key is returned as it is.
    """
    spark, key = df.sparkSession, plan_key(df)
    if key is None:
        return df
    path = f"{folder}/{key}"
    if not _stored(spark, path):
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/aside-{uuid.uuid4().hex}")
        df.write.parquet(aside.toString())
        fs = aside.getFileSystem(spark._jsc.hadoopConfiguration())
        if _stored(spark, path) or not fs.rename(aside, spark._jvm.org.apache.hadoop.fs.Path(path)):
            fs.delete(aside, True)
    return spark.read.schema(df.schema).parquet(path)
