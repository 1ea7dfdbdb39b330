"""What a run's records say of its scaling: states as of a moment, the rules for them, and orders of launch, joining and idling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rows

#: States in which a block is no more.
ENDED = ("CANCELLED", "COMPLETED", "FAILED", "TIMEOUT", "MISSING", "SCALED_IN")


def placed(spark: SparkSession, ordered: DataFrame, key: str = "run_id") -> DataFrame:
    """ordered (a table sorted by key first) with place, 1 and up by key: positions over its partitions, so no task numbers a whole run."""
    numbered = rows.positions(spark, ordered)
    first = numbered.groupBy(key).agg(F.min("position").alias("first"))
    return numbered.join(first, key).withColumn("place", F.col("position") - F.col("first") + 1).drop("position", "first")


def as_of(tasks: DataFrame, blocks: DataFrame, nodes: DataFrame, moment: str, max_blocks: int, parallelism: float) -> DataFrame:
    """The rows that scaling_decision() judges, from what was recorded up to a moment: one for each run with tasks.

    tasks: run_id, task_time_invoked, task_time_returned; blocks: rows of the block table; nodes: run_id, timestamp, worker_count. A task
    is outstanding from its call to its return; a block counts while its last state is none of ENDED.
    """
    at = F.lit(moment).cast("timestamp_ntz")
    late = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    out = tasks.where(F.col("task_time_invoked") <= at).groupBy("run_id").agg(
        F.count_if(F.col("task_time_returned").isNull() | (F.col("task_time_returned") > at)).alias("tasks"), F.max(F.when(F.col("task_time_returned") <= at, late("task_time_returned"))).alias("last")
    )
    live = latest_blocks(blocks.where(F.col("timestamp") <= at)).where(~F.col("status").isin(*ENDED)).groupBy("run_id").agg(F.count("*").alias("blocks"))
    workers = nodes.where(F.col("timestamp") <= at).groupBy("run_id").agg(F.max("worker_count").cast("long").alias("workers_per_node"))
    whole = out.join(live, "run_id", "left").join(workers, "run_id", "left").withColumn("at", at)
    idle = F.when(F.col("tasks") == 0, F.coalesce(late("at") - F.col("last"), F.lit(0.0))).otherwise(0.0)
    return whole.select("run_id", "tasks", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("workers_per_node", F.lit(1)).alias("workers_per_node"), F.lit(0).alias("min_blocks"), F.lit(max_blocks).alias("max_blocks"), F.lit(1).alias("nodes_per_block"), F.lit(parallelism).alias("parallelism"), idle.alias("idle_seconds"), F.lit(120).alias("max_idletime"), F.lit(True).alias("can_shrink"))


def scaling_decision(snapshot: DataFrame) -> DataFrame:
    """case and blocks (to add; negative: to remove) for each executor row.

    Columns: tasks, blocks, min_blocks, max_blocks, workers_per_node, nodes_per_block, parallelism, idle_seconds,
    max_idletime, can_shrink (whether blocks with fewer tasks than slots may go).
    """
    per = F.col("workers_per_node") * F.col("nodes_per_block")
    slots = F.col("blocks") * per
    wanted = F.col("tasks") * F.col("parallelism")
    grow = F.least(F.ceil(F.ceil(wanted - slots) / per), F.col("max_blocks") - F.col("blocks"))
    shrink = F.least(F.floor(F.floor(slots - wanted) / per), F.col("blocks") - F.col("min_blocks"))
    idle = F.col("tasks") == 0
    few = F.col("blocks") <= F.col("min_blocks")
    short = slots / F.col("tasks") < F.col("parallelism")
    full = F.col("blocks") >= F.col("max_blocks")
    case = F.when(idle & few, "1a").when(idle, "1b").when(short & full, "2a").when(short, "2b").when(slots == 0, "4a").when(slots > F.col("tasks"), "4b").otherwise("3")
    out = snapshot.withColumn("case", case)
    gone = F.when(F.col("idle_seconds") > F.col("max_idletime"), F.col("min_blocks") - F.col("blocks")).otherwise(0)
    lone = F.when(full, 0).otherwise(1)
    less = F.when(F.col("can_shrink") & (F.col("blocks") > F.col("min_blocks")), -shrink).otherwise(0)
    by = F.when(F.col("case") == "1b", gone).when(F.col("case") == "2b", grow).when(F.col("case") == "4a", lone).when(F.col("case") == "4b", less).otherwise(0)
    return out.withColumn("change", by.cast("long"))


def latest_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("run_id", "executor_label", "block_id").agg(F.max_by("status", "timestamp").alias("status"))


def block_failure(latest: DataFrame, threshold: int = 3) -> DataFrame:
    """Executors whose blocks are at least `threshold` and have all failed or gone missing."""
    bad = F.col("status").isin("FAILED", "MISSING")
    sums = latest.groupBy("run_id", "executor_label").agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"))
    return sums.withColumn("bad_state", (F.col("total") >= max(1, threshold)) & (F.col("total") == F.col("failed")))


def windowed_block_failure(latest: DataFrame, threshold: int = 3) -> DataFrame:
    """Executors whose last `threshold` blocks, by number, have all failed or gone missing; fewer blocks never count."""
    bad = F.col("status").isin("FAILED", "MISSING")
    w = Window.partitionBy("run_id", "executor_label").orderBy(F.col("block_id").cast("long").desc())
    tail = latest.withColumn("place", F.row_number().over(w)).where(F.col("place") <= threshold)
    return tail.groupBy("run_id", "executor_label").agg(F.count_if(bad).alias("failed")).withColumn("bad_state", F.col("failed") == threshold)


def block_idle_ranking(spark: SparkSession, blocks: DataFrame, tries: DataFrame, moment: str) -> DataFrame:
    """The live blocks of each run as of a moment, in the order in which they could go: longest idle first, then by block_id.

    tries: run_id, block_id, task_try_time_launched, task_try_time_returned. A block is idle since its last return, not at all while it
    has a try, and without end if it never had one. Blocks with tries count even if the block table does not know them.
    """
    at = F.lit(moment).cast("timestamp_ntz")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    known = latest_blocks(blocks.where(F.col("timestamp") <= at)).where(~F.col("status").isin(*ENDED)).select("run_id", "block_id").distinct()
    back = F.col("task_try_time_returned")
    used = tries.where(F.col("task_try_time_launched") <= at).groupBy("run_id", "block_id").agg(F.count_if(back.isNull() | (back > at)).alias("tasks"), F.max(F.when(back <= at, back)).alias("last"))
    every = known.join(used, ["run_id", "block_id"], "full_outer")
    idle = F.when(F.col("tasks") > 0, 0.0).otherwise(F.coalesce(seconds(at) - seconds(F.col("last")), F.lit(float("inf"))))
    return placed(spark, every.select("run_id", "block_id", F.coalesce("tasks", F.lit(0)).alias("tasks"), idle.alias("idle")).orderBy("run_id", F.desc("idle"), "block_id"))


def first_launches(tries: DataFrame, most: int) -> DataFrame:
    """The `most` tries of each run that were launched first, by time, task and try: each task of the shuffle is sent so many of a run at most."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("task_try_time_launched", "task_id", "try_id"))
    return tries.where(F.col("task_try_time_launched").isNotNull()).withColumn("place", place).where(F.col("place") <= most)


def retry_outcome(tries: DataFrame, retries: float) -> DataFrame:
    """For each task of a log of tries (run_id, task_id, try_id, cost; null cost for a success): how it ends if costs are bounded.

    A try runs as long as those before it failed and their costs never summed to more than retries. The window is by task.
    """
    w = Window.partitionBy("run_id", "task_id").orderBy("try_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run_id", "task_id").orderBy("try_id").rowsBetween(Window.unboundedPreceding, 0)
    t = tries.select("run_id", "task_id", "try_id", "cost").withColumn("spent", F.coalesce(F.sum("cost").over(upto), F.lit(0.0)))
    runs = F.coalesce(~F.bool_or(F.col("cost").isNull()).over(w) & (F.max("spent").over(w) <= retries), F.lit(True))
    made = t.withColumn("runs", runs).where("runs")
    ends = F.when(F.bool_or(F.col("cost").isNull()), "exec_done").otherwise("failed")
    return made.groupBy("run_id", "task_id").agg(F.count("*").alias("tries"), F.max_by("spent", "try_id").alias("fail_cost"), ends.alias("final_state"))
