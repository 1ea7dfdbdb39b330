"""Relational operators over the monitoring tables: filters, joins, latest states, counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def for_run(rows: DataFrame, run_id: str) -> DataFrame:
    """Rows of one run; the filter reaches the scan."""
    return rows.where(F.col("run_id") == F.lit(run_id))


def resources_for_task(resources: DataFrame, run_id: str, task_id: int | str) -> DataFrame:
    """Samples of one task. The task id may be a number or its text; text that is no number finds nothing."""
    return for_run(resources, run_id).where(F.col("task_id") == F.lit(str(task_id)).try_cast("long"))


def tasks_for_app(tasks: DataFrame, run_id: str, app: str) -> DataFrame:
    return for_run(tasks, run_id).where(F.col("task_func_name") == F.lit(app))


def workflow_summary(workflows: DataFrame) -> DataFrame:
    """Runs with status ('Completed' if there is a completion time, else 'Running') and duration in whole seconds, '-' while running."""
    seconds = scalars.duration_seconds(F.col("time_began"), F.col("time_completed"))
    return workflows.select("run_id", "workflow_name", F.when(F.col("time_completed").isNotNull(), "Completed").otherwise("Running").alias("status"), seconds.alias("seconds"))


def tries_with_tasks(tasks: DataFrame, tries: DataFrame) -> DataFrame:
    """Each try beside its task: an inner join on run and task."""
    return tasks.join(tries, ["run_id", "task_id"])


def latest_task_status(tasks: DataFrame, status: DataFrame) -> DataFrame:
    """Every task with its statuses of the latest time: all of them where several tie, null where there is none.

    The maximum is aggregated before the shuffle, so a task with many statuses costs one row a partition.
    """
    last = status.groupBy("run_id", "task_id").agg(F.max("timestamp").alias("timestamp"))
    now = status.select("run_id", "task_id", "timestamp", "task_status_name").join(last, ["run_id", "task_id", "timestamp"])
    return tasks.select("run_id", "task_id", "task_func_name").join(now, ["run_id", "task_id"], "left")


def state_counts(latest: DataFrame) -> DataFrame:
    """Tasks in each state; tasks without a status count as unsubmitted."""
    return latest.groupBy("run_id", F.coalesce("task_status_name", F.lit("unsubmitted")).alias("state")).agg(F.count("*").alias("n"))


def workflow_task_counts(tasks: DataFrame) -> DataFrame:
    """Tasks of a run that failed, and that completed by running; tasks whose dependency failed or that were reused are in neither."""
    return tasks.groupBy("run_id").agg(F.count_if(F.col("final_state") == "failed").alias("tasks_failed_count"), F.count_if(F.col("final_state") == "exec_done").alias("tasks_completed_count"))


def hash_reuse(tasks: DataFrame) -> DataFrame:
    """Tasks by hash, without those that have none, and how many of them could reuse an earlier result."""
    return tasks.where(F.col("task_hashsum").isNotNull()).groupBy("task_hashsum").agg(F.count("task_hashsum").alias("tasks"), (F.count("task_hashsum") - 1).alias("reusable"))


def memo_hits(tasks: DataFrame) -> DataFrame:
    """For each memoised task the first task of its run with the same hash, where it is another one.

    Only the least id by hash is joined back, so a hash that a third of all tasks share makes no pairs among them.
    """
    keyed = tasks.where((F.col("task_memoize") == "True") & F.col("task_hashsum").isNotNull())
    first = keyed.groupBy("run_id", "task_hashsum").agg(F.min("task_id").alias("source_task"))
    return keyed.join(first, ["run_id", "task_hashsum"]).where(F.col("task_id") > F.col("source_task")).select("run_id", "task_id", "source_task")


def node_totals(nodes: DataFrame) -> DataFrame:
    """Sums over all node rows of a run (as reported, a row for each report), and over each host's last report."""
    sums = nodes.groupBy("run_id").agg(F.sum("worker_count").alias("workers"), F.sum("cpu_count").alias("cpus"), (F.sum("total_memory") / 2**30).alias("memory_gib"))
    last = nodes.groupBy("run_id", "hostname").agg(F.max_by(F.struct("worker_count", "cpu_count"), F.struct("timestamp", "id")).alias("x"))
    return sums.join(last.groupBy("run_id").agg(F.sum("x.worker_count").alias("workers_latest"), F.sum("x.cpu_count").alias("cpus_latest")), "run_id")


def upsert(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state after all updates of an append-only log: for each column, its last non-null value by key."""
    when = F.struct(*order)
    values = [c for c in log.columns if c not in (*keys, *order)]
    return log.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c) for c in values])


def block_transitions(blocks: DataFrame) -> DataFrame:
    """Rows in which a block is new or has another status than the one before."""
    w = Window.partitionBy("run_id", "executor_label", "block_id").orderBy("timestamp")
    return blocks.withColumn("before", F.lag("status").over(w)).where(~F.col("status").eqNullSafe(F.col("before")))


def process_rollup(samples: DataFrame) -> DataFrame:
    """Resources of a task try's processes: memory and disk summed over those in the last sample, CPU time over all ever seen.

    samples: run_id, task_id, try_id, pid, timestamp and the values; a process that ended keeps its last CPU time.
    """
    key = ["run_id", "task_id", "try_id"]
    when = F.struct("timestamp", "event_id")
    per = samples.groupBy(*key, "psutil_process_pid").agg(F.max("timestamp").alias("seen"), *[F.max_by(c, when).alias(c) for c in ("psutil_process_time_user", "psutil_process_memory_resident", "psutil_process_disk_read")])
    last = samples.groupBy(*key).agg(F.max("timestamp").alias("end"))
    live = F.col("seen") == F.col("end")
    out = per.join(last, key).groupBy(*key)
    return out.agg(F.sum("psutil_process_time_user").alias("time_user"), F.sum(F.when(live, F.col("psutil_process_memory_resident"))).alias("memory_resident"), F.sum(F.when(live, F.col("psutil_process_disk_read"))).alias("disk_read"), F.count("*").alias("processes"))


def overlay(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have a key, those of updates."""
    return base.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def throughput(tries: DataFrame) -> DataFrame:
    """For each run: tries that returned, seconds from the first launch to the last return, tries a second, and least, mean and greatest latency."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    t = tries.where(F.col("task_try_time_returned").isNotNull()).select("run_id", seconds("task_try_time_launched").alias("l"), seconds("task_try_time_returned").alias("r"))
    out = t.groupBy("run_id").agg(F.count("*").alias("tries"), (F.max("r") - F.min("l")).alias("seconds"), F.min(F.col("r") - F.col("l")).alias("least"), F.round(F.avg(F.col("r") - F.col("l")), 3).alias("mean"), F.max(F.col("r") - F.col("l")).alias("greatest"))
    return out.withColumn("rate", F.round(F.when(F.col("seconds") > 0, F.col("tries") / F.col("seconds")), 9))


def run_pages(asked: DataFrame, workflows: DataFrame, resources: DataFrame) -> DataFrame:
    """What can be shown of each run_id asked for: 'unknown' runs have no row, 'no resources' have no samples, else 'resources'."""
    known = asked.select("run_id").join(workflows.select("run_id").distinct().withColumn("known", F.lit(True)), "run_id", "left")
    sampled = known.join(resources.select("run_id").distinct().withColumn("sampled", F.lit(True)), "run_id", "left")
    return sampled.select("run_id", F.when(F.col("known").isNull(), "unknown").when(F.col("sampled").isNull(), "no resources").otherwise("resources").alias("page"))


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of the two has, and which: one aggregation, combined before its shuffle."""
    both = left.select(*keys, F.lit(1).alias("side")).unionByName(right.select(*keys, F.lit(2).alias("side")))
    sides = both.groupBy(*keys).agg(F.min("side").alias("least"), F.max("side").alias("most")).where("least = most")
    return sides.select(*keys, F.when(F.col("least") == 1, "left").otherwise("right").alias("side"))


def state_log(tasks: DataFrame, tries: DataFrame) -> DataFrame:
    """The states that tasks and their tries went through, as rows of the status table: no shuffle, each row is told once.

    A try is launched and runs; a task is pending from its call, and in its final state from its return. try_id is null for a task.
    """
    state = lambda name, time: F.struct(F.lit(name).alias("task_status_name") if isinstance(name, str) else name.alias("task_status_name"), F.col(time).alias("timestamp"))
    of_try = tries.select("run_id", "task_id", "try_id", F.inline(F.array(state("launched", "task_try_time_launched"), state("running", "task_try_time_running"))))
    of_task = tasks.select("run_id", "task_id", F.lit(None).cast("long").alias("try_id"), F.inline(F.array(state("pending", "task_time_invoked"), state(F.col("final_state"), "task_time_returned"))))
    return of_try.unionByName(of_task).where(F.col("timestamp").isNotNull())
