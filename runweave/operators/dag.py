"""Task graphs: edges from comma-joined dependencies, and what failures reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared


def edges(tasks: DataFrame) -> DataFrame:
    """run_id, source, task_id for each dependency of a task, once however often it is listed; position is its first place in the list."""
    listed = tasks.select("run_id", "task_id", F.array_distinct(F.split("task_depends", ",")).alias("d")).where(F.col("d").isNotNull())
    return listed.select("run_id", "task_id", F.posexplode("d").alias("position", "x")).where(F.col("x") != "").select("run_id", F.col("x").cast("long").alias("source"), "task_id", "position")


#: Levels of the graph that one round of dep_fail_closure follows before it writes what it found.
HOPS = 3
#: Doubling rounds after which a chain must be a circle.
MOST_ROUNDS = 60


def chains(spark: SparkSession, links: DataFrame, stops: DataFrame) -> tuple[DataFrame, str]:
    """For each task with one dependency: the nearest task up its chain that has none or several, or is in stops, as top, and the steps there; and the folder.

    links: run_id, source, task_id, each pair once; stops: run_id, task_id, distinct. Pointers are followed by doubling, so a chain of n
    tasks takes log2(n) rounds; those that have arrived are not joined again.
    """
    single = links.groupBy("run_id", "task_id").agg(F.count("*").alias("n"), F.min("source").alias("top")).where("n = 1").select("run_id", "task_id", "top")
    onward = single.select("run_id", F.col("task_id").alias("top"), F.lit(True).alias("goes_on"))
    marked = stops.select("run_id", F.col("task_id").alias("top"), F.lit(True).alias("stop"))
    start = single.join(onward, ["run_id", "top"], "left").join(marked, ["run_id", "top"], "left")
    arrived = F.col("stop").isNotNull() | F.col("goes_on").isNull()
    now, path = shared.materialize(spark, start.select("run_id", "task_id", "top", F.lit(1).cast("long").alias("steps"), arrived.alias("arrived")), "chains")
    for _ in range(MOST_ROUNDS):
        if now.where("not arrived").isEmpty():
            return now.drop("arrived"), path
        ahead = now.select("run_id", F.col("task_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("arrived").alias("there"))
        moved = now.where("not arrived").join(ahead, ["run_id", "top"]).select("run_id", "task_id", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("arrived"))
        after, new = shared.materialize(spark, now.where("arrived").unionByName(moved), "chains")
        shared.remove(spark, path)
        now, path = after, new
    raise ValueError("tasks depend on each other in a circle")


def dep_fail_closure(spark: SparkSession, tasks: DataFrame, failed: DataFrame) -> DataFrame:
    """Tasks that depend, directly or through others, on a failed one, with the least number of steps from it.

    tasks: run_id, task_id, task_depends; failed: run_id, task_id. Chains of tasks with one dependency each are contracted to
    one edge first, see chains(). What is left is followed from the failed tasks on: a round follows HOPS edges, a shuffle of the newest tasks
    for each, and adds the tasks that it reached for the first time, or by fewer steps. At the end the chains take the steps of
    their tops. So rounds grow with the number of tasks of several dependencies on a path, not with its length.
    """
    links, links_path = shared.materialize(spark, edges(tasks).select("run_id", "source", "task_id"), "edges")
    start = failed.select("run_id", "task_id").distinct()
    up, up_path = chains(spark, links, start)
    joint = links.join(up.select("run_id", "task_id"), ["run_id", "task_id"], "left_anti")
    over = up.select("run_id", F.col("task_id").alias("source"), "top", F.col("steps").alias("more")).join(start.select("run_id", F.col("task_id").alias("source")), ["run_id", "source"], "left_anti")
    short = joint.join(over, ["run_id", "source"], "left").select("run_id", F.coalesce("top", "source").alias("task_id"), F.col("task_id").alias("next"), (F.coalesce("more", F.lit(0)) + 1).alias("more"))
    short, short_path = shared.materialize(spark, short.groupBy("run_id", "task_id", "next").agg(F.min("more").alias("more")), "short")
    base, done = shared.fresh(spark, "reached"), 0
    first = start.withColumns({"steps": F.lit(0).cast("long"), "newest": F.lit(True)})
    first.write.parquet(f"{base}/round=0")
    reached = lambda rounds: spark.read.schema(first.schema).parquet(f"{base}/round={rounds}")
    while True:
        level, found = reached(done).where("newest").select("run_id", "task_id", "steps"), None
        for hop in range(HOPS):
            level = short.join(level, ["run_id", "task_id"]).groupBy("run_id", F.col("next").alias("task_id")).agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
            told = level.withColumn("last", F.lit(hop == HOPS - 1))
            found = told if found is None else found.unionByName(told)
        best = found.groupBy("run_id", "task_id").agg(F.min(F.struct("steps", "last")).alias("x")).select("run_id", "task_id", "x.steps", F.col("x.last").alias("newest"))
        known = reached("*").groupBy("run_id", "task_id").agg(F.min("steps").alias("known"))
        better = best.join(known, ["run_id", "task_id"], "left").where("known is null or steps < known").drop("known")
        done += 1
        better.write.parquet(f"{base}/round={done}")
        if reached(done).where("newest").isEmpty():
            break
    steps = reached("*").groupBy("run_id", "task_id").agg(F.min("steps").alias("steps"))
    chained = up.join(steps.withColumnsRenamed({"task_id": "top", "steps": "more"}), ["run_id", "top"]).select("run_id", "task_id", (F.col("steps") + F.col("more")).alias("steps"))
    every = steps.unionByName(chained).groupBy("run_id", "task_id").agg(F.min("steps").cast("int").alias("steps"))
    out, _ = shared.materialize(spark, every.where("steps > 0"), "closure")
    for path in (links_path, up_path, short_path, base):
        shared.remove(spark, path)
    return out


def root_cause(spark: SparkSession, tasks: DataFrame, reached: DataFrame, failed: DataFrame) -> DataFrame:
    """For each task that a failure reaches, the failed task that its first failing dependency leads to, and the steps there.

    Pointers are followed by doubling: a round joins every pointer with the pointer of its target, so chains of n steps
    take log2(n) rounds.
    """
    bad = reached.select("run_id", "task_id").unionByName(failed.select("run_id", "task_id")).distinct()
    first = edges(tasks).join(bad.withColumnRenamed("task_id", "source"), ["run_id", "source"]).groupBy("run_id", "task_id").agg(F.min_by("source", "position").alias("cause"))
    start = reached.select("run_id", "task_id").join(failed.select("run_id", "task_id"), ["run_id", "task_id"], "left_anti").join(first, ["run_id", "task_id"]).withColumn("steps", F.lit(1))
    now, path = shared.materialize(spark, start, "causes")
    while True:
        onward = now.select("run_id", F.col("task_id").alias("cause"), F.col("cause").alias("next"), F.col("steps").alias("more"))
        joined = now.join(onward, ["run_id", "cause"], "left")
        after = joined.select("run_id", "task_id", F.coalesce("next", "cause").alias("cause"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        after, new = shared.materialize(spark, after, "causes")
        shared.remove(spark, path)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now, path = after.drop("moved"), new
