"""Time-series operators over monitoring tables, as sweep lines: cost follows the rows, not rows times seconds.

Times are counted in whole buckets of `unit` seconds since 1970. Every operator works on all runs at once, by run_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def epoch(ts: Column | str, unit: int = 1) -> Column:
    """Timestamp as a fractional number of units since 1970."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / (1e6 * unit)


def bucket(ts: Column | str, unit: int = 1) -> Column:
    return F.floor(epoch(ts, unit)).cast("long")


def markers(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of no weight at the first bucket of each row of bounds (keys, low, high) and behind its last one; none where low is above high."""
    ends = F.array(F.struct(F.col("low").alias("bucket"), F.lit(1).alias("mark")), F.struct((F.col("high") + 1).alias("bucket"), F.lit(2).alias("mark")))
    return bounds.where(F.col("low") <= F.col("high")).select(*keys, F.explode(ends).alias("x")).select(*keys, "x.*")


#: Buckets that one row of a gap is filled with at most.
PIECE = 4_096


def _by(keys: list[str], a: str, b: str) -> Column:
    """Whether two sides have the same keys, null being one of them."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def changes(deltas: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """The series of sweep() as it changes: rows (keys, at, length, level, points) that cover each series without gaps.

    From bucket `at` on (0 is the series' first) the level, the sum of all deltas so far, holds for `length` buckets; points add to the
    first of them alone. deltas: keys, bucket, delta, points and mark (1 at the first bucket, 2 behind the last, else null).

    Sums run by blocks. The deltas, added up by bucket, are range-partitioned by key and bucket and written; the totals of each block
    and key are few and are summed up to the block; a window runs over a block's rows of a key alone. So a series of any
    length, with any share of all rows, is dealt over as many tasks as it has blocks. blocks: how many there are; by size if not given.
    """
    spark = deltas.sparkSession
    small = deltas.groupBy(*keys, "bucket").agg(F.sum("delta").alias("delta"), F.sum("points").alias("points"), F.min("mark").alias("first"), F.max("mark").alias("last"))
    zero = F.lit(0).cast(small.schema["delta"].dataType)
    ranged = small.repartitionByRange(blocks, *keys, "bucket") if blocks else small.repartitionByRange(*keys, "bucket")
    cut, _ = materialize(spark, ranged.withColumn("block", F.spark_partition_id()), "blocks")
    totals = cut.groupBy("block", *keys).agg(
        F.sum(F.coalesce("delta", zero)).alias("total"), F.min("bucket").alias("head"), F.max(F.when(F.col("first") == 1, F.col("bucket"))).alias("low"), F.max(F.when(F.col("last") == 2, F.col("bucket"))).alias("end")
    )
    order = Window.partitionBy(*keys).orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero)
    offsets = totals.select("block", *keys, earlier.alias("earlier"), F.lead("head").over(order).alias("next_head"), F.max("low").over(whole).alias("low"), F.max("end").over(whole).alias("end"))
    met = cut.alias("c").join(offsets.alias("o"), (F.col("c.block") == F.col("o.block")) & _by(keys, "c", "o"))
    own = Window.partitionBy("block", *keys).orderBy("bucket")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = met.select("c.block", *[f"c.{k}" for k in keys], "bucket", F.coalesce("delta", zero).alias("delta"), F.coalesce("points", zero).alias("points"), "earlier", "next_head", "low", "end")
    known = rows.select(*keys, "bucket", "points", "low", "end", (F.col("earlier") + F.sum("delta").over(run)).alias("level"), F.coalesce(F.lead("bucket").over(own), F.col("next_head")).alias("after"))
    begin, last = F.greatest("bucket", "low"), F.least("after", "end") - 1
    there = known.where(F.col("low").isNotNull() & (begin <= last))
    return there.select(*keys, (begin - F.col("low")).alias("at"), (last - begin + 1).alias("length"), "level", F.when(F.col("bucket") >= F.col("low"), F.col("points")).otherwise(zero).alias("points"))


def fill(steps: DataFrame, keys: list[str]) -> DataFrame:
    """A row (keys, at, value) for each bucket of changes(). Long gaps are cut into pieces, which are dealt out before they are filled."""
    cut = steps.select(*keys, "at", "length", "level", "points", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(PIECE).cast("long"))).alias("piece")).hint("rebalance")
    filled = cut.select(*keys, "level", "points", "at", F.explode(F.sequence(F.col("at") + F.col("piece"), F.col("at") + F.least(F.col("piece") + PIECE, F.col("length")) - 1)).alias("b"))
    return filled.select(*keys, F.col("b").alias("at"), (F.col("level") + F.when(F.col("b") == F.col("at"), F.col("points")).otherwise(F.lit(0).cast(steps.schema["points"].dataType))).alias("value"))


def sweep(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Dense series by keys: `points` of a bucket, plus all `delta` up to and with it. See changes() and fill()."""
    return fill(changes(deltas, keys), keys)


def _concurrency(tasks: DataFrame, unit: int) -> DataFrame:
    """The changes that concurrency_per_app() sums up. The tasks are read once and written as what changes by app and bucket."""
    t = tasks.select("run_id", F.col("task_func_name").alias("app"), bucket("running", unit).alias("s"), bucket("returned", unit).alias("e"))
    counts = F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("s")))
    change = lambda at, d: F.struct(at.alias("bucket"), d.cast("long").alias("delta"))
    none = F.lit(None).cast("long")
    both = F.when(counts, F.array(change(F.col("s") + 1, F.lit(1)), change(F.col("e") + 1, F.lit(-1)))).otherwise(F.array(change(none, F.lit(0))))
    small = t.select("run_id", "app", "s", "e", F.explode(both).alias("x")).groupBy("run_id", "app", "x.bucket").agg(F.sum("x.delta").alias("delta"), F.min("s").alias("s"), F.max("e").alias("e"))
    small, _ = materialize(tasks.sparkSession, small, "changes")
    bounds = small.groupBy("run_id").agg(F.min("s").alias("low"), F.max("e").alias("high"))
    named = lambda d: d.withColumn("app", F.explode(F.array("app", F.lit("All"))))
    apps = named(small.where("s is not null").select("run_id", "app").distinct()).distinct()
    rows = named(small.where("bucket is not null and s is not null").select("run_id", "app", "bucket", "delta"))
    return rows.unionByName(markers(apps.join(bounds, "run_id"), ["run_id", "app"]), allowMissingColumns=True).withColumn("points", F.lit(0).cast("long"))


def concurrency_per_app(tasks: DataFrame, unit: int = 1) -> DataFrame:
    """Running tasks in each bucket of a run, by app and for 'All'.

    tasks: run_id, task_func_name, running, returned. A task counts in the buckets after that of running up to that of
    returned; without running it is skipped; without returned it counts up to the run's last return. at 0 is the first running.
    """
    return sweep(_concurrency(tasks, unit), ["run_id", "app"]).withColumnRenamed("value", "running")


def concurrency_changes(tasks: DataFrame, unit: int = 1, blocks: int | None = None) -> DataFrame:
    """concurrency_per_app() as stored between queries: rows (run_id, app, at, length, running), one for each bucket in which tasks begin or end."""
    return changes(_concurrency(tasks, unit), ["run_id", "app"], blocks).select("run_id", "app", "at", "length", F.col("level").alias("running"))


def _busy(tries: DataFrame, nodes: DataFrame, unit: int) -> tuple[DataFrame, DataFrame]:
    """The changes of busy workers by run, and the workers of each run."""
    t = tries.select("run_id", epoch("launched", unit).alias("l"), epoch("running", unit).alias("s"), epoch("returned", unit).alias("e"))
    last = F.max_by("worker_count", F.struct("timestamp", "id"))
    hosts = nodes.groupBy("run_id", "hostname").agg(last.alias("w")).groupBy("run_id").agg(F.sum("w").alias("workers_latest"))
    total = nodes.groupBy("run_id").agg(F.sum("worker_count").alias("workers"), F.floor(F.min(epoch("timestamp", unit))).cast("long").alias("n")).join(hosts, "run_id")
    bounds = t.groupBy("run_id").agg(F.floor(F.min("l")).cast("long").alias("l"), F.floor(F.max("e")).cast("long").alias("high")).join(total.select("run_id", "n"), "run_id", "left").select("run_id", F.least("l", "n").alias("low"), "high")
    t = t.where(F.col("s").isNotNull()).join(bounds, "run_id").withColumn("e", F.coalesce("e", F.col("high").cast("double"))).where("e >= s")
    a, b = F.floor("s").cast("long"), F.floor("e").cast("long")
    point = lambda at, p: F.struct(at.alias("bucket"), F.lit(0.0).alias("delta"), p.alias("points"))
    step = lambda at, d: F.struct(at.alias("bucket"), F.lit(float(d)).alias("delta"), F.lit(0.0).alias("points"))
    edges = F.array(point(a, 1 - (F.col("s") - a)), point(b, F.col("e") - b), step(a + 1, 1), step(b, -1))
    parts = F.when(a == b, F.array(point(a, F.col("e") - F.col("s")))).otherwise(edges)
    return t.select("run_id", F.explode(parts).alias("x")).select("run_id", "x.*").unionByName(markers(bounds, ["run_id"]), allowMissingColumns=True), total.select("run_id", "workers", "workers_latest")


def worker_efficiency(tries: DataFrame, nodes: DataFrame, unit: int = 1) -> DataFrame:
    """Busy workers in each bucket of a run, in fractions of a bucket, beside the sum of worker_count over its node rows.

    tries: run_id, launched, running, returned; nodes: run_id, timestamp, worker_count. Tries that end before they run are left out.
    workers_latest counts each host once, by its last row.
    """
    deltas, total = _busy(tries, nodes, unit)
    return sweep(deltas, ["run_id"]).join(total, "run_id", "left").select("run_id", "at", (F.round("value", 4) + 0.0).alias("busy"), F.coalesce("workers", F.lit(0)).alias("workers"), F.coalesce("workers_latest", F.lit(0)).alias("workers_latest"))


def worker_changes(tries: DataFrame, nodes: DataFrame, unit: int = 1, blocks: int | None = None) -> DataFrame:
    """worker_efficiency() as stored between queries: rows (run_id, at, length, busy, first): first in bucket `at`, busy in the others up to length."""
    deltas, _ = _busy(tries, nodes, unit)
    steps = changes(deltas, ["run_id"], blocks)
    return steps.select("run_id", "at", "length", (F.round("level", 4) + 0.0).alias("busy"), (F.round(F.col("level") + F.col("points"), 4) + 0.0).alias("first"))


def rate_samples(resources: DataFrame, unit: int = 1, tie: str = "timestamp") -> DataFrame:
    """Each sample of a task try with the one before: buckets prev and cur, CPU rate between them, resident GiB at the later one.

    The first sample of a try has none before and is left out; samples of one bucket have no rate.
    """
    cpu = F.col("psutil_process_time_user") + F.col("psutil_process_time_system")
    r = resources.select("run_id", "task_id", "try_id", bucket("timestamp", unit).alias("cur"), cpu.alias("cpu"), (F.col("psutil_process_memory_resident") / 2**30).alias("gib"), "timestamp", F.col(tie).alias("_tie"))
    w = Window.partitionBy("run_id", "task_id", "try_id").orderBy("timestamp", "_tie")
    r = r.withColumns({"prev": F.lag("cur").over(w), "cpu_before": F.lag("cpu").over(w)}).where(F.col("prev").isNotNull())
    rate = F.when(F.col("cur") > F.col("prev"), (F.col("cpu") - F.col("cpu_before")) / (F.col("cur") - F.col("prev")))
    return r.select("run_id", "task_id", "try_id", "prev", "cur", rate.alias("rate"), "gib")


def _used(resources: DataFrame, nodes: DataFrame, label: str, unit: int, tie: str) -> tuple[DataFrame, DataFrame]:
    """The changes of what a run uses, and what its nodes have."""
    weight = {"CPU": "rate", "mem": "gib"}[label]
    samples = rate_samples(resources, unit, tie).where("cur > prev").where(F.col(weight).isNotNull())
    w = F.col(weight)
    steps = samples.select("run_id", F.explode(F.array(F.struct(F.col("prev").alias("bucket"), w.alias("delta")), F.struct(F.col("cur").alias("bucket"), (-w).alias("delta")))).alias("x")).select("run_id", "x.*", F.lit(0.0).alias("points"))
    whole = F.sum("cpu_count").cast("double") if label == "CPU" else F.sum("total_memory") / 2**30
    n = nodes.groupBy("run_id").agg(F.min(bucket("timestamp", unit)).alias("n"), whole.alias("total"))
    bounds = resources.groupBy("run_id").agg(F.min(bucket("timestamp", unit)).alias("r"), F.max(bucket("timestamp", unit)).alias("high")).join(n, "run_id", "left").select("run_id", F.least("r", "n").alias("low"), "high")
    return steps.unionByName(markers(bounds, ["run_id"]), allowMissingColumns=True), n.select("run_id", "total")


def resource_efficiency(resources: DataFrame, nodes: DataFrame, label: str, unit: int = 1, tie: str = "timestamp") -> DataFrame:
    """Use of CPU ('CPU': cores) or memory ('mem': GiB) in each bucket of a run, beside the sum over its node rows."""
    deltas, total = _used(resources, nodes, label, unit, tie)
    return sweep(deltas, ["run_id"]).join(total, "run_id", "left").select("run_id", "at", (F.round("value", 4) + 0.0).alias("used"), "total")


def resource_changes(resources: DataFrame, nodes: DataFrame, label: str, unit: int = 1, tie: str = "timestamp", blocks: int | None = None) -> DataFrame:
    """resource_efficiency() as stored between queries: rows (run_id, at, length, used), one for each bucket in which use changes."""
    deltas, _ = _used(resources, nodes, label, unit, tie)
    return changes(deltas, ["run_id"], blocks).select("run_id", "at", "length", (F.round("level", 4) + 0.0).alias("used"))


def gantt(tasks: DataFrame, status: DataFrame, workflows: DataFrame) -> DataFrame:
    """Segments of each task in a state, until its next status or, for the last, the run's completion or else its last status."""
    ends = status.groupBy("run_id").agg(F.max("timestamp").alias("last")).join(workflows.select("run_id", "time_completed"), "run_id", "left").select("run_id", F.coalesce("time_completed", "last").alias("closing"))
    w = Window.partitionBy("run_id", "task_id").orderBy("timestamp", "task_status_name")
    s = status.select("run_id", "task_id", "task_status_name", "timestamp", F.lead("timestamp").over(w).alias("next"))
    out = tasks.select("run_id", "task_id", "task_func_name").join(s, ["run_id", "task_id"]).join(ends, "run_id")
    return out.select("run_id", "task_id", "task_func_name", "task_status_name", F.col("timestamp").alias("start"), F.coalesce("next", "closing").alias("finish"))


def distribution(resources: DataFrame, tasks: DataFrame, column: str, option: str, columns: int = 20) -> DataFrame:
    """Tasks in each of `columns` + 1 equal bars from the least to the greatest sample of a run, by their mean or greatest value.

    The last bar counts values at the greatest sample or above. Tasks without samples are in none; if all samples are equal
    there is one bar, 0.
    """
    fold = {"avg": F.avg, "max": F.max}[option]
    per = resources.groupBy("run_id", "task_id").agg(fold(column).alias("v"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    bounds = per.groupBy("run_id").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
    own = tasks.select("run_id", "task_id").join(per.select("run_id", "task_id", "v"), ["run_id", "task_id"]).join(bounds, "run_id")
    step = (F.col("high") - F.col("low")) / columns
    bar = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / step), F.lit(columns)))
    counts = own.where(F.col("v").isNotNull()).groupBy("run_id", bar.cast("int").alias("bar")).agg(F.count("*").alias("n"))
    bars = bounds.select("run_id", F.explode(F.sequence(F.lit(0), F.when(F.col("high") == F.col("low"), 0).otherwise(columns))).alias("bar"))
    return bars.join(counts, ["run_id", "bar"], "left").select("run_id", "bar", F.coalesce("n", F.lit(0)).alias("tasks"))


def binned_mean(resources: DataFrame, column: str) -> DataFrame:
    """Mean of a column in bins (a, b] of the run's monitoring interval since its first sample; the first sample is in bin 1."""
    start = resources.groupBy("run_id").agg(F.min(epoch("timestamp")).alias("low"), F.max("resource_monitoring_interval").alias("step"))
    rel = epoch("timestamp") - F.col("low")
    b = F.greatest(F.ceil(rel / F.col("step")), F.lit(1))
    return resources.join(start, "run_id").groupBy("run_id", b.cast("long").alias("bin")).agg(F.round(F.avg(column), 4).alias("mean"))


def status_histogram(status: DataFrame, columns: int = 20, states: tuple[str, ...] = ("exec_done", "failed")) -> DataFrame:
    """Statuses of each kind in `columns` equal half-open bins of a run's time; the very last moment is in none."""
    bounds = status.groupBy("run_id").agg(F.min(epoch("timestamp")).alias("low"), F.max(epoch("timestamp")).alias("high"))
    bin_ = F.floor((epoch("timestamp") - F.col("low")) * columns / (F.col("high") - F.col("low")))
    s = status.join(bounds, "run_id").where("high > low").withColumn("bin", bin_.cast("int")).where(F.col("bin") < columns)
    counts = s.groupBy("run_id", "bin").agg(*[F.count_if(F.col("task_status_name") == x).alias(x) for x in states])
    bins = bounds.where("high > low").select("run_id", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("bin"))
    return bins.join(counts, ["run_id", "bin"], "left").na.fill(0, list(states))
