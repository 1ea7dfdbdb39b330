"""The library's queries by name, each with the SQL that a second engine runs on the same tables.

The SQL takes another route than the operator wherever one exists: brute-force grids for sweep lines, correlated
subqueries for windows, recursion for repeated joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dag, decisions, monitoring, rows, timeseries
from ..sources import archives, logs, results, schemas, shared, zip_source
from ..sources.bridge import duckdb, load
from ..streaming import ingest, progress, snapshot, worker_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RUN, TASK, APP = "run-3", 13, "1-URGENT"
WEEK, HOUR = 7 * 86400, 3600


def _query(views: tuple[str, ...], sql: str | None):
    """Register a function of the session and the named views under its own name, with its SQL over the same views."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, *[load(spark, sf_dir, v) for v in views])
        if sql is not None:
            body = sql.strip()
            head = duckdb(*views)
            ORACLES[f.__name__] = f"{head}, {body[5:]}" if body.startswith("WITH ") else f"{head} {body}"
        return f

    return add


def _units(ts: str, unit: int) -> str:
    """SQL of a timestamp in fractional units since 1970."""
    return f"(epoch_us({ts}) / {unit * 1_000_000}.0)"


# Filters and projections.


@_query(("node",), f"SELECT * FROM node WHERE run_id = '{RUN}'")
def nodes_for_workflow(spark, node):
    return monitoring.for_run(node, RUN)


@_query(("resource",), f"SELECT * FROM resource WHERE run_id = '{RUN}'")
def resources_for_workflow(spark, resource):
    return monitoring.for_run(resource, RUN)


@_query(("resource",), f"SELECT * FROM resource WHERE run_id = '{RUN}' AND task_id = {TASK}")
def resources_for_task(spark, resource):
    return monitoring.resources_for_task(resource, RUN, str(TASK))


@_query(("status",), f"""SELECT run_id, task_id, task_status_name, "timestamp" FROM status WHERE run_id = '{RUN}'""")
def status_for_workflow(spark, status):
    return monitoring.for_run(status, RUN).select("run_id", "task_id", "task_status_name", "timestamp")


@_query(("task",), f"SELECT task_id, task_func_name, task_time_returned FROM task WHERE run_id = '{RUN}'")
def completion_times(spark, task):
    return monitoring.for_run(task, RUN).select("task_id", "task_func_name", "task_time_returned")


@_query(("task",), f"SELECT * FROM task WHERE run_id = '{RUN}'")
def tasks_for_workflow(spark, task):
    return monitoring.for_run(task, RUN)


@_query(("task",), f"SELECT * FROM task WHERE run_id = '{RUN}' AND task_func_name = '{APP}'")
def tasks_for_app(spark, task):
    return monitoring.tasks_for_app(task, RUN, APP)


@_query(("workflow",), "SELECT run_id, workflow_name FROM workflow WHERE time_began IS NOT NULL AND time_completed IS NOT NULL")
def completed_workflows(spark, workflow):
    return workflow.where(F.col("time_began").isNotNull() & F.col("time_completed").isNotNull()).select("run_id", "workflow_name")


@_query(("workflow",), "SELECT run_id, workflow_name, CASE WHEN time_completed IS NULL THEN 'Running' ELSE 'Completed' END AS status, coalesce(CAST(date_diff('second', time_began, time_completed) AS VARCHAR), '-') AS seconds FROM workflow")
def workflow_summary(spark, workflow):
    return monitoring.workflow_summary(workflow)


@_query(("block",), """SELECT b.*, p.status AS before FROM block b LEFT JOIN block p ON p.run_id = b.run_id AND p.executor_label = b.executor_label AND p.block_id = b.block_id
        AND p."timestamp" = (SELECT max(q."timestamp") FROM block q WHERE q.run_id = b.run_id AND q.executor_label = b.executor_label AND q.block_id = b.block_id AND q."timestamp" < b."timestamp") WHERE p.status IS DISTINCT FROM b.status""")
def block_transitions(spark, block):
    return monitoring.block_transitions(block)


# Joins.


@_query(("task", "try"), f"""SELECT t.run_id, t.task_id, t.task_func_name, y.try_id, y.task_executor, y.task_try_time_running, t.task_time_returned FROM task t, "try" y WHERE t.task_id = y.task_id AND t.run_id = '{RUN}' AND y.run_id = '{RUN}'""")
def tries_for_workflow(spark, task, tries):
    both = monitoring.tries_with_tasks(monitoring.for_run(task, RUN), monitoring.for_run(tries, RUN))
    return both.select("run_id", "task_id", "task_func_name", "try_id", "task_executor", "task_try_time_running", "task_time_returned")


@_query(("task", "try"), """SELECT t.run_id, t.task_id, t.task_func_name, y.try_id, y.task_try_time_launched, y.task_try_time_running, y.task_try_time_returned FROM task t, "try" y WHERE t.task_id = y.task_id AND t.run_id = y.run_id""")
def task_try_times(spark, task, tries):
    return monitoring.tries_with_tasks(task, tries).select("run_id", "task_id", "task_func_name", "try_id", "task_try_time_launched", "task_try_time_running", "task_try_time_returned")


_LATEST = """SELECT t.run_id, t.task_id, t.task_func_name, s."timestamp", s.task_status_name FROM event_task t LEFT JOIN (SELECT *, rank() OVER (PARTITION BY run_id, task_id ORDER BY "timestamp" DESC) AS place FROM status) s
        ON s.run_id = t.run_id AND s.task_id = t.task_id AND s.place = 1"""


@_query(("event_task", "status"), _LATEST)
def latest_task_status(spark, task, status):
    return monitoring.latest_task_status(task, status)


@_query(("event_task", "status"), f"WITH l AS ({_LATEST}) SELECT run_id, coalesce(task_status_name, 'unsubmitted') AS state, count(*) AS n FROM l GROUP BY ALL")
def state_counts(spark, task, status):
    return monitoring.state_counts(monitoring.latest_task_status(task, status))


@_query(("task", "try"), """SELECT count(*) AS n FROM task t, "try" y WHERE t.task_id = y.task_id AND t.run_id = y.run_id AND t.final_state = 'exec_done' AND y.task_try_time_running IS NULL""")
def exec_done_without_running(spark, task, tries):
    done = task.where("final_state = 'exec_done'").select("run_id", "task_id")
    return tries.where(F.col("task_try_time_running").isNull()).select("run_id", "task_id").join(done, ["run_id", "task_id"]).agg(F.count("*").alias("n"))


_EDGES = """SELECT run_id, CAST(x AS BIGINT) AS source, task_id, min(p) AS place FROM (SELECT run_id, task_id, unnest(string_split(task_depends, ',')) AS x, generate_subscripts(string_split(task_depends, ','), 1) AS p FROM task WHERE task_depends IS NOT NULL) GROUP BY ALL"""


@_query(("task",), f"SELECT run_id, source, task_id FROM ({_EDGES.replace(', min(p) AS place', '')})")
def dag_edges(spark, task):
    return dag.edges(task).select("run_id", "source", "task_id")


@_query(("task",), "SELECT run_id, task_id, task_func_name AS app, final_state AS state, coalesce(len(list_distinct(string_split(task_depends, ','))), 0) AS dependencies FROM task")
def dag_nodes(spark, task):
    n = F.when(F.col("task_depends").isNotNull(), F.size(F.array_distinct(F.split("task_depends", ",")))).otherwise(0)
    return task.select("run_id", "task_id", F.col("task_func_name").alias("app"), F.col("final_state").alias("state"), n.cast("long").alias("dependencies"))


@_query(("task",), """SELECT run_id, task_id, source_task FROM (SELECT run_id, task_id, first_value(task_id) OVER (PARTITION BY run_id, task_hashsum ORDER BY task_id) AS source_task FROM task WHERE task_memoize = 'True') WHERE source_task <> task_id""")
def memo_hits(spark, task):
    return monitoring.memo_hits(task)


# Aggregations.


@_query(("task",), f"SELECT task_func_name, count(*) AS frequency FROM task WHERE run_id = '{RUN}' GROUP BY task_func_name")
def app_counts(spark, task):
    return monitoring.for_run(task, RUN).groupBy("task_func_name").agg(F.count("*").alias("frequency"))


@_query(("workflow", "task", "try", "status", "node", "block", "resource"), "SELECT 'workflow' AS name, count(*) AS n FROM workflow" + "".join(f""" UNION ALL SELECT '{v}', count(*) FROM "{v}" """ for v in ("task", "try", "status", "node", "block", "resource")))
def table_counts(spark, *tables):
    names = ("workflow", "task", "try", "status", "node", "block", "resource")
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in zip(names, tables, strict=True)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@_query(("block",), "SELECT run_id, count(DISTINCT block_id) AS blocks, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'SCALED_IN') AS scaled_in FROM block GROUP BY run_id")
def distinct_blocks(spark, block):
    return block.groupBy("run_id").agg(F.countDistinct("block_id").alias("blocks"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "SCALED_IN").alias("scaled_in"))


@_query(("task",), "SELECT task_hashsum, count(task_hashsum) AS tasks, count(task_hashsum) - 1 AS reusable FROM task GROUP BY task_hashsum")
def hash_reuse_counts(spark, task):
    return monitoring.hash_reuse(task)


@_query(("node",), """SELECT n.run_id, CAST(sum(worker_count) AS BIGINT) AS workers, CAST(sum(cpu_count) AS BIGINT) AS cpus, CAST(sum(total_memory) AS DOUBLE) / 1073741824 AS memory_gib, CAST(sum(CASE WHEN last THEN worker_count END) AS BIGINT) AS workers_latest,
        CAST(sum(CASE WHEN last THEN cpu_count END) AS BIGINT) AS cpus_latest FROM (SELECT *, "timestamp" = max("timestamp") OVER (PARTITION BY run_id, hostname) AS last FROM node) n GROUP BY n.run_id""")
def node_totals(spark, node):
    return monitoring.node_totals(node)


@_query(("task",), "SELECT DISTINCT run_id, task_func_name FROM task")
def distinct_apps(spark, task):
    return task.select("run_id", "task_func_name").distinct()


@_query(("task",), "SELECT run_id, sum(CASE WHEN final_state = 'failed' THEN 1 ELSE 0 END)::BIGINT AS tasks_failed_count, sum(CASE WHEN final_state = 'exec_done' THEN 1 ELSE 0 END)::BIGINT AS tasks_completed_count FROM task GROUP BY run_id")
def workflow_task_counts(spark, task):
    return monitoring.workflow_task_counts(task)


@_query(("resource",), """SELECT r.run_id, r.task_id, r.try_id, sum(u) AS time_user, sum(CASE WHEN live THEN m END) AS memory_resident, sum(CASE WHEN live THEN d END) AS disk_read, count(*) AS processes FROM
        (SELECT DISTINCT run_id, task_id, try_id, psutil_process_pid, last_value(psutil_process_time_user) OVER w AS u, last_value(psutil_process_memory_resident) OVER w AS m, last_value(psutil_process_disk_read) OVER w AS d,
        last_value("timestamp") OVER w = (SELECT max("timestamp") FROM resource q WHERE q.run_id = p.run_id AND q.task_id = p.task_id AND q.try_id = p.try_id) AS live FROM resource p
        WINDOW w AS (PARTITION BY run_id, task_id, try_id, psutil_process_pid ORDER BY "timestamp", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) r GROUP BY ALL""")
def process_tree_rollup(spark, resource):
    return monitoring.process_rollup(resource)


def map_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map over rows and a reduction by key, combined before the shuffle."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mapped = orders.select(F.col("o_orderpriority").alias("app"), F.round(F.col("o_totalprice") * 100).cast("long").alias("part"))
    return mapped.groupBy("app").agg(F.count("*").alias("parts"), F.sum("part").alias("total"))


QUERIES["map_reduce_sum"] = map_reduce_sum
ORACLES["map_reduce_sum"] = "SELECT o_orderpriority AS app, count(*) AS parts, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders GROUP BY ALL"


@_query(("try",), """SELECT *, round(tries / seconds, 9) AS rate FROM (SELECT run_id, count(*) AS tries, (epoch_us(max(task_try_time_returned)) - epoch_us(min(task_try_time_launched))) / 1e6 AS seconds, min(epoch_us(task_try_time_returned) - epoch_us(task_try_time_launched)) / 1e6 AS least,
        round(avg(epoch_us(task_try_time_returned) / 1e6 - epoch_us(task_try_time_launched) / 1e6), 3) AS mean, max(epoch_us(task_try_time_returned) - epoch_us(task_try_time_launched)) / 1e6 AS greatest FROM "try" WHERE task_try_time_returned IS NOT NULL GROUP BY run_id)""")
def throughput_stats(spark, tries):
    return monitoring.throughput(tries)


@_query(("block",), """SELECT run_id, executor_label, block_id, CASE WHEN CAST(block_id AS BIGINT) % 4 = 0 THEN 'MISSING' ELSE arg_max(status, "timestamp") END AS status FROM block GROUP BY run_id, executor_label, block_id""")
def block_status_overlay(spark, block):
    now = decisions.latest_blocks(block)
    simulated = now.where(F.col("block_id").cast("long") % 4 == 0).withColumn("status", F.lit("MISSING"))
    return monitoring.overlay(now, simulated, ["run_id", "executor_label", "block_id"])


# Windows, orders.


@_query(("event_task", "status", "workflow"), """WITH s AS (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY "timestamp", task_status_name) AS i FROM status)
        SELECT t.run_id, t.task_id, t.task_func_name, a.task_status_name, a."timestamp" AS "start", coalesce(b."timestamp", w.time_completed, (SELECT max("timestamp") FROM status q WHERE q.run_id = t.run_id)) AS finish
        FROM event_task t JOIN s a ON a.run_id = t.run_id AND a.task_id = t.task_id LEFT JOIN s b ON b.run_id = a.run_id AND b.task_id = a.task_id AND b.i = a.i + 1 LEFT JOIN workflow w ON w.run_id = t.run_id""")
def task_gantt(spark, task, status, workflow):
    return timeseries.gantt(task, status, workflow)


_SAMPLES = f"""r AS (SELECT run_id, task_id, try_id, CAST(floor({_units('"timestamp"', HOUR)}) AS BIGINT) AS cur, psutil_process_time_user + psutil_process_time_system AS cpu, psutil_process_memory_resident / 1073741824 AS gib,
        row_number() OVER (PARTITION BY run_id, task_id, try_id ORDER BY "timestamp", event_id) AS i FROM resource),
        p AS (SELECT b.run_id, b.task_id, b.try_id, a.cur AS prev, b.cur, CASE WHEN b.cur > a.cur THEN (b.cpu - a.cpu) / (b.cur - a.cur) END AS rate, b.gib FROM r a JOIN r b ON a.run_id = b.run_id AND a.task_id = b.task_id AND a.try_id = b.try_id AND b.i = a.i + 1)"""


@_query(("resource",), f"WITH {_SAMPLES} SELECT run_id, task_id, try_id, prev, cur, round(rate, 6) AS rate, gib FROM p")
def cpu_rate_samples(spark, resource):
    return timeseries.rate_samples(resource, HOUR, "event_id").withColumn("rate", F.round("rate", 6))


def _efficiency(column: str, total: str) -> str:
    return f"""WITH {_SAMPLES},
        b AS (SELECT run_id, least(min(cur), (SELECT min(CAST(floor({_units('"timestamp"', HOUR)}) AS BIGINT)) FROM event_node n WHERE n.run_id = r.run_id)) AS low, max(cur) AS high FROM r GROUP BY run_id),
        g AS (SELECT run_id, low, unnest(generate_series(low, high)) AS bucket FROM b)
        SELECT g.run_id, bucket - low AS at, round(coalesce(sum({column}), 0), 4) + 0.0 AS used, (SELECT {total} FROM event_node n WHERE n.run_id = g.run_id) AS total
        FROM g LEFT JOIN p ON p.run_id = g.run_id AND bucket >= prev AND bucket < cur GROUP BY g.run_id, bucket, low"""


@_query(("resource", "event_node"), _efficiency("rate", "CAST(sum(cpu_count) AS DOUBLE)"))
def cpu_efficiency(spark, resource, node):
    return timeseries.resource_efficiency(resource, node, "CPU", HOUR, "event_id")


@_query(("resource", "event_node"), _efficiency("gib", "CAST(sum(total_memory) AS DOUBLE) / 1073741824"))
def memory_efficiency(spark, resource, node):
    return timeseries.resource_efficiency(resource, node, "mem", HOUR, "event_id")


@_query(("task", "try"), f"""WITH t AS (SELECT y.run_id, t.task_func_name AS app, CAST(floor({_units('y.task_try_time_running', WEEK)}) AS BIGINT) AS s, CAST(floor({_units('t.task_time_returned', WEEK)}) AS BIGINT) AS e FROM "try" y JOIN task t ON t.task_id = y.task_id AND t.run_id = y.run_id),
        b AS (SELECT run_id, min(s) AS low, max(e) AS high FROM t GROUP BY run_id),
        u AS (SELECT run_id, unnest([app, 'All']) AS app, s, e FROM t WHERE s IS NOT NULL),
        n AS (SELECT run_id, app, bucket, count(*) AS n FROM (SELECT u.run_id, u.app, unnest(generate_series(u.s + 1, coalesce(u.e, b.high))) AS bucket FROM u JOIN b ON b.run_id = u.run_id) GROUP BY ALL),
        g AS (SELECT b.run_id, a.app, low, unnest(generate_series(low, high)) AS bucket FROM b JOIN (SELECT DISTINCT run_id, app FROM u) a ON a.run_id = b.run_id)
        SELECT g.run_id, g.app, g.bucket - low AS at, coalesce(n.n, 0) AS running FROM g LEFT JOIN n ON n.run_id = g.run_id AND n.app = g.app AND n.bucket = g.bucket""")
def concurrency_per_app(spark, task, tries):
    both = monitoring.tries_with_tasks(task, tries)
    return timeseries.concurrency_per_app(both.select("run_id", "task_func_name", F.col("task_try_time_running").alias("running"), F.col("task_time_returned").alias("returned")), WEEK)


@_query(("try", "node"), f"""WITH t AS (SELECT run_id, {_units('task_try_time_launched', WEEK)} AS l, {_units('task_try_time_running', WEEK)} AS s, {_units('task_try_time_returned', WEEK)} AS e FROM "try"),
        n AS (SELECT run_id, min({_units('"timestamp"', WEEK)}) AS n, CAST(sum(worker_count) AS BIGINT) AS workers, CAST(sum(CASE WHEN last THEN worker_count END) AS BIGINT) AS workers_latest FROM (SELECT *, "timestamp" = max("timestamp") OVER (PARTITION BY run_id, hostname) AS last FROM node) GROUP BY run_id),
        b AS (SELECT t.run_id, CAST(floor(least(min(l), min(n))) AS BIGINT) AS low, CAST(floor(max(e)) AS BIGINT) AS high FROM t LEFT JOIN n ON n.run_id = t.run_id GROUP BY t.run_id),
        g AS (SELECT run_id, low, high, unnest(generate_series(low, high)) AS bucket FROM b)
        SELECT g.run_id, bucket - low AS at, round(coalesce(sum(CASE WHEN s IS NOT NULL THEN greatest(0, least(coalesce(e, high), bucket + 1) - greatest(s, bucket)) END), 0), 4) + 0.0 AS busy, coalesce(any_value(workers), 0) AS workers, coalesce(any_value(workers_latest), 0) AS workers_latest
        FROM g LEFT JOIN t ON t.run_id = g.run_id AND s < bucket + 1 AND coalesce(e, high) > bucket AND coalesce(e, high) >= s LEFT JOIN n ON n.run_id = g.run_id GROUP BY g.run_id, bucket, low""")
def worker_efficiency(spark, tries, node):
    return timeseries.worker_efficiency(tries.select("run_id", F.col("task_try_time_launched").alias("launched"), F.col("task_try_time_running").alias("running"), F.col("task_try_time_returned").alias("returned")), node, WEEK)


def _steps(keys: str, moves: str, bounds: str, shown: str) -> str:
    """SQL of a series as it changes: `moves` has keys, bucket and d, `bounds` keys, low and end; every bucket of either is a step."""
    return f"""m AS ({moves}), b AS ({bounds}), s AS (SELECT {keys}, bucket, sum(d) AS d FROM (SELECT {keys}, bucket, d FROM m UNION ALL SELECT {keys}, low, 0 FROM b UNION ALL SELECT {keys}, "end", 0 FROM b) GROUP BY {keys}, bucket),
        l AS (SELECT *, sum(d) OVER (PARTITION BY {keys} ORDER BY bucket) AS level, lead(bucket) OVER (PARTITION BY {keys} ORDER BY bucket) AS after FROM s)
        SELECT {keys}, greatest(bucket, low) - low AS at, least(after, "end") - greatest(bucket, low) AS length, {shown} FROM l JOIN b USING ({keys}) WHERE greatest(bucket, low) < least(after, "end")"""


@_query(("task", "try"), "WITH " + f"""t AS (SELECT y.run_id, t.task_func_name AS app, CAST(floor({_units('y.task_try_time_running', 1)}) AS BIGINT) AS s, CAST(floor({_units('t.task_time_returned', 1)}) AS BIGINT) AS e FROM "try" y JOIN task t ON t.task_id = y.task_id AND t.run_id = y.run_id),
        u AS (SELECT run_id, unnest([app, 'All']) AS app, s, e FROM t WHERE s IS NOT NULL), """ + _steps(
    "run_id, app",
    "SELECT run_id, app, s + 1 AS bucket, 1 AS d FROM u WHERE e IS NULL OR e > s UNION ALL SELECT run_id, app, e + 1, -1 FROM u WHERE e > s",
    'SELECT DISTINCT u.run_id, u.app, r.low, r."end" FROM u JOIN (SELECT run_id, min(s) AS low, max(e) + 1 AS "end" FROM t GROUP BY run_id) r ON r.run_id = u.run_id WHERE r.low < r."end"',
    "CAST(level AS BIGINT) AS running",
))
def concurrency_by_second(spark, task, tries):
    """Running tasks by app to the second, as the buckets in which they change."""
    both = monitoring.tries_with_tasks(task, tries)
    return timeseries.concurrency_changes(both.select("run_id", "task_func_name", F.col("task_try_time_running").alias("running"), F.col("task_time_returned").alias("returned")))


@_query(("try", "node"), "WITH " + f"""t AS (SELECT run_id, CAST(floor({_units('task_try_time_launched', 1)}) AS BIGINT) AS l, CAST(floor({_units('task_try_time_running', 1)}) AS BIGINT) AS s, CAST(floor({_units('task_try_time_returned', 1)}) AS BIGINT) AS e FROM "try"),
        w AS (SELECT t.run_id, least(min(l), any_value(n)) AS low, max(e) AS high FROM t LEFT JOIN (SELECT run_id, CAST(floor(min({_units('"timestamp"', 1)})) AS BIGINT) AS n FROM node GROUP BY run_id) n ON n.run_id = t.run_id GROUP BY t.run_id),
        v AS (SELECT t.run_id, s, coalesce(e, high) AS e FROM t JOIN w ON w.run_id = t.run_id WHERE s IS NOT NULL AND coalesce(e, high) >= s), """ + _steps(
    "run_id",
    "SELECT run_id, unnest([s, s + 1, e]) AS bucket, unnest([0, CASE WHEN e > s THEN 1 ELSE 0 END, CASE WHEN e > s THEN -1 ELSE 0 END]) AS d FROM v WHERE e > s UNION ALL SELECT run_id, s, 0 FROM v WHERE e = s",
    'SELECT run_id, low, high + 1 AS "end" FROM w WHERE low <= high',
    "round(CAST(level AS DOUBLE), 4) + 0.0 AS busy, round(CAST(level + (SELECT count(*) FROM v WHERE v.run_id = l.run_id AND v.s = l.bucket AND v.e > v.s) AS DOUBLE), 4) + 0.0 AS first",
))
def workers_by_second(spark, tries, node):
    """Busy workers to the second, as the buckets in which they change. Times are whole seconds here, so a worker is busy for whole ones."""
    return timeseries.worker_changes(tries.select("run_id", F.col("task_try_time_launched").alias("launched"), F.col("task_try_time_running").alias("running"), F.col("task_try_time_returned").alias("returned")), node)


def _distribution(column: str, fold: str) -> str:
    return f"""WITH v AS (SELECT r.run_id, r.task_id, {fold}({column}) AS v FROM resource r JOIN event_task t ON t.run_id = r.run_id AND t.task_id = r.task_id GROUP BY ALL),
        b AS (SELECT run_id, min({column}) AS low, max({column}) AS high FROM resource GROUP BY run_id), g AS (SELECT *, unnest(generate_series(0, 20)) AS bar FROM b)
        SELECT g.run_id, CAST(g.bar AS INTEGER) AS bar, count(v.v) AS tasks FROM g LEFT JOIN v ON v.run_id = g.run_id AND least(floor((v.v - low) / ((high - low) / 20)), 20) = bar GROUP BY ALL"""


@_query(("resource", "event_task"), _distribution("psutil_process_time_user", "max"))
def resource_distribution_max(spark, resource, task):
    return timeseries.distribution(resource, task, "psutil_process_time_user", "max")


@_query(("resource", "event_task"), _distribution("psutil_process_memory_resident", "avg"))
def resource_distribution_avg(spark, resource, task):
    return timeseries.distribution(resource, task, "psutil_process_memory_resident", "avg")


@_query(("resource", "event_task"), _distribution("psutil_process_memory_resident", "max"))
def resource_distribution_memory_max(spark, resource, task):
    return timeseries.distribution(resource, task, "psutil_process_memory_resident", "max")


@_query(("resource",), """WITH b AS (SELECT run_id, min(epoch_us("timestamp")) AS low, max(resource_monitoring_interval) AS step FROM resource GROUP BY run_id)
        SELECT r.run_id, CAST(greatest(ceil((epoch_us("timestamp") / 1000000.0 - low / 1000000.0) / step), 1) AS BIGINT) AS bin, round(avg(psutil_process_memory_percent), 4) AS mean FROM resource r JOIN b USING (run_id) GROUP BY ALL""")
def resource_time_series(spark, resource):
    return timeseries.binned_mean(resource, "psutil_process_memory_percent")


@_query(("status",), """WITH b AS (SELECT run_id, min(epoch_us("timestamp") / 1000000.0) AS low, max(epoch_us("timestamp") / 1000000.0) AS high FROM status GROUP BY run_id), g AS (SELECT *, unnest(generate_series(0, 19)) AS bin FROM b)
        SELECT g.run_id, CAST(bin AS INTEGER) AS bin, count(*) FILTER (task_status_name = 'exec_done') AS exec_done, count(*) FILTER (task_status_name = 'failed') AS failed
        FROM g LEFT JOIN status s ON s.run_id = g.run_id AND floor((epoch_us(s."timestamp") / 1000000.0 - low) * 20 / (high - low)) = bin GROUP BY ALL""")
def status_histogram(spark, status):
    return timeseries.status_histogram(status)


@_query(("resource",), """SELECT run_id, task_id, try_id, "timestamp", psutil_process_memory_resident / 1e9 AS memory_gb, psutil_process_memory_percent AS memory_percent FROM resource""")
def task_memory_series(spark, resource):
    return resource.select("run_id", "task_id", "try_id", "timestamp", (F.col("psutil_process_memory_resident") / 1e9).alias("memory_gb"), F.col("psutil_process_memory_percent").alias("memory_percent"))


@_query(("resource",), """SELECT run_id, task_id, try_id, "timestamp", psutil_process_time_user AS time_user FROM resource""")
def task_cpu_series(spark, resource):
    return resource.select("run_id", "task_id", "try_id", "timestamp", F.col("psutil_process_time_user").alias("time_user"))


@_query(("status",), f"""SELECT "timestamp", task_status_name, try_id, row_number() OVER (ORDER BY "timestamp", task_status_name) AS place FROM status WHERE run_id = '{RUN}' AND task_id = {TASK}""")
def status_history_for_task(spark, status):
    from pyspark.sql import Window

    own = monitoring.for_run(status, RUN).where(F.col("task_id") == TASK)
    order = Window.partitionBy("task_id").orderBy("timestamp", "task_status_name")
    return own.select("timestamp", "task_status_name", "try_id", F.row_number().over(order).cast("long").alias("place"))


@_query(("status",), """SELECT DISTINCT run_id, task_id, first_value(task_status_name) OVER w AS task_status_name, first_value(try_id) OVER w AS try_id FROM status
        WINDOW w AS (PARTITION BY run_id, task_id ORDER BY "timestamp" DESC, task_status_name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def task_upsert(spark, status):
    log = status.withColumn("seq", F.col("task_status_name"))
    return monitoring.upsert(log, ["run_id", "task_id"], ["timestamp", "seq"])


@_query(("try",), """SELECT run_id, task_id, try_id, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY task_try_time_launched, task_id, try_id) AS place FROM "try" WHERE task_try_time_launched IS NOT NULL) WHERE place <= 50""")
def dispatch_order(spark, tries):
    """The 50 tries of each run that were launched first."""
    return decisions.first_launches(tries, 50).select("run_id", "task_id", "try_id", F.col("place").cast("long").alias("place"))


@_query(("node",), 'SELECT run_id, id, "timestamp", row_number() OVER (PARTITION BY run_id ORDER BY "timestamp", id) AS place FROM node')
def manager_order(spark, node):
    """The reports of each run's nodes in the order in which they came."""
    return decisions.placed(spark, node.select("run_id", "id", "timestamp").orderBy("run_id", "timestamp", "id"))


# Messages and earlier results.

_MESSAGES = """SELECT CASE event_type WHEN 'signup' THEN 'TRY_INFO' WHEN 'click' THEN 'FIRST' WHEN 'purchase' THEN 'LAST' ELSE 'RESOURCE_INFO' END AS type, concat('run-', CAST(user_id % 5 AS VARCHAR)) AS run_id, user_id AS task_id, event_id % 4 AS try_id, event_id AS seq, ts FROM events"""


def _worker_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "TRY_INFO").when(F.col("event_type") == "click", "FIRST").when(F.col("event_type") == "purchase", "LAST").otherwise("RESOURCE_INFO")
    return events.select(kind.alias("type"), F.concat(F.lit("run-"), (F.col("user_id") % 5).cast("string")).alias("run_id"), F.col("user_id").alias("task_id"), (F.col("event_id") % 4).alias("try_id"), F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"))


def deferred_first_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker statuses of a finished message log in which tries' rows come late."""
    return worker_status.worker_status_batch(_worker_messages(spark, sf_dir))


QUERIES["deferred_first_message"] = deferred_first_message
ORACLES["deferred_first_message"] = f"""WITH m AS ({_MESSAGES}), y AS (SELECT run_id, task_id, try_id, min(seq) AS seq FROM m WHERE type = 'TRY_INFO' GROUP BY ALL)
        SELECT run_id, task_id, try_id, 'running_ended' AS task_status_name, ts AS "timestamp", seq FROM m WHERE type = 'LAST'
        UNION ALL SELECT m.run_id, m.task_id, m.try_id, 'running', m.ts, m.seq FROM m JOIN y USING (run_id, task_id, try_id) WHERE m.type = 'FIRST' AND (m.seq > y.seq OR m.seq = (SELECT max(q.seq) FROM m q WHERE q.type = 'FIRST' AND q.run_id = m.run_id AND q.task_id = m.task_id AND q.try_id = m.try_id AND q.seq < y.seq))"""


def _streamed(spark: SparkSession, messages: DataFrame) -> tuple[DataFrame, str]:
    """The messages, written aside as finished files, as a stream; and a folder for what is made of them."""
    base = shared.fresh(spark, "stream")
    messages.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{base}/in")
    return ingest.read(spark, f"{base}/in"), base


def streamed_worker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deferred_first_message by the stateful stream operator, from files to a file sink, with every message delivered twice."""
    once = _worker_messages(spark, sf_dir)
    stream, base = _streamed(spark, once.unionByName(once))
    out = worker_status.worker_status(spark, stream)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


QUERIES["streamed_worker_status"] = streamed_worker_status
ORACLES["streamed_worker_status"] = ORACLES["deferred_first_message"]


@_query(("task",), "SELECT run_id, task_id, task_func_name, task_fail_count, task_hashsum FROM task")
def streamed_tasks(spark, task):
    """Task rows that come as two messages each through the ingest, and their state after both: the second has only what changed."""
    body = lambda **c: F.to_json(F.struct("run_id", "task_id", *[v.alias(k) for k, v in c.items()]))
    first = body(task_func_name=F.col("task_func_name"), task_hashsum=F.col("task_hashsum"), task_fail_count=F.lit(-1))
    head = lambda seq, payload: task.select(F.lit("TASK_INFO").alias("type"), "run_id", "task_id", F.lit(seq).alias("seq"), payload.alias("payload"))
    stream, base = _streamed(spark, head(2, body(task_fail_count=F.col("task_fail_count"))).unionByName(head(1, first)))
    ingest.ingest(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{base}/out/task").select("seq", "run_id", F.col("task_id").cast("long").alias("task_id"), "task_func_name", "task_fail_count", "task_hashsum")
    return monitoring.upsert(log, ["run_id", "task_id"], ["seq"])


def _in_files(messages: DataFrame, base: str, number, batches: int) -> tuple[DataFrame, Iterator[int]]:
    """The messages as a stream, and an iterator that lets the files of the next batch appear; number says which batch has a message.

    A batch has as many files as its size asks for, so no task holds a whole one. The stream is started anew for each batch.
    """
    spark = messages.sparkSession
    messages.withColumn("k", number.cast("int")).hint("rebalance", F.col("k")).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").partitionBy("k").json(f"{base}/made")
    appear = (k for k in range(batches) if shared.move(spark, f"{base}/made/k={k}", f"{base}/in/k={k}"))
    return ingest.read(spark, f"{base}/in/*", 2**31 - 1), appear


def _task_message(task: DataFrame, seq, **values) -> DataFrame:
    payload = F.to_json(F.struct("run_id", "task_id", *[v.alias(k) for k, v in values.items()]))
    return task.select(F.lit("TASK_INFO").alias("type"), "run_id", "task_id", seq.cast("long").alias("seq"), payload.alias("payload"))


@_query(("task",), "SELECT run_id, task_id, task_func_name, task_hashsum, task_fail_count FROM task")
def kept_tasks(spark, task):
    """The state of tasks whose rows come in three messages each, in any order, over 12 micro-batches of which every fourth merges the changes."""
    base = shared.fresh(spark, "kept")
    called = _task_message(task, F.lit(1), task_func_name=F.col("task_func_name"), task_fail_count=F.lit(-2))
    hashed = _task_message(task, F.lit(2), task_hashsum=F.col("task_hashsum"), task_fail_count=F.lit(-1))
    ended = _task_message(task, F.lit(3), task_fail_count=F.col("task_fail_count"))
    messages = called.unionByName(hashed).unionByName(ended)
    stream, appear = _in_files(messages, base, F.pmod(F.xxhash64("task_id", "seq"), F.lit(12)), 12)
    state = snapshot.Snapshot(spark, f"{base}/state", ("run_id", "task_id"), ("seq",))
    rows = lambda batch: ingest.rows_for(batch, "task").select("seq", "run_id", "task_id", "task_func_name", "task_hashsum", "task_fail_count")
    for _ in appear:
        snapshot.keep(stream, rows, state, f"{base}/checkpoint", 4).awaitTermination()
    return state.read()


@_query(("task",), "SELECT run_id, task_id, CASE WHEN task_id % 4 = 3 THEN 'put aside' ELSE 'stored' END AS state FROM task WHERE task_id % 4 < 3 OR task_id % 64 <> 7")
def isolated_batches(spark, task):
    """Tasks through a strict ingest in four micro-batches; one of them has messages without their task and is put aside, the others are stored."""
    base = shared.fresh(spark, "isolated")
    good = _task_message(task.where("task_id % 64 <> 7"), F.col("task_id"))
    bad = task.where("task_id % 64 = 7").select(F.lit("TASK_INFO").alias("type"), "run_id", F.col("task_id").alias("seq"), F.lit("{}").alias("payload"))
    stream, appear = _in_files(good.unionByName(bad, allowMissingColumns=True), base, F.col("seq") % 4, 4)
    for _ in appear:
        ingest.ingest(stream, f"{base}/out", f"{base}/checkpoint", strict=True, isolate=True).awaitTermination()
    stored = spark.read.parquet(f"{base}/out/task").select("run_id", F.col("task_id").cast("long").alias("task_id"), F.lit("stored").alias("state"))
    return stored.unionByName(ingest.errors(spark, f"{base}/out").where("task_id is not null").select("run_id", "task_id", F.lit("put aside").alias("state")))


@_query(("task",), "SELECT task_hashsum AS hash, last(task_id ORDER BY task_id % 3, task_id) AS result FROM task GROUP BY task_hashsum")
def stored_results(spark, task):
    """Results of three runs, appended to a table and read back: the later run's count."""
    folder = shared.fresh(spark, "results")
    for run in (0, 1, 2):
        results.append(task.where(F.col("task_id") % 3 == run).select(F.col("task_hashsum").alias("hash"), F.col("task_id").alias("result"), F.col("task_id").alias("seq")), folder, run)
    return results.read(spark, folder)


@_query(("task",), """WITH r AS (SELECT task_func_name, count(*) AS n, sum(task_fail_count)::BIGINT AS fails FROM task GROUP BY ALL)
        SELECT 'first' AS run, false AS stored, * FROM r UNION ALL SELECT 'again', true, * FROM r UNION ALL SELECT 'more rows', false, task_func_name, 2 * n, 2 * fails FROM r UNION ALL SELECT 'another plan', false, task_func_name, 2 * n, 2 * fails FROM r WHERE n > 1""")
def results_by_plan(spark, task):
    """An aggregate over files, asked for again, after more files have come, and by another plan: stored results are found by plan and files."""
    base = shared.fresh(spark, "plans")
    rows = task.select("task_func_name", "task_fail_count")
    rows.write.parquet(f"{base}/task")
    plan = lambda: spark.read.parquet(f"{base}/task").groupBy("task_func_name").agg(F.count("*").alias("n"), F.sum("task_fail_count").alias("fails"))

    def told(run: str, df: DataFrame) -> DataFrame:
        stored = results.has_plan(df, f"{base}/results")
        return results.by_plan(df, f"{base}/results").select(F.lit(run).alias("run"), F.lit(stored).alias("stored"), "*")

    out = told("first", plan()).unionByName(told("again", plan()))
    rows.write.mode("append").parquet(f"{base}/task")
    return out.unionByName(told("more rows", plan())).unionByName(told("another plan", plan().where("n > 1")))


@_query(("task",), "SELECT task_hashsum AS hash, last(task_id ORDER BY task_time_invoked, task_id) AS result FROM task GROUP BY task_hashsum")
def latest_results(spark, task):
    return task.groupBy(F.col("task_hashsum").alias("hash")).agg(F.max_by("task_id", F.struct("task_time_invoked", "task_id")).alias("result"))


# Graphs.


def _graph(spark: SparkSession, task: DataFrame) -> DataFrame:
    """What the graph operators read of the tasks, derived once rather than in each round."""
    return shared.materialize(spark, task.select("run_id", "task_id", "task_depends", "final_state"), "task")[0]


@_query(("task",), f"""WITH e AS ({_EDGES}), reach(run_id, task_id, steps) AS (SELECT run_id, task_id, 0 FROM task WHERE final_state = 'failed' UNION SELECT e.run_id, e.task_id, r.steps + 1 FROM reach r JOIN e ON e.run_id = r.run_id AND e.source = r.task_id)
        SELECT run_id, task_id, min(steps) AS steps FROM reach GROUP BY ALL HAVING min(steps) > 0""")
def dep_fail_closure(spark, task):
    task = _graph(spark, task)
    return dag.dep_fail_closure(spark, task, task.where("final_state = 'failed'"))


@_query(("task",), f"""WITH e AS ({_EDGES}), reach(run_id, task_id) AS (SELECT run_id, task_id FROM task WHERE final_state = 'failed' UNION SELECT e.run_id, e.task_id FROM reach r JOIN e ON e.run_id = r.run_id AND e.source = r.task_id),
        f AS (SELECT e.run_id, e.task_id, arg_min(e.source, e.place) AS cause FROM e JOIN reach r ON r.run_id = e.run_id AND r.task_id = e.source JOIN task t ON t.run_id = e.run_id AND t.task_id = e.task_id AND t.final_state <> 'failed' GROUP BY ALL),
        walk(run_id, task_id, cause, steps) AS (SELECT run_id, task_id, cause, 1 FROM f UNION ALL SELECT w.run_id, w.task_id, f.cause, w.steps + 1 FROM walk w JOIN f ON f.run_id = w.run_id AND f.task_id = w.cause)
        SELECT w.run_id, w.task_id, w.cause, w.steps FROM walk w JOIN task t ON t.run_id = w.run_id AND t.task_id = w.cause AND t.final_state = 'failed'""")
def root_cause(spark, task):
    task = _graph(spark, task)
    failed = task.where("final_state = 'failed'")
    return dag.root_cause(spark, task, dag.dep_fail_closure(spark, task, failed), failed)


@_query(("task",), f"""WITH e AS ({_EDGES}), reach(run_id, task_id) AS (SELECT run_id, task_id FROM task WHERE final_state = 'failed' UNION SELECT e.run_id, e.task_id FROM reach r JOIN e ON e.run_id = r.run_id AND e.source = r.task_id)
        SELECT run_id, count(*) AS failures FROM reach GROUP BY run_id""")
def app_fail_count(spark, task):
    task = _graph(spark, task)
    failed = task.where("final_state = 'failed'")
    reached = dag.dep_fail_closure(spark, task, failed).select("run_id", "task_id")
    return failed.select("run_id", "task_id").unionByName(reached).distinct().groupBy("run_id").agg(F.count("*").alias("failures"))


# Decisions.

_AT = "1995-01-03 12:00:00"
_LIVE = f"""l AS (SELECT run_id, executor_label, block_id, arg_max(status, "timestamp") AS status FROM block WHERE "timestamp" <= TIMESTAMP '{_AT}' GROUP BY ALL),
        k AS (SELECT * FROM l WHERE status NOT IN ('CANCELLED', 'COMPLETED', 'FAILED', 'TIMEOUT', 'MISSING', 'SCALED_IN'))"""


@_query(("task", "block", "node"), f"""WITH {_LIVE}, s AS (SELECT t.run_id, count(*) FILTER (task_time_returned IS NULL OR task_time_returned > TIMESTAMP '{_AT}') AS tasks, epoch(TIMESTAMP '{_AT}') - epoch(max(task_time_returned) FILTER (task_time_returned <= TIMESTAMP '{_AT}')) AS idle,
        coalesce((SELECT count(*) FROM k WHERE k.run_id = t.run_id), 0) AS blocks, coalesce((SELECT max(worker_count) FROM node n WHERE n.run_id = t.run_id AND n."timestamp" <= TIMESTAMP '{_AT}'), 1) AS per FROM task t WHERE task_time_invoked <= TIMESTAMP '{_AT}' GROUP BY t.run_id),
        c AS (SELECT *, CASE WHEN tasks = 0 THEN CASE WHEN blocks = 0 THEN '1a' ELSE '1b' END WHEN blocks * per < tasks THEN CASE WHEN blocks >= 5 THEN '2a' ELSE '2b' END WHEN blocks * per > tasks THEN '4b' ELSE '3' END AS "case" FROM s)
        SELECT run_id, tasks, blocks, "case", CAST(CASE "case" WHEN '1b' THEN CASE WHEN coalesce(idle, 0) > 120 THEN -blocks ELSE 0 END WHEN '2b' THEN least(ceil((tasks - blocks * per) / per), 5 - blocks) WHEN '4b' THEN -least((blocks * per - tasks) // per, blocks) ELSE 0 END AS BIGINT) AS change FROM c""")
def scaling_decision(spark, task, block, node):
    """What the rule of scaling says of each run as it was recorded at a moment."""
    return decisions.scaling_decision(decisions.as_of(task, block, node, _AT, 5, 1.0)).select("run_id", "tasks", "blocks", "case", "change")


_BLOCKS = """l AS (SELECT run_id, executor_label, block_id, arg_max(status, "timestamp") AS status FROM block GROUP BY ALL)"""


@_query(("block",), f"WITH {_BLOCKS} SELECT run_id, executor_label, count(*) AS total, count(*) FILTER (status IN ('FAILED', 'MISSING')) AS failed, count(*) >= 1 AND bool_and(status IN ('FAILED', 'MISSING')) AS bad_state FROM l GROUP BY ALL")
def block_failure_rule(spark, block):
    return decisions.block_failure(decisions.latest_blocks(block), 1)


@_query(("block",), f"""WITH {_BLOCKS}, x AS (SELECT a.*, (SELECT count(*) FROM l b WHERE b.run_id = a.run_id AND b.executor_label = a.executor_label AND CAST(b.block_id AS BIGINT) > CAST(a.block_id AS BIGINT)) AS later FROM l a)
        SELECT run_id, executor_label, count(*) FILTER (status IN ('FAILED', 'MISSING')) AS failed, count(*) FILTER (status IN ('FAILED', 'MISSING')) = 2 AS bad_state FROM x WHERE later < 2 GROUP BY ALL""")
def windowed_block_failure(spark, block):
    return decisions.windowed_block_failure(decisions.latest_blocks(block), 2)


@_query(("block", "try"), f"""WITH {_LIVE}, m AS (SELECT run_id, block_id, count(*) FILTER (task_try_time_returned IS NULL OR task_try_time_returned > TIMESTAMP '{_AT}') AS tasks, max(task_try_time_returned) FILTER (task_try_time_returned <= TIMESTAMP '{_AT}') AS last FROM "try" WHERE task_try_time_launched <= TIMESTAMP '{_AT}' GROUP BY ALL),
        u AS (SELECT run_id, block_id FROM k UNION SELECT run_id, block_id FROM m), i AS (SELECT u.run_id, u.block_id, coalesce(tasks, 0) AS tasks, CASE WHEN tasks > 0 THEN 0.0 ELSE coalesce(epoch(TIMESTAMP '{_AT}') - epoch(last), 'inf'::DOUBLE) END AS idle FROM u LEFT JOIN m ON m.run_id = u.run_id AND m.block_id = u.block_id)
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idle DESC, block_id) AS place FROM i""")
def block_idle_ranking(spark, block, tries):
    """Live blocks of each run as recorded at a moment, the longest idle ones first."""
    return decisions.block_idle_ranking(spark, block, tries, _AT)


# Scalar functions.


@_query(("task",), """SELECT task_id, 'http' AS scheme, '/data/' || task_func_name || '.zip/run/' || task_id || '.txt' AS path, task_id || '.txt' AS name, '/data/' || task_func_name || '.zip' AS archive, 'run/' || task_id || '.txt' AS member, (task_id % 30) * 60 + task_id % 60 AS minutes,
        trim(regexp_replace(lower(task_func_name || '--' || run_id || '.'), '[^a-z0-9]+', '-', 'g'), '-') AS label, lpad(CAST(task_id // 10000 AS VARCHAR), 4, '0') AS logs FROM task""")
def scalar_functions(spark, task):
    text = F.col("task_id").cast("string")
    url = F.concat(F.lit("http://host/data/"), "task_func_name", F.lit(".zip/run/"), text, F.lit(".txt"))
    time = F.concat_ws(":", (F.col("task_id") % 30).cast("string"), (F.col("task_id") % 60).cast("string"), F.lit("00"))
    path = scalars.url_path(url)
    return task.select("task_id", scalars.url_scheme(url).alias("scheme"), path.alias("path"), scalars.file_name(url).alias("name"), scalars.zip_archive(path).alias("archive"), scalars.zip_member(path).alias("member"), scalars.walltime_minutes(time).cast("long").alias("minutes"),
                       scalars.dns_label(F.concat("task_func_name", F.lit("--"), "run_id", F.lit("."))).alias("label"), scalars.log_directory(F.col("task_id")).alias("logs"))


@_query(("task",), """SELECT task_id, strftime(task_time_invoked, '%Y-%m-%d %H:%M:%S') AS "text", epoch(task_time_invoked)::BIGINT AS seconds, TRUE AS no_date, run_id || '-' || task_id AS plot_name, run_id || '.' || task_id AS log_name FROM task""")
def date_texts(spark, task):
    text = scalars.date_text(F.col("task_time_invoked"))
    names = [scalars.try_name(F.col("run_id"), F.col("task_id"), b).alias(n) for b, n in (("-", "plot_name"), (".", "log_name"))]
    return task.select("task_id", text.alias("text"), scalars.text_seconds(text).alias("seconds"), scalars.text_seconds(F.concat(F.lit("x"), text)).isNull().alias("no_date"), *names)


@_query(("task",), """SELECT task_id, md5(task_func_name || chr(31) || '1' || chr(31) || '{"v":[{"key":"a","value":"' || run_id || '"},{"key":"b","value":"' || task_fail_count || '"}]}' || chr(31) || '{"v":[' || task_fail_count || ',7]}') AS hash FROM task""")
def call_keys(spark, task):
    """Keys of calls whose map arguments have their entries in either order, and which differ in an ignored argument."""
    a, b, count = F.lit("a"), F.lit("b"), F.col("task_fail_count").cast("string")
    options = F.when(F.col("task_id") % 2 == 0, F.create_map(a, F.col("run_id"), b, count)).otherwise(F.create_map(b, count, a, F.col("run_id")))
    calls = task.select("task_id", "task_func_name", F.lit("1").alias("version"), options.alias("options"), F.array("task_fail_count", F.lit(7)).alias("sizes"), F.col("task_id").alias("stdout"))
    return scalars.memo_keys(calls, "task_func_name", "version", ["sizes", "stdout", "options"], ignore=("stdout",)).select("task_id", "hash")


# Runs that are asked for, keys of one side only, states by time, retries.


@_query(("task", "workflow", "resource"), """WITH a AS (SELECT DISTINCT run_id FROM task UNION ALL SELECT DISTINCT 'lost-' || run_id FROM task), n AS (SELECT DISTINCT run_id FROM resource)
        SELECT run_id, CASE WHEN run_id NOT IN (SELECT run_id FROM workflow) THEN 'unknown' WHEN run_id NOT IN (SELECT run_id FROM n) THEN 'no resources' ELSE 'resources' END AS page FROM a""")
def run_pages(spark, task, workflow, resource):
    """Runs of the tasks and as many that do not exist; only some runs have samples."""
    runs = task.select("run_id").distinct()
    asked = runs.unionByName(runs.select(F.concat(F.lit("lost-"), "run_id").alias("run_id")))
    return monitoring.run_pages(asked, workflow, resource)


@_query(("workflow",), "SELECT run_id, workflow_name FROM workflow ORDER BY run_id LIMIT 1")
def first_workflow(spark, workflow):
    return workflow.select("run_id", "workflow_name").orderBy("run_id").limit(1)


@_query(("task", "try"), """SELECT run_id, task_id, 'left' AS side FROM task t WHERE NOT EXISTS (SELECT 1 FROM "try" y WHERE y.run_id = t.run_id AND y.task_id = t.task_id AND y.try_id > 2)
        UNION ALL SELECT DISTINCT run_id, task_id, 'right' FROM "try" y WHERE try_id > 2 AND NOT EXISTS (SELECT 1 FROM task t WHERE y.run_id = t.run_id AND y.task_id = t.task_id)""")
def tasks_without_third_try(spark, task, tries):
    return monitoring.key_difference(task, tries.where("try_id > 2"), ["run_id", "task_id"])


@_query(("task", "try"), """SELECT run_id, task_id, try_id, 'launched' AS task_status_name, task_try_time_launched AS "timestamp" FROM "try" WHERE task_try_time_launched IS NOT NULL
        UNION ALL SELECT run_id, task_id, try_id, 'running', task_try_time_running FROM "try" WHERE task_try_time_running IS NOT NULL
        UNION ALL SELECT run_id, task_id, -1, 'pending', task_time_invoked FROM task WHERE task_time_invoked IS NOT NULL UNION ALL SELECT run_id, task_id, -1, final_state, task_time_returned FROM task WHERE task_time_returned IS NOT NULL""")
def state_log(spark, task, tries):
    return monitoring.state_log(task, tries).withColumn("try_id", F.coalesce("try_id", F.lit(-1).cast("long")))


@_query(("try",), """WITH c AS (SELECT run_id, task_id, try_id, CASE WHEN hash % 5 > 1 THEN (1 + hash % 3) / 2.0 END::DOUBLE AS cost FROM (SELECT *, task_id * 7 + try_id * 3 AS hash FROM "try")),
        walk(run_id, task_id, try_id, spent, cost) AS (SELECT run_id, task_id, try_id, coalesce(cost, 0), cost FROM c WHERE try_id = 0 UNION ALL SELECT c.run_id, c.task_id, c.try_id, w.spent + coalesce(c.cost, 0), c.cost FROM walk w JOIN c ON c.run_id = w.run_id AND c.task_id = w.task_id AND c.try_id = w.try_id + 1 WHERE w.cost IS NOT NULL AND w.spent <= 2)
        SELECT run_id, task_id, count(*) AS tries, max(spent) AS fail_cost, CASE WHEN bool_or(cost IS NULL) THEN 'exec_done' ELSE 'failed' END AS final_state FROM walk GROUP BY ALL""")
def retry_outcome(spark, tries):
    n = F.col("task_id") * 7 + F.col("try_id") * 3
    return decisions.retry_outcome(tries.select("run_id", "task_id", "try_id", F.when(n % 5 > 1, (1 + n % 3) / 2).alias("cost")), 2)


# Functions and commands by row.


@_query(("task",), """SELECT run_id, task_id, unnest(range(least(len(string_split(task_depends, ',')), task_fail_count + 1)))::INT AS place, unnest(string_split(task_depends, ',')[:task_fail_count + 1]) AS depend, unnest(range(least(len(string_split(task_depends, ',')), task_fail_count + 1)))::INT * 10 AS n FROM task WHERE task_depends IS NOT NULL""")
def zipped_arguments(spark, task):
    """Two arrays of each task, position by position up to the shorter one's end."""
    two = task.select("run_id", "task_id", F.split("task_depends", ",").alias("depend"), F.transform(F.sequence(F.lit(0), F.col("task_fail_count")), lambda i: i * 10).alias("n"))
    return rows.zipped(two, ["depend", "n"])


@_query(("task", "node"), """SELECT position, run_id, task_id, id, hostname FROM (SELECT run_id, task_id, row_number() OVER (ORDER BY task_id) - 1 AS position FROM task)
        JOIN (SELECT id, hostname, row_number() OVER (ORDER BY id DESC) - 1 AS position FROM node) USING (position)""")
def zipped_tables(spark, task, node):
    """Tasks in their order beside nodes in theirs, row by row up to the end of the shorter table."""
    tables = (task.select("run_id", "task_id").orderBy("task_id"), node.select("id", "hostname").orderBy(F.desc("id")))
    return rows.zipped_tables(spark, *tables)


@_query(("node",), """SELECT id, CASE WHEN cpu_count % 5 > 0 THEN 60.0::DOUBLE / (cpu_count % 5) END AS share, CASE WHEN cpu_count % 5 = 0 THEN 'ZeroDivisionError' END AS error FROM node""")
def mapped_rows(spark, node):
    """A function of each row, which fails for some."""
    out = rows.map_rows(node.select("id", (F.col("cpu_count") % 5).alias("v")), "v", lambda v: 60.0 / int(v), "share double", walltime=60)
    return out.select("id", "share", F.substring_index("error", ":", 1).alias("error"))


@_query(("task", "node"), """SELECT position, CASE WHEN cpu_count % 7 > 0 THEN task_id * 100 // (cpu_count % 7) ELSE -1 END AS share, cpu_count % 7 = 0 AS failed FROM (SELECT task_id, row_number() OVER (ORDER BY task_id DESC) - 1 AS position FROM task)
        JOIN (SELECT cpu_count, row_number() OVER (ORDER BY id) - 1 AS position FROM node) USING (position)""")
def mapped_tables(spark, task, node):
    """A function of each task and the node at its place, which fails for some; results by the order of the inputs."""
    tables = (task.select("task_id", "run_id").orderBy(F.desc("task_id")).select("task_id"), node.select("id", "cpu_count").orderBy("id").select((F.col("cpu_count") % 7).alias("n")))
    return rows.map_tables(spark, lambda a, b: int(a) * 100 // int(b), "share long", *tables).select("position", F.coalesce("share", F.lit(-1)).alias("share"), F.col("error").isNotNull().alias("failed"))


def commands_with_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each customer's nation that reads a file; where there is none it does not run."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("/no/such/file-"), "n_nationkey")).otherwise("/bin/bash")
    given = nation.select("n_nationkey", path.alias("path")).select("n_nationkey", F.array("path").alias("needs"), F.concat(F.lit("test -e "), "path", F.lit(" && echo read")).alias("command"))
    return rows.run_commands(given, "command", inputs="needs").select("n_nationkey", F.coalesce("exit_code", F.lit(-1)).alias("exit_code"), "stdout", F.col("stderr").alias("told"))


QUERIES["commands_with_inputs"] = commands_with_inputs
ORACLES["commands_with_inputs"] = """SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN 0 ELSE -1 END AS exit_code, CASE WHEN n_nationkey % 4 > 0 THEN 'read' || chr(10) END AS stdout, CASE WHEN n_nationkey % 4 > 0 THEN '' ELSE 'no input /no/such/file-' || n_nationkey END AS told FROM nation"""


def command_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each nation, with exit codes and outputs that are not there."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    made = F.array(F.lit("/bin/bash"), F.concat(F.lit("/no/such/file-"), "n_nationkey"))
    given = nation.select("n_nationkey", F.concat(F.lit("echo key "), "n_nationkey", F.lit("; exit "), F.col("n_nationkey") % 3).alias("command"), made.alias("made"))
    return rows.run_commands(given, "command", outputs="made").select("n_nationkey", "exit_code", "stdout", F.concat_ws(",", "missing").alias("missing"))


QUERIES["command_rows"] = command_rows
ORACLES["command_rows"] = "SELECT n_nationkey, CAST(n_nationkey % 3 AS INT) AS exit_code, 'key ' || n_nationkey || chr(10) AS stdout, '/no/such/file-' || n_nationkey AS missing FROM nation"


# Tables, archives, logs and messages as they are stored.


@_query(("workflow",), "SELECT run_id, workflow_name, host, TRUE AS uncounted, 2::BIGINT AS n FROM workflow")
def created_tables(spark, workflow):
    """Tables made where there were none, and runs inserted twice: the key check reports each."""
    folder = shared.fresh(spark, "tables")
    for _ in range(2):
        schemas.create(spark, folder)
        schemas.insert(workflow, folder, "workflow")
    kept = schemas.table(spark, folder, "workflow")
    return kept.select("run_id", "workflow_name", "host", F.col("tasks_failed_count").isNull().alias("uncounted")).distinct().join(schemas.duplicate_keys(kept, "workflow"), "run_id")


@_query(("workflow",), "SELECT run_id, workflow_name, CASE WHEN host = 'host-1' THEN host || '.site' END AS site FROM workflow")
def reflected_tables(spark, workflow):
    """Runs stored by two writers, one of which adds a column; the table is read with what its files have."""
    folder = shared.fresh(spark, "tables")
    schemas.create(spark, folder)
    schemas.insert(workflow.where("host <> 'host-1'"), folder, "workflow")
    schemas.insert(workflow.where("host = 'host-1'").withColumn("site", F.concat("host", F.lit(".site"))), folder, "workflow", ("site",))
    return schemas.table(spark, folder, "workflow", reflected=True).select("run_id", "workflow_name", "site")


@_query(("status",), "SELECT task_id, run_id, task_status_name, \"timestamp\", sum(CASE WHEN try_id = 1 THEN 3 ELSE 1 END)::BIGINT AS n FROM status GROUP BY ALL HAVING sum(CASE WHEN try_id = 1 THEN 3 ELSE 1 END) > 1")
def repeated_statuses(spark, status):
    """Statuses of which those of second tries were told three times."""
    again = status.where("try_id = 1")
    return schemas.duplicate_keys(schemas.conform(status.unionByName(again).unionByName(again), "status"), "status")


@_query(("block",), "SELECT run_id, block_id, lower(status) AS status FROM block WHERE status = 'MISSING'")
def unknown_block_states(spark, block):
    """Blocks of a source that writes one state in small letters, which the domain does not have."""
    told = block.withColumn("status", F.when(F.col("status") == "MISSING", "missing").otherwise(F.col("status")))
    return schemas.unknown_states(told, "block").select("run_id", "block_id", "status")


@_query(("task",), "SELECT task_func_name AS archive, 'run/' || task_id || '.txt' AS member, md5(task_hashsum || task_id) AS content FROM task")
def zipped_members(spark, task):
    """A file for each task, in one archive for each function, packed into zip files and taken out of them."""
    files = task.select(F.col("task_func_name").alias("archive"), F.concat(F.lit("run/"), "task_id", F.lit(".txt")).alias("member"), F.concat("task_hashsum", "task_id").cast("binary").alias("content"))
    return archives.members_of(archives.to_zips(files), r"^run/\d+\.txt$").withColumn("content", F.md5("content"))


@_query(("task",), "SELECT 'run-' || (task_id % 5) || '/' || run_id || '-' || task_id AS member, octet_length(encode(task_hashsum || task_id))::BIGINT AS size, md5(task_hashsum || task_id) AS content FROM task WHERE task_id % 5 = 3")
def zip_source_members(spark, task):
    """A file for each task written as zip files by the data source, and those of one folder read back: the filter reaches the reader."""
    zip_source.register(spark)
    folder = shared.fresh(spark, "zips")
    member = F.concat(F.lit("run-"), F.col("task_id") % 5, F.lit("/"), "run_id", F.lit("-"), "task_id")
    task.select(member.alias("member"), F.concat("task_hashsum", "task_id").cast("binary").alias("content")).write.format("zip").mode("append").save(folder)
    return spark.read.format("zip").load(folder).where(F.col("member").startswith("run-3/")).select("member", "size", F.md5("content").alias("content"))


@_query(("task",), """SELECT 'counted' AS name, 'exec_done' AS state, count(*) FILTER (task_id % 3 < 2) AS "rows", 2::BIGINT AS batches, false AS told FROM task UNION ALL SELECT 'broken', 'failed', 0, 0, true""")
def stream_states(spark, task):
    """Two streams of messages told of by a listener: one reads two of three thirds in a batch each, the other one fails at its first."""
    base = shared.fresh(spark, "states")
    messages = _task_message(task.where("task_id % 3 < 2"), F.col("task_id"))
    stream, appear = _in_files(messages, base, F.col("seq") % 3, 2)
    log = progress.StreamLog(spark, f"{base}/states").start()
    for _ in appear:
        stream.writeStream.format("noop").option("checkpointLocation", f"{base}/a").trigger(availableNow=True).queryName("counted").start().awaitTermination()
    bad = stream.select(F.raise_error(F.lit("odd"))).writeStream.format("noop").option("checkpointLocation", f"{base}/b").trigger(availableNow=True).queryName("broken").start()
    try:
        bad.awaitTermination()
    except StreamingQueryException:
        pass
    log.stop()
    rows = progress.states(spark, f"{base}/states").where(F.col("name").isin("counted", "broken"))
    ended = F.max(F.when(F.col("task_status_name").isin("exec_done", "failed"), F.col("task_status_name")))
    return rows.groupBy("name").agg(ended.alias("state"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("rows") > 0).alias("batches"), F.bool_or(F.coalesce(F.col("error").contains("odd"), F.lit(False))).alias("told"))


@_query(("status",), """SELECT 'run.' || task_status_name AS name, CASE WHEN task_status_name = 'failed' THEN 'ERROR' ELSE 'INFO' END AS levelname, try_id AS lineno,
        'task ' || task_id || CASE WHEN task_status_name = 'failed' THEN chr(10) || 'Traceback (most recent call last):' || chr(10) || '  in try ' || try_id ELSE '' END AS message, count(*) AS n FROM status GROUP BY ALL""")
def text_logs(spark, status):
    """Statuses written as records of a text log, failures with a traceback of several lines, and read back field by field."""
    path = shared.fresh(spark, "log")
    failed = F.col("task_status_name") == "failed"
    head = F.format_string("1.500000 2024-01-01 00:00:00,500 MainProcess-7 Thread-1 (run)-99 run.%s:%d step %s: task %d", "task_status_name", "try_id", F.when(failed, "ERROR").otherwise("INFO"), "task_id")
    trace = F.concat(F.lit("\nTraceback (most recent call last):\n  in try "), "try_id")
    status.select(F.concat(head, F.when(failed, trace).otherwise(""))).write.text(path)
    return logs.read_text_log(spark, path).groupBy("name", "levelname", "lineno", "message").agg(F.count("*").alias("n"))


@_query(("status",), """SELECT CASE WHEN task_id % 3 > 0 THEN 'task ' || task_status_name END AS formatted, CASE WHEN task_id % 3 = 1 THEN task_status_name END AS state, task_id % 3 = 0 AS bad, count(*) AS n, coalesce(sum(task_id) FILTER (task_id % 3 > 0), 0)::BIGINT AS threads FROM status GROUP BY ALL""")
def json_logs(spark, status):
    """Statuses written as a JSON log, with a key of their own for some and lines that are no JSON, and read back."""
    path = shared.fresh(spark, "log")
    state = F.col("task_status_name")
    line = F.to_json(F.struct(F.lit("task %s").alias("msg"), F.concat(F.lit("task "), state).alias("formatted"), F.col("task_id").alias("thread"), F.when(F.col("task_id") % 3 == 1, state).alias("own.state")))
    status.select(F.when(F.col("task_id") % 3 > 0, line).otherwise(F.concat(F.lit("{at task "), "task_id"))).write.text(path)
    read = logs.read_json_log(spark, path).select("formatted", F.col("extra")["own.state"].alias("state"), "thread", F.col("_corrupt_record").isNotNull().alias("bad"))
    return read.groupBy("formatted", "state", "bad").agg(F.count("*").alias("n"), F.coalesce(F.sum("thread"), F.lit(0)).alias("threads"))


@_query(("task",), """WITH k AS (SELECT task_hashsum AS hash, max(task_id) AS result FROM task WHERE task_id % 3 = 0 AND task_id % 5 > 0 GROUP BY ALL)
        SELECT t.task_hashsum AS hash, count(*) AS calls, coalesce(k.result, -1) AS result FROM task t LEFT JOIN k ON k.hash = t.task_hashsum GROUP BY ALL""")
def reused_results(spark, task):
    """Calls by whether an earlier run has a result; those that failed there were not kept."""
    folder = shared.fresh(spark, "results")
    calls = task.select(F.col("task_hashsum").alias("hash"), F.col("task_id").alias("result"), F.col("task_id").alias("seq"), F.when(F.col("task_id") % 5 == 0, "failed").alias("error"))
    results.append(calls.where("seq % 3 = 0"), folder, 0)
    counted = calls.groupBy("hash").agg(F.count("*").alias("calls"))
    have, need = results.split(counted, results.read(spark, folder))
    return have.unionByName(need.withColumn("result", F.lit(-1).cast("long")))


@_query(("task",), """SELECT task_id AS seq FROM task WHERE task_id % 4 = 0 UNION ALL SELECT task_id FROM task WHERE task_id % 4 = 1""")
def rejected_messages(spark, task):
    """Messages of an unknown type, and of a known one whose payload is no JSON object."""
    kind = F.when(F.col("task_id") % 4 == 0, "ODD_INFO").when(F.col("task_id") % 4 == 3, "FIRST").otherwise("TASK_INFO")
    payload = F.when(F.col("task_id") % 4 == 1, "{broken").otherwise(F.to_json(F.struct("run_id", "task_id")))
    return ingest.rejected(task.select(kind.alias("type"), "run_id", "task_id", F.col("task_id").alias("seq"), payload.alias("payload"))).select("seq")
