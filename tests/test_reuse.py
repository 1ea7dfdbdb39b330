"""Results by plan, positions over partitions, limits on jobs, run folders of several drivers."""

import threading
import time

from pyspark.sql import functions as F

from runweave import session
from runweave.operators import rows
from runweave.sources import results, schemas


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_plan_keys(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(path)
    t = lambda: spark.read.parquet(path)
    key = results.plan_key
    assert key(t().where("k > 1").groupBy("k").count()) == key(t().where("k > 1").groupBy("k").count()) == key(t().where("1 < k").groupBy("k").count())
    different = [t().where("k > 1"), t().where("k > 2"), t().where("k > 1").select("id"), t().where("k > 1").select(F.col("id").alias("x")), t().select(F.lit(1)), t().select(F.lit("1")), t().select(F.lit(1).cast("long")), spark.range(10), spark.range(11)]
    assert len({key(d) for d in different}) == len(different) and None not in map(key, different)
    for odd in (t().select(F.rand()), t().select(F.udf(lambda x: x)("id")), t().mapInArrow(lambda b: b, "id long, k long"), spark.createDataFrame([(1,)], "a int"), t().cache()):
        assert key(odd) is None
    spark.catalog.clearCache()
    csv = f"file://{tmp_path}/c"
    spark.createDataFrame([("1;2,3",)], "a string").write.text(csv)
    read = lambda sep: spark.read.schema("a string, b string").option("sep", sep).csv(csv)
    assert key(read(",")) == key(read(",")) != key(read(";"))


def test_a_stored_result_runs_no_job(spark, tmp_path):
    path, folder = f"file://{tmp_path}/t", f"file://{tmp_path}/results"
    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(path)
    plan = lambda: spark.read.schema("id long, k long").parquet(path).groupBy("k").agg(F.sum("id").alias("s"))
    want = sorted(map(tuple, plan().collect()))
    assert not results.has_plan(plan(), folder)
    assert sorted(map(tuple, results.by_plan(plan(), folder).collect())) == want and results.has_plan(plan(), folder)
    before = jobs(spark)
    again = results.by_plan(plan(), folder)
    assert jobs(spark) == before and sorted(map(tuple, again.collect())) == want
    time.sleep(1.1)
    spark.range(5).selectExpr("id", "id % 3 AS k").write.mode("append").parquet(path)
    assert not results.has_plan(plan(), folder)
    assert sorted(map(tuple, results.by_plan(plan(), folder).collect())) == sorted(map(tuple, plan().collect())) != want
    chance = spark.range(3).select(F.rand().alias("r"))
    assert results.by_plan(chance, folder) is chance


def test_positions(spark):
    table = spark.range(1000).repartition(7).select("id", F.lit("x").alias("part"), F.lit(5).alias("number"))
    got = [tuple(r) for r in rows.positions(spark, table.orderBy(F.desc("id"))).orderBy("position").collect()]
    assert got == [(999 - i, "x", 5, i) for i in range(1000)]
    assert rows.positions(spark, table.limit(0)).count() == 0


def test_zipped_tables(spark):
    a, b, c = spark.range(100).orderBy("id"), spark.range(0, 60, 2).select((-F.col("id")).alias("n")).orderBy("n"), spark.range(50).select(F.col("id").alias("m")).orderBy("m")
    got = sorted(tuple(r) for r in rows.zipped_tables(spark, a, b, c).collect())
    assert got == [(i, i, -(58 - 2 * i), i) for i in range(30)]


def test_a_job_that_takes_too_long(spark):
    """The late job gives an error; one beside it ends as ever, and so does the next of the same thread."""
    slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
    other = {}
    beside = threading.Thread(target=lambda: other.update(n=spark.range(0, 12, 1, 1).select(slow("id").alias("x")).agg(F.sum("x")).first()[0]))
    beside.start()
    began = time.time()
    assert session.limited(spark, lambda: spark.range(0, 400, 1, 4).select(slow("id").alias("x")).agg(F.sum("x")).first(), 3) == (None, "no end after 3 s")
    assert time.time() - began < 30
    assert session.limited(spark, lambda: spark.range(5).count(), 60) == (5, None)
    value, error = session.limited(spark, lambda: spark.range(1).select(F.raise_error(F.lit("odd"))).collect(), 60)
    assert value is None and "odd" in error
    beside.join(60)
    assert other == {"n": 66}


def test_run_folders_of_two_drivers(spark, tmp_path):
    folder, made = f"file://{tmp_path}/runs", []
    threads = [threading.Thread(target=lambda: made.extend(session.next_run(spark, folder) for _ in range(5))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [f"{folder}/{i:03d}" for i in range(20)]


def test_map_tables_in_input_order(spark):
    a, b = spark.range(40).repartition(5).orderBy(F.desc("id")), spark.range(30).orderBy("id").select(F.col("id").alias("n"))
    got = [tuple(r) for r in rows.map_tables(spark, lambda x, y: x // (y % 5), "v long", a, b).orderBy("position").collect()]
    assert [g[0] for g in got] == list(range(30))
    assert all(g[1:] == ((39 - i) // (i % 5), None) if i % 5 else g[1] is None and g[2].startswith("ZeroDivisionError") for i, g in enumerate(got))


def test_commands_without_inputs_do_not_run(spark, tmp_path):
    (tmp_path / "in").write_text("x")
    given = [(1, f"cat {tmp_path}/in", [f"{tmp_path}/in"]), (2, f"touch {tmp_path}/ran", [f"{tmp_path}/in", f"{tmp_path}/none"]), (3, "echo y", None), (4, "echo z", [])]
    got = {r["k"]: r for r in rows.run_commands(spark.createDataFrame(given, "k int, c string, i array<string>"), "c", inputs="i").collect()}
    assert [(got[k]["exit_code"], got[k]["stdout"]) for k in (1, 2, 3, 4)] == [(0, "x"), (None, None), (0, "y\n"), (0, "z\n")]
    assert got[2]["stderr"] == f"no input {tmp_path}/none" and not (tmp_path / "ran").exists()


def test_reflected_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    one = spark.createDataFrame([("a", 1, 5)], "run_id string, task_id long, more long")
    schemas.insert(one, folder, "task")
    schemas.insert(one.withColumn("run_id", F.lit("b")), folder, "task", ("more", "task_id"))
    t = schemas.table(spark, folder, "task", reflected=True)
    assert t.columns == [*schemas.TABLES["task"].names, "more"] and "more" not in schemas.table(spark, folder, "task").columns
    assert sorted(tuple(r) for r in t.select("run_id", "task_id", "more").collect()) == [("a", 1, None), ("b", 1, 5)]
