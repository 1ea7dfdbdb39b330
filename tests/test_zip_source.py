"""The zip format: one archive by many tasks, pushed filters, whole writes."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from runweave.sources import zip_source


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(folder / "big.zip", "w") as z:
        z.writestr("folder/", "")
        for i in range(10_000):
            z.writestr(f"d{i % 10}/m{i}", f"{i}:".encode() + os.urandom(200))
    with zipfile.ZipFile(folder / "small.zip", "w") as z:
        z.writestr("d3/s", b"")
    (folder / "other.txt").write_text("no zip")
    return f"file://{folder}"


def test_one_archive_is_read_by_many_tasks(spark, big):
    zip_source.register(spark)
    t = spark.read.format("zip").option("splitBytes", 100_000).load(big)
    assert t.rdd.getNumPartitions() >= 20
    row = t.agg(F.count("*"), F.countDistinct("member"), F.sum("size"), F.sum(F.length("content"))).first()
    assert row[0] == row[1] == 10_001 and row[2] == row[3]
    tasks = [r["n"] for r in t.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(tasks) < 1_000
    assert spark.read.format("zip").load(big + "/small.zip").first()[:] == ("small.zip", "d3/s", 0, bytearray())


def test_filters_reach_the_reader(spark, big, monkeypatch):
    zip_source.register(spark)
    t = spark.read.format("zip").option("splitBytes", 100_000).load(big)
    plan = t.where("member LIKE 'd3/%' AND size > 3")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("BatchScan")[0] and "size" in plan.split("BatchScan")[0]
    assert t.where(F.col("member").startswith("d3/")).count() == 1_001
    assert sorted(r["member"] for r in t.where(F.col("member").isin("d3/m3", "d4/m4", "none")).collect()) == ["d3/m3", "d4/m4"]
    assert t.where((F.col("member") == "d3/m3") & (F.col("member") == "d4/m4")).count() == 0
    read = []
    plain = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda z, info, *a: read.append(info.filename) or plain(z, info, *a))
    reader = zip_source.ZipReader({"path": big, "splitBytes": "100000"})
    list(reader.pushFilters([zip_source.EqualTo(("member",), "d3/m13")]))
    parts = reader.partitions()
    assert [r[1] for p in parts for r in reader.read(p)] == read == ["d3/m13"] and len(parts) == 2


def test_writes_are_whole(spark, tmp_path):
    zip_source.register(spark)
    folder = tmp_path / "out"
    rows = spark.range(100).repartition(4).select(F.concat(F.lit("m"), "id").alias("member"), F.when(F.col("id") > 0, F.col("id").cast("string").cast("binary")).alias("content"), F.lit(1).alias("more"))
    for _ in range(2):
        rows.write.format("zip").mode("append").save(f"file://{folder}")
    assert len(list(folder.iterdir())) == 8
    back = spark.read.format("zip").load(f"file://{folder}").groupBy("member", F.col("content").cast("string").alias("c")).count().collect()
    assert sorted((r["member"], r["c"], r["count"]) for r in back) == sorted((f"m{i}", str(i) if i else "", 2) for i in range(100))
    bad = rows.withColumn("member", F.when(F.col("more") == 1, F.raise_error(F.lit("odd"))).otherwise(F.col("member")))
    with pytest.raises(Exception, match="odd"):
        bad.write.format("zip").mode("append").save(f"file://{folder}")
    assert len(list(folder.iterdir())) == 8
    with pytest.raises(Exception, match="mode"):
        rows.write.format("zip").mode("overwrite").save(f"file://{folder}")
    with pytest.raises(Exception, match="content"):
        rows.drop("content").write.format("zip").mode("append").save(f"file://{folder}")
    rows.limit(0).write.format("zip").mode("append").save(f"file://{tmp_path}/none")
    os.makedirs(tmp_path / "empty", exist_ok=True)
    assert spark.read.format("zip").load(f"file://{tmp_path}/empty").count() == 0


def test_a_task_writes_archives_of_a_bounded_directory(spark, tmp_path):
    zip_source.register(spark)
    rows = spark.range(0, 45_000, 1, 1).select(F.concat(F.lit("m"), "id").alias("member"), F.repeat(F.col("id").cast("string"), 3).cast("binary").alias("content"))
    rows.write.format("zip").mode("append").save(f"file://{tmp_path}/many")
    sizes = [len(zipfile.ZipFile(f).namelist()) for f in (tmp_path / "many").iterdir()]
    assert sorted(sizes) == [5_000, 20_000, 20_000]
    back = spark.read.format("zip").load(f"file://{tmp_path}/many").select("member", "content")
    assert back.exceptAll(rows).count() == 0 and back.count() == 45_000
    noise = [(f"m{i}", os.urandom(50_000)) for i in range(10)]
    spark.createDataFrame(noise, "member string, content binary").coalesce(1).write.format("zip").mode("append").option("splitBytes", 100_000).save(f"file://{tmp_path}/large")
    assert len(list((tmp_path / "large").iterdir())) == 5
    assert sorted((r["member"], bytes(r["content"])) for r in spark.read.format("zip").load(f"file://{tmp_path}/large").collect()) == noise
