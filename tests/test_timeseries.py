"""Series summed by blocks: against a plain walk, with one key that has most rows, at one-second buckets and over long gaps."""

import random

import pytest
from pyspark.sql import functions as F

from runweave.operators import timeseries

DELTAS = "k string, bucket long, delta long, points long, mark int"


def brute(rows):
    """{(k, at): value} of dense series."""
    out = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        low = max((b for _, b, _, _, m in own if m == 1), default=None)
        end = max((b for _, b, _, _, m in own if m == 2), default=None)
        if low is None or end is None:
            continue
        for b in range(low, end):
            out[k, b - low] = sum(d for _, c, d, _, _ in own if c <= b) + sum(p for _, c, _, p, _ in own if c == b)
    return out


def given(n=300):
    r = random.Random(4)
    rows = [(r.choice(["big", "big", "big", "x", None]), r.randrange(-20, 400), r.randrange(-3, 4), r.randrange(0, 3), None) for _ in range(n)]
    for k in ("big", "x", None, "empty"):
        rows += [(k, 0, 0, 0, 1), (k, 350, 0, 0, 2)]
    return [*rows, ("no bounds", 3, 1, 0, None), ("backwards", 9, 0, 0, 1), ("backwards", 2, 0, 0, 2)]


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_blocks(spark, blocks):
    rows = given()
    steps = timeseries.changes(spark.createDataFrame(rows, DELTAS), ["k"], blocks)
    got = {(r["k"], r["at"]): r["value"] for r in timeseries.fill(steps, ["k"]).collect()}
    want = brute(rows)
    assert got == want
    covered = sorted((str(r["k"]), r["at"], r["length"]) for r in steps.collect())
    for (k, a, n), (j, b, _) in zip(covered, covered[1:], strict=False):
        assert k != j or a + n == b
    assert timeseries.changes(spark.createDataFrame([], DELTAS), ["k"], blocks).count() == 0


def test_no_window_over_a_whole_series(spark, monkeypatch):
    """One run has 30,000 of 30,300 changes; no block has much more than its share of them."""
    deltas = spark.range(30_000).select(F.lit("big").alias("k"), F.col("id").alias("bucket"), F.lit(1).cast("long").alias("delta"), F.lit(0).cast("long").alias("points"), F.lit(None).cast("int").alias("mark"))
    small = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 100).alias("k"), F.col("id").alias("bucket"), F.lit(1).cast("long").alias("delta"), F.lit(0).cast("long").alias("points"), F.lit(None).cast("int").alias("mark"))
    ends = spark.createDataFrame([("big", 0, 0, 0, 1), ("big", 30_000, 0, 0, 2)], DELTAS)
    cuts = []
    write = timeseries.materialize
    monkeypatch.setattr(timeseries, "materialize", lambda *a: cuts.append(write(*a)) or cuts[-1])
    steps = timeseries.changes(deltas.unionByName(small).unionByName(ends), ["k"], 10)
    row = steps.where("k = 'big'").agg(F.count("*"), F.max("level"), F.sum("length")).first()
    assert tuple(row) == (30_000, 30_000, 30_000)
    sizes = [r["count"] for r in cuts[0][0].groupBy("block", "k").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 6_000


def test_long_gaps_are_filled_in_pieces(spark):
    rows = [("a", 0, 5, 1, 1), ("a", 20_000, 0, 0, 2)]
    out = timeseries.fill(timeseries.changes(spark.createDataFrame(rows, DELTAS), ["k"]), ["k"])
    assert out.agg(F.count("*"), F.countDistinct("at"), F.sum("value"), F.max("at")).first()[:] == (20_000, 20_000, 5 * 20_000 + 1, 19_999)
    assert out.rdd.getNumPartitions() >= 1


def test_concurrency_of_runs_without_starts(spark):
    tasks = spark.sql("""SELECT * FROM VALUES ('a', 'f', TIMESTAMP'2024-01-01 00:00:00', TIMESTAMP'2024-01-01 00:00:03'), ('a', 'g', NULL, NULL), ('b', 'f', NULL, TIMESTAMP'2024-01-01 00:00:03'),
        ('c', 'f', TIMESTAMP'2024-01-01 00:00:05', NULL), ('d', 'f', TIMESTAMP'2024-01-01 00:00:05', TIMESTAMP'2024-01-01 00:00:05') AS t(run_id, task_func_name, running, returned)""")
    got = sorted(tuple(r) for r in timeseries.concurrency_changes(tasks).collect())
    assert got == [("a", "All", 0, 1, 0), ("a", "All", 1, 3, 1), ("a", "f", 0, 1, 0), ("a", "f", 1, 3, 1), ("d", "All", 0, 1, 0), ("d", "f", 0, 1, 0)]
