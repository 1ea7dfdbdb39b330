"""Connected components of links between documents, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Links of a node from which joins on it are salted, and salts.
HUB, SALTS = 1_000_000, 64


def _beside(links: DataFrame, least: DataFrame, hubs: list) -> DataFrame:
    """links (a, b) with the m of a in least (a, m); the rows of hubs are spread over SALTS keys."""
    if not hubs:
        return links.join(least, "a")
    hub = F.coalesce(*[F.when(F.col("a") == F.lit(h), True) for h in hubs], F.lit(False))
    spread = links.withColumn("salt", F.when(hub, F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0))
    return spread.join(least.withColumn("salt", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))), ["a", "salt"]).drop("salt")


def _literal(row):
    return F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()]) if hasattr(row, "asDict") else row


def components(spark: SparkSession, links: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows (a, b): each linked value but the least of its component, and that least value; and the folder that holds them.

    links: two columns of one type that has an order (numbers, or structs of numbers). Alternates large-star and small-star
    steps, which keep the components and shrink their depth by a power at each round; a round is four shuffles, written to
    the shared folder. Nodes of HUB links or more are few (a millionth of the links), and their joins are salted.
    """
    a, b = links.columns
    low, high = F.least(a, b), F.greatest(a, b)
    edges, path = common.materialize(spark, links.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct(), name)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == seen:
            return edges, path
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = []
        if state[0] >= HUB:
            hubs = [_literal(r["a"]) for r in both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= HUB).collect()]
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = _beside(both, least, hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _beside(large, least, hubs).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = path
        edges, path = common.materialize(spark, small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        common.remove(spark, old)
