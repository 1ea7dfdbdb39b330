"""Fixity audit of WARC records by Merkle trees.

A file holds the records of one range of ids, in order. Its leaves are the records' hashes, each node above hashes
FANOUT neighbours of an ordered range of offsets. Two replicas compare file roots first and then only the children of
nodes that differ, down to the records. Trees have a fixed shape over ids, so a lost record moves no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records of a file, and children of a node: FILE_RECORDS is a power of FANOUT.
FILE_RECORDS, FANOUT, LEVELS = 1000, 10, 3


def record(url: Column, payload: Column) -> Column:
    """Bytes (as text) of a WARC response record; nulls are empty."""
    url, payload = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, key: str, content: Column) -> DataFrame:
    """One leaf for each id: file, slot, key, length in bytes and hash of its records.

    The hash of several records is that of their number and of the sums of their hashes' four lanes: whatever their order,
    and summed up before the shuffle, so an id with a third of all records is no group of its own. It tells corruption, not
    forgery. Rows without an id are one record each, spread over files below 0 by their content's hash.
    """
    rows = records.select(F.col(key).cast("long").alias("key"), content.alias("c")).select("key", F.octet_length("c").cast("long").alias("length"), F.sha2(F.col("c").cast("binary"), 256).alias("hash"))
    loose = F.conv(F.substring("hash", 1, 12), 16, 10).cast("long")
    file = F.coalesce(F.floor(F.col("key") / FILE_RECORDS), -1 - loose % 1_000_003)
    place = F.coalesce(F.pmod("key", F.lit(FILE_RECORDS)), loose % FILE_RECORDS)
    lane = lambda at: F.conv(F.substring("hash", at, 16), 16, 10).cast("decimal(28,0)")
    lanes = {f"lane{at}": at for at in (1, 17, 33, 49)}
    one = rows.groupBy(file.alias("file"), place.alias("slot")).agg(F.max("key").alias("key"), F.sum("length").alias("length"), F.count("*").alias("records"), *(F.sum(lane(at)).alias(c) for c, at in lanes.items()))
    single = F.concat(*(F.lpad(F.conv(F.col(c).cast("string"), 10, 16), 16, "0") for c in lanes))
    return one.select("file", "slot", "key", "length", F.when(F.col("records") == 1, F.lower(single)).otherwise(F.sha2(F.concat_ws(":", "records", *lanes), 256)).alias("hash"))


def tree(leaf: DataFrame, stored: Callable[[DataFrame], DataFrame] = lambda level: level) -> list[DataFrame]:
    """Levels from the leaves to the roots: file, node, hash, and the range of offsets in the file; each is made from the stored one below."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("slot")
    end = F.sum("length").over(order)
    levels = [stored(leaf.select("file", F.col("slot").alias("node"), "hash", (end - F.col("length")).alias("start"), end.alias("end"), "key"))]
    for _ in range(LEVELS):
        up = levels[-1].groupBy("file", F.floor(F.col("node") / FANOUT).alias("node"))
        kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
        levels.append(stored(up.agg(F.sha2(F.to_json(kids), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"))))
    return levels


def audit(spark: SparkSession, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records in which two replicas' leaves differ: file, slot, key, start and end offset (in ours, else theirs), hashes, status.

    status is corrupt, or missing (only in ours) or extra (only in theirs). Two empty replicas agree.
    """
    paths: list[str] = []

    def stored(rows: DataFrame) -> DataFrame:
        written, path = common.materialize(spark, rows, "level")
        paths.append(path)
        return written

    a, b = tree(ours, stored), tree(theirs, stored)
    bad = None
    for level in range(LEVELS, -1, -1):
        x, y = a[level], b[level]
        if bad is not None:
            up = [F.col("file"), F.floor(F.col("node") / FANOUT).alias("up")]
            x, y = (t.withColumn("up", up[1]).join(bad, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.alias("x").join(y.alias("y"), ["file", "node"], "full_outer").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        if level:
            bad = stored(both.select("file", F.col("node").alias("up")))
    # the result reads the leaves of both and the last mismatches
    for path in (*paths[1 : LEVELS + 1], *paths[LEVELS + 2 : -1]):
        common.remove(spark, path)
    status = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("corrupt")
    pick = lambda c: F.coalesce(f"x.{c}", f"y.{c}").alias(c)
    return both.select("file", F.col("node").alias("slot"), pick("key"), pick("start"), pick("end"), F.col("x.hash").alias("hash"), F.col("y.hash").alias("replica_hash"), status.alias("status"))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a replica in which some records are altered and some are lost."""
    pages = common.table(spark, sf_dir, "pages")
    altered = F.when(F.col("page_id") % 101 == 7, F.concat(F.substring("html", 1, 20), F.lit("?"), F.substring("html", 22, 1 << 30))).otherwise(F.col("html"))
    lost = F.coalesce(F.col("page_id") % 211 == 5, F.lit(False))
    replica = pages.withColumn("html", altered).where(~lost)
    content = record(F.col("url"), F.col("html"))
    out = audit(spark, leaves(pages, "page_id", content), leaves(replica, "page_id", content))
    return out.select(F.col("key").alias("page_id"), "file", "start", "end", "status", "hash", "replica_hash")


_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce({0}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({0}, '') || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE = f"""
WITH r AS (SELECT page_id, page_id // {FILE_RECORDS} AS file, {_RECORD.format('html')} AS rec FROM pages),
o AS (SELECT page_id, file, sha256(rec) AS hash, CAST(sum(strlen(rec)) OVER w - strlen(rec) AS BIGINT) AS "start", CAST(sum(strlen(rec)) OVER w AS BIGINT) AS "end" FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)),
c AS (SELECT page_id, url, CASE WHEN page_id % 101 = 7 THEN substr(html, 1, 20) || '?' || substr(html, 22) ELSE html END AS h FROM pages WHERE page_id % 211 <> 5),
t AS (SELECT page_id, sha256({_RECORD.format('h')}) AS replica_hash FROM c)
SELECT o.page_id, o.file, o."start", o."end", CASE WHEN t.page_id IS NULL THEN 'missing' ELSE 'corrupt' END AS status, o.hash, t.replica_hash
FROM o LEFT JOIN t USING (page_id) WHERE t.replica_hash IS DISTINCT FROM o.hash
"""
