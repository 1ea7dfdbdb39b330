"""Audit of how filters of documents interact: what each removes, and would remove, in every order of application.

1. One pass over the texts gives each row a hash and the bits of the filters that look at the text alone (A to D).
2. Copies (E): rows whose hash a smaller doc_id has too are semi-joined on hash, exact text and smaller doc_id with the least
   doc_id of each text. Only rows of shared hashes bring their texts. The rows of a hash that very many share are salted.
3. The failures are united by row, and rows are counted by part and combination of bits: 32 combinations for a part at most.
4. All orders are read off these counts, without the documents.

A text is told by its words [^\\x20\\x09-\\x0D]+, case-sensitive; null is the empty text. Rows with a null doc_id are counted as
documents, are no copies and have none. Repeated rows are documents of their own, but no copies of each other, as neither id is
smaller. A part is a value of `source`, null being the empty one. A document is good (toxic) if any row of labels says so.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The filters, by their letters; filter i has bit 1 << i.
FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
#: Shared hashes up to which their list is broadcast (16 MB); longer lists are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Rows of one hash (and a thousandth of all) from which they are salted, and salts.
COPIES, SALTS = 2_000, 64

_SPACE = " \t\n\x0b\f\r"


def text_bits(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    inner = F.btrim(text, F.lit(_SPACE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        text.rlike(f"[{SYMBOLS}]"),
    )
    bits = F.lit(0)
    for i, failed in enumerate(fails):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    return bits.cast("int")


def copies(spark: SparkSession, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (doc_id, part, h) of docs (doc_id, part, text, h) whose text some smaller doc_id has; keys: doc_id and h of all rows."""
    shared = keys.where("doc_id IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    shared, _ = common.materialize(spark, shared, "shared")
    total, hashes = keys.count(), shared.count()
    # at most a thousand values
    hot = [r["h"] for r in shared.where(F.col("n") >= max(COPIES, total // 1000)).select("h").collect()]
    salts = lambda n: F.when(F.col("h").isin(hot), n).otherwise(F.lit(0)) if hot else F.lit(0)
    every = F.explode(F.when(F.col("h").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    rows = docs.where("doc_id IS NOT NULL").withColumn("salt", salts(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    few = shared.select("h", "low")
    met = rows.join(F.broadcast(few), "h") if hashes <= BROADCAST_HASHES else rows.join(few.withColumn("salt", every), ["h", "salt"])
    # what a text of a shared hash is compared with: the least doc_id that has it
    first = met.groupBy("h", "text").agg(F.min("doc_id").alias("first")).withColumn("salt", every)
    later = met.where(F.col("doc_id") > F.col("low")).alias("l")
    same = [F.col(f"l.{c}") == F.col(f"f.{c}") for c in ("h", "salt", "text")]
    return later.join(first.alias("f"), [*same, F.col("f.first") < F.col("l.doc_id")], "left_semi").select("doc_id", "part", "h")


def combinations(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, bits, n, good, toxic): documents of docs (doc_id, text, source) by part and by the filters that they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))
    keys, _ = common.materialize(spark, docs.select("doc_id", "part", "h", text_bits(F.col("text")).alias("bits")), "failures")
    copied = copies(spark, docs, keys.select("doc_id", "h"))
    failures = keys.withColumn("n", F.lit(1)).unionByName(copied.select("*", F.lit(1 << FILTERS.index("E")).alias("bits"), F.lit(0).alias("n")))
    rows = failures.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    ids = rows.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = ids.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "bits", "n", "good", "toxic")
    every = known.unionByName(ids.where("doc_id IS NULL").select("part", "bits", "n"), allowMissingColumns=True)
    return every.groupBy("part", "bits").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of combinations(), zeros included.

    For each part and each order of all filters, what the step's filter does after those before it. shapley sums what the filter
    removes over all orders: a document that fails k filters is removed first by each of them in 1 / k of the orders.
    """
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    total = len(list(permutations(filters)))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # 2 ** len(filters) at most
    steps = parts.select("part", "c", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    of = "shiftleft(1, instr('" + filters + "', substring(filter_order, {}, 1)) - 1)"
    earlier = f"aggregate(sequence(1, step), 0, (a, i) -> IF(i < step, a | {of.format('i')}, a))"
    steps = steps.withColumns({"bit": F.expr(of.format("step")), "before": F.expr(earlier)})

    def count(where: str, what: str = "x.n") -> Column:
        return F.expr(f"aggregate(c, 0L, (a, x) -> a + IF({where}, {what}, 0L))")

    fails, alive = "x.bits & bit <> 0", "x.bits & before = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        count(f"{alive} AND x.bits & bit = 0").alias("kept"),
        count(f"{alive} AND {fails}").alias("removed"),
        count(f"x.bits & before <> 0 AND {fails}").alias("redundant"),
        count("x.bits = bit").alias("unique_fails"),
        count(f"{alive} AND {fails}", "x.good").alias("good_lost"),
        count(f"{alive} AND {fails}", "x.toxic").alias("toxic_lost"),
        count(fails, f"x.n * {total} DIV bit_count(x.bits)").alias("shapley"),
    )


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(combinations(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


#: Another route: each order's first failure by the order's string, copies by a window over whole texts, Shapley sums added up.
ORACLE = r"""
WITH docs AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS copy
  FROM documents
), failing AS (
  SELECT part, doc_id, concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
         CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END,
         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN copy THEN 'E' ELSE '' END) AS f
  FROM docs
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1
), combos AS (
  SELECT part, f, count(*) AS n, count(good.doc_id) AS g, count(toxic.doc_id) AS x
  FROM failing LEFT JOIN good ON failing.doc_id = good.doc_id LEFT JOIN toxic ON failing.doc_id = toxic.doc_id GROUP BY part, f
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT o, s, substr(o, s, 1) AS l, substr(o, 1, s - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), told AS (
  SELECT part, o, s, l, n, g, x, contains(f, l) AS fails, f = l AS alone, len(list_intersect(string_split(f, ''), string_split(earlier, ''))) > 0 AND f <> '' AND earlier <> '' AS gone FROM combos, steps
), report AS (
  SELECT part, o AS filter_order, s AS step, l,
         CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(g) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM told GROUP BY part, o, s, l
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM report
"""
