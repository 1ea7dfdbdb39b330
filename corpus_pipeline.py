"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. run() writes every stage's result as
Parquet in the shared folder and reads it back, so that a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import common, contamination, jaccard_join, packing, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, row by row: texts of under 50 words (null and empty ones too) go, repeated rows stay alike."""
    return quality.assess(docs, COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text, that of the smallest doc_id, of each group of near duplicates; repeated rows count once.

    Different texts of one doc_id are documents of their own: each stays unless its group has another one to keep. Of texts of one
    doc_id in one group the one with the smallest hash stays, so every run keeps the same. Rows without words or doc_id are in no
    group and stay, repeated ones too.
    """
    kept = jaccard_join.representatives(spark, docs)
    grouped = F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    rows = docs.where(grouped).select(F.struct(*COLUMNS).alias("own"), "doc_id", jaccard_join.text_key(F.col("text")).alias("key"))
    # equal texts of one doc_id: the row with the smallest of the other columns
    one = rows.join(kept, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.min("own").alias("own")).select("own.*")
    return one.unionByName(docs.where(~F.coalesce(grouped, F.lit(False))).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows stay alike, an empty benchmark removes nothing."""
    return contamination.clean(spark, docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; n_chars is that of the new text. Null is the empty text."""
    found = pii.find(docs, pii.fit(spark), ("doc_id", "lang", "source"))
    text = found.select("own.doc_id", pii.redact(found).alias("text"), "own.lang", "own.source")
    return text.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; an empty (or null) text is one piece of one token, a repeated row has pieces of its own."""
    return packing.digest(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizers' measures, the trees and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is removed when the next one's is written; the last is read by the result."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = common.materialize(spark, stage(spark, docs, sf_dir), name)
        if before:
            common.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
