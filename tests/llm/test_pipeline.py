"""The pipeline's stages on a small table, and the production queries on the smallest tables."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from runweave.llm import contamination, jaccard_join, packing, queries

SMALL = "/root/testdata/sf0.001"


def prose(n, seed):
    r = random.Random(seed)
    part = lambda: r.choice("bcdfghlmnprstvw") + r.choice("aeiou") + r.choice(["n", "r", "st", "ll", "m", "nd", "t"])
    return " ".join(r.choice(["the", "of", "and", *(part() for _ in range(4)), *(part() + r.choice(["ing", "er", "ed"]) for _ in range(4))]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    item = prose(30, 1)
    rows = [(i, prose(120, 100 + i)) for i in range(20)]
    rows += [(30, prose(120, 100)), (31, prose(120, 101) + " more"), (32, prose(120, 101) + " more")]
    rows += [(40, f"{prose(50, 5)} {item} {prose(50, 6)}"), (41, prose(70, 7) + " me@mail.example.com " + prose(10, 8)), (42, "### $$$ *** " * 60), (43, "short"), (44, None), (45, ""), (46, prose(9000, 9)), (None, prose(90, 10))]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("n", F.lit("extra")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        given[name] = docs
    ids = {k: collections.Counter(r["doc_id"] for r in v.collect()) for k, v in given.items()}
    for name in list(ids)[:-1]:
        assert tuple(given[name].columns) == corpus_pipeline.COLUMNS
    assert set(ids["quality_rules"]) == {*range(20), 30, 31, 32, 40, 41, 46, None}
    assert ids["near_duplicates"] == collections.Counter([*range(20), 40, 41, 46, None])
    assert ids["decontamination"] == ids["near_duplicates"] - collections.Counter([40])
    assert ids["personal_data"] == ids["decontamination"]
    mail = given["personal_data"].where("doc_id = 41").first()
    assert "[EMAIL]" in mail["text"] and "@" not in mail["text"] and mail["n_chars"] == len(mail["text"])
    whole = collections.Counter()
    for r in given["best_fit_packing"].collect():
        whole[r["doc_id"]] += r["length"]
    assert set(whole) == set(ids["personal_data"]) and max(r["length"] for r in given["best_fit_packing"].collect()) == 4096


def test_equal_ids_of_different_texts(spark):
    """No text is lost with another of its id; the same rows stay in every run."""
    a, b = prose(120, 200), prose(120, 201)
    rows = [(5, a), (5, b), (5, b), (3, b + " more"), (7, prose(120, 202)), (7, prose(120, 202).upper()), (8, ""), (8, None), (None, a), (9, a)]
    docs = spark.createDataFrame([(i, t, "en", "src", 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, own string, key int, root int")
    runs = [sorted(map(str, corpus_pipeline.near_duplicates(spark, docs.repartition(k), "").collect())) for k in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    seven = [t for i, t in got if i == 7]
    assert len(seven) == 1 and seven[0].lower() == prose(120, 202)
    assert got == collections.Counter([(5, a), (3, b + " more"), (7, seven[0]), (8, ""), (8, None), (None, a)])


def test_repeated_rows_meet_once(spark, monkeypatch):
    """Very many equal rows and a near copy: one row for each set reaches the task that compares whole sets."""
    a = prose(60, 300)
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(a).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, a + " more"), *[(i, prose(60, i)) for i in range(400, 420)]], "doc_id long, text string")).repartition(8)
    most = spark.sparkContext.accumulator(0)
    verified = jaccard_join._verified

    def counted(batches):
        for batch in batches:
            most.add(len(batch))
            yield from verified(iter([batch]))

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = collections.Counter(r["component_id"] for r in jaccard_join.classes(spark, docs).collect())
    assert got == collections.Counter({1: 100_001, **{i: 1 for i in range(400, 420)}})
    assert most.value == 2


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    cut = lambda d: collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert cut(corpus_pipeline.run(spark, folder)) == cut(docs)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES} and set(queries.QUERIES) <= set(names) and "pipeline" in names


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    told = lambda names, rows: sorted(str(sorted(zip(names, r, strict=True))) for r in rows)
    got, want = queries.QUERIES[name](spark, SMALL), con.execute(queries.ORACLES[name])
    assert told(got.columns, got.collect()) == told([c[0] for c in want.description], want.fetchall())


def test_production_parameters():
    assert (jaccard_join.WORDS, jaccard_join.PERCENT, contamination.WORDS, contamination.PERCENT) == (5, 80, 5, 80)
    assert packing.vocabulary_path().endswith("word_bpe_49k.json")
