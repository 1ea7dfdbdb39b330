"""Licenses as they are given: marks of a few words, whole bodies, notices from a table, very many of them."""

import random
import time

import pytest

from runweave.llm import licenses


def found(spark, texts, notices=licenses.NOTICES):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, license string, h string")
    return {(r["doc_id"], r["license"]): (r["containment"], r["first_word"], r["last_word"]) for r in licenses.scan(spark, docs, notices).collect()}


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("before, after", [(0, 0), (0, 300), (300, 0), (7, 9)])
def test_marks_of_a_few_words(spark, before, after):
    text = f"{prose(before, 1)}\n# SPDX-License-Identifier: MIT\n{prose(after, 2)}"
    assert found(spark, [text, "# SPDX license", "license identifier mit spdx"]) == {(0, "SPDX-MIT"): (100.0, before, before + 3)}


def test_notices_of_every_short_length(spark):
    notices = {f"n{k}": " ".join(f"mark{k}x{i}" for i in range(k)) for k in range(1, 8)} | {"none": " . "}
    texts = [f"{prose(20, k)} {notices[f'n{k}']} {prose(20, k + 50)}" for k in range(1, 8)] + ["", None, notices["n2"], "mark2x1 mark2x0"]
    got = found(spark, texts, notices)
    assert got == {**{(k - 1, f"n{k}"): got[k - 1, f"n{k}"] for k in range(1, 8)}, (9, "n2"): (100.0, 0, 1)}
    assert all(got[k - 1, f"n{k}"] == (100.0, 20, 19 + k) for k in range(1, 5))
    assert found(spark, texts, {}) == {} and found(spark, texts, {"none": " . "}) == {}


def test_whole_bodies(spark):
    body = licenses.NOTICES["MIT-body"]
    words = body.split()
    edited = " ".join(w for i, w in enumerate(words) if i not in (40, 90))
    got = found(spark, [f"{prose(100, 3)} {body} {prose(100, 4)}", f"{prose(100, 5)} {edited}", " ".join(words[: len(words) // 2])])
    assert {i for i, name in got if name == "MIT-body"} == {0, 1} and {i for i, name in got if name == "MIT-grant"} == {0, 1, 2}


@pytest.mark.parametrize("key_bytes", [licenses.KEY_BYTES, 0])
def test_five_hundred_bodies(spark, monkeypatch, key_bytes):
    """They are rows, not parts of the plan."""
    monkeypatch.setattr(licenses, "KEY_BYTES", key_bytes)
    table = spark.createDataFrame([(f"body{i}", prose(1000, 1000 + i)) for i in range(500)] + [("empty", None), (None, "text")], "license string, text string")
    notices = licenses.given(table)
    assert len(notices) == 501
    docs = spark.createDataFrame([(1, notices["body7"] + " end"), (2, "start " + notices["body400"]), (3, prose(500, 77))], "doc_id long, text string")
    began = time.time()
    plan = licenses.scan(spark, docs, notices)
    plan._jdf.queryExecution().optimizedPlan()
    took = time.time() - began
    assert sorted((r["doc_id"], r["license"]) for r in plan.collect()) == [(1, "body7"), (2, "body400")]
    assert took < 15
