"""The audit of filters against a plain walk through all documents in every order."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from runweave.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(60))
DOCS = "doc_id long, text string, source string, n string, h string, low long"


def brute(rows, labels):
    """rows (doc_id, text, source), labels (doc_id, quality, toxic): the report as a set of tuples."""
    space = " \t\n\x0b\f\r"
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    told = []
    for i, text, source in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in space else c for c in t).split(" ") if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        told.append((source or "", fails, i in good, i in toxic))
    out = set()
    for part in {p for p, *_ in told}:
        here = [x for x in told if x[0] == part]
        removed = {}
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                before = [x for x in here if any(x[1][e] for e in order[: step - 1])]
                left = [x for x in left if not x[1][f]]
                lines.append((part, order, step, len(left), len(gone), sum(x[1][f] for x in before), sum(x[1][f] and sum(x[1].values()) == 1 for x in here), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
                removed[f] = removed.get(f, 0) + len(gone)
        out |= {(*x[:-1], removed[x[-1]]) for x in lines}
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(filter_audit.combinations(spark, docs, marks)).collect()]
    assert len(got) == len(set(got))
    return set(got)


ROWS = [
    (5, LONG, "a"),
    (3, LONG, "b"),
    (3, LONG, "b"),
    (9, LONG, None),
    (None, LONG, "a"),
    (1, None, "a"),
    (2, "", ""),
    (4, "SHOUT # now", "b"),
    (4, "another text of this id", "b"),
    (6, "same " * 80, "a"),
    (7, "café 中文 " * 30 + "\x0bA\x1cB", "a"),
    (8, " \t\n ", "b"),
]
LABELS = [(5, 1, 0), (5, 0, 1), (4, 0, 1), (9, 1, None), (None, 1, 1), (77, 1, 1), (3, None, None)]


def test_every_order(spark):
    assert audited(spark, ROWS, LABELS) == brute(ROWS, LABELS)


def test_lists_too_long_to_broadcast_and_hot_texts(spark, monkeypatch):
    rows = ROWS + [(100 + i, LONG, "hot") for i in range(40)]
    want = brute(rows, LABELS)
    monkeypatch.setattr(filter_audit, "COPIES", 10)
    assert audited(spark, rows, LABELS) == want
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", 0)
    assert audited(spark, rows, LABELS) == want


def test_no_documents(spark):
    assert audited(spark, [], LABELS) == set()


def test_colliding_hashes_are_told_by_text(spark):
    """Rows of one hash with different texts are no copies."""
    docs = spark.createDataFrame([(1, "p", "x", 7), (2, "p", "y", 7), (3, "p", "x", 7)], "doc_id long, part string, text string, h long")
    assert [r["doc_id"] for r in filter_audit.copies(spark, docs, docs.select("doc_id", "h")).collect()] == [3]


@pytest.mark.parametrize("text, bits", [("", 1), ("x " * 60, 2), (LONG, 0), ("A" + LONG[1:], 0), (LONG.upper(), 4), (LONG + "|", 8)])
def test_bits(spark, text, bits):
    assert spark.createDataFrame([(text,)], "t string").select(filter_audit.text_bits(F.col("t"))).first()[0] == bits
