"""Fill-in-the-middle: the wavelet matrix against counting, the transformation against regular expressions, round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.llm import fill_in_middle as fim

TOKENS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def wanted(doc_id, text):
    t = text or ""
    tokens = TOKENS.findall(t)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 50:
        return n, "plain", None, None, t
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_text(rng):
    return "".join(rng.choice(["a", "bc", " ", "\n", "\t\x0b", "é", "中", "\U0001f600", "\x1c", " ", "<P", "<S", ">", "  "]) for _ in range(rng.randrange(0, 40)))


def test_ranks():
    symbols = np.random.default_rng(3).integers(0, 8, 1000).astype(np.uint8)
    matrix = fim.WaveletMatrix(symbols)
    at = np.arange(1001)
    for s in range(8):
        assert (matrix.rank(s, at) == np.append(0, np.cumsum(symbols == s))).all()
    assert (fim.WaveletMatrix(np.zeros(0, np.uint8)).rank(3, np.zeros(2, np.int64)) == 0).all()


def test_boundaries():
    rng = random.Random(5)
    texts = [some_text(rng) for _ in range(300)]
    raw = [t.encode() for t in texts]
    starts = np.append(0, np.cumsum([len(t) for t in raw]))[:-1]
    bounds = fim.Boundaries(np.frombuffer(b"".join(raw), np.uint8), starts)
    tokens = [TOKENS.findall(t) for t in texts]
    assert bounds.tokens().tolist() == [len(x) for x in tokens]
    for k in range(12):
        ends = bounds.after(np.minimum(k, bounds.tokens()))
        assert (ends - starts).tolist() == [len("".join(x[:k]).encode()) for x in tokens]
        assert bounds.code_points(starts, ends).tolist() == [len("".join(x[:k])) for x in tokens]


ROWS = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n "), (4, "holds <M> itself"), (5, "one"), (5, "one"), (5, "other text of the id")]


@pytest.mark.parametrize("block", [fim.BLOCK, 50])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(7)
    rows = ROWS + [(10 + i, some_text(rng)) for i in range(400)] + [(900 + i, "very long é " * 30_000 + " ") for i in range(4)]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, own string, output long")
    made = fim.transform(docs, ("doc_id", "own", "output"))
    got = made.select("own.output", "n", "form", "prefix_chars", "middle_chars", F.col("output"), fim.restore(F.col("output"), F.col("form"))).collect()
    assert {r[0]: tuple(r)[1:6] for r in got} == {k: wanted(i, t) for k, (i, t) in enumerate(rows)}
    assert {r[0]: r[6] for r in got} == {k: t or "" for k, (i, t) in enumerate(rows)}
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(300)], "doc_id long, text string")
    assert {r["form"] for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(docs, rate=100, suffix_first=0).collect()} == {"psm"}
    assert fim.transform(docs.limit(0)).count() == 0
