"""Nearest neighbours: exact where all candidates are seen, recall by brute force, copies, rows that take no part."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runweave.llm import neighbour_graph as graph

SCHEMA = "vec_id long, embedding array<float>, label int, id string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], SCHEMA)


def brute(rows, k=20):
    """{query: [(vec_id, score)]} over distinct rows that take part."""
    kept = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    kept = sorted(kept)
    dim = max((len(v) for _, v in kept), default=0)
    ids = np.array([i for i, _ in kept])
    x = np.array([[*v, *[0.0] * (dim - len(v))] for _, v in kept])
    out = {}
    for row, (i, _) in enumerate(kept):
        if i % 20 == 0:
            s = x @ x[row]
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def found(spark, rows, k=20):
    got = {}
    for r in sorted(graph.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0, k).collect()):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def same(got, want):
    assert set(got) == {q for q, x in want.items() if x}
    for q, x in got.items():
        assert [i for i, _ in x] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in x], [s for _, s in want[q]], rtol=1e-12)


def vectors(n, dim, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).tolist())]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [1.0, None])]
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [3.0]), (20, [-1.0, 2.0, 0.25]), (7, [1.0, 0.5]), (3, [1.0, 0.5]), (-20, [0.5, 0.5])]
    same(found(spark, rows + odd), brute(rows + odd))
    same(found(spark, rows, 2), brute(rows, 2))
    assert found(spark, [(0, [1.0])]) == {} and found(spark, odd) == {} and found(spark, []) == {}


def test_copies(spark):
    """Two thirds of all rows are one vector; ties go to the smaller id."""
    rows = vectors(150, 8)
    rows += [(1000 + i, rows[20][1]) for i in range(300)]
    same(found(spark, rows), brute(rows))


@pytest.mark.parametrize("lengths", [1, 3])
def test_recall(spark, lengths):
    rows = vectors(3000, 24)
    rows = [(i, [lengths ** ((i % 7) / 7) * c for c in v]) for i, v in rows]
    got, want = found(spark, rows), brute(rows)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert len(got) == len(want) and all(len(x) == 20 for x in got.values()) and np.mean(hits) >= 0.95


def test_hubs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 20)
    monkeypatch.setattr(graph, "BLOCKS", 3)
    monkeypatch.setattr(graph, "LEAF", 50)
    rows = vectors(600, 6)
    got, want = found(spark, rows), brute(rows)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.98


def test_groups_over_batches():
    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array(x, pa.int64())], ["k"])
    whole = [g.column("k").to_pylist() for g in graph._groups(iter([batch(1, 1, 2), batch(), batch(2, 2), batch(3)]), ["k"])]
    assert whole == [[1, 1], [2, 2, 2], [3]]
    assert [len(g) for g in graph._groups(iter([batch(2), batch(2, 2), batch(2)]), ["k"], 2)] == [3, 1]


def test_merging_over_batches():
    names = [c.split()[0] for c in graph._STATE.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.float32(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    first = batch([(1, False, b"a", 1.0, [2, 3], [0.5, 0.25], [False, False])])
    second = batch([(1, None, None, None, [3, 4, 1], [0.25, 0.75, 9.0], [True] * 3), (2, True, b"b", 1.0, [], [], []), (2, None, None, None, [5], [0.125], [True])])
    out = [r for b in graph._merged(iter([first, second]), 2) for r in b.to_pylist()]
    assert [(r["id"], r["code"], r["dst"], r["fresh"]) for r in out] == [(1, b"a", [4, 2], [True, False]), (2, b"b", [5], [True])]
