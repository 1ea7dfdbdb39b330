"""What failures reach, against a plain walk: random graphs, long chains, circles."""

import random

import pytest

from runweave.operators import dag
from runweave.sources import shared

TASKS = "run_id string, task_id long, task_depends string"


def brute(tasks, failed):
    after = {}
    for run, task, depends in tasks:
        for d in set((depends or "").split(",")) - {""}:
            after.setdefault((run, int(d)), []).append((run, task))
    steps, level, n = {f: 0 for f in failed}, set(failed), 0
    while level:
        n += 1
        level = {t for s in level for t in after.get(s, ())} - set(steps)
        steps |= {t: n for t in level}
    return {k: v for k, v in steps.items() if v}


def closure(spark, tasks, failed):
    out = dag.dep_fail_closure(spark, spark.createDataFrame(tasks, TASKS), spark.createDataFrame(failed, "run_id string, task_id long"))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    tasks = []
    for run in "ab":
        for i in range(150):
            parents = r.sample(range(i), min(i, r.choice([0, 1, 1, 1, 1, 2, 3])))
            tasks.append((run, i, ",".join(map(str, [*parents, *parents[:1]])) or None))
    failed = [(run, i) for run, i, _ in tasks if r.random() < 0.06]
    assert closure(spark, tasks, failed) == brute(tasks, failed)


def test_a_shorter_way_is_found_later(spark):
    """A path of few tasks of several dependencies and long chains against one of many such tasks and none."""
    tasks = [("a", 0, None), ("a", 99, None), *[("a", i, str(i - 1)) for i in range(1, 31)], ("a", 31, "30,99")]
    tasks += [("a", 100, "0,99"), *[("a", i, f"{i - 1},99") for i in range(101, 106)], ("a", 200, "31,105"), ("a", 201, "200")]
    assert closure(spark, tasks, [("a", 0)]) == brute(tasks, [("a", 0)])
    assert closure(spark, tasks, [("a", 0), ("a", 15)]) == brute(tasks, [("a", 0), ("a", 15)])
    assert closure(spark, tasks, [("a", 12345)]) == {} and closure(spark, [], [("a", 1)]) == {}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    write = shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda *a: written.append(a[2]) or write(*a))
    tasks = [("a", i, str(i - 1) if i else None) for i in range(10_000)]
    got = closure(spark, tasks, [("a", 3)])
    assert got == {("a", i): i - 3 for i in range(4, 10_000)} and len(written) < 20


def test_circles(spark, monkeypatch):
    monkeypatch.setattr(dag, "MOST_ROUNDS", 5)
    with pytest.raises(ValueError, match="circle"):
        closure(spark, [("a", 1, "2"), ("a", 2, "1")], [])
