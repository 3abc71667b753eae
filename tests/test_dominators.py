"""The dominator table by layers against the kernel on the whole graph."""

import numpy as np
import pytest
from graphlens.model import CLASS_FIELDS, CLASSES, EDGES, FIELD_VALUES, GC_ROOTS, OBJECTS, PRIM_ARRAYS, STRINGS, GraphHeap
from graphlens.operators import dominators, kernel


def heap_of(spark, n, src, dst, roots, shallow):
    empty = lambda schema: spark.createDataFrame([], schema)
    objects = spark.createDataFrame([(i, 1, "instance", None, None, int(s)) for i, s in enumerate(shallow)], OBJECTS)
    edges = spark.createDataFrame([(int(a), 0, int(b), "f", None, "field") for a, b in zip(src, dst)], EDGES)
    marked = spark.createDataFrame([(int(r), 1, 0) for r in roots], GC_ROOTS)
    return GraphHeap(spark, objects, empty(CLASSES), empty(CLASS_FIELDS), edges, marked, empty(FIELD_VALUES), empty(PRIM_ARRAYS), empty(STRINGS))


def graph(seed):
    """Cycles at the top, references downwards below them; numbers n and n + 1 are of no object."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(30, 120))
    m, core = int(rng.integers(n, 3 * n)), int(rng.integers(0, 15 if seed % 2 else n // 2))
    ends = np.sort(rng.integers(0, n, (m, 2)), axis=1)
    ends = ends[ends[:, 0] < ends[:, 1]]
    loops = rng.integers(0, max(core, 1), (2 * core, 2))
    chain = np.stack((np.arange(core // 2), np.arange(core // 2) + 1), axis=1)
    src, dst = np.concatenate((ends, loops, chain, [[n, 3], [2, n + 1], [n + 1, 4]])).T
    return n, src, dst, np.unique(rng.integers(0, n, int(rng.integers(1, 4)))), rng.integers(1, 9, n)


@pytest.mark.parametrize("seed", range(5))
def test_layers_against_the_kernel(spark, monkeypatch, seed):
    monkeypatch.setattr(dominators, "SMALL", 0)
    monkeypatch.setattr(dominators, "CORE", 0 if seed % 4 < 2 else 20)
    monkeypatch.setattr(dominators, "MAX_LAYERS", 3)
    monkeypatch.setattr(dominators, "FAMILY", 3)
    n, src, dst, roots, shallow = graph(seed)
    rows = {r["id"]: r for r in heap_of(spark, n, src, dst, [*roots, n + 5], shallow).dom.collect()}
    assert sorted(rows) == list(range(n))
    known = (src < n) & (dst < n)
    idom, order = kernel.dominators(n, src[known], dst[known], roots)
    tree = kernel.tree(idom, order, shallow)
    assert [rows[v]["retained"] for v in range(n)] == tree["retained"].tolist()
    assert [rows[v]["idom"] for v in range(n)] == [int(x) if x >= 0 else None for x in idom]
    reached = np.flatnonzero(idom != kernel.UNREACHED).tolist()
    assert [rows[v]["pre"] is None and rows[v]["subtree"] is None and rows[v]["depth"] is None for v in range(n)] == (idom == kernel.UNREACHED).tolist()
    assert [(rows[v]["subtree"], rows[v]["depth"]) for v in reached] == [(tree["subtree"][v], tree["depth"][v]) for v in reached]
    assert sorted(rows[v]["pre"] for v in reached) == list(range(len(reached)))
    assert all(idom[v] < 0 or 0 < rows[v]["pre"] - rows[idom[v]]["pre"] <= rows[idom[v]]["subtree"] - rows[v]["subtree"] for v in reached)
    assert [v for _, v in sorted((rows[v]["rank"], v) for v in rows)] == sorted(rows, key=lambda v: (-rows[v]["retained"], v))
    assert sorted(r["rank"] for r in rows.values()) == list(range(n))


def test_large_graphs_stay_out_of_one_task(spark, monkeypatch):
    """The kernel's tasks see the core only: here one root of 50 owners that share 500 objects."""
    monkeypatch.setattr(dominators, "SMALL", 0)
    monkeypatch.setattr(dominators, "CORE", 10)
    monkeypatch.setattr(dominators, "dense", lambda table, whole=dominators.dense: whole(table) if len(table) < 20 else 1 / 0)
    owners, shared = np.arange(1, 51), np.arange(51, 551)
    src = np.concatenate((np.zeros(50, int), owners[shared % 50], owners[shared % 7]))
    rows = {r["id"]: r for r in heap_of(spark, 551, src, np.concatenate((owners, shared, shared)), [0], np.ones(551)).dom.collect()}
    assert rows[0]["retained"] == 551 and sum(r["idom"] == 0 for r in rows.values()) > 50


def test_labels_of_a_deep_tree():
    n = 50_000
    idom = np.arange(-1, n - 1)
    sizes, values = kernel.labels(idom, np.arange(n), np.arange(1, n + 1))
    assert set(sizes.tolist()) == {3} and values[-3:].tolist() == [0, n, n - 1]
