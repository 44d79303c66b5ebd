import random

import pytest

from fractura.operators import graph


def _edges(spark):
    rng = random.Random(5)
    rows = [("k2", 1, 2), ("path", 1, 2), ("path", 2, 3), ("path", 3, 4), ("triangle", 1, 2), ("triangle", 2, 3), ("triangle", 1, 3)]
    rows += [("star", 0, k) for k in range(1, 9)]
    rows += [("drawn", a, b) for a, b in {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}]
    rows += [("places", k % 4, k) for k in range(10, 50)] + [("places", 5, k) for k in range(4)]
    return rows, graph.canonical(spark.createDataFrame(rows, "graph_id string, src long, dst long"))


def _distances(rows):
    near = {}
    for g, a, b in rows:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    out = {}
    for g, a in near:
        out[g, a, a], front = 0, [a]
        while front:
            new = {y for x in front for y in near[g, x] if (g, a, y) not in out}
            out |= {(g, a, y): out[g, a, front[0]] + 1 for y in new}
            front = sorted(new)
    return out


def test_path_lengths_with_leaves(spark):
    rows, edges = _edges(spark)
    every = _distances(rows)
    got = {r.graph_id: (r.avg_path, r.diameter) for r in graph.path_lengths(edges).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        parts = {frozenset(b for (h, x, b) in every if (h, x) == (g, a)) for (h, a, _) in every if h == g}
        big = min(parts, key=lambda p: (-len(p), min(p)))
        d = [n for (h, a, b), n in every.items() if h == g and a in big and a != b]
        want[g] = pytest.approx(sum(d) / len(d)), max(d)
    assert got == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_boundary(spark, radius):
    rows, edges = _edges(spark)
    got = [tuple(r) for r in graph.boundary(edges, graph.nodes(edges), radius).select("graph_id", "source", "node", "distance").collect()]
    assert sorted(got) == sorted((*k, n) for k, n in _distances(rows).items() if n == radius)


def test_many_leaves(spark):
    """A star of 30,000 leaves has 900 million pairs of them, which no round may hold."""
    edges = spark.range(1, 30_001).selectExpr("'star' AS graph_id", "0L AS src", "id AS dst")
    assert [tuple(r) for r in graph.path_lengths(edges).select("diameter").collect()] == [(2,)]
    assert graph.boundary(edges, graph.nodes(edges), 3).count() == 0
