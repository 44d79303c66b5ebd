"""Iterations that converge, and noise on graphs that have little room for it."""

import itertools
import random

import numpy as np
import pytest

from fractura.operators import graph, perturb

EDGES = "graph_id string, src long, dst long"
GRAPHS = {
    "star": [(0, i) for i in range(1, 9)],
    "path": [(i, i + 1) for i in range(4)],
    "ring": [(i, (i + 1) % 5) for i in range(5)],
    "mixed": [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (5, 6)],
}


def matrix(edges, n):
    a = np.zeros((n, n))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    return a


def test_pagerank_is_the_fixed_point(spark):
    e = spark.createDataFrame([(g, *x) for g, some in GRAPHS.items() for x in some], EDGES)
    alone = spark.createDataFrame([("mixed", v) for v in range(10)] + [(g, v) for g in ("star", "path", "ring") for v in {x for e in GRAPHS[g] for x in e}], "graph_id string, node long")
    for among in (None, alone):
        got = {(r.graph_id, r.node): r["rank"] for r in graph.pagerank(e, among=among).collect()}
        for g, some in GRAPHS.items():
            n = 10 if g == "mixed" and among is not None else 1 + max(x for e in some for x in e)
            a = matrix(some, n)
            p = np.where(a.sum(0) > 0, a / np.maximum(a.sum(0), 1), 1 / n)
            x = np.linalg.solve(np.eye(n) - 0.85 * p, np.full(n, 0.15 / n))
            assert [got[g, v] for v in range(n)] == pytest.approx(x.tolist(), abs=1e-9)
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        graph.pagerank(e, most=3)


def test_eigenvector_is_the_leading_one(spark):
    some = {g: x for g, x in GRAPHS.items() if g != "mixed"} | {"joined": [*GRAPHS["mixed"], (4, 5)]}
    e = spark.createDataFrame([(g, *x, float(1 + (x[0] + x[1]) % 3)) for g, v in some.items() for x in v], EDGES + ", weight double")
    for weight in (None, "weight"):
        got = {(r.graph_id, r.node): r.centrality for r in graph.eigenvector(e, weight, tolerance=1e-8).collect()}
        for g, x in some.items():
            n = 1 + max(v for e in x for v in e)
            a = matrix(x, n)
            if weight:
                for i, j in x:
                    a[i, j] = a[j, i] = 1 + (i + j) % 3
            v = np.abs(np.linalg.eigh(a)[1][:, -1])
            assert [got[g, k] for k in range(n)] == pytest.approx(v.tolist(), abs=1e-6)
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        graph.eigenvector(e, most=3)


def test_noise_takes_the_last_absent_pairs(spark):
    whole = list(itertools.combinations(range(12), 2))
    e = spark.createDataFrame([("near", *x) for x in whole[3:]] + [("full", *x) for x in whole] + [("wide", i, i + 1) for i in range(20)], EDGES)
    got = sorted(map(tuple, perturb.noise_edges(e, 0.1, 3).collect()))
    assert [x[1:] for x in got if x[0] == "near"] == whole[:3] and not [x for x in got if x[0] == "full"]
    wide = [x for x in got if x[0] == "wide"]
    assert len(wide) == 2 and all(b > a + 1 for _, a, b in wide) and len(set(got)) == len(got)
    two = sorted(map(tuple, perturb.noise_edges(e.where("graph_id = 'near'"), 2 / 63, 3).collect()))
    assert len(two) == 2 and {x[1:] for x in two} < set(whole[:3])


def test_eigenvector_of_joined_copies(spark):
    """Two copies of a graph with one edge between them have eigenvalues so near that plain iteration takes 267 rounds."""
    rng = random.Random(3)
    one = sorted({tuple(sorted(rng.sample(range(10), 2))) for _ in range(25)})
    some = [(10 * k + a, 10 * k + b) for k in range(2) for a, b in one] + [(9, 10)]
    v = np.abs(np.linalg.eigh(matrix(some, 20))[1][:, -1])
    e = spark.createDataFrame([("g", *x) for x in some], EDGES)
    got = {r.node: r.centrality for r in graph.eigenvector(e, tolerance=1e-8, most=30, block=8).collect()}
    assert [got[k] for k in range(20)] == pytest.approx(v.tolist(), abs=1e-6)
