"""Order scoring by spanning forest, against one union-find pass a graph."""

import random

import pytest

from fractura.operators import kernels, orders, scoring

EDGES, ORDER = "graph_id string, src long, dst long", "graph_id string, strategy string, node long, step long"


def made(seed):
    """Graphs of several shapes with two orders each, some with nodes without edges."""
    rng = random.Random(seed)
    graphs = {"path": {(i, i + 1) for i in range(40)}, "star": {(0, i) for i in range(1, 30)}, "two": {(0, 1), (2, 3)}, "clique": {(i, j) for j in range(9) for i in range(j)}}
    for g in range(6):
        n = rng.randint(3, 50)
        graphs[f"g{g}"] = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 90))}
    listed = []
    for k, (g, edges) in enumerate(graphs.items()):
        for name in ("by_id", "drawn"):
            order = sorted({v for e in edges for v in e} | set(range(900, 900 + k % 3)))
            if name == "drawn":
                rng.shuffle(order)
            listed.append((g, name, edges, order))
    return listed


@pytest.fixture(scope="module")
def frames(spark):
    listed = made(1)
    e = spark.createDataFrame(sorted({(g, *x) for g, _, edges, _ in listed for x in edges}), EDGES)
    o = spark.createDataFrame([(g, s, v, k) for g, s, _, order in listed for k, v in enumerate(order, 1)], ORDER)
    return listed, e, o


@pytest.mark.parametrize("width", [scoring.WIDTH, 4])
def test_series_and_metrics(frames, width):
    listed, e, o = frames
    series = scoring.stored(scoring.step_series(e, o, width=width))
    got = {(r.graph_id, r.strategy, r.step): (r.cp, r.lcc) for r in series.collect()}
    records = {(r.graph_id, r.strategy): r for r in scoring.metrics(series).collect()}
    n = 0
    for g, s, edges, order in listed:
        adj = kernels.adjacency(*zip(*edges, strict=True), order)
        cp, top = kernels.connectivity(adj, order)
        assert [got[g, s, k] for k in range(len(order) + 1)] == list(zip(cp.astype(int).tolist(), top.tolist(), strict=True))
        for c, x in kernels.metrics(adj, order).items():
            assert records[g, s][c] == pytest.approx(x, abs=1e-12)
        n += len(order) + 1
    assert n == len(got) and len(records) == len(listed)


def test_prefixes(frames):
    listed, e, o = frames
    got = {(r.graph_id, r.strategy): r for r in orders.prefix_anc(e, o.where("step <= 3 and strategy = 'drawn'")).collect()}
    for g, s, edges, order in listed:
        if s == "drawn":
            cp, _ = kernels.connectivity(kernels.adjacency(*zip(*edges, strict=True), order), order)
            k = min(3, len(order))
            assert got[g, s].steps == k and got[g, s].anc == pytest.approx(cp[1 : k + 1].sum() / (k * cp[0]))


def test_orders_that_are_none(spark):
    e = spark.createDataFrame([("a", 1, 2), ("a", 2, 3)], EDGES)
    for rows in ([(1, 1), (2, 2)], [(1, 1), (2, 2), (2, 3), (3, 4)], [(1, 1), (2, 2), (3, 4)], [(1, 0), (2, 1), (3, 2)]):
        with pytest.raises(Exception, match="each node once"):
            scoring.step_series(e, spark.createDataFrame([("a", "s", *r) for r in rows], ORDER)).collect()
    alone = spark.createDataFrame([("b", "s", 5, 1), ("b", "s", 6, 2)], ORDER)
    assert [(r.step, r.cp, r.lcc) for r in scoring.step_series(e, alone).orderBy("step").collect()] == [(0, 0, 1), (1, 0, 1), (2, 0, 0)]
    assert [tuple(r) for r in scoring.metrics(scoring.step_series(e, alone)).collect()] == [("b", "s", 0.0, 0.0, 1, 1, 0.5, 1)]
    assert not scoring.step_series(e, alone.limit(0)).collect()
