"""Communities, matchings, covers and bisections against brute force."""

import collections
import itertools
import random

import numpy as np
import pytest

from fractura.operators import communities, partition

EDGES = "graph_id string, src long, dst long"


def planted(name, n, parts, inside, across, rng):
    return {(name, i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < (inside if i * parts // n == j * parts // n else across)}


def by_hand(edges, part, weight):
    m = sum(weight.values())
    total, inside = collections.Counter(), collections.Counter()
    for e in edges:
        total[part[e[0]]] += weight[e]
        total[part[e[1]]] += weight[e]
        inside[part[e[0]]] += weight[e] * (part[e[0]] == part[e[1]])
    return sum(inside[c] / m - (total[c] / (2 * m)) ** 2 for c in total)


def test_levels_gain_modularity(spark):
    rng = random.Random(1)
    rows = sorted(planted("four", 40, 4, 0.5, 0.03, rng) | {("star", 0, i) for i in range(1, 25)} | {("pair", 1, 2)})
    weight = {r: 1 + (r[1] * r[2]) % 3 / 4 for r in rows}
    e = spark.createDataFrame([(*r, weight[r]) for r in rows], EDGES + ", weight double")
    levels = communities.stored(communities.louvain(e, "weight"))
    last = {}
    for n in range(1, 1 + max(r.level for r in levels.select("level").distinct().collect())):
        here = levels.where(f"level = {n}")
        got = {r.graph_id: r for r in communities.modularity(e, here, "weight").collect()}
        part = collections.defaultdict(dict)
        for r in here.collect():
            part[r.graph_id][r.node] = r.community
        for g, p in part.items():
            own = {(a, b): weight[g, a, b] for x, a, b in rows if x == g}
            q = by_hand(own, p, own)
            assert got[g].modularity == pytest.approx(q) and got[g].n_communities == len(set(p.values()))
            assert all(c == min(v for v in p if p[v] == c) for c in p.values())
            assert q >= last.get(g, by_hand(own, {v: v for v in p}, own)) - 1e-12
            last[g] = q
    top = collections.defaultdict(set)
    for r in communities.last_level(levels).collect():
        if r.graph_id == "four":
            top[r.community].add(r.node)
    assert sorted(map(sorted, top.values())) == [list(range(k, k + 10)) for k in (0, 10, 20, 30)]
    assert not communities.louvain(e.limit(0)).collect()


def test_shares_of_communities(spark):
    degrees = spark.createDataFrame([("a", v, 20 - v) for v in range(10)], "graph_id string, node long, degree long")
    parts = spark.createDataFrame([("a", v, 0 if v < 7 else 7 if v < 9 else 9) for v in range(10)], "graph_id string, node long, community long")
    assert {r.node for r in communities.shares(degrees, parts, 5).collect()} == {0, 1, 2, 7, 9}


def test_matching_is_the_one_in_order(spark):
    rng = random.Random(2)
    rows = [(g, a, b) for g in ("x", "y") for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.1] + [("hub", 0, i) for i in range(1, 40)]
    ranks = rng.sample(range(10_000), len(rows))
    e = spark.createDataFrame([(*r, k) for r, k in zip(rows, ranks, strict=True)], "graph_id string, u long, v long, rank long")
    want, used = set(), set()
    for _, (g, a, b) in sorted(zip(ranks, rows, strict=True)):
        if not {(g, a), (g, b)} & used:
            used |= {(g, a), (g, b)}
            want.add((g, a, b))
    assert set(map(tuple, partition.matching(e).collect())) == want
    edges = e.selectExpr("graph_id", "u as src", "v as dst")
    sides = spark.createDataFrame(sorted({(g, v, v % 2) for g, *x in rows for v in x}), "graph_id string, node long, side int")
    cover = {tuple(r) for r in partition.cut_cover(edges, sides, 3).collect()}
    cut = [r for r in rows if r[1] % 2 != r[2] % 2]
    assert all((g, a) in cover or (g, b) in cover for g, a, b in cut) and {g for g, _ in cover} == {g for g, *_ in cut}
    assert sum(g == "hub" for g, _ in cover) == 2


def improved(edges, side):
    """Exchanges of the best pair, from one start, until none shortens the cut."""
    cut = lambda s: sum(s[a] != s[b] for a, b in edges)
    now = cut(side)
    while True:
        best = min(((cut({**side, a: 1 - side[a], b: 1 - side[b]}), a, b) for a in side for b in side if side[a] < side[b]), default=(now,))
        if best[0] >= now:
            return now
        now, a, b = best
        side = {**side, a: 1 - side[a], b: 1 - side[b]}


@pytest.mark.parametrize("coarse", [128, 20])
def test_bisections(spark, coarse):
    rng = random.Random(coarse)
    rows = sorted(planted("two", 60, 2, 0.2, 0.04, rng) | {("ring", i, (i + 1)) for i in range(50)} | {("ring", 0, 50)} | {("star", 0, i) for i in range(1, 41)} | {("parts", 2 * i, 2 * i + 1) for i in range(20)})
    got = collections.defaultdict(dict)
    for r in partition.bisection(spark.createDataFrame(rows, EDGES), coarse=coarse).collect():
        got[r.graph_id][r.node] = r.side
    for g in ("two", "ring", "star", "parts"):
        own = [(a, b) for x, a, b in rows if x == g]
        assert set(got[g]) == {v for e in own for v in e} and abs(sum(1 - 2 * s for s in got[g].values())) <= 1
    cut = lambda g: sum(got[g][a] != got[g][b] for x, a, b in rows if x == g)
    assert cut("ring") == 2 and cut("star") == 20 and cut("parts") <= (0 if coarse == 128 else 2)
    own = [(a, b) for x, a, b in rows if x == "two"]
    starts = []
    for _ in range(3):
        drawn = rng.sample(sorted(got["two"]), len(got["two"]))
        starts.append(improved(own, {v: int(k < len(drawn) // 2) for k, v in enumerate(drawn)}))
    assert cut("two") <= min(starts) + (0 if coarse == 128 else 3)


def test_small_graphs_are_halved_as_well_as_can_be():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 11))
        w = np.triu(rng.integers(0, 2, (n, n)), 1).astype(float)
        w += w.T
        side = partition.best_halves(w, np.ones(n, int), 20, 1)
        least = min(w[list(x)][:, [v for v in range(n) if v not in x]].sum() for x in itertools.combinations(range(n), n // 2))
        assert side.sum() in (n // 2, n - n // 2) and w[side == 0][:, side == 1].sum() == least


def test_levels_merge_several_nodes_at_once(spark, monkeypatch):
    """A graph of 400 nodes is merged to few with few tables (39 when nodes were merged pair by pair), and halved with a short cut."""
    rng = random.Random(3)
    rows = sorted(planted("four", 400, 4, 0.08, 0.002, rng))
    made, merged = [], []
    stored = partition.stored
    monkeypatch.setattr(partition, "stored", lambda df, *a: made.append(1) or stored(df, *a))
    monkeypatch.setattr(partition, "_merged", lambda *a, old=partition._merged: merged.append(len(made)) or old(*a))
    got = {r.node: r.side for r in partition.bisection(spark.createDataFrame(rows, EDGES), coarse=40).collect()}
    assert len(got) == 400 and sum(got.values()) == 200
    assert sum(got[a] != got[b] for _, a, b in rows) <= 1.5 * min(sum((a // 100 in two) != (b // 100 in two) for _, a, b in rows) for two in ((0, 1), (0, 2), (0, 3)))
    assert merged[-1] <= 25


def test_clusters_keep_to_their_size(spark, monkeypatch):
    """Hubs of many nodes are dealt into several windows; no cluster is too large, and most nodes are in one with others."""
    monkeypatch.setattr(partition, "WIDTH", 16)
    rng = random.Random(4)
    rows = [("star", 0, i, 1) for i in range(1, 301)] + [("drawn", *sorted(rng.sample(range(100), 2)), 1) for _ in range(300)]
    size = {(g, v): 1 + v % 3 for g, a, b, _ in rows for v in (a, b)}
    e = spark.createDataFrame(sorted(set(rows)), "graph_id string, u long, v long, w long")
    at = spark.createDataFrame([(g, v, s, 9) for (g, v), s in size.items()] + [("lone", v, 4, 9) for v in range(6)], "graph_id string, node long, size long, most long")
    size |= {("lone", v): 4 for v in range(6)}
    for seed in range(2):
        into = {(r.graph_id, r.node): r.into for r in partition._clusters(e, at, seed).collect()}
        total = collections.Counter()
        for (g, v), s in size.items():
            assert (g, into.get((g, v), v)) not in into
            total[g, into.get((g, v), v)] += s
        assert max(total.values()) <= 9
        number = collections.Counter(g for g, _ in total)
        assert number["star"] <= 160 and number["drawn"] <= 60 and number["lone"] == 3
