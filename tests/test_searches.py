import itertools
import random

import pytest

from fractura.operators import cuts, graph, samplers, search
from fractura.operators import kernels as K

PATH = [(k, k + 1) for k in range(9)]
BARBELL = [*itertools.combinations(range(5), 2), (4, 5), *itertools.combinations(range(5, 10), 2)]


def adj(edges):
    return K.adjacency(*zip(*edges, strict=True))


def test_a_bridge_is_cut():
    a = adj(BARBELL)
    assert sorted(map(sorted, cuts.bisect(a, list(a)))) == [list(range(5)), list(range(5, 10))]
    assert cuts.separators(a, 5) == [4]


@pytest.mark.parametrize("edges", [PATH, BARBELL])
def test_covers_touch_every_cut_edge(edges):
    a = adj(edges)
    one, two = cuts.bisect(a, list(a))
    chosen = set(cuts.cover(a, one, two))
    assert all(v in chosen or u in chosen for v in one for u in a[v] & two)


@pytest.mark.parametrize("edges", [PATH, BARBELL])
@pytest.mark.parametrize("make", [cuts.by_ratio_cut, cuts.by_cut_reinsertion])
def test_cut_orders(edges, make):
    a = adj(edges)
    assert sorted(make(a, 0.3)) == sorted(a)


def test_put_back_keeps_components_small():
    a = adj(PATH)
    stay = cuts.put_back(a, [1, 2, 4, 6, 8], 3)
    left = K._copy(a)
    for v in stay:
        K._strip(left, v)
    assert len(K._largest(left)) <= 3 and set(stay) < {1, 2, 4, 6, 8}


def test_crossover_makes_permutations():
    rng = random.Random(3)
    for _ in range(200):
        a, b = rng.sample(range(8), 8), rng.sample(range(8), 8)
        low, high = sorted(rng.sample(range(9), 2))
        child = search.mapped_crossover(a, b, low, high)
        assert sorted(child) == list(range(8)) and child[low:high] == a[low:high]


@pytest.mark.parametrize("method", sorted(search.SEARCHES))
def test_searches_find_the_best_order_of_a_small_graph(method):
    a = adj([(0, 1), (1, 2), (2, 3), (3, 4)])
    order, anc = search.SEARCHES[method](a, 7)
    assert sorted(order) == sorted(a) and anc == pytest.approx(search.cost(a, order))
    assert anc == pytest.approx(min(search.cost(a, list(p)) for p in itertools.permutations(a)))


def test_completion(spark):
    n = spark.createDataFrame([("g", k) for k in range(4)], "graph_id string, node long")
    o = spark.createDataFrame([("g", 2, 5), ("g", 9, 6), ("g", 1, 7), ("g", 2, 8)], "graph_id string, node long, step long")
    assert [r.node for r in search.completed(o, n).orderBy("step").collect()] == [2, 1, 0, 3]


@pytest.mark.parametrize("name", sorted(samplers.SAMPLERS))
@pytest.mark.parametrize("k", [1, 4, 10, 50])
def test_samples_have_k_nodes(name, k):
    a = adj(BARBELL)
    got = samplers.SAMPLERS[name](a, k, random.Random(1))
    assert len(got) == len(set(got)) == min(k, 10) and set(got) <= set(a)


def test_weighted_clustering_with_equal_weights_is_clustering(spark):
    e = spark.createDataFrame([("g", a, b, 2.0) for a, b in BARBELL], "graph_id string, src long, dst long, weight double")
    plain = {r.node: r.clustering for r in graph.clustering(e.drop("weight")).collect()}
    assert {r.node: r.clustering for r in graph.weighted_clustering(e).collect()} == pytest.approx(plain)


def test_eigenvector_of_a_star():
    c = K.eigenvector_of(adj([(0, k) for k in range(1, 5)]))
    assert c[0] == pytest.approx(2 * c[1], rel=1e-4) and sum(x * x for x in c.values()) == pytest.approx(1)


@pytest.mark.parametrize("n", [200, 400])
def test_a_long_path_is_cut_once(n):
    a = adj([(k, k + 1) for k in range(n - 1)])
    one, two = cuts.bisect(a, list(a))
    assert len(one) == len(two) and sum(len(a[v] & two) for v in one) == 1


def test_paths_longer_than_any_bound(spark):
    edges = spark.createDataFrame([("p", k, k + 1) for k in range(19)], "graph_id string, src long, dst long")
    assert [tuple(r) for r in graph.path_lengths(edges).collect()] == [("p", 7.0, 19)]
