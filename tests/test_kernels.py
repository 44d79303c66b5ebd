import pytest

from fractura.operators import kernels as K

PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]
STAR = [(0, k) for k in range(1, 6)]
CYCLE = [(k, (k + 1) % 6) for k in range(6)]
BARBELL = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


@pytest.mark.parametrize(
    ("edges", "name", "order", "metrics"),
    [
        (PATH, "degree", [1, 3, 0, 2, 4], (0.06, 0.3, 1, 2, 0.6)),
        (PATH, "core", [1, 2, 3, 0, 4], (0.08, 0.3, 1, 2, 0.6)),
        (PATH, "influence", [0, 1, 2, 3, 4], (0.2, 0.6, 2, 3, 0.8)),
        (STAR, "degree", [0, 1, 2, 3, 4, 5], (0, 0, 1, 1, 1 / 6)),
        (STAR, "core", [0, 1, 2, 3, 4, 5], (0, 0, 1, 1, 1 / 6)),
        (STAR, "influence", [0, 1, 2, 3, 4, 5], (0, 0, 1, 1, 1 / 6)),
        (CYCLE, "degree", [0, 2, 4, 1, 3, 5], (13 / 90, 2 / 3, 2, 3, 5 / 6)),
        (CYCLE, "core", [0, 2, 3, 4, 1, 5], (14 / 90, 2 / 3, 2, 3, 5 / 6)),
        (CYCLE, "influence", [0, 1, 2, 3, 4, 5], (20 / 90, 2 / 3, 2, 4, 5 / 6)),
        (BARBELL, "degree", [2, 3, 0, 4, 1, 5], (7 / 90, 4 / 15, 1, 3, 0.5)),
        (BARBELL, "core", [2, 3, 0, 1, 4, 5], (8 / 90, 4 / 15, 1, 3, 0.5)),
        (BARBELL, "influence", [0, 1, 2, 3, 4, 5], (20 / 90, 2 / 3, 2, 4, 5 / 6)),
    ],
)
def test_micro_graphs(edges, name, order, metrics):
    adj = K.adjacency(*zip(*edges, strict=True))
    assert K.STRATEGIES[name](adj) == order
    m = K.metrics(adj, order)
    assert [m[k] for k in ("anc", "anc_prefix_k", "fht_50", "fht_10", "lcc_at_k")] == pytest.approx(metrics)


@pytest.mark.parametrize("name", sorted(K.STRATEGIES))
def test_orders_are_permutations(name):
    adj = K.adjacency(*zip(*(BARBELL + [(5, 6), (6, 7), (8, 9)]), strict=True))
    assert sorted(K.STRATEGIES[name](adj)) == sorted(adj)


def test_scores_equal_a_scan_of_each_step():
    adj = K.adjacency(*zip(*BARBELL, strict=True))
    cp, top = K.connectivity(adj, [2, 0, 3, 1, 5, 4])
    left, want = {v: set(s) for v, s in adj.items()}, []
    for v in [None, 2, 0, 3, 1, 5, 4]:
        if v is not None:
            for u in left.pop(v):
                left[u].discard(v)
        seen, sizes = set(), []
        for x in left:
            if x not in seen:
                c = set(K._ball(left, x, 10))
                seen |= c
                sizes.append(len(c))
        want.append((sum(s * (s - 1) // 2 for s in sizes), max(sizes, default=0)))
    assert [(int(a), int(b)) for a, b in zip(cp, top, strict=True)] == want


def test_a_repeated_node_fails():
    with pytest.raises(ValueError):
        K.connectivity(K.adjacency([0], [1]), [0, 0])


def test_graph_without_edges():
    m = K.metrics(K.adjacency([], [], [1, 2, 3]), [1, 2, 3])
    assert (m["anc"], m["anc_prefix_k"], m["fht_50"], m["fht_10"]) == (0, 0, 1, 1)
