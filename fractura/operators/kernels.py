"""Sequential kernels for one graph: adaptive removal orders and the scoring of orders.

An adaptive order is inherently sequential within a graph; Spark runs graphs, strategies and conditions side by side.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import deque
from collections.abc import Callable

import numpy as np

Adjacency = dict[int, set[int]]


def adjacency(src, dst, among=()) -> Adjacency:
    adj: Adjacency = {int(v): set() for v in among}
    for a, b in zip(src, dst, strict=True):
        if a != b:
            adj.setdefault(int(a), set()).add(int(b))
            adj.setdefault(int(b), set()).add(int(a))
    return dict(sorted(adj.items()))


def connectivity(adj: Adjacency, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Connected pairs and largest component after 0, 1, ..., N removals.

    Read backwards, removals add nodes, so one union-find pass gives all steps: an edge lives until its first end goes.
    """
    if sorted(order) != sorted(adj):
        raise ValueError("an order must hold each node once")
    parent, size = {}, {}
    n = len(order)
    pairs, largest, cp, top = np.zeros(n + 1), np.zeros(n + 1, np.int64), 0, 0

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for step in range(n, 0, -1):
        v = order[step - 1]
        parent[v], size[v] = v, 1
        for u in adj[v]:
            if u in parent:
                a, b = root(v), root(u)
                if a != b:
                    cp += size[a] * size[b]
                    if size[a] < size[b]:
                        a, b = b, a
                    parent[b] = a
                    size[a] += size[b]
        top = max(top, size[root(v)])
        pairs[step - 1], largest[step - 1] = cp, top
    return pairs, largest


def metrics(adj: Adjacency, order: list[int], share: float = 0.15) -> dict[str, float]:
    """ANC, its prefix form, first hitting times of one half and one tenth (1-based; N if never), and the largest component after k."""
    cp, top = connectivity(adj, order)
    n = len(order)
    k = max(1, int(share * n))
    if n == 0 or cp[0] == 0:
        return {"anc": 0.0, "anc_prefix_k": 0.0, "fht_50": 1 if n else 0, "fht_10": 1 if n else 0, "lcc_at_k": float(top[k]) / n if n else 0.0, "k": k}
    ratio = cp[1:] / cp[0]
    hit = lambda t: int(np.flatnonzero(ratio <= t)[0]) + 1 if (ratio <= t).any() else n
    return {"anc": float(ratio.sum() / n), "anc_prefix_k": float(ratio[:k].sum() / k), "fht_50": hit(0.5), "fht_10": hit(0.1), "lcc_at_k": float(top[k]) / n, "k": k}


def _strip(adj: Adjacency, v: int) -> None:
    for u in adj.pop(v):
        adj[u].discard(v)


def _copy(adj: Adjacency) -> Adjacency:
    return {v: set(s) for v, s in adj.items()}


def by_degree(adj: Adjacency) -> list[int]:
    """Adaptive: always the node of most remaining neighbours, the smallest on ties. A heap with outdated entries skipped."""
    adj, out = _copy(adj), []
    heap = [(-len(s), v) for v, s in adj.items()]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v not in adj or -d != len(adj[v]):
            continue
        near = adj[v]
        _strip(adj, v)
        out.append(v)
        for u in near:
            heapq.heappush(heap, (-len(adj[u]), u))
    return out


def _two_core(adj: Adjacency) -> Adjacency:
    core, weak = _copy(adj), [v for v, s in adj.items() if len(s) < 2]
    while weak:
        v = weak.pop()
        if v in core:
            near = core[v]
            _strip(core, v)
            weak += [u for u in near if len(core[u]) < 2]
    return core


def decycle(adj: Adjacency) -> list[int]:
    """Removes the node of highest degree inside the 2-core until there is none. A heap with outdated entries skipped."""
    core, out = _two_core(adj), []
    heap = [(-len(s), v) for v, s in core.items()]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v not in core or -d != len(core[v]):
            continue
        out.append(v)
        touched = set(core[v])
        _strip(core, v)
        weak = [u for u in touched if len(core[u]) < 2]
        while weak:
            u = weak.pop()
            if u in core:
                more = core[u]
                _strip(core, u)
                touched |= more
                weak += [w for w in more if len(core[w]) < 2]
        for u in touched:
            if u in core:
                heapq.heappush(heap, (-len(core[u]), u))
    return out


def by_core(adj: Adjacency) -> list[int]:
    """2-core removals, then all others by remaining degree in one sort."""
    out, left = decycle(adj), _copy(adj)
    for v in out:
        _strip(left, v)
    return out + sorted(left, key=lambda v: (-len(left[v]), v))


def _ball(adj: Adjacency, v: int, reach: int) -> dict[int, int]:
    seen, queue = {v: 0}, deque([v])
    while queue:
        x = queue.popleft()
        if seen[x] < reach:
            for u in adj[x]:
                if u not in seen:
                    seen[u] = seen[x] + 1
                    queue.append(u)
    return seen


def by_influence(adj: Adjacency, reach: int = 3) -> list[int]:
    """Collective influence: (d - 1) times the sum of d' - 1 over nodes at distance ``reach``; only the ball around a removal is rescored."""
    adj, out = _copy(adj), []

    def score(v: int) -> int:
        if len(adj[v]) <= 1:
            return 0
        return (len(adj[v]) - 1) * sum(len(adj[u]) - 1 for u, d in _ball(adj, v, reach).items() if d == reach)

    value = {v: score(v) for v in adj}
    heap = [(-s, v) for v, s in value.items()]
    heapq.heapify(heap)
    while heap:
        s, v = heapq.heappop(heap)
        if v not in adj or -s != value[v]:
            continue
        touched = [u for u in _ball(adj, v, reach + 1) if u != v]
        _strip(adj, v)
        out.append(v)
        for u in touched:
            new = score(u)
            if new != value[u]:
                value[u] = new
                heapq.heappush(heap, (-new, u))
    return out


def closeness_of(adj: Adjacency) -> dict[int, float]:
    out, n = {}, len(adj)
    for v in adj:
        d = _ball(adj, v, n)
        far, r = sum(d.values()), len(d)
        out[v] = (r - 1) / (n - 1) * (r - 1) / far if far and n > 1 else 0.0
    return out


def pagerank_of(adj: Adjacency, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> dict[int, float]:
    names = list(adj)
    at, n = {v: k for k, v in enumerate(names)}, len(adj)
    a = np.array([at[v] for v, s in adj.items() for _ in s], np.int64)
    b = np.array([at[u] for s in adj.values() for u in s], np.int64)
    deg = np.array([len(s) for s in adj.values()], float)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        share = np.divide(rank, deg, out=np.zeros(n), where=deg > 0)
        new = (1 - damping) / n + damping * (np.bincount(b, share[a], n) + rank[deg == 0].sum() / n)
        if np.abs(new - rank).sum() < n * tolerance:
            return dict(zip(names, new.tolist(), strict=True))
        rank = new
    raise ValueError("no convergence")


def eigenvector_of(adj: Adjacency, tolerance: float = 1e-6, rounds: int = 1000) -> dict[int, float]:
    """Power iteration on A + I, of length 1, from equal parts."""
    names, n = list(adj), len(adj)
    at = {v: k for k, v in enumerate(names)}
    a = np.array([at[v] for v, s in adj.items() for _ in s], np.int64)
    b = np.array([at[u] for s in adj.values() for u in s], np.int64)
    x = np.full(n, 1 / max(1, n))
    for _ in range(rounds):
        new = x + np.bincount(b, x[a], n)
        new = new / (np.linalg.norm(new) or 1)
        if np.abs(new - x).sum() < n * tolerance:
            return dict(zip(names, new.tolist(), strict=True))
        x = new
    if not n:
        return {}
    raise ValueError("no convergence")


def betweenness_of(adj: Adjacency) -> dict[int, float]:
    """Exact, unnormalised, each pair once: shortest-path counts forward, dependencies backward, from every source."""
    total = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, paths, order, queue = {s: 0}, dict.fromkeys(adj, 0.0), [], deque([s])
        paths[s] = 1.0
        while queue:
            v = queue.popleft()
            order.append(v)
            for u in adj[v]:
                if u not in dist:
                    dist[u] = dist[v] + 1
                    queue.append(u)
                if dist[u] == dist[v] + 1:
                    paths[u] += paths[v]
        need = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in adj[v]:
                if dist[u] == dist[v] + 1:
                    need[v] += paths[v] / paths[u] * (1 + need[u])
            if v != s:
                total[v] += need[v] / 2
    return total


def _adaptive(centrality: Callable[[Adjacency], dict[int, float]], slack: float = 1e-12) -> Callable[[Adjacency], list[int]]:
    def order(adj: Adjacency) -> list[int]:
        left, out = _copy(adj), []
        while left:
            c = centrality(left)
            top = max(c.values())
            v = min(x for x in c if c[x] >= top - slack)
            out.append(v)
            _strip(left, v)
        return out

    return order


def _seeded(key: Callable[[int, int, int], tuple]) -> Callable[[Adjacency], list[int]]:
    """Adaptive on the original graph: key(unvisited neighbours, visited neighbours, degree), largest first, smallest id on ties."""

    def order(adj: Adjacency) -> list[int]:
        free, out = set(adj), []
        open_ = {v: len(s) for v, s in adj.items()}
        heap = [(tuple(-x for x in key(open_[v], 0, len(adj[v]))), v) for v in adj]
        heapq.heapify(heap)
        while heap:
            k, v = heapq.heappop(heap)
            if v not in free or k != tuple(-x for x in key(open_[v], len(adj[v]) - open_[v], len(adj[v]))):
                continue
            free.discard(v)
            out.append(v)
            for u in adj[v]:
                if u in free:
                    open_[u] -= 1
                    heapq.heappush(heap, (tuple(-x for x in key(open_[u], len(adj[u]) - open_[u], len(adj[u]))), u))
        return out

    return order


def by_rule(adj: Adjacency, rule: Callable[[Adjacency, list[int]], int], residual: bool = False, robust: bool = False) -> list[int]:
    """An order by a caller's rule(graph, nodes left) -> next node. The rule sees the whole graph, or with ``residual`` what is left of
    it. Where it raises, the node left of the largest degree in the whole graph goes, the smallest on ties; so it does with ``robust``
    where the rule names a node that is unknown or gone (with ``residual`` the first node left), which else is an error."""
    left, seen, out = dict.fromkeys(adj), _copy(adj), []
    while left:
        names = list(left)
        fallback = min(names, key=lambda v: (-len(adj[v]), v))
        try:
            v = rule(seen, names)
        except Exception:  # noqa: BLE001
            v = fallback
        if v not in left:
            if not (robust or residual):
                raise ValueError(f"the rule names {v!r}, which is unknown or gone")
            v = names[0] if residual else fallback
        del left[v]
        out.append(v)
        if residual:
            _strip(seen, v)
    return out


def by_random_ties(adj: Adjacency, centrality: Callable[[Adjacency], dict[int, float]], seed: int) -> list[int]:
    """Adaptive by a centrality; ties are broken at random."""
    rng, left, out = random.Random(seed), _copy(adj), []
    while left:
        c = centrality(left)
        top = max(c.values())
        out.append(v := rng.choice(sorted(x for x in c if c[x] >= top - 1e-12)))
        _strip(left, v)
    return out


def degree_of(adj: Adjacency) -> dict[int, float]:
    return {v: float(len(s)) for v, s in adj.items()}


CENTRALITIES = {"degree": degree_of, "betweenness": betweenness_of, "closeness": closeness_of, "pagerank": pagerank_of}


def weighted_eigenvector_of(adj: Adjacency, weight: dict[tuple[int, int], float], tolerance: float = 1e-6, rounds: int = 5000) -> dict[int, float]:
    """Of the matrix of weights (by (smaller, larger) pair), of length 1: power iteration on it and the identity, and where that does not
    converge the first vector of a dense solver."""
    names = list(adj)
    at, n = {v: k for k, v in enumerate(names)}, len(adj)
    if not n:
        return {}
    a = np.array([at[v] for v, s in adj.items() for _ in s], np.int64)
    b = np.array([at[u] for s in adj.values() for u in s], np.int64)
    w = np.array([weight[min(v, u), max(v, u)] for v, s in adj.items() for u in s], float)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = x + np.bincount(b, x[a] * w, n)
        new = new / (np.linalg.norm(new) or 1)
        if np.abs(new - x).sum() < n * tolerance:
            return dict(zip(names, new.tolist(), strict=True))
        x = new
    dense = np.zeros((n, n))
    np.add.at(dense, (a, b), w)
    top = np.abs(np.linalg.eigh(dense)[1][:, -1])
    return dict(zip(names, top.tolist(), strict=True))


def _reinsert_forest(adj: Adjacency, removed: list[int]) -> list[int]:
    """Puts removals back, last first, where the graph stays a forest: the neighbours present lie in pairwise different trees."""
    parent = {v: v for v in adj}

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    present = set(adj) - set(removed)
    for v in present:
        for u in adj[v]:
            if u in present:
                parent[root(u)] = root(v)
    kept = []
    for v in reversed(removed):
        roots = [root(u) for u in adj[v] if u in present]
        if len(roots) == len(set(roots)):
            present.add(v)
            for r in roots:
                parent[r] = v
        else:
            kept.append(v)
    return kept[::-1]


def _largest(adj: Adjacency) -> list[int]:
    seen, best = set(), []
    for v in adj:
        if v not in seen:
            c = list(_ball(adj, v, len(adj)))
            seen.update(c)
            if len(c) > len(best):
                best = c
    return best


def _tree_break(adj: Adjacency, removed: list[int], limit: int) -> list[int]:
    left, out = _copy(adj), list(removed)
    for v in removed:
        _strip(left, v)
    while len(big := _largest(left)) > limit:
        v = min(big, key=lambda x: (-len(left[x]), x))
        out.append(v)
        _strip(left, v)
    return out + sorted(left, key=lambda v: (-len(adj[v]), v))


def by_min_sum(adj: Adjacency, share: float = 0.15) -> list[int]:
    """Decycle, put back what closes no cycle, break trees down to the target size; the rest by original degree."""
    return _tree_break(adj, _reinsert_forest(adj, decycle(adj)), max(1, int(share * len(adj))))


def by_belief(adj: Adjacency, share: float = 0.15) -> list[int]:
    """As ``by_min_sum``, decycling by betweenness in the 2-core."""
    core, out = _two_core(adj), []
    while core:
        c = betweenness_of(core)
        v = max(sorted(c), key=lambda x: c[x])
        out.append(v)
        _strip(core, v)
        core = _two_core(core)
    return _tree_break(adj, _reinsert_forest(adj, out), max(1, int(share * len(adj))))


STRATEGIES: dict[str, Callable[[Adjacency], list[int]]] = {
    "degree": by_degree,
    "core": by_core,
    "influence": by_influence,
    "betweenness": _adaptive(betweenness_of),
    "closeness": _adaptive(closeness_of),
    "pagerank": _adaptive(pagerank_of),
    "min_sum": by_min_sum,
    "belief": by_belief,
    "seed_unvisited": _seeded(lambda u, w, d: (u,)),
    "seed_fewest_visited": _seeded(lambda u, w, d: (u, -w)),
    "seed_sqrt": _seeded(lambda u, w, d: (u * math.sqrt(d),)),
    "seed_log": _seeded(lambda u, w, d: (u + math.log(d) if d else float("-inf"),)),
}
