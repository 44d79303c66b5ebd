"""Cut-based removal orders of one graph: bisect the largest component, take a vertex cover of the cut, go on until all parts are small."""

from __future__ import annotations

from .kernels import Adjacency, _copy, _largest, _strip


def _limit(adj: Adjacency, share: float) -> int:
    return max(1, int(share * len(adj)))


def halves(adj: Adjacency, part: list[int]) -> tuple[set[int], set[int]]:
    """The balanced start: by falling degree inside the part (smaller ids first), dealt at the middle."""
    inside = set(part)
    ranked = sorted(part, key=lambda v: (-len(adj[v] & inside), v))
    return set(ranked[: len(ranked) // 2]), set(ranked[len(ranked) // 2 :])


def bisect(adj: Adjacency, part: list[int], passes: int = 10) -> tuple[set[int], set[int]]:
    """Balanced halves by exchange passes: each pass swaps the pair of best gain over and over, each node once, and keeps the prefix of
    swaps with the largest total gain; passes end when none gains."""
    one, two = halves(adj, part)
    for _ in range(passes):
        side = dict.fromkeys(one, 0) | dict.fromkeys(two, 1)
        gain = {v: sum((side[u] != side[v]) - (side[u] == side[v]) for u in adj[v] if u in side) for v in side}
        free, swaps, total, best, upto = (set(one), set(two)), [], 0, 0, 0
        while free[0] and free[1]:
            a = min(free[0], key=lambda v: (-gain[v], v))
            b = min(free[1], key=lambda v: (-gain[v] + 2 * (v in adj[a]), v))
            total += gain[a] + gain[b] - 2 * (b in adj[a])
            swaps.append((a, b))
            if total > best:
                best, upto = total, len(swaps)
            for moved in (a, b):
                free[side[moved]].discard(moved)
                side[moved] ^= 1
                for u in adj[moved]:
                    if u in side:
                        gain[u] += -2 if side[u] == side[moved] else 2
        if not best:
            break
        for a, b in swaps[:upto]:
            one.symmetric_difference_update((a, b))
            two.symmetric_difference_update((a, b))
    return one, two


def cover(adj: Adjacency, one: set[int], two: set[int]) -> list[int]:
    """Ascending ids of a vertex cover of the cut edges, at most twice the least one: both ends of each edge not covered yet, in edge
    order; then, from the largest id on, nodes whose cut neighbours are all in the cover leave it."""
    cut = sorted((a, b) for a in one for b in adj[a] & two)
    chosen: set[int] = set()
    for a, b in cut:
        if a not in chosen and b not in chosen:
            chosen |= {a, b}
    for v in sorted(chosen, reverse=True):
        if (adj[v] & (two if v in one else one)) <= chosen:
            chosen.discard(v)
    return sorted(chosen)


def separators(adj: Adjacency, limit: int) -> list[int]:
    """Covers taken one after the other until the largest component has at most ``limit`` nodes; without a cut its largest degree goes."""
    left, out = _copy(adj), []
    while len(big := _largest(left)) > limit:
        gone = cover(left, *bisect(left, big)) or [min(big, key=lambda v: (-len(left[v]), v))]
        for v in gone:
            _strip(left, v)
        out += gone
    return out


def _rest(adj: Adjacency, removed: list[int]) -> list[int]:
    return removed + sorted(set(adj) - set(removed), key=lambda v: (-len(adj[v]), v))


def by_ratio_cut(adj: Adjacency, share: float = 0.15) -> list[int]:
    """Separators, then the others by falling original degree."""
    return _rest(adj, separators(adj, _limit(adj, share)))


def put_back(adj: Adjacency, removed: list[int], limit: int) -> list[int]:
    """Removals that stay when, last first, each returns if the component it then makes has at most ``limit`` nodes (all others have
    no more than that already). One union-find pass."""
    gone = set(removed)
    parent = {v: v for v in adj if v not in gone}
    size = dict.fromkeys(parent, 1)

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    def link(a, b):
        if (a := root(a)) != (b := root(b)):
            parent[b] = a
            size[a] += size[b]

    for v in list(parent):
        for u in adj[v]:
            if u in parent:
                link(v, u)
    stay = []
    for v in reversed(removed):
        near = {root(u) for u in adj[v] if u in parent}
        if 1 + sum(size[r] for r in near) <= limit:
            parent[v], size[v] = v, 1
            for r in near:
                link(v, r)
        else:
            stay.append(v)
    return stay[::-1]


def by_cut_reinsertion(adj: Adjacency, share: float = 0.15) -> list[int]:
    """As ``by_ratio_cut``, after putting back what leaves all components small."""
    limit = _limit(adj, share)
    return _rest(adj, put_back(adj, separators(adj, limit), limit))
