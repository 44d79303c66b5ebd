"""Samples of k nodes: walks, one task a graph (breadth first, forest fire, snowball, by degree with neighbours), by communities, and the repair
of samples in parts."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractura.session import stored

from . import kernels
from .communities import last_level, louvain, shares
from .graph import components, degree, symmetric
from .kernels import Adjacency


def _ranked(adj: Adjacency, among=None) -> list[int]:
    return sorted(adj if among is None else among, key=lambda v: (-len(adj[v]), v))


def _fill(adj: Adjacency, got: list[int], k: int, rng: random.Random) -> list[int]:
    """Tops up with random nodes not taken yet."""
    rest = sorted(set(adj) - set(got))
    return got + rng.sample(rest, min(len(rest), max(0, k - len(got))))


def breadth_first(adj: Adjacency, k: int, rng: random.Random) -> list[int]:
    """First in, first out from the node of highest degree."""
    if not adj:
        return []
    seen, queue, out = {v := _ranked(adj)[0]}, deque([v]), []
    while queue and len(out) < k:
        out.append(v := queue.popleft())
        for u in sorted(adj[v] - seen):
            seen.add(u)
            queue.append(u)
    return _fill(adj, out, k, rng)


def largest_breadth_first(adj: Adjacency, k: int, rng: random.Random) -> list[int]:
    """Inside the largest component; all nodes if there are no more than k, and its first k nodes if it is smaller than that."""
    if len(adj) <= k:
        return list(adj)
    big = set(kernels._largest(adj))
    return sorted(big)[:k] if len(big) < k else breadth_first({v: adj[v] for v in sorted(big)}, k, rng)


def degree_first(adj: Adjacency, k: int, rng: random.Random) -> list[int]:
    """Nodes by falling degree, each with its two first neighbours."""
    out: dict[int, None] = {}
    for v in _ranked(adj):
        for u in (v, *sorted(adj[v])[:2]):
            if len(out) < k:
                out[u] = None
    return _fill(adj, list(out), k, rng)


def forest_fire(adj: Adjacency, k: int, rng: random.Random, burn: float = 0.7) -> list[int]:
    """From a drawn node. Neighbours, highest degrees first, catch fire with burn x min(0.9, 0.3 + 0.6 d / largest d). A fire that dies starts
    anew at the node of highest degree that has burnt and has a neighbour that has not; where there is none, at a drawn node."""
    if not adj:
        return []
    top, out = max(map(len, adj.values())) or 1, {rng.choice(sorted(adj)): None}
    queue = deque(out)
    while len(out) < min(k, len(adj)):
        if not queue:
            edge = [v for v in out if any(u not in out for u in adj[v])]
            if edge:
                queue.append(_ranked(adj, edge)[0])
            else:
                out[v := rng.choice(sorted(set(adj) - set(out)))] = None
                queue.append(v)
                continue
        for u in _ranked(adj, [u for u in adj[queue.popleft()] if u not in out]):
            if len(out) < k and rng.random() < burn * min(0.9, 0.3 + 0.6 * len(adj[u]) / top):
                out[u] = None
                queue.append(u)
    return list(out)


def snowball(adj: Adjacency, k: int, rng: random.Random, depth: int = 2) -> list[int]:
    """Waves of ``depth`` from the highest degrees left; a node passes on to at most k / 10 neighbours (one at least)."""
    out, seen, quota = [], set(), max(1, k // 10)
    for seed in _ranked(adj):
        if len(out) >= k:
            break
        if seed in seen:
            continue
        seen.add(seed)
        queue = deque([(seed, 0)])
        while queue and len(out) < k:
            v, d = queue.popleft()
            out.append(v)
            near = sorted(adj[v] - seen) if d < depth else []
            for u in rng.sample(near, min(quota, len(near))):
                seen.add(u)
                queue.append((u, d + 1))
    return out


def hybrid(adj: Adjacency, k: int, rng: random.Random) -> list[int]:
    """A third drawn from the top twentieth by degree (ties at its end included), a third by a walk outwards from a random node, the
    rest by degree."""
    if not adj:
        return []
    ranked = _ranked(adj)
    least = len(adj[ranked[int(len(ranked) * 0.05)]])
    top = [v for v in ranked if len(adj[v]) >= least]
    out = dict.fromkeys(rng.sample(top, min(len(top), k // 3)))
    start = rng.choice(sorted(adj))
    seen, queue = {start: None}, deque([start])
    while queue and len(seen) < k // 3:
        near = sorted(adj[queue.popleft()])
        rng.shuffle(near)
        for u in near:
            if u not in seen and len(seen) < k // 3:
                seen[u] = None
                queue.append(u)
    return list(dict.fromkeys([*out, *seen, *ranked]))[:k]


def by_core(adj: Adjacency, k: int, rng: random.Random) -> list[int]:
    """By falling core number, in random order inside a number."""
    core, left, level = {}, kernels._copy(adj), 0
    while left:
        v = min(left, key=lambda x: (len(left[x]), x))
        level = max(level, len(left[v]))
        core[v] = level
        kernels._strip(left, v)
    draws = {v: rng.random() for v in sorted(adj)}
    return sorted(adj, key=lambda v: (-core[v], draws[v]))[:k]


SAMPLERS: dict[str, Callable[[Adjacency, int, random.Random], list[int]]] = {
    "breadth_first": breadth_first,
    "largest_breadth_first": largest_breadth_first,
    "degree_first": degree_first,
    "forest_fire": forest_fire,
    "snowball": snowball,
    "hybrid": hybrid,
    "by_core": by_core,
}


QUALITY = "graph_id string, sampler string, n_nodes long, n_edges long, max_degree long, mean_degree double, clustering double, connected boolean, avg_path double"


#: Samplers whose samples are repaired: their nodes need not hang together.
REPAIRED = ("degree_first", "forest_fire", "snowball", "by_community", "hybrid", "by_core")


def repaired(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """(graph_id, sampler, node): of each sample its largest connected part (the one of the smallest node on ties). Where that has less than
    half of the sample, the other nodes join with a shortest path to it each, as far as the graph has one: one search from all nodes of
    the part at once, in which every node keeps its smallest neighbour that is nearer, and a walk back."""
    key = ["graph_id", "sampler"]
    picked = stored(sampled.select(*key, "node"))
    name = F.concat_ws("|", "sampler", "graph_id")
    one = lambda end: picked.select(*key, F.col("node").alias(end))
    inside = edges.join(one("src"), ["graph_id", "src"]).join(one("dst"), [*key, "dst"]).select(name.alias("graph_id"), "src", "dst")
    part = components(inside).withColumnRenamed("graph_id", "name")
    own = stored(picked.withColumn("name", name).join(part, ["name", "node"], "left").withColumn("component", F.coalesce("component", "node")).drop("name"))
    sizes = own.groupBy(*key, "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy(*key).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("best"), F.max("size").alias("size"), F.sum("size").alias("n"))
    known = stored(own.join(best, key).select(*key, "node", (F.col("component") == F.col("best")).alias("in"), (F.col("size") < F.floor(F.col("n") / 2)).alias("small")))
    kept = known.where("in").select(*key, "node")
    apart = known.where("small and not in").select(*key, "node")
    both = stored(symmetric(edges))
    front = stored(known.where("small and in").select(*key, "node"))
    seen = front.withColumn("back", F.lit(None).cast("long"))
    while front.limit(1).count():
        grown = front.join(both, ["graph_id", "node"]).groupBy(*key, F.col("other").alias("to")).agg(F.min("node").alias("back")).withColumnRenamed("to", "node")
        new = stored(grown.join(seen.select(*key, "node"), [*key, "node"], "left_anti"))
        seen, front = seen.unionByName(new.select(*key, "node", "back")), new.select(*key, "node")
    walk = apart
    while True:
        step = stored(walk.join(seen.where("back is not null"), [*key, "node"]).select(*key, "node", "back"))
        if not step.limit(1).count():
            return kept.distinct()
        kept = kept.unionByName(step.select(*key, "node"))
        walk = step.select(*key, F.col("back").alias("node")).distinct()


def sample(edges: DataFrame, names: list[str], k: int, seed: int = 42) -> DataFrame:
    """(graph_id, sampler, node): k nodes of each graph (all, if it has fewer), the same for the same seed; ``REPAIRED`` ones may lose or
    gain some so as to hang together. ``by_community`` takes its share of each community by modularity."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        adj, name = kernels.adjacency(pdf.src, pdf.dst), pdf.sampler.iloc[0]
        got = SAMPLERS[name](adj, k, random.Random(seed))
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "sampler": name, "node": sorted(got)})

    walks = F.array(*(F.lit(x) for x in names if x != "by_community"))
    found = edges.withColumn("sampler", F.explode(walks)).groupBy("graph_id", "sampler").applyInPandas(one, "graph_id string, sampler string, node long") if set(names) - {"by_community"} else None
    if "by_community" in names:
        shared = shares(degree(edges), last_level(louvain(edges)), k).select("graph_id", F.lit("by_community").alias("sampler"), "node")
        found = shared if found is None else found.unionByName(shared)
    found = stored(found)
    mends = F.col("sampler").isin(*REPAIRED)
    return found.where(~mends).unionByName(repaired(edges, found.where(mends)))


def quality(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """Of each sample: nodes, edges, largest and mean degree, mean clustering, whether it is connected, and the average path if so.
    One task a sample, whose size the sampler bounds."""
    pick = sampled.select("graph_id", "sampler", "node")
    inside = edges.join(pick.withColumnRenamed("node", "src"), ["graph_id", "src"]).join(pick.withColumnRenamed("node", "dst"), ["graph_id", "sampler", "dst"])

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        adj = kernels.adjacency(left.src, left.dst, right.node)
        size = [len(s) for s in adj.values()]
        tri = [sum(len(adj[u] & s) for u in s) / (len(s) * (len(s) - 1)) if len(s) > 1 else 0.0 for s in adj.values()]
        balls = [kernels._ball(adj, v, len(adj)) for v in adj]
        whole = all(len(b) == len(adj) for b in balls)
        path = sum(sum(b.values()) for b in balls) / (len(adj) * (len(adj) - 1)) if whole and len(adj) > 1 else None
        row = (right.graph_id.iloc[0], right.sampler.iloc[0], len(adj), sum(size) // 2, max(size), sum(size) / len(size), sum(tri) / len(tri), whole, path)
        return pd.DataFrame([row], columns=[c.split()[0] for c in QUALITY.split(", ")])

    key = ("graph_id", "sampler")
    return inside.select(*key, "src", "dst").groupBy(*key).cogroup(pick.select(*(F.col(c).alias(c) for c in pick.columns)).groupBy(*key)).applyInPandas(one, QUALITY)
