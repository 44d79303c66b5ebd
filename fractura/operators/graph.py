"""Graph primitives over edges(graph_id, src, dst), src < dst and distinct, and nodes(graph_id, node)."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fractura.session import settle, stored

from .blocks import BLOCK, grouped, pack, product, tiles, unpack


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple edges: reversed and repeated ones collapse, self-loops go."""
    return edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(graph_id, node, other): each edge from both ends, from one scan."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select("graph_id", ends.alias("e")).select("graph_id", "e.node", "e.other")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def degree(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, degree); isolated nodes of ``among`` have 0."""
    d = symmetric(edges).groupBy("graph_id", "node").agg(F.count("*").alias("degree"))
    if among is None:
        return d
    return among.join(d, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def strength(edges: DataFrame, weight: str = "weight") -> DataFrame:
    both = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"), weight)
    return both.groupBy("graph_id", "node").agg(F.sum(weight).alias("strength"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Average degree 2m/n and the population variance of degrees, per graph."""
    return degree(edges).groupBy("graph_id").agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("avg_degree"), F.var_pop("degree").alias("degree_variance"))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(graph_id, node)."""
    for end in ("src", "dst"):
        edges = edges.join(keep.select("graph_id", F.col("node").alias(end)), ["graph_id", end], "left_semi")
    return edges.select("graph_id", "src", "dst")


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(gone.select("graph_id", F.col("node").alias(end)), ["graph_id", end], "left_anti")
    return edges.select("graph_id", "src", "dst")


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(canonical(gone), ["graph_id", "src", "dst"], "left_anti")


def with_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return canonical(edges.unionByName(more))


def corners(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, a): each triangle once. Edges point from the end of smaller (degree, id) to the larger, so that a hub's many
    neighbours don't meet pair by pair."""
    d = degree(edges)
    e = edges.join(d.toDF("graph_id", "src", "ds"), ["graph_id", "src"]).join(d.toDF("graph_id", "dst", "dd"), ["graph_id", "dst"])
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select("graph_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedge = e.alias("x").join(e.alias("y"), (F.col("x.graph_id") == F.col("y.graph_id")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b")))
    wedge = wedge.select("x.graph_id", "x.a", F.col("x.b").alias("src"), F.col("y.b").alias("dst"))
    return wedge.join(edges.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"])


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, node, triangles) for nodes in at least one."""
    return corners(edges).select("graph_id", F.explode(F.array("a", "src", "dst")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("triangles"))


def weighted_clustering(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(graph_id, node, clustering): cube roots of the products of a triangle's weights, as shares of the graph's largest weight,
    summed up over a node's triangles and divided by d (d - 1) / 2; 0 below two neighbours."""
    top = edges.groupBy("graph_id").agg(F.max(weight).alias("top"))
    shares = edges.join(top, "graph_id").select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), (F.col(weight) / F.col("top")).alias("w"))
    rows = corners(edges).withColumn("product", F.lit(1.0))
    for x, y in (("src", "dst"), ("a", "src"), ("a", "dst")):
        ends = rows.withColumn("u", F.least(x, y)).withColumn("v", F.greatest(x, y))
        rows = ends.join(shares, ["graph_id", "u", "v"]).withColumn("product", F.col("product") * F.col("w")).drop("u", "v", "w")
    total = rows.select("graph_id", F.explode(F.array("a", "src", "dst")).alias("node"), F.cbrt("product").alias("x")).groupBy("graph_id", "node").agg(F.sum("x").alias("x"))
    d = F.col("degree")
    c = F.when(d < 2, 0.0).otherwise(2 * F.coalesce("x", F.lit(0.0)) / (d * (d - 1)))
    return degree(edges).join(total, ["graph_id", "node"], "left").select("graph_id", "node", c.alias("clustering"))


def clustering(edges: DataFrame) -> DataFrame:
    """(graph_id, node, clustering): 2t / (d (d - 1)), 0 below two neighbours."""
    d = F.col("degree")
    c = F.when(d < 2, F.lit(0.0)).otherwise(2 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1)))
    return degree(edges).join(triangles(edges), ["graph_id", "node"], "left").select("graph_id", "node", c.alias("clustering"))


def fragility(edges: DataFrame) -> DataFrame:
    """Share of a node's neighbours whose degree is at most their graph's average."""
    d = degree(edges)
    avg = d.groupBy("graph_id").agg(F.avg("degree").alias("avg_degree"))
    near = symmetric(edges).join(d.toDF("graph_id", "other", "degree"), ["graph_id", "other"]).join(avg, "graph_id")
    return near.groupBy("graph_id", "node").agg(F.avg(F.when(F.col("degree") <= F.col("avg_degree"), 1.0).otherwise(0.0)).alias("fragility"))


def components(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): the smallest node of each component; hooking and label halving until nothing changes."""
    both = settle(symmetric(edges))
    label = settle(both.groupBy("graph_id", "node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        near = both.join(label.select("graph_id", F.col("node").alias("other"), F.col("component").alias("c")), ["graph_id", "other"]).groupBy("graph_id", "node").agg(F.min("c").alias("near"))
        hook = label.join(near, ["graph_id", "node"]).select("graph_id", "node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = hook.select("graph_id", F.col("node").alias("to"), F.col("to").alias("next"))
        new = settle(hook.join(jump, ["graph_id", "to"], "left").select("graph_id", "node", "old", F.least("to", F.coalesce("next", "to")).alias("component")))
        if not new.where("component <> old").limit(1).count():
            return new.select("graph_id", "node", "component")
        label = new.select("graph_id", "node", "component")


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("graph_id", "component").agg(F.count("*").alias("size"))


def pairwise_connectivity(edges: DataFrame) -> DataFrame:
    """Per graph: components, size of the largest, connected pairs, whether it is connected and whether a forest."""
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    s = component_sizes(edges).groupBy("graph_id").agg(F.count("*").alias("n_components"), F.max("size").alias("largest"), F.sum(F.expr("size * (size - 1) div 2")).alias("connected_pairs"), F.sum("size").alias("n"))
    return s.join(m, "graph_id").select("graph_id", "n_components", "largest", "connected_pairs", (F.col("n_components") == 1).alias("connected"), (F.col("m") == F.col("n") - F.col("n_components")).alias("forest"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component; ties: the one with the smallest node."""
    c = components(edges)
    sizes = c.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy("graph_id").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    return c.join(best, ["graph_id", "component"]).select("graph_id", "node")


def k_core(edges: DataFrame, k: int = 2) -> DataFrame:
    """Nodes left when nodes of degree below k are removed until none is left to remove."""
    left = settle(edges)
    while True:
        weak = settle(degree(left).where(F.col("degree") < k))
        if not weak.limit(1).count():
            return nodes(left)
        left = settle(without_nodes(left, weak))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(graph_id, node, core): the largest k such that the node is in the k-core. Every round a node's number becomes the largest h such
    that h neighbours have h or more, from counts by number (a hub's neighbours are summed up before they meet)."""
    both = settle(symmetric(edges))
    core = settle(degree(edges).withColumnRenamed("degree", "core"))
    while True:
        near = both.join(core.toDF("graph_id", "other", "theirs"), ["graph_id", "other"]).join(core, ["graph_id", "node"])
        counts = near.groupBy("graph_id", "node", "core", F.least("core", "theirs").alias("v")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("graph_id", "node").orderBy(F.desc("v")))
        new = counts.withColumn("h", F.least("v", above)).groupBy("graph_id", "node").agg(F.max("h").alias("h"), F.first("core").alias("core"))
        new = settle(new)
        if not new.where("h <> core").limit(1).count():
            return new.select("graph_id", "node", "core")
        core = new.select("graph_id", "node", F.col("h").alias("core"))


def bfs(edges: DataFrame, sources: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(graph_id, source, node, distance) up to the cut-off, or until no node is new: a frontier join a round, known nodes taken out by
    anti join."""
    both = settle(symmetric(edges))
    seen = settle(sources.select("graph_id", F.col("node").alias("source"), "node", F.lit(0).alias("distance")))
    front = seen
    for step in itertools.count(1) if cutoff is None else range(1, cutoff + 1):
        grown = front.join(both, ["graph_id", "node"]).select("graph_id", "source", F.col("other").alias("node")).distinct()
        front = settle(grown.join(seen, ["graph_id", "source", "node"], "left_anti").select("graph_id", "source", "node", F.lit(step).alias("distance")))
        if cutoff is None and not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def boundary(edges: DataFrame, sources: DataFrame, radius: int) -> DataFrame:
    """(graph_id, source, node, distance) of the nodes at a distance of exactly ``radius`` (1 or more). A node of one neighbour leads nowhere
    new, so that before the last round only others are reached; what a round reaches is new but for the two rounds before."""
    both = stored(symmetric(edges))
    inner = both.groupBy("graph_id", F.col("node").alias("other")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    inward = stored(both.join(inner, ["graph_id", "other"], "left_semi"))
    front = known = stored(sources.select("graph_id", F.col("node").alias("source"), "node"))
    for step in range(1, radius + 1):
        grown = front.join(both if step == radius else inward, ["graph_id", "node"]).select("graph_id", "source", F.col("other").alias("node")).distinct()
        last, front = front, stored(grown.join(known, ["graph_id", "source", "node"], "left_anti"))
        known = last.unionByName(front)
    return front.withColumn("distance", F.lit(radius))


def closeness(edges: DataFrame) -> DataFrame:
    """Reachable-set scaled closeness of each node, from the distances between all nodes of a component."""
    d = bfs(edges, nodes(edges))
    n = nodes(edges).groupBy("graph_id").agg(F.count("*").alias("n"))
    r = d.groupBy("graph_id", "source").agg(F.count("*").alias("r"), F.sum("distance").alias("far")).join(n, "graph_id")
    one = F.lit(1.0)
    return r.select("graph_id", F.col("source").alias("node"), F.when(F.col("far") == 0, 0.0).otherwise((F.col("r") - one) / (F.col("n") - 1) * ((F.col("r") - one) / F.col("far"))).alias("closeness"))


def dependencies(both: DataFrame, sources: DataFrame) -> DataFrame:
    """(graph_id, source, node, need) for each node that a source (graph_id, node) reaches: the sum, over the nodes behind it, of the shares of
    shortest paths from the source that lead through it. Paths are counted forward from all sources at once, a frontier a round, and
    dependencies summed up backward, so that there are as many rows as sources times nodes they reach. both: ``symmetric`` edges."""
    front = settle(sources.select("graph_id", F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("graph_id", "source", "node")
    while True:
        grown = front.join(both, ["graph_id", "node"]).groupBy("graph_id", "source", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        front = settle(grown.join(seen, ["graph_id", "source", "node"], "left_anti"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("graph_id", "source", "node"))
    below = levels[-1].withColumn("need", F.lit(0.0))
    total = [below]
    for level in levels[-2:0:-1]:
        down = level.join(both, ["graph_id", "node"]).join(below.select("graph_id", "source", F.col("node").alias("other"), (F.lit(1.0) + F.col("need")).alias("one"), F.col("paths").alias("theirs")), ["graph_id", "source", "other"])
        got = down.groupBy("graph_id", "source", "node").agg(F.sum(F.col("paths") / F.col("theirs") * F.col("one")).alias("need"))
        below = settle(level.join(got, ["graph_id", "source", "node"], "left").select("graph_id", "source", "node", "paths", F.coalesce("need", F.lit(0.0)).alias("need")))
        total.append(below)
    needs = total[0]
    for t in total[1:]:
        needs = needs.unionByName(t)
    return needs.select("graph_id", "source", "node", "need")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, betweenness): unnormalised, each pair once. With ``sources`` only the paths that start there count, each whole (not
    halved), which for drawn sources is a sample of the sum; ``distances.drawn_betweenness`` scales it and bounds its error."""
    needs = dependencies(settle(symmetric(edges)), nodes(edges) if sources is None else sources)
    summed = needs.groupBy("graph_id", "node").agg((F.sum("need") / (2 if sources is None else 1)).alias("betweenness"))
    return nodes(edges).join(summed, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def high_share(values: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """(graph_id, share): of nodes whose value is above its graph's interpolated quantile."""
    top = values.groupBy("graph_id").agg(F.percentile(value, F.lit(q)).alias("cut"))
    return values.join(top, "graph_id").groupBy("graph_id").agg(F.avg((F.col(value) > F.col("cut")).cast("double")).alias("share"))


def shortest_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, source, target, position, node) of one shortest path of each connected pair (graph_id, source, target): from the
    target back, always to the smallest neighbour that is one step nearer to the source."""
    both = settle(symmetric(edges))
    reach = settle(bfs(edges, pairs.select("graph_id", F.col("source").alias("node")).distinct()))
    here = settle(pairs.join(reach.withColumnRenamed("node", "target"), ["graph_id", "source", "target"]).select("graph_id", "source", "target", F.col("distance").alias("position"), F.col("target").alias("node")))
    path = here
    while True:
        before = here.join(both, ["graph_id", "node"]).select("graph_id", "source", "target", (F.col("position") - 1).alias("distance"), F.col("other").alias("node"))
        nearer = before.join(reach, ["graph_id", "source", "node", "distance"])
        here = settle(nearer.groupBy("graph_id", "source", "target", F.col("distance").alias("position")).agg(F.min("node").alias("node")))
        if not here.limit(1).count():
            return path
        path = path.unionByName(here)


def path_lengths(edges: DataFrame) -> DataFrame:
    """Average shortest path and diameter of each graph's largest component. Leaves are counted at their neighbours, so that only pairs of
    other nodes are searched: a leaf is one step farther from all others than its neighbour is."""
    inside = stored(induced(edges, largest_component(edges)))
    d = degree(inside)
    ends = symmetric(inside).join(d, ["graph_id", "node"]).where("degree = 1").join(d.toDF("graph_id", "other", "theirs"), ["graph_id", "other"])
    leaf = stored(ends.where("theirs > 1 or node > other").select("graph_id", "node", "other"))
    held = leaf.groupBy("graph_id", F.col("other").alias("node")).agg(F.count("*").alias("leaves"))
    core = stored(d.join(leaf, ["graph_id", "node"], "left_anti").join(held, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves")))
    far = bfs(without_nodes(inside, leaf), core.select("graph_id", "node"))
    far = far.join(core.toDF("graph_id", "source", "x"), ["graph_id", "source"]).join(core.toDF("graph_id", "node", "y"), ["graph_id", "node"])
    x, y, away = F.col("x"), F.col("y"), F.col("distance")
    same = F.col("source") == F.col("node")
    steps = F.when(same, 2 * x * x).otherwise((1 + x) * (1 + y) * away + x * (1 + y) + (1 + x) * y)
    most = F.when(same, F.least(x, F.lit(2))).otherwise(away + (x > 0).cast("int") + (y > 0).cast("int"))
    n = core.groupBy("graph_id").agg(F.sum(1 + F.col("leaves")).alias("n"))
    total = far.groupBy("graph_id").agg(F.sum(steps).alias("steps"), F.max(most).cast("int").alias("diameter")).join(n, "graph_id")
    return total.select("graph_id", (F.col("steps") / F.col("n") / (F.col("n") - 1)).alias("avg_path"), "diameter")


def _settled(state: DataFrame, x: str, before: str, share: float) -> bool:
    """Whether in each graph the sum of changes is below ``share`` a node."""
    moved = state.groupBy("graph_id").agg(F.sum(F.abs(F.col(x) - F.col(before))).alias("moved"), F.count("*").alias("n"))
    return not moved.where(F.isnan("moved") | (F.col("moved") >= share * F.col("n"))).limit(1).count()


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-11, among: DataFrame | None = None, most: int = 1_000) -> DataFrame:
    """(graph_id, node, rank): uniform teleport; isolated nodes of ``among`` spread their rank over all nodes.

    Rounds go on until ranks change by less than ``tolerance`` a node in each graph; an error after ``most`` of them. Links go both ways, so
    that all eigenvalues are real and within the damping: each round extrapolates from the last two (Chebyshev's weights), which takes about
    a quarter of the rounds of plain iteration.
    """
    d = degree(edges)
    every = d if among is None else degree(edges, among)
    n = every.groupBy("graph_id").agg(F.count("*").alias("n"), F.sum((F.col("degree") == 0).cast("long")).alias("alone"))
    base = ((1 - damping) / F.col("n")) / (1 - damping * F.col("alone") / F.col("n"))
    known = stored(every.join(n, "graph_id").select("graph_id", "node", "degree", base.alias("base")))
    links = stored(symmetric(edges))
    state, weight = stored(known.select("graph_id", "node", "degree", "base", F.col("base").alias("before"), F.col("base").alias("rank"))), 1.0
    for step in range(1, most + 1):
        flow = links.join(state.where("degree > 0").select("graph_id", "node", (F.col("rank") / F.col("degree")).alias("part")), ["graph_id", "node"]).groupBy("graph_id", F.col("other").alias("node")).agg(F.sum("part").alias("s"))
        plain = F.col("base") + damping * F.coalesce("s", F.lit(0.0))
        state = state.join(flow, ["graph_id", "node"], "left").select("graph_id", "node", "degree", "base", F.col("rank").alias("before"), (F.lit(weight) * (plain - F.col("before")) + F.col("before")).alias("rank"))
        weight = 1 / (1 - damping**2 / 2) if step == 1 else 1 / (1 - damping**2 * weight / 4)
        if step % 3 == 0:
            state = stored(state)
            if _settled(state, "rank", "before", tolerance):
                return state.select("graph_id", "node", "rank")
    raise RuntimeError(f"ranks still change after {most} rounds")


def _ritz(theirs: np.ndarray) -> tuple[float, np.ndarray]:
    """The largest value of a matrix among combinations of up to three vectors, and the combination of length 1. theirs: products of the
    vectors with each other, then with their images; vectors of length 0 and what others span already take no part."""
    g, h = theirs.reshape(2, 3, 3)
    some = np.flatnonzero(np.diag(g) > 0)
    d = 1 / np.sqrt(np.diag(g)[some])
    g, h = (m[np.ix_(some, some)] * d * d[:, None] for m in (g, (h + h.T) / 2))
    lengths, own = np.linalg.eigh(g)
    own = own[:, lengths > 1e-12] / np.sqrt(lengths[lengths > 1e-12])
    values, best = np.linalg.eigh(own.T @ h @ own)
    mix = np.zeros(3)
    mix[some] = own @ best[:, -1] * d
    return float(values[-1]), mix * (1 if mix[0] >= 0 else -1)


def eigenvector(edges: DataFrame, weight: str | None = None, tolerance: float = 1e-11, most: int = 5_000, block: int = BLOCK) -> DataFrame:
    """(graph_id, node, centrality): the leading eigenvector of the (weighted, not negative) adjacency matrix, of length 1.

    A round takes the best combination (Rayleigh and Ritz) of the vector, of what its image adds to it, and of the last step, until that
    changes the vector by less than ``tolerance`` a node in each graph; an error after ``most`` of them. This needs the root of the rounds of plain
    iteration where the next eigenvalues are near. A round is one product with the tiles of the graph (``blocks``), and a task holds a tile
    and few blocks of vectors. Graphs in parts of the same leading eigenvalue have no one such vector; the start decides.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    links = stored(edges.select("graph_id", ends.alias("e"), w.alias("w")).select("graph_id", "e.node", "e.other", "w"))
    every = links.select("graph_id", "node").distinct().withColumn("zero", F.lit(0))
    places = stored(static_order(every, F.col("zero")).select("graph_id", "node", (F.col("step") - 1).alias("place")))
    tiled = tiles(links, places, block)
    name = edges.schema["graph_id"].simpleString().replace(":", " ")
    vectors = [f"v{k}" for k in range(3)] + [f"a{k}" for k in range(3)]
    key = f"{name}, i long, c long, n long"
    kinds = key + "".join(f", {v} binary" for v in vectors)
    load = lambda data, n: np.zeros(n) if data is None else np.frombuffer(data)

    def met(at: tuple, parts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        r = own.iloc[0]
        n = int(min(block, r.n - at[1] * block))
        got = sum((unpack(y, n) for y in parts.y), np.zeros(n))
        if r.a0 is None:
            v, a = [load(r.v0, n), np.zeros(n), np.zeros(n)], [got, np.zeros(n), np.zeros(n)]
        else:
            v = [load(r[x], n) for x in ("v0", "v1", "v2")]
            a = [load(r.a0, n), got, load(r.a2, n)]
        products = np.concatenate([np.array(v) @ np.array(v).T, np.array(v) @ np.array(a).T]).reshape(-1)
        return pd.DataFrame({"graph_id": [at[0]], "i": [at[1]], "c": [0], "n": [r.n]} | {x: [y.tobytes()] for x, y in zip(vectors, [*v, *a], strict=True)} | {"m": [products]})

    def solved(batches):
        for t in batches:
            found = [_ritz(np.array(m)) for m in t.m]
            yield pd.DataFrame({"graph_id": t.graph_id, "value": [x for x, _ in found], "mix": [y for _, y in found]})

    def mixed(batches):
        """The vector, what its image adds, and the step, with the images of the first and the last."""
        for t in batches:
            out = []
            for r in t.itertuples():
                v, a = (np.array([np.frombuffer(getattr(r, f"{x}{k}")) for k in range(3)]) for x in "va")
                mix, step = np.array(r.mix), np.array(r.mix) * [0, 1, 1]
                x, ax = mix @ v, mix @ a
                add = ax - r.value * x
                out.append((*(y.tobytes() for y in (x, add, step @ v, ax)), None, (step @ a).tobytes(), pack(add), float(np.abs(x - v[0]).sum())))
            rows = pd.DataFrame(out, columns=[*vectors, "send", "moved"], dtype=object)
            yield pd.concat([t[["graph_id", "i", "c", "n"]].reset_index(drop=True), rows.astype({"moved": float})], axis=1)

    def begun(batches):
        for t in batches:
            first = [np.full(int(min(block, n - i * block)), n**-0.5) for i, n in zip(t.i, t.n, strict=True)]
            yield t.assign(v0=[x.tobytes() for x in first], **dict.fromkeys(vectors[1:]), send=[pack(x) for x in first], moved=np.inf)[[*t.columns, *vectors, "send", "moved"]]

    size = places.groupBy("graph_id").agg(F.count("*").alias("n"))
    start = size.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("i"), F.lit(0).cast("long").alias("c"), "n")
    state = stored(start.mapInPandas(begun, f"{kinds}, send binary, moved double"), large=True)
    for step in range(most + 1):
        sent = product(tiled, state.select("graph_id", F.col("i").alias("j"), "c", "n", F.col("send").alias("x")), 1, True, block)
        new = stored(grouped(sent, state.select("graph_id", "i", "c", "n", *vectors), met, f"{kinds}, m array<double>"), large=True)
        sums = new.groupBy("graph_id").agg(F.array(*(F.sum(F.col("m")[k]) for k in range(18))).alias("m"))
        best = sums.mapInPandas(solved, f"{name}, value double, mix array<double>")
        state = stored(new.drop("m").join(best, "graph_id").mapInPandas(mixed, f"{kinds}, send binary, moved double"), large=True)
        open_ = state.groupBy("graph_id", "n").agg(F.sum("moved").alias("moved")).where(F.isnan("moved") | (F.col("moved") >= tolerance * F.col("n")))
        # the first round only finds the image of the start
        if step and not open_.limit(1).count():
            break
    else:
        raise RuntimeError(f"the vector still changes after {most} rounds")

    def listed(batches):
        for t in batches:
            for r in t.itertuples():
                x = np.frombuffer(r.v0)
                yield pd.DataFrame({"graph_id": r.graph_id, "place": np.arange(len(x)) + r.i * block, "centrality": np.where(x > 0, x, 0.0)})

    found = state.select("graph_id", "i", "v0").mapInPandas(listed, f"{name}, place long, centrality double")
    return places.join(found, ["graph_id", "place"]).select("graph_id", "node", "centrality")


def static_order(features: DataFrame, by: Column) -> DataFrame:
    """(graph_id, node, step): nodes by falling feature, smaller ids first on ties. Ranks are counts ahead by (feature, range of ids) and
    places inside such a part, so that no task sorts a whole graph."""
    rows = features.select("graph_id", "node", by.alias("_by"), F.shiftright("node", 16).alias("_range"))
    part = ["graph_id", "_by", "_range"]
    before = Window.partitionBy("graph_id").orderBy(F.desc("_by"), "_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*part).agg(F.count("*").alias("n")).select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("node"))
    return rows.join(ahead, part).select("graph_id", "node", (F.col("ahead") + inside).cast("long").alias("step"))


def features(edges: DataFrame) -> DataFrame:
    """(graph_id, node, degree, clustering, core, betweenness): what strategies may look at."""
    out = degree(edges)
    for more in (clustering(edges), core_numbers(edges), betweenness(edges)):
        out = out.join(more, ["graph_id", "node"])
    return out


def summary(edges: DataFrame) -> DataFrame:
    """The feature record of each graph: average degree, variance of degrees, average path and diameter of the largest component (0 for
    a single node), largest core number, share of nodes of high betweenness."""
    out = degree_stats(edges).select("graph_id", "avg_degree", "degree_variance")
    paths = path_lengths(edges).select("graph_id", F.col("avg_path").alias("apl_lcc"), F.col("diameter").alias("diameter_lcc"))
    core = core_numbers(edges).groupBy("graph_id").agg(F.max("core").alias("max_core"))
    high = high_share(betweenness(edges), "betweenness").withColumnRenamed("share", "bridge_ratio")
    out = out.join(paths, "graph_id", "left").join(core, "graph_id").join(high, "graph_id")
    return out.na.fill({"apl_lcc": 0.0, "diameter_lcc": 0})
