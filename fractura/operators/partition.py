"""Matchings, balanced bisections and covers of cuts, in rounds of joins and aggregates.

A bisection works on levels: nodes are merged along heavy edges, several at once, until a graph has few of them, those are divided by the
best of several starts, and on the way back nodes on the border change sides in equal numbers as long as that shortens the cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fractura.session import stored

from .graph import static_order
from .perturb import draw

#: Nodes of a graph that is not merged further, starts that divide it, and nodes that one window puts together.
COARSE, STARTS, WIDTH = 512, 20, 4_096
#: Nodes for one that others join, and starts that one task makes.
SPREAD, BATCH = 4, 5
#: Shares of the nodes that a level must merge not to be a poor one, three of which end the merging, and for another one to follow where no
#: graph has over twice COARSE nodes.
FEW, SOME = 0.05, 0.25
#: Share of the cut that a round of exchanges must take off for another one to follow.
LEAST = 0.02


def _ends(e: DataFrame, *more: str) -> DataFrame:
    there, back = (F.struct(F.col(a).alias("node"), F.col(b).alias("other"), *more) for a, b in (("u", "v"), ("v", "u")))
    out = e.select("graph_id", F.explode(F.array(there, back)).alias("e"))
    return out.select("graph_id", "e.node", "e.other", *(f"e.{c}" for c in more))


def matching(e: DataFrame) -> DataFrame:
    """(graph_id, u, v): the edges that taking one after the other by rank, where both ends are free, would take. e: (graph_id, u, v, rank),
    ranks distinct in a graph. A round takes all edges that are first at both ends; drawn ranks need few rounds."""
    left, taken = e.select("graph_id", "u", "v", "rank"), None
    while True:
        first = _ends(left, "rank").groupBy("graph_id", "node").agg(F.min("rank").alias("first"))
        at = lambda end, first=first: first.select("graph_id", F.col("node").alias(end), F.col("first").alias(f"first_{end}"))
        met = left.join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"])
        met = stored(met.select("graph_id", "u", "v", "rank", (F.col("rank").eqNullSafe(F.col("first_u")) & F.col("rank").eqNullSafe(F.col("first_v"))).alias("hit")))
        new = met.where("hit").select("graph_id", "u", "v")
        taken = new if taken is None else taken.unionByName(new)
        left = met.where("not hit").drop("hit")
        if not left.limit(1).count():
            return taken
        gone = new.select("graph_id", F.explode(F.array("u", "v")).alias("node"))
        for end in ("u", "v"):
            left = left.join(gone.withColumnRenamed("node", end), ["graph_id", end], "left_anti")
        left = left.select("graph_id", "u", "v", "rank")


def cut_cover(edges: DataFrame, sides: DataFrame, seed: int) -> DataFrame:
    """(graph_id, node): both ends of a matching of the edges between the two sides, which no other edge there can be added to; so all of
    them are covered, by at most twice the fewest nodes that could. sides: (graph_id, node, side); edges rank by draws."""
    e = edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    for end in ("u", "v"):
        e = e.join(sides.select("graph_id", F.col("node").alias(end), F.col("side").alias(f"side_{end}")), ["graph_id", end])
    cut = e.where("side_u <> side_v").withColumn("rank", F.struct(draw(seed, "u", "v").alias("d"), "u", "v"))
    return matching(cut).select("graph_id", F.explode(F.array("u", "v")).alias("node"))


# --- levels


def _clusters(e: DataFrame, at: DataFrame, seed: int) -> DataFrame:
    """(graph_id, node, into): drawn nodes lead, and the others join the heaviest neighbour that leads, the heaviest edges first; those for
    which there is no room join each other, and so do nodes with the same heaviest neighbour where none leads (or without any). No cluster
    is larger than ``most``. at: (graph_id, node, size, most)."""
    leads = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(SPREAD)) == 0
    pick = F.max(F.struct(leads("other").alias("leads"), "w", F.xxhash64(F.lit(seed), "node", "other").alias("d"), "other"))
    heavy = _ends(e, "w").groupBy("graph_id", "node").agg(pick.alias("h")).select("graph_id", "node", "h.w", "h.d", "h.other")
    hub = F.coalesce(F.when(leads("node") & F.col("other").isNotNull(), F.col("node")), "other", F.lit(-1))
    near = stored(at.join(heavy, ["graph_id", "node"], "left").withColumn("hub", hub).drop("other"))
    crowd = near.groupBy("graph_id", "hub").agg(F.count("*").alias("crowd"))
    part = F.when(F.col("node") == F.col("hub"), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd") / WIDTH)))
    key = ["graph_id", "hub", "part"]
    window = Window.partitionBy(*key).orderBy(F.col("node") != F.col("hub"), F.desc("w"), "d", "node").rowsBetween(Window.unboundedPreceding, 0)
    filled = near.join(crowd, ["graph_id", "hub"]).withColumn("part", part).withColumn("first", F.sum("size").over(window) <= F.col("most"))
    rest = Window.partitionBy(*key, "first")
    each = F.greatest(F.lit(1), F.floor(F.col("most") / F.max("size").over(rest)))
    place = F.floor((F.row_number().over(rest.orderBy("size", "node")) - 1) / each)
    named = filled.withColumn("place", F.when(~F.col("first"), place)).withColumn("into", F.min("node").over(Window.partitionBy(*key, "place")))
    return named.where("node > into").select("graph_id", "node", "into")


def _merged(e: DataFrame, at: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of the next level."""
    name = lambda c: F.coalesce(F.col("into"), F.col(c))
    for end in ("u", "v"):
        e = e.join(into.withColumnRenamed("node", end), ["graph_id", end], "left").withColumn(end, name(end)).drop("into")
    e = e.where("u <> v").groupBy("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))
    at = at.join(into, ["graph_id", "node"], "left").groupBy("graph_id", name("node").alias("node")).agg(F.sum("size").alias("size"), F.first("most").alias("most"))
    return stored(e), stored(at)


def best_halves(w: np.ndarray, size: np.ndarray, starts: int, seed: int) -> np.ndarray:
    """Sides of a small graph (symmetric weights): from each of several drawn starts, passes that move every node once, always the best of
    the larger side, and keep the shortest balanced cut on the way, until none is shorter; the best of all."""
    rng, n = np.random.default_rng(seed), len(size)
    slack = int(size.sum() % 2) if size.max(initial=1) == 1 else int(size.max())
    best, found = np.inf, np.zeros(n, int)
    for _ in range(starts):
        side = np.zeros(n, int)
        order = rng.permutation(n)
        side[order[np.cumsum(size[order]) > size.sum() / 2]] = 1
        cut = np.inf
        while True:
            now, at, kept, gap = side.copy(), float(w[side == 0][:, side == 1].sum()), None, int(size @ (1 - 2 * side))
            gain, free, shortest = w @ (2 * now - 1) * (1 - 2 * now), np.ones(n, bool), cut
            for step in range(n + 1):
                if abs(gap) <= slack and at < shortest - 1e-9:
                    shortest, kept = at, now.copy()
                movable = free & (now == (0 if gap > 0 or (gap == 0 and step % 2 == 0) else 1))
                if not movable.any():
                    break
                v = int(np.argmax(np.where(movable, gain, -np.inf)))
                at -= gain[v]
                gap -= 2 * int(size[v]) * (1 - 2 * int(now[v]))
                gain += 2 * w[v] * np.where(now == now[v], 1, -1)
                gain[v] = -gain[v]
                now[v], free[v] = 1 - now[v], False
            if kept is None:
                break
            side, cut = kept, shortest
        if cut < best:
            best, found = cut, side
    return found


def _gains(e: DataFrame, sides: DataFrame) -> DataFrame:
    """(graph_id, node, side, size, gain, cut): by how much less the cut would weigh with the node on the other side, and its edges there."""
    for end in ("u", "v"):
        e = e.join(sides.select("graph_id", F.col("node").alias(end), F.col("side").alias(f"side_{end}")), ["graph_id", end])
    far = F.when(F.col("side_u") == F.col("side_v"), 0).otherwise(F.col("w"))
    ends = e.select("graph_id", F.explode(F.array("u", "v")).alias("node"), (2 * far - F.col("w")).alias("gain"), far.alias("cut"))
    sums = ends.groupBy("graph_id", "node").agg(F.sum("gain").alias("gain"), F.sum("cut").alias("cut"))
    return sides.join(sums, ["graph_id", "node"], "left").na.fill(0, ["gain", "cut"])


def _by_gain(rows: DataFrame, *key: str) -> DataFrame:
    """Adds step: the place by falling gain among the rows of a graph with the same values of ``key``."""
    name = F.concat_ws("|", "graph_id", *key)
    place = static_order(rows.select(name.alias("graph_id"), "node", "gain"), F.col("gain")).withColumnRenamed("graph_id", "_name")
    return rows.withColumn("_name", name).join(place, ["_name", "node"]).drop("_name")


def refined(e: DataFrame, sides: DataFrame, least: float = LEAST) -> DataFrame:
    """Sides after rounds of exchanges: the n-th best of one side changes with the n-th best of the same size of the other, where both together
    shorten the cut. Of neighbours on different sides only the better one may change, so that what nodes gain adds up (neighbours that
    change from the same side gain more). A graph is done when a round shortens its cut by less than ``least`` of it, or not at all."""
    while True:
        gains = stored(_gains(e, sides))
        met = e
        for end in ("u", "v"):
            strong = F.struct("gain", F.xxhash64("node"), "node").alias(f"strong_{end}")
            met = met.join(gains.select("graph_id", F.col("node").alias(end), strong, F.col("side").alias(f"side_{end}")), ["graph_id", end])
        beaten = met.where("side_u <> side_v").select("graph_id", F.when(F.col("strong_u") < F.col("strong_v"), F.col("u")).otherwise(F.col("v")).alias("node")).distinct()
        cut = gains.groupBy("graph_id").agg((F.sum("cut") / 2).alias("cut"))
        ranked = _by_gain(gains.join(beaten, ["graph_id", "node"], "left_anti"), "side", "size")
        one, two = (ranked.where(F.col("side") == s).select("graph_id", "size", "step", F.col("node").alias(f"n{s}"), F.col("gain").alias(f"g{s}")) for s in (0, 1))
        moved = stored(one.join(two, ["graph_id", "size", "step"]).where("g0 + g1 > 0").select("graph_id", "n0", "n1", (F.col("g0") + F.col("g1")).alias("gain")))
        enough = moved.groupBy("graph_id").agg(F.sum("gain").alias("gain")).join(cut, "graph_id").where(F.col("gain") >= least * F.col("cut")).select("graph_id")
        if not enough.limit(1).count():
            return sides
        flips = moved.join(enough, "graph_id").select("graph_id", F.explode(F.array("n0", "n1")).alias("node"), F.lit(1).alias("m"))
        sides = stored(sides.join(flips, ["graph_id", "node"], "left").select("graph_id", "node", "size", F.when(F.col("m").isNull(), F.col("side")).otherwise(1 - F.col("side")).alias("side")))


def evened(e: DataFrame, sides: DataFrame) -> DataFrame:
    """Sides of single nodes whose numbers differ by one at most: the best of the larger side go over."""
    more = sides.groupBy("graph_id").agg(F.sum(1 - 2 * F.col("side")).alias("more"))
    ranked = _by_gain(_gains(e, sides).join(more, "graph_id"), "side")
    over = (F.col("side") == F.when(F.col("more") > 0, 0).otherwise(1)) & (F.col("step") <= F.floor(F.abs("more") / 2))
    return stored(ranked.select("graph_id", "node", "size", F.when(over, 1 - F.col("side")).otherwise(F.col("side")).alias("side")))


def bisection(edges: DataFrame, seed: int = 42, coarse: int = COARSE, starts: int = STARTS) -> DataFrame:
    """(graph_id, node, side): two halves of each graph's nodes, equal but for one, between which few edges run. Node ids are not negative."""
    e = stored(edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).cast("long").alias("w")))
    at = e.select("graph_id", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("size", F.lit(1).cast("long"))
    n = at.groupBy("graph_id").agg(F.count("*").alias("n"))
    at = stored(at.join(n, "graph_id").select("graph_id", "node", "size", F.greatest(F.lit(2), F.ceil(1.5 * F.col("n") / coarse)).alias("most")))
    levels: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    tries = poor = 0
    while poor < 3:
        large = stored(at.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > coarse))
        every, widest = large.agg(F.sum("n"), F.max("n")).first()
        if not every:
            break
        some = [x.join(large.select("graph_id"), "graph_id", "left_semi") for x in (e, at)]
        into = stored(_clusters(*some, seed + tries))
        n, tries = into.count(), tries + 1
        poor = 3 if widest <= 2 * coarse and n < SOME * every else 0 if n >= FEW * every else poor + 1
        if n:
            levels.append((e, at, into))
            e, at = _merged(e, at, into)

    def divided(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, batch = np.sort(right.node.to_numpy()), int(right.batch.iloc[0])
        w = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, left.u), np.searchsorted(ids, left.v)
        w[i, j] = w[j, i] = left.w
        size = right.set_index("node").loc[ids]["size"].to_numpy()
        side = best_halves(w, size, min(BATCH, starts - batch * BATCH), seed + batch)
        return pd.DataFrame({"graph_id": right.graph_id.iloc[0], "node": ids, "size": size, "side": side, "batch": batch, "cut": w[side == 0][:, side == 1].sum()})

    batches = F.explode(F.sequence(F.lit(0), F.lit((starts - 1) // BATCH))).alias("batch")
    begun = [x.select("*", batches).groupBy("graph_id", "batch") for x in (e, at)]
    halves = stored(begun[0].cogroup(begun[1]).applyInPandas(divided, "graph_id string, node long, size long, side int, batch int, cut double"))
    best = halves.groupBy("graph_id").agg(F.min(F.struct("cut", "batch")).alias("b")).select("graph_id", "b.batch")
    sides = stored(halves.join(best, ["graph_id", "batch"]).select("graph_id", "node", "size", "side"))
    for fine, nodes, into in reversed(levels):
        whole = sides.select("graph_id", F.col("node").alias("into"), "side")
        known = nodes.join(into, ["graph_id", "node"], "left").withColumn("into", F.coalesce("into", "node"))
        sides = refined(fine, stored(known.join(whole, ["graph_id", "into"]).select("graph_id", "node", "size", "side")))
        e = fine
    if levels:
        sides = refined(e, evened(e, sides))
    return sides.select("graph_id", "node", "side")
