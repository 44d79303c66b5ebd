"""Communities by modularity: levels of local moves and contraction, each round of moves in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractura.session import stored

from .graph import static_order

#: A move that gains less is none, so that rounding does not keep the rounds going.
LEAST_GAIN = 1e-12


def _ends(e: DataFrame) -> DataFrame:
    there, back = (F.struct(F.col(a).alias("u"), F.col(b).alias("other"), "w") for a, b in (("u", "v"), ("v", "u")))
    return e.select("graph_id", F.explode(F.array(there, back)).alias("e")).select("graph_id", "e.u", "e.other", "e.w")


def _weighted(edges: DataFrame, weight: str | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w"))


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = None) -> DataFrame:
    """(graph_id, n_communities, modularity) of communities(graph_id, node, community): weight inside, as a share of all, less what the
    strengths of a community let expect."""
    e = _weighted(edges, weight)
    part = lambda end: communities.select("graph_id", F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    met = e.join(part("u"), ["graph_id", "u"]).join(part("v"), ["graph_id", "v"])
    half = F.explode(F.array(F.struct(F.col("c_u").alias("c")), F.struct(F.col("c_v").alias("c")))).alias("x")
    sums = met.select("graph_id", "w", F.when(F.col("c_u") == F.col("c_v"), F.col("w") / 2).otherwise(0.0).alias("inside"), half)
    sums = sums.groupBy("graph_id", "x.c").agg(F.sum("w").alias("tot"), F.sum("inside").alias("inside"))
    m = e.groupBy("graph_id").agg(F.sum("w").alias("m"))
    share = F.col("tot") / (2 * F.col("m"))
    return sums.join(m, "graph_id").groupBy("graph_id").agg(F.count("*").alias("n_communities"), F.sum(F.col("inside") / F.col("m") - share * share).alias("modularity"))


def moves(both: DataFrame, at: DataFrame, m: DataFrame) -> DataFrame:
    """(graph_id, u, a, b, k, m, gain): of each node the move from community a to b of the largest gain in modularity, where it has one.
    both: (graph_id, u, other, w); at: (graph_id, u, k, c), strengths and communities."""
    total = at.groupBy("graph_id", "c").agg(F.sum("k").alias("tot"))
    near = both.join(at.select("graph_id", F.col("u").alias("other"), "c"), ["graph_id", "other"]).groupBy("graph_id", "u", "c").agg(F.sum("w").alias("w"))
    mine = at.join(total, ["graph_id", "c"]).select("graph_id", "u", "k", F.col("c").alias("a"), F.col("tot").alias("tot_a"))
    met = near.join(mine, ["graph_id", "u"])
    own = met.where("c = a").select("graph_id", "u", F.col("w").alias("w_a"))
    there = met.where("c <> a").join(total, ["graph_id", "c"]).join(own, ["graph_id", "u"], "left").join(m, "graph_id")
    gain = (F.col("w") - F.coalesce("w_a", F.lit(0.0))) / F.col("m") - F.col("k") * (F.col("tot") - F.col("tot_a") + F.col("k")) / (2 * F.col("m") * F.col("m"))
    rows = there.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    best = rows.groupBy("graph_id", "u", "a", "k", "m").agg(F.max(F.struct("gain", (-F.col("c")).alias("minus"))).alias("best"))
    return best.select("graph_id", "u", "a", (-F.col("best.minus")).alias("b"), "k", "m", "best.gain")


def chosen(found: DataFrame) -> DataFrame:
    """Moves that are made together, such that their gains add up to a gain.

    A community is left or entered in a round, not both, as the best move that touches it says. Two moves that leave, or enter, one
    community take k1 k2 / (2 m^2) of each other's gain at most; moves that gain more than their half of that against all others are made.
    In a graph without one of these, the moves are made that are the best both of the community they leave and of the one they enter;
    the best move of a graph always is.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(True).alias("left")), F.struct(F.col("b").alias("c"), F.lit(False).alias("left")))).alias("e")
    role = found.select("graph_id", "gain", "u", ends).groupBy("graph_id", "e.c").agg(F.max(F.struct("gain", "u", "e.left")).alias("r"))
    role = role.select("graph_id", "c", F.col("r.left").alias("left"))
    kept = found.join(role.where("left").select("graph_id", F.col("c").alias("a")), ["graph_id", "a"]).join(role.where("not left").select("graph_id", F.col("c").alias("b")), ["graph_id", "b"])
    for end in ("a", "b"):
        kept = kept.join(kept.groupBy("graph_id", end).agg(F.sum("k").alias(f"k_{end}"), F.max(F.struct("gain", "u")).alias(f"best_{end}")), ["graph_id", end])
    k, m = F.col("k"), F.col("m")
    safe = F.col("gain") > k * (F.col("k_a") + F.col("k_b") - 2 * k) / (4 * m * m)
    best = (F.col("best_a.u") == F.col("u")) & (F.col("best_b.u") == F.col("u"))
    rows = kept.withColumns({"safe": safe, "first": best})
    some = rows.groupBy("graph_id").agg(F.max("safe").alias("some"))
    return rows.join(some, "graph_id").where((F.col("some") & F.col("safe")) | (~F.col("some") & F.col("first"))).select("graph_id", "u", "b")


def louvain(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(graph_id, node, level, community) from level 1 on: at each level nodes, then communities as nodes, move as long as a move gains
    modularity. A level without any move is the end. A community is named by its smallest node. Weights must be positive."""
    e = stored(_weighted(edges, weight))
    m = stored(e.groupBy("graph_id").agg(F.sum("w").alias("m")))
    at = stored(_ends(e).groupBy("graph_id", "u").agg(F.sum("w").alias("k")).withColumn("c", F.col("u")))
    whole = at.select("graph_id", F.col("u").alias("node"), F.col("u").alias("community"))
    levels, level = None, 0
    while True:
        level += 1
        both, moved = _ends(e), False
        while True:
            found = stored(moves(both, at, m))
            if not found.limit(1).count():
                break
            moved = True
            at = stored(at.join(chosen(found), ["graph_id", "u"], "left").select("graph_id", "u", "k", F.coalesce("b", "c").alias("c")))
        if not moved:
            return levels if levels is not None else whole.select("graph_id", "node", F.lit(1).alias("level"), "community")
        whole = stored(whole.join(at.select("graph_id", F.col("u").alias("community"), "c"), ["graph_id", "community"]).select("graph_id", "node", F.col("c").alias("community")))
        names = whole.groupBy("graph_id", "community").agg(F.min("node").alias("name"))
        here = whole.join(names, ["graph_id", "community"]).select("graph_id", "node", F.lit(level).alias("level"), F.col("name").alias("community"))
        levels = here if levels is None else levels.unionByName(here)
        part = lambda end, at=at: at.select("graph_id", F.col("u").alias(end), F.col("c").alias(f"c_{end}"))
        met = e.join(part("u"), ["graph_id", "u"]).join(part("v"), ["graph_id", "v"]).where("c_u <> c_v")
        e = stored(met.groupBy("graph_id", F.least("c_u", "c_v").alias("u"), F.greatest("c_u", "c_v").alias("v")).agg(F.sum("w").alias("w")))
        at = stored(at.groupBy("graph_id", F.col("c").alias("u")).agg(F.sum("k").alias("k")).withColumn("c", F.col("u")))


def last_level(levels: DataFrame) -> DataFrame:
    """(graph_id, node, community) of the last level."""
    top = levels.groupBy("graph_id").agg(F.max("level").alias("level"))
    return levels.join(top, ["graph_id", "level"]).select("graph_id", "node", "community")


def shares(degrees: DataFrame, communities: DataFrame, k: int) -> DataFrame:
    """(graph_id, node): of each community max(1, floor(k x its share of the nodes)) nodes of highest degree, smaller ids on ties; where that
    is less than k in all, the nodes of highest degree of the rest, at most up to k."""
    named = degrees.join(communities, ["graph_id", "node"])
    inside = static_order(named.select(F.concat_ws("|", "graph_id", "community").alias("graph_id"), "node", "degree"), F.col("degree"))
    size = named.groupBy("graph_id", "community").agg(F.count("*").alias("size"))
    n = size.groupBy("graph_id").agg(F.sum("size").alias("n"))
    quota = size.join(n, "graph_id").select(F.concat_ws("|", "graph_id", "community").alias("name"), F.greatest(F.lit(1), F.floor(F.lit(k) * F.col("size") / F.col("n"))).alias("quota"))
    ranked = named.withColumn("name", F.concat_ws("|", "graph_id", "community")).join(inside.select(F.col("graph_id").alias("name"), "node", "step"), ["name", "node"]).join(quota, "name")
    first = ranked.select("graph_id", "node", F.struct((F.col("step") <= F.col("quota")).alias("in"), F.col("degree")).alias("by"))
    return static_order(first, F.col("by")).where(F.col("step") <= k).select("graph_id", "node")
