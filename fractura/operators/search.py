"""Searches over removal orders: chains of one annealing each, and a genetic search whose populations are independent islands.

Each chain or island is one task on its graph; Spark runs (graph, seed) pairs side by side. Scores are by the reverse union-find pass.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

FOUND = "graph_id string, seed long, node long, step long, anc double"


def cost(adj: kernels.Adjacency, order: list[int]) -> float:
    return kernels.metrics(adj, order)["anc"]


def anneal(adj: kernels.Adjacency, seed: int, steps: int = 300, start: float = 0.05, cooling: float = 0.98) -> tuple[list[int], float]:
    """Swaps two positions; a worse order is taken with exp(-difference / temperature). The best order met comes back."""
    rng, now = random.Random(seed), list(adj)
    rng.shuffle(now)
    best, at = list(now), cost(adj, now)
    low, heat = at, start
    for _ in range(steps if len(now) > 1 else 0):
        i, j = rng.sample(range(len(now)), 2)
        now[i], now[j] = now[j], now[i]
        new = cost(adj, now)
        if new <= at or rng.random() < math.exp((at - new) / max(heat, 1e-12)):
            at = new
            if at < low:
                best, low = list(now), at
        else:
            now[i], now[j] = now[j], now[i]
        heat *= cooling
    return best, low


def mapped_crossover(a: list[int], b: list[int], low: int, high: int) -> list[int]:
    """Partially mapped: a's slice [low, high) stays in place, other positions take b's, followed through the slice while taken."""
    child, inside = list(b), {v: k for k, v in enumerate(a[low:high], low)}
    for k, v in enumerate(b):
        if low <= k < high:
            child[k] = a[k]
        else:
            while v in inside:
                v = b[inside[v]]
            child[k] = v
    return child


def breed(adj: kernels.Adjacency, seed: int, size: int = 10, generations: int = 20, crossover: float = 0.9, mutation: float = 0.1) -> tuple[list[int], float]:
    """Parents and offspring compete: the best survives as it is, the others by tournaments of three."""
    rng, names = random.Random(seed), list(adj)
    pool = [(cost(adj, p), p) for p in (rng.sample(names, len(names)) for _ in range(size))]
    for _ in range(generations if len(names) > 1 else 0):
        young = []
        for _ in range(size):
            (_, a), (_, b) = rng.sample(pool, 2)
            child = list(a)
            if rng.random() < crossover:
                child = mapped_crossover(a, b, *sorted(rng.sample(range(len(names) + 1), 2)))
            if rng.random() < mutation:
                i, j = rng.sample(range(len(names)), 2)
                child[i], child[j] = child[j], child[i]
            young.append((cost(adj, child), child))
        pool = sorted(pool + young)
        pool = pool[:1] + [min(rng.sample(pool, 3)) for _ in range(size - 1)]
    return min(pool)[::-1]


SEARCHES = {"anneal": anneal, "breed": breed}


def searched(edges: DataFrame, method: str, seeds: list[int], **options) -> DataFrame:
    """(graph_id, seed, node, step, anc) of the order that each seed's search ends with."""
    find = SEARCHES[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        order, anc = find(kernels.adjacency(pdf.src, pdf.dst), int(pdf.seed.iloc[0]), **options)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "seed": pdf.seed.iloc[0], "node": order, "step": range(1, len(order) + 1), "anc": anc})

    return edges.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds)))).groupBy("graph_id", "seed").applyInPandas(one, FOUND)


def best_of(found: DataFrame) -> DataFrame:
    """The order of smallest ANC of each graph, smallest seed on ties."""
    top = found.groupBy("graph_id").agg(F.min(F.struct("anc", "seed")).alias("t")).select("graph_id", "t.seed")
    return found.join(top, ["graph_id", "seed"])


def completed(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """An order from elsewhere (graph_id, node, step): unknown nodes go, repeated ones count at their first step, missing ones follow
    by ascending id; steps are numbered anew from 1."""
    first = order.groupBy("graph_id", "node").agg(F.min("step").alias("at"))
    rows = nodes.select("graph_id", "node").distinct().join(first, ["graph_id", "node"], "left")
    from .graph import static_order

    return static_order(rows.withColumn("at", -F.coalesce("at", F.lit(2**62))), F.col("at"))
