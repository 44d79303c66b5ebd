"""Removal orders and their metrics, one task a (graph, strategy)."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cuts, kernels, scoring
from .graph import static_order

STRATEGIES = kernels.STRATEGIES | {"ratio_cut": cuts.by_ratio_cut, "cut_reinsertion": cuts.by_cut_reinsertion, "eigenvector": kernels._adaptive(kernels.eigenvector_of)}


def orders(edges: DataFrame, strategies: list[str]) -> DataFrame:
    """(graph_id, strategy, node, step) of each named strategy on each graph."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = STRATEGIES[pdf.strategy.iloc[0]](kernels.adjacency(pdf.src, pdf.dst))
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "strategy": pdf.strategy.iloc[0], "node": found, "step": range(1, len(found) + 1)})

    names = F.explode(F.array(*map(F.lit, strategies)))
    return edges.withColumn("strategy", names).groupBy("graph_id", "strategy").applyInPandas(one, "graph_id string, strategy string, node long, step long")


def by_rules(edges: DataFrame, rules: dict[str, Callable], residual: bool = False, robust: bool = False) -> DataFrame:
    """(graph_id, strategy, node, step) of callers' own rules on each graph; see ``kernels.by_rule``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf.strategy.iloc[0]
        found = kernels.by_rule(kernels.adjacency(pdf.src, pdf.dst), rules[name], residual, robust)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "strategy": name, "node": found, "step": range(1, len(found) + 1)})

    names = F.explode(F.array(*map(F.lit, rules)))
    return edges.withColumn("strategy", names).groupBy("graph_id", "strategy").applyInPandas(one, "graph_id string, strategy string, node long, step long")


def attacks(edges: DataFrame, seeds: list[int]) -> DataFrame:
    """(graph_id, strategy, seed, cost): 10,000 times the ANC of adaptive attacks with random ties, by centrality and seed."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        adj, name, seed = kernels.adjacency(pdf.src, pdf.dst), pdf.strategy.iloc[0], int(pdf.seed.iloc[0])
        order = kernels.by_random_ties(adj, kernels.CENTRALITIES[name], seed)
        return pd.DataFrame({"graph_id": [pdf.graph_id.iloc[0]], "strategy": [name], "seed": [seed], "cost": [10_000 * kernels.metrics(adj, order)["anc"]]})

    rows = edges.withColumn("strategy", F.explode(F.array(*map(F.lit, kernels.CENTRALITIES)))).withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))
    return rows.groupBy("graph_id", "strategy", "seed").applyInPandas(one, "graph_id string, strategy string, seed long, cost double")


def evaluate(edges: DataFrame, order: DataFrame) -> DataFrame:
    """The metric record of each order."""
    return scoring.metrics(scoring.step_series(edges, order))


def prefix_anc(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(graph_id, strategy, steps, anc) of orders of any length: the mean share of connected pairs left after each removal that the
    order has; null without pairs."""
    rows = scoring.step_series(edges, order, partial=True)
    heads = rows.groupBy("graph_id", "strategy").agg(F.max("step").alias("steps"), F.max(F.when(F.col("step") == 0, F.col("cp"))).alias("c0"), F.sum(F.when(F.col("step") > 0, F.col("cp").cast("decimal(20,0)"))).cast("double").alias("total"))
    return heads.select("graph_id", "strategy", "steps", F.when(F.col("c0") > 0, F.col("total") / (F.col("steps") * F.col("c0").cast("double"))).alias("anc"))


step_series = scoring.step_series


def curve(series: DataFrame, share: float = 0.7) -> DataFrame:
    """Fractions removed, of the first largest component and of the first connectivity, up to ``share`` of the steps."""
    w = Window.partitionBy("graph_id", "strategy")
    at0 = lambda c: F.max(F.when(F.col("step") == 0, F.col(c))).over(w)
    n = F.max("step").over(w)
    rows = series.withColumns({"n": n, "l0": at0("lcc"), "c0": at0("cp")}).where(F.col("step") <= F.least(F.col("n"), F.ceil(F.col("n") * share)))
    return rows.select("graph_id", "strategy", "step", (F.col("step") / F.col("n")).alias("removed"), (F.col("lcc") / F.col("l0")).alias("lcc_ratio"), F.when(F.col("c0") == 0, 0.0).otherwise(F.col("cp") / F.col("c0")).alias("cp_ratio"))


def truncated(points: DataFrame, stop: float, low: float = 1e-4) -> DataFrame:
    """The curve up to its first value at or below ``stop``, clipped to [low, 1]."""
    w = Window.partitionBy("graph_id", "strategy")
    end = F.min(F.when(F.col("cp_ratio") <= stop, F.col("step"))).over(w)
    rows = points.withColumn("end", end).where(F.col("end").isNull() | (F.col("step") <= F.col("end")))
    return rows.select("graph_id", "strategy", "step", F.least(F.greatest(F.col("cp_ratio"), F.lit(low)), F.lit(1.0)).alias("cp_clipped"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means over graphs, the population deviation of ANC, and the k of the last graph; nulls are left out."""
    return metrics.groupBy("strategy").agg(F.avg("anc").alias("anc"), F.stddev_pop("anc").alias("anc_std"), F.avg("anc_prefix_k").alias("anc_prefix_k"), F.avg("fht_50").alias("fht_50"), F.avg("fht_10").alias("fht_10"), F.avg("lcc_at_k").alias("lcc_at_k"), F.max_by("k", "graph_id").alias("k"))


#: Stages of an order by share of its steps.
STAGES = (0.0, 0.1, 0.2, 0.4, 0.6, 1.0)


def stages(order: DataFrame, bounds: tuple[float, ...] = STAGES) -> DataFrame:
    """Adds stage (from 1) to the steps: parts of an order from floor(share * n) on; a part without a step is widened to one, which
    then is in two stages."""
    n = F.max("step").over(Window.partitionBy("graph_id", "strategy"))
    slices = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        start = F.floor(F.lit(low) * F.col("_n"))
        end = F.col("_n") if k == len(bounds) - 1 else F.least(F.col("_n"), F.greatest(F.floor(F.lit(high) * F.col("_n")), start + 1))
        slices.append(F.when((F.col("step") > start) & (F.col("step") <= end), F.lit(k)))
    inside = F.filter(F.array(*slices), lambda x: x.isNotNull())
    return order.withColumn("_n", n).withColumn("stage", F.explode(inside)).drop("_n")


def stage_summary(staged: DataFrame, features: list[str]) -> DataFrame:
    """(strategy, stage, feature, n, mean, std): population deviation of each feature in each stage, over graphs."""
    pairs = F.expr(f"stack({len(features)}, {', '.join(f"'{c}', cast({c} as double)" for c in features)}) as (feature, x)")
    return staged.select("strategy", "stage", pairs).groupBy("strategy", "stage", "feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def window_limits(points: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    """(strategy, y_min, y_max): 0.85 of the smallest and 1.03 of the largest value inside a range of x."""
    return points.where(F.col(x).between(low, high)).groupBy("strategy").agg((F.min(y) * 0.85).alias("y_min"), (F.max(y) * 1.03).alias("y_max"))


def fused_order(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """An order by a weighted sum of features, each scaled to [0, 1] inside its graph (0 where they hardly differ)."""
    ends = features.groupBy("graph_id").agg(*(f(c).alias(f"_{k}_{c}") for c in weights for k, f in (("min", F.min), ("max", F.max))))
    scaled = lambda c: F.when(F.col(f"_max_{c}") - F.col(f"_min_{c}") < 1e-12, 0.0).otherwise((F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}")))
    score = functools.reduce(lambda a, b: a + b, (w * scaled(c) for c, w in weights.items()))
    return static_order(features.join(ends, "graph_id").withColumn("score", F.round(score, 9)), F.col("score"))


def best_k(found: DataFrame, value: str, k: int, *key: str) -> DataFrame:
    """The k rows of each graph with the smallest values, ties by key."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(value, *key))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def unvisited_ratio(neighbours: DataFrame, order: DataFrame) -> DataFrame:
    """At the moment a node goes: the share of its neighbours that are still there. neighbours: (graph_id, node, other)."""
    later = neighbours.join(order, ["graph_id", "node"]).join(order.select("graph_id", F.col("node").alias("other"), F.col("step").alias("o")), ["graph_id", "other"])
    return later.groupBy("graph_id", "node", "step").agg((F.sum((F.col("o") > F.col("step")).cast("int")) / F.count("*")).alias("ratio"))


def percentile_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Tie-averaged percentile ranks; 0.5 alone."""
    low, ties, n = F.rank().over(Window.partitionBy(group).orderBy(value)), F.count("*").over(Window.partitionBy(group, value)), F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("percentile", F.when(n == 1, 0.5).otherwise((low - 1 + (ties - 1) / 2) / (n - 1)))
