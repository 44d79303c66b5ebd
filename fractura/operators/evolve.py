"""Relational operators of the evolutionary loop, over candidates(generation, id, code, objective, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def survivors(candidates: DataFrame, n: int) -> DataFrame:
    """Per generation: candidates that failed or have no code go, then repeated code (the smallest id stays), then repeated objectives: of
    those the one of the smallest fht_50, fht_10 and id stays, a missing time counting as the largest. The n smallest objectives stay."""
    times = [F.asc_nulls_last("fht_50"), F.asc_nulls_last("fht_10")]
    first = lambda *by, order: F.row_number().over(Window.partitionBy("generation", *by).orderBy(*order))
    c = candidates.where("objective is not null and code is not null").withColumn("r", first("code", order=["id"])).where("r = 1")
    c = c.withColumn("r", first("objective", order=[*times, "id"])).where("r = 1")
    return c.withColumn("rank", first(order=["objective"]).cast("long")).where(F.col("rank") <= n).select("generation", "rank", "id", "objective", "fht_50")


def rank_weights(ranked: DataFrame) -> DataFrame:
    """Parent weights 1 / (rank + 1 + n), rank from 0, normalised per generation."""
    w = Window.partitionBy("generation")
    raw = 1.0 / (F.col("rank") + F.count("*").over(w))
    return ranked.withColumn("raw", raw).select("generation", "id", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))


def roulette_weights(ranked: DataFrame) -> DataFrame:
    """Parent weights by the inverse objective; 1e-6 of the time to one half is added to it, so that faster ones win ties."""
    raw = 1.0 / (F.col("objective") + 1e-6 * F.coalesce("fht_50", F.lit(0)) + 1e-6)
    w = Window.partitionBy("generation")
    return ranked.withColumn("raw", raw).select("generation", "id", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))


def operator_stats(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("generation", "operator").agg(F.count("*").alias("offspring"), F.count("objective").alias("valid"), F.min("objective").alias("best"), F.avg("objective").alias("mean"))


def best_so_far(trace: DataFrame) -> DataFrame:
    """(generation, best, best_so_far, improves, delta): improvement is strict by 1e-12; the first row improves with delta 0."""
    g = trace.groupBy("generation").agg(F.min("objective").alias("best"))
    w = Window.orderBy("generation")
    before = F.min("best").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return g.withColumn("before", before).select("generation", "best", F.least("best", F.coalesce("before", "best")).alias("best_so_far"), (F.col("before").isNull() | (F.col("best") < F.col("before") - 1e-12)).alias("improves"), F.when(F.col("best") < F.col("before") - 1e-12, F.col("before") - F.col("best")).otherwise(0.0).alias("delta"))


def greedy(chain: DataFrame) -> DataFrame:
    """(operator, generation, objective, accepted): a single solution per operator, replaced only by a strictly better one."""
    before = F.min("objective").over(Window.partitionBy("operator").orderBy("generation").rowsBetween(Window.unboundedPreceding, -1))
    better = F.col("objective") < F.coalesce(before, F.lit(float("inf")))
    return chain.select("operator", "generation", "objective", F.coalesce(better, F.lit(False)).alias("accepted"))


def population_state(trace: DataFrame) -> DataFrame:
    """Diversity of each generation: (q90 - q10) / (|median| + 1e-8), clipped; validity: share of non-null objectives."""
    q = lambda p: F.percentile("objective", F.lit(p))
    return trace.groupBy("generation").agg(clip((q(0.9) - q(0.1)) / (F.abs(q(0.5)) + 1e-8)).alias("diversity"), (F.count("objective") / F.count("*")).alias("validity"))


def early_stop(curve: DataFrame, patience: int) -> DataFrame:
    """Generations since the last improvement, and whether they reach the patience."""
    last = F.max(F.when(F.col("improves"), F.col("generation"))).over(Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("stale", (F.col("generation") - last).cast("long")).select("generation", "stale", (F.col("stale") >= patience).alias("stop"))


def memory_window(items: DataFrame, budget: int, extra: int = 8, most: int = 50, longest: int = 1200, show: int = 10) -> DataFrame:
    """The latest items of each group whose lengths (of ``longest`` at most, and ``extra`` each) sum up to the budget, at most ``most``,
    but always the last one; ``shown`` marks the ``show`` latest."""
    w = Window.partitionBy("grp").orderBy(F.desc("pos"))
    size = F.least("size", F.lit(longest)) + extra
    rows = items.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.row_number().over(w))
    return rows.where(((F.col("used") <= budget) & (F.col("r") <= most)) | (F.col("r") == 1)).select("grp", "pos", F.col("used").cast("long").alias("used"), (F.col("r") <= show).alias("shown"))


def search_state(trace: DataFrame, back: int = 5) -> DataFrame:
    """(generation, d, i, s, v): diversity; improvement on the best ``back`` generations ago (else the oldest), as a share of 0.15;
    the streak of generations just before whose best is the same within tolerance, as a share of ``back`` (no more of them are looked at); validity. All in [0, 1]; without a
    valid objective 0, 0, 1 and the validity."""
    best = trace.groupBy("generation").agg(F.min("objective").alias("best"))
    w = Window.orderBy("generation")
    old = F.coalesce(F.lag("best", back).over(w), F.first("best", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.collect_list("best").over(w.rowsBetween(-back, -1))
    same = F.greatest(F.lit(1e-6), 1e-4 * F.abs("best"))
    other = F.transform("before", lambda x, k: F.when(F.abs(x - F.col("best")) > F.col("same"), k + 1).otherwise(0))
    rows = best.withColumns({"old": old, "before": before, "same": same})
    rows = rows.withColumn("streak", F.size("before") - F.coalesce(F.array_max(other), F.lit(0)))
    i = clip(F.greatest(F.lit(0.0), F.col("old") - F.col("best")) / (F.abs("old") + 1e-8) / 0.15)
    none = F.col("best").isNull()
    return population_state(trace).join(rows, "generation").select(
        "generation",
        F.when(none, 0.0).otherwise(F.col("diversity")).alias("d"),
        F.when(none, 0.0).otherwise(i).alias("i"),
        F.when(none, 1.0).otherwise(clip(F.col("streak") / back)).alias("s"),
        F.col("validity").alias("v"),
    )


def credit(rewards: DataFrame, keep: float = 0.75) -> DataFrame:
    """Exponential averages of rewards per operator, from 0: one ordered fold a group."""
    got = rewards.groupBy("operator").agg(F.transform(F.array_sort(F.collect_list(F.struct("generation", "reward"))), lambda x: x.reward).alias("r"))
    return got.select("operator", F.aggregate("r", F.lit(0.0), lambda c, x: keep * c + (1 - keep) * x).alias("credit"))


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, rows: int = 4096) -> DataFrame:
    """The k largest dot products of each query with all vectors (id, vec), its own left out; a stated query set against all rows.

    Both sides are put together in blocks of about ``rows``; each two blocks meet in one task, which leaves k rows a query. Null
    vectors, and those of another length than a block's first, take no part.
    """

    def packed(side: DataFrame, name: str, n: int) -> DataFrame:
        some = side.where("vec is not null").select(F.pmod(F.xxhash64("id"), F.lit(n)).alias(name), "id", F.col("vec").cast("array<double>").alias("vec"))
        return some.groupBy(name).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("vec").alias(f"{name}_vecs"))

    nq, nv = (max(1, -(-side.count() // rows)) for side in (queries, vectors))
    asked = packed(queries, "q", nq).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))))
    pairs = asked.join(packed(vectors, "v", nv), "v")

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = len(row["q_vecs"][0])
                q, v = ([(i, x) for i, x in zip(row[f"{c}_ids"], row[f"{c}_vecs"], strict=True) if len(x) == width] for c in "qv")
                if not v:
                    continue
                ids, own, x = (np.array([i for i, _ in q], np.int64), np.array([i for i, _ in v], np.int64), np.array([y for _, y in v]))
                for i, y in zip(ids, (np.array(y) for _, y in q), strict=True):
                    dot = (x * y).sum(axis=1)
                    other = np.flatnonzero(own != i)
                    best = other[np.lexsort((own[other], -dot[other]))][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(own[best]), pa.array(dot[best])], ["query", "id", "dot"])

    found = pairs.select("q_ids", "q_vecs", "v_ids", "v_vecs").mapInArrow(look, "query long, id long, dot double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dot"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def similar_parents(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, rank) of the parents of each query: its k most similar rows of vectors(id, vec, objective), then, at rank k + 1, the row
    of the largest objective of all (the smallest id on ties), be it one of them or not."""
    worst = vectors.where("objective is not null").agg(F.max_by("id", F.struct("objective", -F.col("id"))).alias("id"))
    extra = queries.select(F.col("id").alias("query")).join(F.broadcast(worst)).select("query", "id", F.lit(k + 1).cast("long").alias("rank"))
    return top_similar(vectors, queries, k).select("query", "id", "rank").unionByName(extra)
