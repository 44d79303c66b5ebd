"""Seeded perturbations and samples; ranks are md5 of seed and key, so that they are the same on any engine."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fractura.operators import orders
from fractura.operators.graph import nodes, static_order, without_nodes
from fractura.session import settle, stored


def draw(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *key))


def uniform(seed: int, *key: str) -> Column:
    """A number in [0, 1) from the first eight hex digits of the draw."""
    return F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def ranked_by_draw(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """Adds _rank, the place of a row's draw in its graph, and _all, the graph's rows. Rows are counted by the first four digits of the draw,
    so that only the rows of one such part are sorted at once."""
    some = rows.withColumn("_draw", draw(seed, *key)).withColumn("_part", F.substring("_draw", 1, 4))
    before = Window.partitionBy("graph_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = some.groupBy("graph_id", "_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("graph_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy("graph_id")).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("graph_id", "_part").orderBy("_draw", *key)) + F.col("_ahead")
    return some.join(ahead, ["graph_id", "_part"]).withColumn("_rank", rank)


def first_share(rows: DataFrame, share: float, seed: int, *key: str) -> DataFrame:
    """max(1, round(share * n)) rows of each graph, those of the smallest draws."""
    return ranked_by_draw(rows, seed, *key).where(F.col("_rank") <= F.greatest(F.lit(1), F.round(F.col("_all") * share))).select(rows.columns)


def drop_edges(edges: DataFrame, share: float, seed: int) -> DataFrame:
    return edges.join(first_share(edges, share, seed, "src", "dst"), ["graph_id", "src", "dst"], "left_anti")


def pick_nodes(nodes: DataFrame, share: float, seed: int) -> DataFrame:
    return first_share(nodes, share, seed, "node")


def top_degree(degrees: DataFrame, k: int) -> DataFrame:
    best = static_order(degrees, F.col("degree")).where(F.col("step") <= k)
    return degrees.join(best.select("graph_id", "node"), ["graph_id", "node"], "left_semi")


def top_core(cores: DataFrame, k: int, seed: int) -> DataFrame:
    """k nodes of each graph (graph_id, node, core) by falling core number, in the order of their draws inside a number."""
    later = F.conv(F.substring(draw(seed, "node"), 1, 12), 16, 10).cast("long")
    best = static_order(cores, F.struct(F.col("core"), (-later).alias("draw"))).where(F.col("step") <= k)
    return cores.join(best.select("graph_id", "node"), ["graph_id", "node"], "left_semi")


def noise_edges(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """max(1, round(share * m)) new edges of each graph. Tries are numbered; a try's draws name its two ends; loops, edges that are
    there and repeated tries do not count; of the others the first are taken. A graph that 128 tries an edge leave short has hardly more
    absent pairs than it needs: they are listed, and the first by draw are taken, all of them if there are no more."""
    known = settle(static_order(nodes(edges).withColumn("zero", F.lit(0)), F.col("zero")))
    sizes = known.groupBy("graph_id").agg(F.count("*").alias("n")).join(edges.groupBy("graph_id").agg(F.count("*").alias("m")), "graph_id")
    sizes = settle(sizes.withColumn("want", F.greatest(F.lit(1), F.round(F.col("m") * share)).cast("long")))
    found, tries = None, 4
    for _ in range(6):
        trial = sizes.select("graph_id", "n", "want", F.explode(F.sequence(F.lit(1).cast("long"), F.col("want") * tries)).alias("try"))
        end = lambda side: (F.conv(F.substring(draw(seed, F.lit(side), "graph_id", "try"), 1, 12), 16, 10).cast("long") % F.col("n") + 1).alias(side)
        drawn = trial.select("graph_id", "try", "want", end("l"), end("r")).where("l <> r")
        for side in ("l", "r"):
            drawn = drawn.join(known.select("graph_id", F.col("step").alias(side), F.col("node").alias(f"{side}_node")), ["graph_id", side])
        pairs = drawn.groupBy("graph_id", F.least("l_node", "r_node").alias("src"), F.greatest("l_node", "r_node").alias("dst")).agg(F.min("try").alias("try"), F.first("want").alias("want"))
        new = pairs.join(edges, ["graph_id", "src", "dst"], "left_anti")
        first = static_order(new.select("graph_id", F.col("try").alias("node"), F.lit(0).alias("zero")), F.col("zero")).withColumnRenamed("node", "try")
        found = settle(new.join(first, ["graph_id", "try"]).where("step <= want").select("graph_id", "src", "dst"))
        short = sizes.join(found.groupBy("graph_id").agg(F.count("*").alias("got")), "graph_id", "left").where("coalesce(got, 0) < want")
        if not short.limit(1).count():
            return found
        tries *= 2
    some = stored(short.select("graph_id", (F.col("want") - F.coalesce("got", F.lit(0))).alias("need")))
    ends = known.join(some, "graph_id").select("graph_id", "node")
    pairs = ends.withColumnRenamed("node", "src").join(ends.withColumnRenamed("node", "dst"), "graph_id").where("src < dst")
    absent = pairs.join(edges, ["graph_id", "src", "dst"], "left_anti").join(found, ["graph_id", "src", "dst"], "left_anti")
    more = ranked_by_draw(stored(absent), seed, "src", "dst").join(some, "graph_id").where("_rank <= need")
    return found.unionByName(more.select("graph_id", "src", "dst"))


def add_noise(edges: DataFrame, share: float, seed: int) -> DataFrame:
    return edges.select("graph_id", "src", "dst").unionByName(noise_edges(edges, share, seed))


def jitter(edges: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Edges with weight max(0.05, 1 + sigma z), z normal from two draws of the edge."""
    u, v = uniform(seed, "src", "dst"), uniform(seed + 1, "src", "dst")
    z = F.sqrt(-2 * F.log(F.lit(1.0) - u)) * F.cos(2 * math.pi * v)
    return edges.select("graph_id", "src", "dst", F.greatest(F.lit(0.05), 1 + sigma * z).alias("weight"))


def unit_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def grid(kinds: list[str], levels: list[float], replicates: int, base: int = 0) -> list[tuple]:
    """(kind, level, replicate, seed): base + 1000 (level + 1) + 100 (kind + 1) + replicate - 1, indexes from 0."""
    return [(k, lv, r, base + 1000 * (j + 1) + 100 * (i + 1) + r - 1) for i, k in enumerate(kinds) for j, lv in enumerate(levels) for r in range(1, replicates + 1)]


def conditions(spark: SparkSession, kinds: list[str], levels: list[float], replicates: int, base: int = 0) -> DataFrame:
    """``grid`` as a DataFrame (kind, level, replicate, seed)."""
    return spark.createDataFrame(grid(kinds, levels, replicates, base), "kind string, level double, replicate long, seed long")


def changes(records: DataFrame, value: str = "anc", clean: str = "clean") -> DataFrame:
    """Adds delta and delta_percent against the clean row (kind = ``clean``) of each dataset; in percent 0 where that is not positive."""
    base = records.where(F.col("kind") == clean).groupBy("dataset").agg(F.first(value).alias("_clean"))
    delta = F.col(value) - F.col("_clean")
    rows = records.join(base, "dataset").withColumns({"delta": delta, "delta_percent": F.when(F.col("_clean") > 0, delta / F.col("_clean") * 100).otherwise(0.0)})
    return rows.drop("_clean")


def by_level(changed: DataFrame, value: str = "anc") -> DataFrame:
    """Means over replicates of each (dataset, kind, level)."""
    return changed.groupBy("dataset", "kind", "level").agg(F.avg(value).alias(value), F.avg("delta_percent").alias("delta_percent"))


def sweep(edges: DataFrame, kinds: list[str], levels: list[float], replicates: int, strategy: str = "degree", base: int = 0) -> DataFrame:
    """(dataset, kind, level, replicate, anc, ...) of the strategy on each graph as it is and under each condition, with its change."""
    make = {"node_delete": lambda e, x, s: without_nodes(e, pick_nodes(nodes(e), x, s)), "edge_delete": drop_edges, "edge_add": add_noise}
    tagged = [edges.withColumn("graph_id", F.concat_ws("|", "graph_id", F.lit("clean"), F.lit(0.0), F.lit(0)))]
    for kind, level, replicate, seed in grid(kinds, levels, replicates, base):
        tagged.append(make[kind](edges, level, seed).withColumn("graph_id", F.concat_ws("|", "graph_id", F.lit(kind), F.lit(level), F.lit(replicate))))
    every = functools.reduce(DataFrame.unionByName, tagged)
    found = orders.evaluate(every, orders.orders(every, [strategy]))
    part = F.split("graph_id", r"\|")
    rows = found.select(part[0].alias("dataset"), part[1].alias("kind"), part[2].cast("double").alias("level"), part[3].cast("long").alias("replicate"), "strategy", "anc", "anc_prefix_k", "fht_50", "fht_10", "lcc_at_k", "k")
    return changes(rows)
