"""Experiment analytics: phases, milestones, comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def phase(generation: Column) -> Column:
    return F.when(generation.between(1, 10), "early").when(generation.between(11, 20), "middle").when(generation.between(21, 30), "late").otherwise("other")


def operator_share(trace: DataFrame) -> DataFrame:
    """Dense phase x operator grid with shares inside the phase, 0 where there is none."""
    t = trace.select(phase(F.col("generation")).alias("phase"), "operator")
    n = t.groupBy("phase", "operator").agg(F.count("*").alias("n"))
    grid = t.select("phase").distinct().crossJoin(t.select("operator").distinct())
    dense = grid.join(n, ["phase", "operator"], "left").select("phase", "operator", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return dense.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("phase")))


def milestones(curve: DataFrame, levels: list[float]) -> DataFrame:
    """For each level the first generation whose best-so-far is within that share of the whole gain."""
    ends = curve.agg(F.max_by("best_so_far", -F.col("generation")).alias("first"), F.min("best_so_far").alias("last"))
    goals = ends.select("first", "last", F.explode(F.array(*map(F.lit, levels))).alias("level")).select("level", (F.col("first") - F.col("level") * (F.col("first") - F.col("last"))).alias("target"))
    return curve.join(F.broadcast(goals), F.col("best_so_far") <= F.col("target") + 1e-12).groupBy("level").agg(F.min("target").alias("target"), F.min("generation").alias("generation"))


def compare(scores: DataFrame, ours: str) -> DataFrame:
    """(dataset, method, value, diff, percent, best): ours minus each method, in percent of it; null in our own row."""
    w = Window.partitionBy("dataset")
    mine = F.max(F.when(F.col("method") == ours, F.col("value"))).over(w)
    diff = F.when(F.col("method") != ours, mine - F.col("value"))
    return scores.select("dataset", "method", "value", diff.alias("diff"), (100 * diff / F.col("value")).alias("percent"), (F.col("value") == F.min("value").over(w)).alias("best"))


def pivot(scores: DataFrame, methods: list[str]) -> DataFrame:
    return scores.groupBy("dataset").pivot("method", methods).agg(F.first("value"))


def trajectory(rows: DataFrame) -> DataFrame:
    """(run, generation, objective, operator, best_so_far, improves, delta): as ``evolve.best_so_far``, for one row a generation and
    several runs. Generation 0 and rows without objective go."""
    w = Window.partitionBy("run").orderBy("generation")
    before = F.min("objective").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.where((F.col("generation") > 0) & F.col("objective").isNotNull()).withColumn("_b", before)
    better = F.col("_b").isNull() | (F.col("objective") < F.col("_b") - 1e-12)
    out = kept.withColumns({"improves": better, "delta": F.when(F.col("_b").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_b") - F.col("objective"))), "best_so_far": F.least("objective", F.coalesce("_b", "objective"))})
    return out.select("run", "generation", "objective", "operator", "best_so_far", "improves", "delta")


def jumps(rows: DataFrame) -> DataFrame:
    """Adds jump to (run, generation, value): the first row, and those below the one before by more than 1e-12."""
    last = F.lag("value").over(Window.partitionBy("run").orderBy("generation"))
    return rows.withColumn("jump", last.isNull() | (F.col("value") < last - 1e-12))


def gains(curve: DataFrame) -> DataFrame:
    """A row a run of ``trajectory``: start, final, first generation within 95 % of the gain, first at the final value, generations from
    there on (plateau) and their share, improvements after the first row, their mean, and the operator of most improvements (the first
    one counted, too; ties: the one seen first)."""
    ends = curve.groupBy("run").agg(F.min_by("best_so_far", "generation").alias("start"), F.min("best_so_far").alias("final"), F.count("*").alias("n"))
    c = curve.join(ends, "run")
    out = c.groupBy("run").agg(
        F.first("start").alias("start"),
        F.first("final").alias("final"),
        F.min(F.when(F.col("best_so_far") <= F.col("start") - 0.95 * (F.col("start") - F.col("final")) + 1e-12, F.col("generation"))).alias("first_95"),
        F.min(F.when(F.abs(F.col("best_so_far") - F.col("final")) <= 1e-12, F.col("generation"))).alias("first_best"),
        F.first("n").alias("n"),
        (F.sum(F.col("improves").cast("long")) - 1).alias("improvements"),
        F.sum(F.when(F.col("improves"), F.col("delta")).otherwise(0.0)).alias("_sum"),
    )
    by = curve.where("improves").groupBy("run", "operator").agg(F.count("*").alias("k"), F.min("generation").alias("seen"))
    top = by.groupBy("run").agg(F.max_by("operator", F.struct("k", -F.col("seen"))).alias("dominant"))
    plateau = F.col("n") - F.col("first_best") + 1
    return out.join(top, "run").select("run", "start", "final", "first_95", "first_best", plateau.alias("plateau"), (plateau / F.col("n")).alias("plateau_ratio"), "improvements", F.when(F.col("improvements") > 0, F.col("_sum") / F.col("improvements")).otherwise(0.0).alias("mean_improvement"), "dominant")


def ablation(curve: DataFrame) -> DataFrame:
    """(run, final, improvements): final best, and the number of improving rows, of each arm."""
    return curve.groupBy("run").agg(F.min("best_so_far").alias("final"), F.sum(F.col("improves").cast("long")).alias("improvements"))


def top_tags(weights: DataFrame, order: list[str], k: int = 2) -> DataFrame:
    """(run, tag, weight, rank): the k tags of the largest mean weight of each run; ties in the order given."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("tag"))
    mean = weights.groupBy("run", "tag").agg(F.round(F.avg("weight"), 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("weight"), place))
    return mean.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def mean_of_known(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean): of values that are numbers (null and texts that are none are skipped); null where there is none."""
    x = F.expr(f"try_cast({value} as double)")
    return rows.groupBy(by).agg(F.avg(F.when(~F.isnan(x), x)).alias("mean"))


def dense_grid(scores: DataFrame, datasets: DataFrame, methods: list[str]) -> DataFrame:
    """Each dataset with each method; null where there is no value."""
    grid = datasets.select("dataset").distinct().withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    return grid.join(scores, ["dataset", "method"], "left").select("dataset", "method", "value")


def lead(grid: DataFrame, ours: str) -> DataFrame:
    """(dataset, best_baseline, ours, delta): the smallest known value of the others less ours; null if either is missing."""
    mine = F.max(F.when(F.col("method") == ours, F.col("value")))
    best = F.min(F.when((F.col("method") != ours) & ~F.isnan("value"), F.col("value")))
    return grid.groupBy("dataset").agg(best.alias("best_baseline"), mine.alias("ours")).withColumn("delta", F.col("best_baseline") - F.col("ours"))


def signed(delta: Column, whole: bool) -> Column:
    """A difference with its sign: rounded to a whole number, or to three decimals."""
    sign = F.when(delta > 0, "+").otherwise("")
    return F.concat(sign, F.format_string("%d", F.rint(delta).cast("long")) if whole else F.format_string("%.3f", F.bround(delta, 3)))


def is_sample(dataset: Column) -> Column:
    return F.contains(F.lower(dataset), F.lit("sample"))


def variant_rank(dataset: Column) -> Column:
    """0 for samples, 1 for those of 4000 nodes, 2 for others."""
    return F.when(dataset.endswith("_sample") | dataset.endswith("_sampled"), 0).when(dataset.contains("4000"), 1).otherwise(2)


def first_match(keys: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keys with their first row by ``order``; nulls where there is none."""
    best = rows.groupBy(key).agg(F.min(F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("_r")).select(key, "_r.*")
    return keys.select(key).distinct().join(best, key, "left")


def markdown(compared: DataFrame, ours: str) -> DataFrame:
    """(dataset, line, text) of a table from ``compare``: ours first, then the others by value and name; bold are the dataset in its first
    line, our method, and the smallest value; ``-`` stands for what is missing."""
    mine = F.col("method") == ours
    line = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(mine), "value", "method"))
    bold = lambda x, yes: F.when(yes, F.concat(F.lit("**"), x, F.lit("**"))).otherwise(x)
    number = lambda c, p: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f"%.{p}f", F.col(c)))
    rows = compared.withColumn("line", line.cast("long"))
    cells = F.concat_ws(" | ", F.when(F.col("line") == 1, bold(F.col("dataset"), F.lit(True))).otherwise(""), bold(F.col("method"), mine), bold(number("value", 4), F.coalesce(F.col("best"), F.lit(False))), number("diff", 4), number("percent", 2))
    return rows.select("dataset", "line", F.concat(F.lit("| "), cells, F.lit(" |")).alias("text"))


def formatted(value: Column) -> Column:
    """A whole number without decimals, else one decimal (halves to even); ``-`` for null."""
    return F.when(value.isNull(), "-").when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.1f", F.bround(value, 1)))


def narrative(curve: DataFrame, places: int = 5) -> DataFrame:
    """All improvements in order as one text, ``g3(op):a->b`` each: generation, operator, the best before and after. curve: (generation,
    operator, best, before, improves); an improvement without a best before is the start, and left out."""
    number = lambda c: F.format_string(f"%.{places}f", c)
    text = F.concat(F.lit("g"), F.col("generation").cast("string"), F.lit("("), "operator", F.lit("):"), number("before"), F.lit("->"), number("best"))
    jumps = curve.where("improves and before is not null").agg(F.array_sort(F.collect_list(F.struct("generation", text.alias("s")))).alias("j"))
    return jumps.select(F.array_join(F.transform("j", lambda x: x.s), "; ").alias("jumps"))
