"""Candidates of a search as texts: parsing answers, views, multi-view distance, and summaries by generation and step.

A trace has (step, generation, id, objective, description, reflection, code), steps counted from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fractura.session import stored

from . import sparse, text

VIEWS = ("description", "reflection", "code")
#: Pairs at this distance or nearer are in one basin.
NEAR = 0.42
LEVELS = (0.25, 0.50, 0.75, 0.90, 1.00)
#: Tags and the patterns that stand for them.
TAGS = {
    "Bridge / Boundary": ["bridge", "bottleneck", "conductance", "resistance", "boundary", "cut", "fragment", "detour", "flow", "component", "split", "stress", "high_bc"],
    "Centrality Mix": ["betweenness", "eigenvector", "centrality", "harmonic mean", "geometric mean", "anchor", "entropy"],
    "Core / Degree": ["core", "coreness", "degree", "hub", "high-core"],
    "Local Cohesion": ["clustering", "neighbor", "neighborhood", "local", "cohesion", "redundancy", "2-hop", "union-find"],
    "Spectral / Path": ["laplacian", "spectral", "path", "apl", "diameter", "decay", "distance"],
    "Adaptive Weighting": ["dynamic", "progress", "phase", "weight", "target", "residual", "penalty", "adaptive", "modulat", "calibrat"],
}
DEFAULT_TAG = "Centrality Mix"
#: Labels that end a labelled field.
LABELS = ("Analysis", "Thought", "Reflection", "AwareProfile", "Algorithm Description", "Code")


# --- answers


def parsed(raw: Column) -> dict[str, Column]:
    """Reflection, description and fenced code of a labelled answer; empty where they are missing."""
    found = lambda p: F.coalesce(F.regexp_extract(raw, p, 1), F.lit(""))
    return {
        "reflection": text.squeeze(found(r"(?is)Reflection:\s*(.*?)(?=\s*Algorithm Description:|\s*Code:|$)")),
        "description": text.squeeze(found(r"(?is)Algorithm Description:\s*\{?(.*?)\}?(?=\s*Code:|$)")),
        "code": F.regexp_replace(found(r"(?is)Code:\s*```(?:python)?\s*(.*?)```"), r"^\s+|\s+$", ""),
    }


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def labelled(raw: Column, label: str) -> Column:
    """What follows ``label:`` up to a line that begins with a known label, or the end; null if there is nothing."""
    stop = "|".join(LABELS)
    return F.nullif(_stripped(F.regexp_extract(raw, rf"(?is){label}\s*:\s*(.*?)(?:\n\s*(?:{stop})\s*:|\z)", 1)), F.lit(""))


def description(raw: Column) -> Column:
    """The last text in braces, else what stands before the code, without marks at its end."""
    head = F.regexp_replace(_stripped(F.element_at(F.split(raw, r"```python|def\s+\w+\s*\("), 1)), r"[\s`#*]+$", "")
    return F.coalesce(_stripped(F.try_element_at(F.regexp_extract_all(raw, F.lit(r"(?s)\{(.*?)\}"), F.lit(1)), F.lit(-1))), F.nullif(head, F.lit("")), F.lit("No algorithm description found."))


def code(raw: Column) -> Column:
    """The last fenced block; else all from the first function on; else from the first import to its return; else null."""
    last = lambda p: _stripped(F.try_element_at(F.regexp_extract_all(raw, F.lit(p), F.lit(1)), F.lit(-1)))
    return F.coalesce(last(r"(?s)```python(.*?)```"), last(r"(?s)(def\s+\w+\s*\(.*)"), last(r"(?s)(def.*?return[^\n]*)"), last(r"(?s)(import.*?return[^\n]*)"))


def longest(*texts: Column) -> Column:
    """The longest of the squeezed texts, the first of equal ones; empty if all are null."""
    clean = F.array(*(text.squeeze(F.coalesce(t, F.lit(""))) for t in texts))
    return F.aggregate(clean, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))


def prompt(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` filled in from columns; null fields are empty."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def tag_weights(rows: DataFrame, tags: dict[str, list[str]] = TAGS, default: str = DEFAULT_TAG) -> DataFrame:
    """(id, tag, weight): 2 for each pattern of a tag in the description, 0.6 for each in the code (1 without a description), as shares
    of their sum; all on the default tag if there are none."""
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    per = F.when(lower("description") != "", 0.6).otherwise(1.0)
    score = {t: sum((F.when(lower("description").rlike(p), 2.0).otherwise(0.0) + F.when(lower("code").rlike(p), per).otherwise(0.0) for p in ps), F.lit(0.0)) for t, ps in tags.items()}
    total = sum(score.values(), F.lit(0.0))
    pairs = F.array(*(F.struct(F.lit(t).alias("tag"), F.when(total <= 0, 1.0 if t == default else 0.0).otherwise(x / total).alias("weight")) for t, x in score.items()))
    return rows.select("id", F.inline(pairs))


# --- traces


def trace(rows: DataFrame) -> DataFrame:
    """Adds step to candidates (generation, index, id, objective, ...): generation 0 and failed ones go, the others are counted in order.
    Counts by generation come first, so that no task sorts the whole trace."""
    kept = rows.where((F.col("generation") > 0) & F.col("objective").isNotNull())
    ahead = kept.groupBy("generation").agg(F.count("*").alias("n"))
    ahead = ahead.select("generation", F.coalesce(F.sum("n").over(Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("generation").orderBy("index"))
    return kept.join(ahead, "generation").withColumn("step", (F.col("ahead") + own).cast("long")).drop("ahead")


def collapsed(rows: DataFrame) -> DataFrame:
    """(id, description, reflection, code): of each view the longest text among a candidate's rows, the earliest of equal ones."""
    best = lambda c, t: F.coalesce(F.max_by(t, F.struct(F.length(t), -F.col("step"))), F.lit("")).alias(c)
    return rows.groupBy("id").agg(best("description", text.squeeze(F.col("description"))), best("reflection", text.squeeze(F.col("reflection"))), best("code", F.col("code")))


def vectors(docs: DataFrame) -> DataFrame:
    """(view, id, token, w): TF-IDF vectors of the three views, computed once."""
    out = None
    for view in VIEWS:
        w = text.tfidf(docs.select(F.col("id").alias("doc_id"), F.col(view).alias("text")), view == "code").select(F.lit(view).alias("view"), F.col("doc_id").alias("id"), "token", "w")
        out = w if out is None else out.unionByName(w)
    return stored(out)


def near_pairs(weights: DataFrame, near: float = NEAR) -> DataFrame:
    """(a, b, distance) of the pairs at a distance of ``near`` or less: 1 less the mean cosine of the views. Vectors meet tile against tile, so
    that only near pairs leave a task."""
    found = stored(sparse.products(weights, len(VIEWS) * (1 - near), VIEWS))
    return found.select("a", "b", F.greatest(F.lit(0.0), 1 - F.col("dot") / len(VIEWS)).alias("distance")).where(F.col("distance") <= near + 1e-12)


def mean_distance(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(generation, div_pair): the mean distance of all pairs of a generation's rows, 0 below two; rows of one candidate are at 0. From
    sums of vectors, not from pairs: the dot products of all pairs are half of |sum|^2 less the sum of |x|^2."""
    count = rows.groupBy("generation", "id").agg(F.count("*").alias("m"))
    filled = weights.select("view", "id").distinct().groupBy("id").agg(F.count("*").alias("views"))
    sums = count.join(weights, "id").groupBy("generation", "view", "token").agg(F.sum(F.col("m") * F.col("w")).alias("x"))
    square = sums.groupBy("generation").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    own = count.join(filled, "id", "left").withColumn("views", F.coalesce("views", F.lit(0)))
    m, v = F.col("m"), F.col("views")
    per = own.groupBy("generation").agg(F.sum("m").alias("n"), F.sum(m * v).alias("self"), F.sum(m * (m - 1) / 2 * (1 - v / len(VIEWS))).alias("same"))
    n = F.col("n")
    pairs = n * (n - 1) / 2
    total = pairs - (F.coalesce("square", F.lit(0.0)) - F.col("self")) / 2 / len(VIEWS) - F.col("same")
    return per.join(square, "generation", "left").select("generation", F.when(n <= 1, 0.0).otherwise(total / pairs).alias("div_pair"))


def generation_summary(rows: DataFrame, basins: DataFrame, diversity: DataFrame) -> DataFrame:
    """A row a generation: size, best, best so far, mean distance, new basins, basins, basins so far."""
    r = rows.join(basins, "id")
    first = r.groupBy("basin").agg(F.min("generation").alias("generation")).groupBy("generation").agg(F.count("*").alias("novel_basins"))
    g = r.groupBy("generation").agg(F.count("*").alias("population_size"), F.min("objective").alias("best"), F.countDistinct("basin").alias("basins"))
    w = Window.orderBy("generation")
    g = g.join(first, "generation", "left").join(diversity, "generation").withColumn("novel_basins", F.coalesce("novel_basins", F.lit(0)))
    return g.withColumns({"best_so_far": F.min("best").over(w), "basins_so_far": F.sum("novel_basins").over(w)})


def step_summary(rows: DataFrame, basins: DataFrame) -> DataFrame:
    """A row a step: objective, best so far, basin, basins so far, and their effective number exp(entropy). With c the counts so far and
    N their sum, the entropy is ln N - sum(c ln c) / N, and a step adds c ln c - (c - 1) ln(c - 1): running sums, no pairs of steps."""
    r = rows.join(basins, "id").withColumn("c", F.row_number().over(Window.partitionBy("basin").orderBy("step")).cast("double"))
    c, w = F.col("c"), Window.orderBy("step")
    grown = c * F.log(c) - F.when(c > 1, (c - 1) * F.log(F.greatest(c - 1, F.lit(1.0)))).otherwise(0.0)
    r = r.withColumns({"best_so_far": F.min("objective").over(w), "basins_so_far": F.sum((c == 1).cast("long")).over(w), "_s": F.sum(grown).over(w)})
    return r.select("step", "generation", "id", "objective", "best_so_far", "basin", "basins_so_far", F.exp(F.log(F.col("step").cast("double")) - F.col("_s") / F.col("step")).alias("effective"))


def complexity(generations: DataFrame, by_step: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """For each level of the whole gain: the target, and the first step that reaches it with its generation and the basins so far."""
    ends = generations.agg(F.min_by("best", "generation").alias("start")).crossJoin(by_step.agg(F.min("best_so_far").alias("final")))
    goals = ends.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("target", F.col("start") - F.col("level") * F.greatest(F.lit(0.0), F.col("start") - F.col("final")))
    hit = by_step.join(F.broadcast(goals), F.col("best_so_far") <= F.col("target") + 1e-12)
    return hit.groupBy("level").agg(F.first("target").alias("target"), F.first("start").alias("start"), F.first("final").alias("final"), F.min("step").alias("step"), F.min_by("generation", "step").alias("generation"), F.min_by("basins_so_far", "step").alias("basins_so_far"))


def quality(rows: DataFrame, basins: DataFrame) -> DataFrame:
    """One row: basins, the largest one's share and the sum of squared shares of the trace, and how many basins (and which share of
    them) the best tenth and quarter of the objectives are in."""
    r = rows.join(basins, "id")
    cut = r.agg(F.percentile("objective", F.lit(0.10)).alias("q10"), F.percentile("objective", F.lit(0.25)).alias("q25"), F.count("*").alias("n"))
    b = r.crossJoin(F.broadcast(cut)).groupBy("basin").agg((F.count("*") / F.first("n")).alias("share"), F.max((F.col("objective") <= F.col("q10")).cast("int")).alias("t10"), F.max((F.col("objective") <= F.col("q25")).cast("int")).alias("t25"))
    return b.agg(F.count("*").alias("basins"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("largest"), F.sum("t10").alias("top10"), F.sum("t25").alias("top25"), (F.sum("t10") / F.count("*")).alias("top10_share"), (F.sum("t25") / F.count("*")).alias("top25_share"))


def matched(rows: DataFrame, arm: str) -> DataFrame:
    """The first steps of each arm, as many as the shortest arm has."""
    n = rows.groupBy(arm).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_budget"))
    return rows.crossJoin(F.broadcast(n)).where(F.col("step") <= F.col("_budget")).drop("_budget")
