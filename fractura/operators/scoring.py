"""Connected pairs and the largest component after every step of removal orders, on graphs of any size.

An edge lives until the first of its ends goes; that step is its death. What is connected after step t is so by edges of a later death, hence
by a maximum spanning forest. Its rounds, in which every component takes its outgoing edge of the latest death, give a tree of few levels:
a component is the child of the one it becomes part of, below an edge as long-lived as the one it took. Between two nodes the first death
on their way is the same in this tree as in the graph. So after step t the nodes that reach a component of the tree by later deaths are one
component of the graph, where that component's own edge is dead already: counts of nodes by death, carried up the tree, are all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fractura.session import stored

from .graph import nodes

KEY = ["graph_id", "strategy"]
#: Steps that one window sorts; sums of such ranges are added before.
WIDTH = 65_536


def from_above(rows: DataFrame, keys: list[str], at: str, total: str, top: str, width: int = WIDTH) -> DataFrame:
    """Adds <total>_upto and <top>_upto: sum and maximum over the rows of the same keys whose ``at`` is as large or larger. Ranges of
    ``width`` are summed up first, so that no window sorts all rows of a key."""
    part = rows.withColumn("_range", F.floor(F.col(at) / width))
    before = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = part.groupBy(*keys, "_range").agg(F.sum(total).alias("_s"), F.max(top).alias("_t"))
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"), F.max("_t").over(before).alias("_t"))
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(at))
    sums = {f"{total}_upto": F.coalesce(F.sum(total).over(inside), F.lit(0)) + F.col("_s"), f"{top}_upto": F.greatest(F.max(top).over(inside), "_t")}
    return part.join(ranges, [*keys, "_range"]).withColumns(sums).drop("_range", "_s", "_t")


def _pairs(n: Column) -> Column:
    return F.call_function("div", n * (n - 1), F.lit(2))


def _must(good: Column, value: Column) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit("an order must hold each node once, at steps from 1 on")).cast("long"))


def deaths(edges: DataFrame, order: DataFrame, partial: bool) -> tuple[DataFrame, DataFrame]:
    """(graph_id, strategy, u, v, death) of the edges, and (graph_id, strategy, n, more): steps of each order and nodes that it leaves out,
    which only a ``partial`` order may; they go after its last step."""
    once = order.groupBy(*KEY, "node").agg(F.min("step").cast("long").alias("step"), F.count("*").alias("times"))
    once = once.withColumn("step", _must((F.col("times") == 1) & (F.col("step") >= 1), F.col("step"))).drop("times")
    names = once.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("step").alias("last"))
    names = stored(names.select(*KEY, _must(F.col("n") == F.col("last"), F.col("n")).alias("n")))
    steps = nodes(edges).join(names, "graph_id").join(once, [*KEY, "node"], "left")
    steps = stored(steps.select(*KEY, "node", "n", F.coalesce("step", F.col("n") + 1 if partial else _must(F.lit(False), F.col("n"))).alias("step")))
    more = steps.where("step > n").groupBy(*KEY).agg(F.count("*").alias("more"))
    e = edges.select("graph_id", "src", "dst")
    for end, name in (("src", "u"), ("dst", "v")):
        own = steps.select("graph_id", "strategy", F.col("node").alias(end), F.col("step").alias(f"{name}_step"))
        e = e.join(own, ["graph_id", end] if name == "u" else [*KEY, end])
    e = e.select(*KEY, F.col("src").alias("u"), F.col("dst").alias("v"), F.least("u_step", "v_step").alias("death"))
    return stored(e), names.join(more, KEY, "left").na.fill(0, ["more"])


def tree_levels(e: DataFrame) -> list[DataFrame]:
    """Levels of the tree: (graph_id, strategy, x, b, c, w) with c nodes that reach component x by deaths of b or later, and w the death of
    x's own edge, 0 at the top. Nodes alone, the lowest level, are left out. A round at least halves the components that are not whole."""
    levels: list[DataFrame] = []
    state: DataFrame | None = None
    while e.limit(1).count():
        ends = e.select(*KEY, F.explode(F.array("u", "v")).alias("x"), F.struct("death", "u", "v").alias("best"))
        pick = ends.groupBy(*KEY, "x").agg(F.max("best").alias("best"))
        pick = pick.select(*KEY, "x", F.when(F.col("best.u") == F.col("x"), F.col("best.v")).otherwise(F.col("best.u")).alias("to"), F.col("best.death").alias("w"))
        back = pick.select(*KEY, F.col("x").alias("to"), F.col("to").alias("back"))
        first = (F.col("back") == F.col("x")) & (F.col("x") < F.col("to"))
        up = stored(pick.join(back, [*KEY, "to"]).select(*KEY, "x", "w", F.when(first, F.col("x")).otherwise(F.col("to")).alias("up")))
        while True:
            one = up.select(*KEY, F.col("x").alias("up"), F.col("up").alias("over"))
            two = up.select(*KEY, F.col("x").alias("over"), F.col("up").alias("top"))
            new = stored(up.join(one, [*KEY, "up"]).join(two, [*KEY, "over"]).select(*KEY, "x", "w", F.col("top").alias("up"), (F.col("top") != F.col("over")).alias("moved")))
            up = new.drop("moved")
            if not new.where("moved").limit(1).count():
                break
        if state is None:
            grown = up.groupBy(*KEY, F.col("up").alias("x"), F.col("w").alias("b")).agg(F.count("*").alias("c"))
        else:
            known = state.join(up, [*KEY, "x"], "left")
            levels.append(known.select(*KEY, "x", "b", "c", F.coalesce("w", F.lit(0)).alias("w")))
            grown = known.where("up is not null").groupBy(*KEY, F.col("up").alias("x"), F.least("b", "w").alias("b")).agg(F.sum("c").alias("c"))
        state = stored(grown)
        for end in ("u", "v"):
            e = e.join(up.select(*KEY, F.col("x").alias(end), F.col("up").alias(f"{end}_up")), [*KEY, end])
        e = e.where("u_up <> v_up").groupBy(*KEY, F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v")).agg(F.max("death").alias("death"))
        e = stored(e)
    if state is not None:
        levels.append(state.withColumn("w", F.lit(0).cast("long")))
    return levels


def changes(level: DataFrame, width: int = WIDTH) -> DataFrame:
    """(graph_id, strategy, step, pairs, top): what one level adds to the connected pairs from a step down to 0, and sizes reached there. A
    component of the tree is one of the graph from its own edge's death on; what it holds then passes to the one above."""
    here = from_above(level.where("b > w"), [*KEY, "x"], "b", "c", "b", width)
    now, last = F.col("c_upto"), F.col("c_upto") - F.col("c")
    came = here.select(*KEY, (F.col("b") - 1).alias("step"), (_pairs(now) - _pairs(last)).alias("pairs"), now.alias("top"))
    held = level.where("b > w and w > 0").groupBy(*KEY, "x", "w").agg(F.sum("c").alias("c"))
    gone = held.select(*KEY, (F.col("w") - 1).alias("step"), (-_pairs(F.col("c"))).alias("pairs"), F.lit(None).cast("long").alias("top"))
    return came.unionByName(gone)


def step_series(edges: DataFrame, order: DataFrame, partial: bool = False, width: int = WIDTH) -> DataFrame:
    """(graph_id, strategy, step, cp, lcc): connected pairs and the largest component after each step from 0 on.

    order: (graph_id, strategy, node, step), steps from 1 without gaps; each node of the graph must be there once (an error otherwise),
    unless ``partial``: then the others stay after its last step. Nodes without edges may be in an order. Graphs without an order have
    no rows.
    """
    order = stored(order.select(*KEY, "node", "step"))
    e, names = deaths(edges, order, partial)
    points = order.select(*KEY, F.col("step").cast("long").alias("step")).unionByName(names.select(*KEY, F.lit(0).cast("long").alias("step")))
    points = points.withColumns({"pairs": F.lit(0).cast("long"), "top": F.lit(None).cast("long"), "shown": F.lit(True)})
    for level in tree_levels(e):
        points = points.unionByName(changes(level, width).withColumn("shown", F.lit(False)))
    each = points.groupBy(*KEY, "step").agg(F.sum("pairs").alias("pairs"), F.max("top").alias("top"), F.max("shown").alias("shown"))
    found = from_above(each, KEY, "step", "pairs", "top", width).where("shown").join(names, KEY)
    alone = (F.col("step") < F.col("n") + F.col("more")).cast("long")
    return found.select(*KEY, "step", F.col("pairs_upto").alias("cp"), F.greatest("top_upto", alone).alias("lcc"))


def metrics(series: DataFrame, share: float = 0.15) -> DataFrame:
    """ANC, its prefix form, first hitting times of one half and one tenth (1-based; the last step if never), and the largest component
    after k = max(1, share of the steps), from a ``step_series``. Without connected pairs the first two are 0 and the times 1."""
    heads = series.groupBy(*KEY).agg(F.max("step").alias("n"), F.max(F.when(F.col("step") == 0, F.col("cp"))).alias("c0"))
    heads = heads.withColumn("k", F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n"))).cast("long"))
    rows = stored(series).where("step > 0").join(heads, KEY)
    cp, none = F.col("cp").cast("decimal(20,0)"), F.col("c0") == 0
    ratio = F.try_divide("cp", "c0")
    summed = rows.groupBy(*KEY, "n", "c0", "k").agg(
        F.sum(cp).cast("double").alias("all"),
        F.sum(F.when(F.col("step") <= F.col("k"), cp)).cast("double").alias("early"),
        *(F.min(F.when(ratio <= t, F.col("step"))).alias(name) for name, t in (("half", 0.5), ("tenth", 0.1))),
        F.max(F.when(F.col("step") == F.col("k"), F.col("lcc"))).alias("lcc"),
    )
    hit = lambda c: F.when(none, F.lit(1)).otherwise(F.coalesce(c, "n")).cast("long")
    mean = lambda c, n: F.when(none, 0.0).otherwise(F.col(c) / (F.col("c0") * F.col(n).cast("double")))
    return summed.select(*KEY, mean("all", "n").alias("anc"), mean("early", "k").alias("anc_prefix_k"), hit("half").alias("fht_50"), hit("tenth").alias("fht_10"), (F.col("lcc") / F.col("n")).alias("lcc_at_k"), "k")
