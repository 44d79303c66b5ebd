"""Selection, acceptance and adaptive control of a search, over candidates(generation, id, operator, objective, code, time)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evolve import clip
from .perturb import draw
from .trials import Trials

#: Factors of a base weight by phase (explore, transition, exploit) for operators that mutate, that cross over, and for others.
PROFILES = {"mutation": (1.45, 1.00, 0.70), "crossover": (0.80, 1.00, 1.40), "other": (1.10, 1.00, 0.95)}
PHASES = ("explore", "transition", "exploit")


def number(seed: int, *key: str) -> Column:
    """A whole number from the first twelve hex digits of the draw."""
    return F.conv(F.substring(draw(seed, *key), 1, 12), 16, 10).cast("long")


# --- parents and acceptance


def _asked(ranked: DataFrame, m: int) -> DataFrame:
    """(generation, n, draw): m draws for each generation of ranked(generation, rank, ...)."""
    n = ranked.groupBy("generation").agg(F.count("*").alias("n"))
    return n.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(m))))


def uniform_parents(ranked: DataFrame, m: int, seed: int) -> DataFrame:
    """(generation, draw, id): m members of each generation, any of them each time."""
    asked = _asked(ranked, m).withColumn("rank", number(seed, "generation", "draw") % F.col("n") + 1)
    return asked.join(ranked, ["generation", "rank"]).select("generation", "draw", "id")


def tournament_parents(ranked: DataFrame, m: int, seed: int) -> DataFrame:
    """(generation, draw, id): the better of two different members, m times; the member itself if it is alone."""
    one = number(seed, F.lit("a"), "generation", "draw") % F.col("n")
    two = (F.col("one") + 1 + number(seed, F.lit("b"), "generation", "draw") % F.greatest(F.col("n") - 1, F.lit(1))) % F.col("n")
    asked = _asked(ranked, m).withColumn("one", one).withColumn("two", two).withColumn("rank", F.least("one", "two") + 1)
    return asked.join(ranked, ["generation", "rank"]).select("generation", "draw", "id")


def weighted_parents(weights: DataFrame, m: int, seed: int) -> DataFrame:
    """(generation, draw, id): m draws with replacement from (generation, id, weight), weights of a generation summing up to 1: the first
    member, by id, whose running sum is above the draw's number."""
    w = Window.partitionBy("generation").orderBy("id")
    ends = weights.withColumn("high", F.when(F.lead("id").over(w).isNull(), 2.0).otherwise(F.round(F.sum("weight").over(w), 9)))
    ends = ends.withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0)))
    u = number(seed, "generation", "draw") / float(1 << 48)
    asked = _asked(weights, m).withColumn("u", u)
    return asked.join(ends, "generation").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("generation", "draw", "id")


def annealed(chain: DataFrame, total: int, seed: int) -> DataFrame:
    """(operator, generation, objective, kept, accepted): a single solution per operator, replaced by a better candidate always, by a
    worse one if exp(((old - new) / old) / T) is above the generation's number, T = 0.5 (1 - generation / total); never at T = 0. A
    failed candidate changes nothing; the first valid one is taken."""
    rows = chain.withColumn("u", number(seed, "operator", "generation") / float(1 << 48))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        old, out = None, []
        for r in pdf.sort_values("generation").itertuples():
            new, heat = (None if pd.isna(r.objective) else r.objective), 0.5 * (1 - r.generation / total)
            take = new is not None and (old is None or new < old or (heat > 0 and old != 0 and math.exp((old - new) / old / heat) > r.u))
            old = new if take else old
            out.append((r.operator, r.generation, new, old, bool(take)))
        return pd.DataFrame(out, columns=["operator", "generation", "objective", "kept", "accepted"])

    return rows.groupBy("operator").applyInPandas(one, "operator string, generation long, objective double, kept double, accepted boolean")


def duplicates(candidates: DataFrame) -> DataFrame:
    """Adds key (md5 of the code) and duplicate: whether a candidate of a smaller id has the same code."""
    first = candidates.groupBy("code").agg(F.min("id").alias("_first"))
    return candidates.join(first, "code").withColumns({"key": F.md5("code"), "duplicate": F.col("id") > F.col("_first")}).drop("_first")


def evaluated(candidates: DataFrame, score: Callable[[dict], float], schema: str, timeout: float = 600.0, memory: int | None = None) -> DataFrame:
    """Adds objective (to five places) and error to the rows: what ``score`` gives for a row, or the text of what went wrong, so that one bad
    candidate doesn't end the run. ``schema``: the candidates' columns.

    Rows are scored one after the other in a child process of the task (``trials``), which a row may hold for ``timeout`` seconds and
    make grow by ``memory`` bytes. Errors: ``Type: text`` of an exception (MemoryError beyond the memory), ``Timeout after ..s``, ``No result``
    for a score of None, ``Ended with ..`` where the row ended the process.
    """
    names = candidates.columns

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Trials(score, timeout, memory) as trial:
            for f in frames:
                out = [trial(r) for r in f.to_dict("records")]
                yield f.assign(objective=[x for x, _ in out], error=[e for _, e in out])[[*names, "objective", "error"]]

    return candidates.mapInPandas(rows, f"{schema}, objective double, error string")


def triggered(weights: DataFrame, seed: int) -> DataFrame:
    """Adds triggered: whether the operator's number in this generation is below its weight."""
    return weights.withColumn("triggered", number(seed, "generation", "operator") / float(1 << 48) < F.col("weight"))


def protected(x: Column, y: Column, delta: float = 1e-8) -> Column:
    """A division whose divisor is moved away from zero."""
    return x / (y + delta)


# --- what operators achieve


def steps(candidates: DataFrame) -> DataFrame:
    """Adds step: operators run one after the other, by name, in each generation."""
    pairs = candidates.select("generation", "operator").distinct()
    return candidates.join(F.broadcast(pairs.withColumn("step", F.row_number().over(Window.orderBy("generation", "operator")))), ["generation", "operator"])


def populations(candidates: DataFrame, n: int) -> DataFrame:
    """(step, id, objective, rank): after each step the n best of all candidates so far, of one code and of one objective the first
    only. Before candidates meet the steps behind theirs, each step leaves one row for each code."""
    s = steps(candidates.where("objective is not null"))
    best = s.groupBy("step", "code").agg(F.min(F.struct("objective", "id")).alias("t")).select(F.col("step").alias("own"), "code", "t.*")
    upto = best.join(F.broadcast(s.select("step").distinct()), F.col("own") <= F.col("step"))
    first = lambda *by: F.row_number().over(Window.partitionBy("step", *by).orderBy("objective", "id"))
    left = upto.withColumn("r", first("code")).where("r = 1").withColumn("r", first("objective")).where("r = 1")
    return left.withColumn("rank", first().cast("long")).where(F.col("rank") <= n).select("step", "id", "objective", "rank")


def accepted(population: DataFrame) -> DataFrame:
    """(step, id): members that were not there a step before."""
    before = population.select((F.col("step") + 1).alias("step"), "id")
    return population.select("step", "id").join(before, ["step", "id"], "left_anti")


def statistics(candidates: DataFrame, n: int) -> DataFrame:
    """A row for each generation and operator: attempted, triggered (it has offspring), offspring, valid, accepted (into a population of
    n), best, best_before (of the candidates of earlier steps) and the sum of times."""
    s = steps(candidates)
    got = s.groupBy("generation", "operator").agg(F.first("step").alias("step"), F.count("*").alias("offspring"), F.count("objective").alias("valid"), F.min("objective").alias("best"), F.sum("time").alias("time_total"))
    took = accepted(populations(candidates, n)).groupBy("step").agg(F.count("*").alias("accepted"))
    grid = got.select("generation").distinct().crossJoin(F.broadcast(got.select("operator").distinct()))
    rows = grid.join(got, ["generation", "operator"], "left").join(took, "step", "left")
    before = F.min("best").over(Window.orderBy("generation", "operator").rowsBetween(Window.unboundedPreceding, -1))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.withColumn("best_before", before).select("generation", "operator", F.lit(1).alias("attempted"), F.col("offspring").isNotNull().cast("int").alias("triggered"), zero("offspring"), zero("valid"), zero("accepted"), "best", "best_before", F.coalesce("time_total", F.lit(0.0)).alias("time_total"))


def rewards(stats: DataFrame) -> DataFrame:
    """(generation, operator, reward): 1.6 gain + 0.5 accepted + 0.2 valid - 0.3 failed - 0.15 t / (t + 1), in [-1, 1]; gain is relative to
    the best before, the others are shares of the offspring, t is its mean time. 0 without offspring."""
    n = F.col("offspring")
    valid, mean = F.col("valid") / n, F.col("time_total") / n
    gain = F.coalesce(F.greatest(F.lit(0.0), F.col("best_before") - F.col("best")) / (F.abs("best_before") + 1e-8), F.lit(0.0))
    gain = F.when(F.col("best").isNull() | F.col("best_before").isNull(), 0.0).otherwise(gain)
    total = 1.6 * gain + 0.5 * F.col("accepted") / n + 0.2 * valid - 0.3 * (1 - valid) - 0.15 * mean / (mean + 1)
    return stats.select("generation", "operator", F.when(n > 0, clip(total, -1.0, 1.0)).otherwise(0.0).alias("reward"))


def averaged(rows: DataFrame, start: dict[str, float], keep: float = 0.75, by: tuple[str, ...] = (), frame: int = 256) -> DataFrame:
    """Columns of ``start`` as exponential averages over generations (x = keep x + (1 - keep) new), from the given values. What is more than
    ``frame`` generations back weighs less than any bit of the result."""
    w = Window.partitionBy(*by).orderBy("generation") if by else Window.orderBy("generation")
    some = lambda c, first: F.aggregate(F.collect_list(c).over(w.rowsBetween(1 - frame, 0)), F.lit(first), lambda s, x: keep * s + (1 - keep) * x)
    return rows.withColumns({c: some(c, first) for c, first in start.items()})


def smoothed(state: DataFrame) -> DataFrame:
    """The averaged state (generation, d, i, s, v) that schedules see: validity is known only after a generation, so the one before counts."""
    late = F.lag("v").over(Window.orderBy("generation"))
    rows = averaged(state, {"d": 1.0, "i": 0.0, "s": 0.0, "v": 1.0})
    return rows.withColumn("v", F.coalesce(late, F.lit(1.0)))


def all_failed(candidates: DataFrame) -> DataFrame:
    """(generation, stop): whether a generation has candidates, and none is valid."""
    return candidates.groupBy("generation").agg((F.count("objective") == 0).alias("stop"))


def guidance(curve: DataFrame, total: int) -> DataFrame:
    """(generation, profile): ``boundary`` from the first generation (8 at least) that is stale for 2; ``reinsertion`` from the first after
    that, at a progress of 0.4 at least, that is stale for 3. curve: (generation, stale)."""
    g, every = F.col("generation"), Window.partitionBy()
    rows = curve.withColumn("b", F.min(F.when((g >= 8) & (F.col("stale") >= 2), g)).over(every))
    rows = rows.withColumn("r", F.min(F.when((g > F.col("b")) & (g / total >= 0.4) & (F.col("stale") >= 3), g)).over(every))
    return rows.select("generation", F.when(g >= F.col("r"), "reinsertion").when(g >= F.col("b"), "boundary").otherwise("none").alias("profile"))


# --- schedules: base(operator, weight) are the weights that a schedule changes


def role(operator: Column) -> Column:
    first = F.substring(operator, 1, 1)
    return F.when(first == "m", "mutation").when(first == "e", "crossover").otherwise("other")


def by_progress(generations: DataFrame, base: DataFrame, total: int) -> DataFrame:
    """The plain schedule: below 0.3 of the run mutation x 1.5 and others x 0.8; below 0.7 as they are; then crossover x 1.5, others x 0.8."""
    p, kind = F.col("generation") / total, role(F.col("operator"))
    factor = F.when(p < 0.3, F.when(kind == "mutation", 1.5).otherwise(0.8)).when(p < 0.7, 1.0).otherwise(F.when(kind == "crossover", 1.5).otherwise(0.8))
    rows = generations.crossJoin(F.broadcast(base))
    return rows.select("generation", "operator", clip(F.col("weight") * factor, 0.1, 1.0).alias("weight"))


def all_equal(generations: DataFrame, base: DataFrame) -> DataFrame:
    mean = base.agg(clip(F.avg("weight"), 0.1, 1.0).alias("weight"))
    return generations.crossJoin(F.broadcast(base.select("operator"))).crossJoin(F.broadcast(mean))


def phase_scores(state: DataFrame) -> DataFrame:
    """(generation, explore, transition, exploit): linear scores of the averaged state, to four places."""
    d, i, s, v = (F.col(c) for c in "disv")
    scores = (1.2 * d + 1.0 * s - 0.8 * i + 0.15 * (1 - v), 1 - 2 * F.abs(d - 0.5) - 0.5 * s + 0.10 * v, 1.3 * (1 - d) + 1.0 * i - 1.2 * s + 0.20 * v)
    return state.select("generation", *(F.round(x, 4).alias(k) for k, x in zip(PHASES, scores, strict=True)))


def phase_mixture(scores: DataFrame, heat: float = 0.7) -> DataFrame:
    """Shares of the phases: softmax of the scores, to four places."""
    rows = scores.withColumns({k: F.exp(F.col(k) / heat) for k in PHASES})
    total = F.col("explore") + F.col("transition") + F.col("exploit")
    return rows.select("generation", *(F.round(F.col(k) / total, 4).alias(k) for k in PHASES))


def held_phase(scores: DataFrame, dwell: int = 2, margin: float = 0.08) -> DataFrame:
    """(generation, phase): the phase of the largest score (ties: the earlier phase), but a phase once taken is left only after ``dwell``
    generations, and for one whose score is larger by more than ``margin``. One fold over a run's generations."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        now, age, out = None, 0, []
        for r in pdf.sort_values("generation").itertuples():
            score = {k: getattr(r, k) for k in PHASES}
            best = max(PHASES, key=score.get)
            if now is None or (best != now and age >= dwell and score[best] > score[now] + margin):
                now, age = best, 0
            age += 1
            out.append((r.generation, now))
        return pd.DataFrame(out, columns=["generation", "phase"])

    return scores.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(fold, "generation long, phase string")


def blended(mixture: DataFrame, base: DataFrame) -> DataFrame:
    """(generation, operator, weight): base weights times the profiles of the phases, by their shares, in [0.1, 1]."""
    kind = role(F.col("operator"))
    at = lambda k: F.when(kind == "mutation", PROFILES["mutation"][k]).when(kind == "crossover", PROFILES["crossover"][k]).otherwise(PROFILES["other"][k])
    share = sum((F.col(p) * at(k) for k, p in enumerate(PHASES)), F.lit(0.0))
    return mixture.crossJoin(F.broadcast(base)).select("generation", "operator", clip(F.col("weight") * share, 0.1, 1.0).alias("weight"))


def credits(rewarded: DataFrame) -> DataFrame:
    """(generation, operator, credit): averaged rewards of the generations before, 0 at first."""
    rows = averaged(rewarded.withColumnRenamed("reward", "credit"), {"credit": 0.0}, by=("operator",))
    late = F.lag("credit").over(Window.partitionBy("operator").orderBy("generation"))
    return rows.select("generation", "operator", F.coalesce(late, F.lit(0.0)).alias("credit"))


def credited(weights: DataFrame, credit: DataFrame, heat: float = 0.6, share: float = 0.35) -> DataFrame:
    """Weights times 1 + ``share`` of how far the softmax of an operator's credit is from an equal part, in [0.1, 1]."""
    w = Window.partitionBy("generation")
    rows = weights.join(credit, ["generation", "operator"]).withColumn("x", F.exp(F.col("credit") / heat))
    bias = F.col("x") / F.sum("x").over(w) - 1 / F.count("*").over(w)
    return rows.withColumn("bias", bias).select("generation", "operator", clip(F.col("weight") * (1 + share * F.col("bias")), 0.1, 1.0).alias("weight"))


def pressures(state: DataFrame) -> DataFrame:
    """The continuous schedule: the phase (a lead of more than 0.12 between two pressures) and the factor of each role."""
    d, i, s = (F.col(c) for c in "dis")
    e, x = F.col("explore"), F.col("exploit")
    rows = state.withColumns({"explore": clip(0.55 * d + 0.60 * s - 0.25 * i), "exploit": clip(0.70 * (1 - d) + 0.55 * i - 0.45 * s)})
    change = clip(1 - F.abs(e - x))
    phase = F.when(x - e > 0.12, "exploit").when(e - x > 0.12, "explore").otherwise("transition")
    return rows.select("generation", phase.alias("phase"), (0.75 + 0.90 * e).alias("mutation"), (0.75 + 0.95 * x).alias("crossover"), (0.70 + 0.60 * change + 0.20 * d).alias("other"))


def pressed(factors: DataFrame, base: DataFrame) -> DataFrame:
    """Base weights times the factors of the continuous schedule, in [0.1, 1]."""
    kind = role(F.col("operator"))
    factor = F.when(kind == "mutation", F.col("mutation")).when(kind == "crossover", F.col("crossover")).otherwise(F.col("other"))
    return factors.crossJoin(F.broadcast(base)).select("generation", "operator", "phase", clip(F.col("weight") * factor, 0.1, 1.0).alias("weight"))
