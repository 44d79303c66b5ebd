"""Queries of selection, acceptance, operator statistics and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fractura.operators import control, evolve
from fractura.session import read
from fractura.streaming.progress import progress

from .inputs import BASE, SURVIVORS, TRACE, base, candidates
from .registry import query, rounded

_HASH = "('0x' || substr(md5(concat_ws('|', {})), 1, 12))::BIGINT"
_BASE = ", base(operator, weight) AS (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in BASE.items()) + ")"
_ROLE = "CASE WHEN operator LIKE 'm%' THEN 'mutation' WHEN operator LIKE 'e%' THEN 'crossover' ELSE 'other' END"


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0.1::DOUBLE), 1.0::DOUBLE)"


# --- parents and acceptance

_POOL = TRACE + SURVIVORS + """, pool AS (SELECT * FROM v WHERE rank <= 10),
asked AS (SELECT generation, n, unnest(range(1, 9))::BIGINT AS draw FROM (SELECT generation, count(*) AS n FROM pool GROUP BY generation))"""


def _pool(spark, d):
    return evolve.survivors(candidates(spark, d), 10)


@query(f"WITH {_POOL} SELECT asked.generation, draw, id FROM asked JOIN pool ON pool.generation = asked.generation AND pool.rank = {_HASH.format('51, asked.generation, draw')} % n + 1")
def parents_uniform(spark, d):
    return control.uniform_parents(_pool(spark, d), 8, 51)


@query(f"WITH {_POOL}, o AS (SELECT *, {_HASH.format("52, 'a', generation, draw")} % n AS one, {_HASH.format("52, 'b', generation, draw")} % greatest(n - 1, 1) AS gap FROM asked) SELECT o.generation, draw, id FROM o JOIN pool ON pool.generation = o.generation AND pool.rank = least(one, (one + 1 + gap) % n) + 1")
def parents_tournament(spark, d):
    return control.tournament_parents(_pool(spark, d), 8, 52)


@query(f"""WITH {_POOL}, w AS (SELECT generation, id, 1.0::DOUBLE / (rank + count(*) OVER (PARTITION BY generation)) AS x FROM pool), q AS (SELECT *, round(sum(x) OVER (PARTITION BY generation ORDER BY id) / sum(x) OVER (PARTITION BY generation), 9) AS high FROM w),
e AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY generation ORDER BY id), 0.0) AS low FROM q) SELECT asked.generation, draw, id FROM (SELECT *, {_HASH.format("53, generation, draw")} / 281474976710656.0::DOUBLE AS u FROM asked) asked JOIN e ON e.generation = asked.generation AND u >= low AND u < high""")
def parents_by_rank(spark, d):
    return control.weighted_parents(evolve.rank_weights(_pool(spark, d)), 8, 53)


_CHAINS = TRACE + ", ch AS (SELECT operator, generation, min(objective) AS objective FROM t GROUP BY operator, generation)"


@query(f"""WITH RECURSIVE {_CHAINS}, nm AS (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY generation) AS k, {_HASH.format('54, operator, generation')} / 281474976710656.0::DOUBLE AS u, 0.5::DOUBLE * (1 - generation / 40.0::DOUBLE) AS heat FROM ch),
f(operator, k, generation, objective, kept, accepted) AS (SELECT operator, k, generation, objective, objective, objective IS NOT NULL FROM nm WHERE k = 1
 UNION ALL SELECT nm.operator, nm.k, nm.generation, nm.objective, CASE WHEN z THEN nm.objective ELSE f.kept END, z FROM f JOIN nm ON nm.operator = f.operator AND nm.k = f.k + 1,
 LATERAL (SELECT coalesce(nm.objective IS NOT NULL AND (f.kept IS NULL OR nm.objective < f.kept OR (nm.heat > 0 AND f.kept <> 0 AND exp((f.kept - nm.objective) / f.kept / nm.heat) > nm.u)), false) AS z))
SELECT operator, generation, objective, kept, accepted FROM f""")
def acceptance_annealed(spark, d):
    chain = candidates(spark, d).groupBy("operator", "generation").agg(F.min("objective").alias("objective"))
    return control.annealed(chain, 40, 54)


@query(f"WITH {_CHAINS}, h AS (SELECT *, min(objective) OVER (PARTITION BY operator ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ch) SELECT operator, generation, objective, coalesce(objective < coalesce(before, 'infinity'::DOUBLE), false) AS accepted FROM h")
def acceptance_greedy(spark, d):
    chain = candidates(spark, d).groupBy("operator", "generation").agg(F.min("objective").alias("objective"))
    return evolve.greedy(chain)


@query(f"WITH {TRACE} SELECT id, md5(code) AS key, id > min(id) OVER (PARTITION BY code) AS duplicate FROM t")
def duplicate_candidates(spark, d):
    return control.duplicates(candidates(spark, d)).select("id", "key", "duplicate")


@query(f"WITH {TRACE} SELECT id, CASE WHEN id % 9 <> 0 THEN round(1.0::DOUBLE / (id % 9) + time, 5) END AS objective, CASE WHEN id % 9 = 0 THEN 'ZeroDivisionError' END AS error FROM t")
def evaluated_candidates(spark, d):
    rows = candidates(spark, d).select("id", "time")
    out = control.evaluated(rows, lambda r: 1 / (r["id"] % 9) + r["time"], "id long, time double")
    return out.select("id", "objective", F.regexp_extract("error", r"^\w+", 0).alias("error"))


def _endless(row):
    while row["operator"] == "i1":
        pass
    return 1 / (1 + row["value"])


@query(f"WITH {TRACE} SELECT generation, operator, CASE WHEN operator <> 'i1' THEN round(1 / (1 + min(objective)), 5) END AS objective, CASE WHEN operator = 'i1' THEN 'Timeout after 2s' END AS error FROM t WHERE objective IS NOT NULL GROUP BY generation, operator")
def evaluated_with_timeout(spark, d):
    rows = candidates(spark, d).where("objective is not null").groupBy("generation", "operator").agg(F.min("objective").alias("value"))
    return control.evaluated(rows.repartition(32, "generation", "operator"), _endless, "generation long, operator string, value double", 2.0).drop("value")


@query(f"WITH {TRACE}{_BASE} SELECT generation, operator, weight, {_HASH.format('55, generation, operator')} / 281474976710656.0::DOUBLE < weight AS triggered FROM (SELECT DISTINCT generation FROM t), base")
def triggers(spark, d):
    rows = candidates(spark, d).select("generation").distinct().crossJoin(F.broadcast(base(spark)))
    return control.triggered(rows, 55)


@query(f"WITH {TRACE} SELECT generation, count(objective) = 0 AS stop FROM t GROUP BY generation")
def all_failed(spark, d):
    return control.all_failed(candidates(spark, d))


@query(f"WITH {TRACE} SELECT id, round(objective / (time + 1e-8), 6) AS ratio FROM t")
def protected_ratio(spark, d):
    return rounded(candidates(spark, d).select("id", control.protected(F.col("objective"), F.col("time")).alias("ratio")), "ratio")


# --- what operators achieve

_STATS = TRACE + """, st AS (SELECT generation, operator, row_number() OVER (ORDER BY generation, operator) AS step FROM (SELECT DISTINCT generation, operator FROM t)), ts AS (SELECT t.*, st.step FROM t JOIN st ON st.generation = t.generation AND st.operator = t.operator),
stv AS (SELECT DISTINCT step FROM ts WHERE objective IS NOT NULL), stn AS (SELECT step, row_number() OVER (ORDER BY step) AS k FROM stv),
up AS (SELECT stv.step, ts.id, ts.objective, ts.code FROM stv JOIN ts ON ts.step <= stv.step WHERE ts.objective IS NOT NULL),
u1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, code ORDER BY objective, id) AS r FROM up) WHERE r = 1), u2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, objective ORDER BY id) AS q FROM u1) WHERE q = 1),
pp AS (SELECT step, id, objective, rank FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY objective, id) AS rank FROM u2) WHERE rank <= 10),
ac AS (SELECT p.step, p.id FROM pp p LEFT JOIN pp b ON b.step = p.step - 1 AND b.id = p.id WHERE b.id IS NULL),
gr AS (SELECT generation, operator FROM (SELECT DISTINCT generation FROM t), (SELECT DISTINCT operator FROM t)),
os AS (SELECT gr.generation, gr.operator, count(ts.id) AS offspring, count(ts.objective) AS valid, min(ts.objective) AS best, coalesce(sum(ts.time), 0) AS time_total, min(ts.step) AS step FROM gr LEFT JOIN ts ON ts.generation = gr.generation AND ts.operator = gr.operator GROUP BY gr.generation, gr.operator),
ss AS (SELECT os.generation, os.operator, offspring, valid, (SELECT count(*) FROM ac WHERE ac.step = os.step) AS accepted, best, min(best) OVER (ORDER BY os.generation, os.operator ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before, time_total FROM os),
rw AS (SELECT generation, operator, CASE WHEN offspring = 0 THEN 0 ELSE least(1, greatest(-1, 1.6::DOUBLE * CASE WHEN best IS NULL OR best_before IS NULL THEN 0 ELSE greatest(0, best_before - best) / (abs(best_before) + 1e-8) END + 0.5::DOUBLE * accepted / offspring + 0.2::DOUBLE * valid / offspring
 - 0.3::DOUBLE * (offspring - valid) / offspring - 0.15::DOUBLE * (time_total / offspring) / (time_total / offspring + 1))) END AS reward FROM ss)"""


@query(f"WITH {_STATS} SELECT step, id, objective, rank FROM pp")
def populations(spark, d):
    return control.populations(candidates(spark, d), 10)


@query(f"WITH {_STATS} SELECT step, id FROM ac")
def accepted_candidates(spark, d):
    return control.accepted(control.populations(candidates(spark, d), 10))


@query(f"WITH {_STATS} SELECT generation, operator, 1 AS attempted, CASE WHEN offspring > 0 THEN 1 ELSE 0 END AS triggered, offspring, valid, accepted, best, best_before, round(time_total, 6) AS time_total FROM ss")
def operator_statistics(spark, d):
    return rounded(control.statistics(candidates(spark, d), 10), "time_total")


@query(f"WITH {_STATS} SELECT generation, operator, round(reward, 6) AS reward FROM rw")
def operator_reward(spark, d):
    return rounded(control.rewards(control.statistics(candidates(spark, d), 10)), "reward")


@query(f"WITH {_STATS}, ag AS (SELECT operator, reward, row_number() OVER (PARTITION BY operator ORDER BY generation DESC) - 1 AS age FROM rw) SELECT operator, round(sum(0.25::DOUBLE * pow(0.75::DOUBLE, age) * reward), 6) AS credit FROM ag GROUP BY operator")
def operator_credit(spark, d):
    return rounded(evolve.credit(control.rewards(control.statistics(candidates(spark, d), 10))), "credit")


# --- state and schedules

_STATE = """, g AS (SELECT generation, min(objective) AS best, count(objective) / count(*) AS v, row_number() OVER (ORDER BY generation) AS n FROM t GROUP BY generation),
k AS (SELECT generation, n, best, v, coalesce(lag(best, 5) OVER w, first(best) OVER w) AS old FROM g WINDOW w AS (ORDER BY generation)),
lk AS (SELECT k.n, count(*) AS streak FROM k JOIN k p ON p.n BETWEEN k.n - 5 AND k.n - 1 WHERE NOT EXISTS (SELECT 1 FROM k q WHERE q.n BETWEEN p.n AND k.n - 1 AND abs(q.best - k.best) > greatest(1e-6::DOUBLE, 1e-4::DOUBLE * abs(k.best))) GROUP BY k.n),
dv AS (SELECT generation, least(greatest((quantile_cont(objective, 0.9) - quantile_cont(objective, 0.1)) / (abs(quantile_cont(objective, 0.5)) + 1e-8), 0.0), 1.0) AS d FROM t GROUP BY generation),
raw AS (SELECT k.generation, k.n, dv.d, least(greatest(0.0::DOUBLE, old - best) / (abs(old) + 1e-8::DOUBLE) / 0.15::DOUBLE, 1.0) AS i, least(coalesce(streak, 0) / 5, 1.0) AS s, k.v FROM k JOIN dv ON dv.generation = k.generation LEFT JOIN lk ON lk.n = k.n),
em AS (SELECT a.generation, a.n, pow(0.75::DOUBLE, a.n) + sum(0.25::DOUBLE * pow(0.75::DOUBLE, a.n - b.n) * b.d) AS d, sum(0.25::DOUBLE * pow(0.75::DOUBLE, a.n - b.n) * b.i) AS i, sum(0.25::DOUBLE * pow(0.75::DOUBLE, a.n - b.n) * b.s) AS s,
 CASE WHEN a.n = 1 THEN 1 ELSE pow(0.75::DOUBLE, a.n - 1) + sum(CASE WHEN b.n < a.n THEN 0.25::DOUBLE * pow(0.75::DOUBLE, a.n - 1 - b.n) * b.v ELSE 0 END) END AS v FROM raw a JOIN raw b ON b.n <= a.n GROUP BY a.generation, a.n),
sc AS (SELECT generation, n, round(1.2::DOUBLE * d + s - 0.8::DOUBLE * i + 0.15::DOUBLE * (1 - v), 4) AS explore, round(1 - 2 * abs(d - 0.5::DOUBLE) - 0.5::DOUBLE * s + 0.1::DOUBLE * v, 4) AS transition, round(1.3::DOUBLE * (1 - d) + i - 1.2::DOUBLE * s + 0.2::DOUBLE * v, 4) AS exploit FROM em),
mx AS (SELECT generation, round(exp(explore / 0.7::DOUBLE) / z, 4) AS explore, round(exp(transition / 0.7::DOUBLE) / z, 4) AS transition, round(exp(exploit / 0.7::DOUBLE) / z, 4) AS exploit FROM (SELECT *, exp(explore / 0.7::DOUBLE) + exp(transition / 0.7::DOUBLE) + exp(exploit / 0.7::DOUBLE) AS z FROM sc)),
pr AS (SELECT generation, d, least(greatest(0.55::DOUBLE * d + 0.6::DOUBLE * s - 0.25::DOUBLE * i, 0.0), 1.0) AS e, least(greatest(0.7::DOUBLE * (1 - d) + 0.55::DOUBLE * i - 0.45::DOUBLE * s, 0.0), 1.0) AS x FROM em)"""
_BLEND = f""", role AS (SELECT operator, weight, {_ROLE} AS kind FROM base), prof(kind, a, b, c) AS (VALUES ('mutation', 1.45::DOUBLE, 1.0::DOUBLE, 0.7::DOUBLE), ('crossover', 0.8, 1.0, 1.4), ('other', 1.1, 1.0, 0.95)),
bl AS (SELECT generation, operator, {_clip('weight * (explore * a + transition * b + exploit * c)')} AS weight FROM mx, role JOIN prof ON prof.kind = role.kind)"""


def _smoothed(spark, d):
    return control.smoothed(evolve.search_state(candidates(spark, d)))


@query(f"WITH {TRACE}{_STATE} SELECT generation, round(d, 6) AS d, round(i, 6) AS i, round(s, 6) AS s, round(v, 6) AS v FROM em")
def smoothed_state(spark, d):
    return rounded(_smoothed(spark, d), "d", "i", "s", "v")


@query(f"WITH {TRACE}{_STATE} SELECT * FROM mx")
def phase_mixture(spark, d):
    return control.phase_mixture(control.phase_scores(_smoothed(spark, d)))


@query(f"""WITH RECURSIVE {TRACE}{_STATE}, tg AS (SELECT *, CASE WHEN explore >= transition AND explore >= exploit THEN 'explore' WHEN transition >= exploit THEN 'transition' ELSE 'exploit' END AS target, greatest(explore, transition, exploit) AS top FROM sc),
h(n, generation, phase, age) AS (SELECT n, generation, target, 1 FROM tg WHERE n = 1
 UNION ALL SELECT tg.n, tg.generation, CASE WHEN sw THEN tg.target ELSE h.phase END, CASE WHEN sw THEN 1 ELSE h.age + 1 END FROM h JOIN tg ON tg.n = h.n + 1, LATERAL (SELECT tg.target <> h.phase AND h.age >= 2 AND tg.top > CASE h.phase WHEN 'explore' THEN tg.explore WHEN 'transition' THEN tg.transition ELSE tg.exploit END + 0.08::DOUBLE AS sw))
SELECT generation, phase FROM h""")
def held_phase(spark, d):
    return control.held_phase(control.phase_scores(_smoothed(spark, d)))


@query(f"WITH {TRACE}{_STATE}{_BASE}{_BLEND} SELECT generation, operator, round(weight, 9) AS weight FROM bl")
def weights_by_state(spark, d):
    return rounded(control.blended(phase_mixture(spark, d), base(spark)), "weight", places=9)


@query(f"""WITH {_STATS}{_STATE}{_BASE}{_BLEND}, cr AS (SELECT a.generation, a.operator, coalesce(sum(0.25::DOUBLE * pow(0.75::DOUBLE, a.n - 1 - b.n) * b.reward), 0) AS credit
 FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY generation) AS n FROM rw) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY generation) AS n FROM rw) b ON b.operator = a.operator AND b.n < a.n GROUP BY a.generation, a.operator),
bi AS (SELECT generation, operator, exp(credit / 0.6::DOUBLE) / sum(exp(credit / 0.6::DOUBLE)) OVER (PARTITION BY generation) - 1.0::DOUBLE / count(*) OVER (PARTITION BY generation) AS bias FROM cr)
SELECT bl.generation, bl.operator, round({_clip('weight * (1 + 0.35::DOUBLE * bias)')}, 6) AS weight FROM bl JOIN bi ON bi.generation = bl.generation AND bi.operator = bl.operator""")
def weights_by_credit(spark, d):
    rewarded = control.rewards(control.statistics(candidates(spark, d), 10))
    return rounded(control.credited(control.blended(phase_mixture(spark, d), base(spark)), control.credits(rewarded)), "weight")


@query(f"""WITH {TRACE}{_STATE}{_BASE} SELECT generation, operator, CASE WHEN x - e > 0.12 THEN 'exploit' WHEN e - x > 0.12 THEN 'explore' ELSE 'transition' END AS phase,
 round({_clip(f"weight * CASE {_ROLE} WHEN 'mutation' THEN 0.75::DOUBLE + 0.9::DOUBLE * e WHEN 'crossover' THEN 0.75::DOUBLE + 0.95::DOUBLE * x ELSE 0.7::DOUBLE + 0.6::DOUBLE * least(greatest(1 - abs(e - x), 0.0), 1.0) + 0.2::DOUBLE * d END")}, 6) AS weight FROM pr, base""")
def weights_by_pressure(spark, d):
    return rounded(control.pressed(control.pressures(_smoothed(spark, d)), base(spark)), "weight")


@query(f"""WITH {TRACE}{_BASE}, gs AS (SELECT DISTINCT generation, generation / 31.0::DOUBLE AS p FROM t) SELECT generation, operator,
 round({_clip(f"weight * CASE WHEN p < 0.3 THEN CASE WHEN operator LIKE 'm%' THEN 1.5::DOUBLE ELSE 0.8 END WHEN p < 0.7 THEN 1 ELSE CASE WHEN operator LIKE 'e%' THEN 1.5::DOUBLE ELSE 0.8 END END")}, 6) AS weight FROM gs, base""")
def weights_by_progress(spark, d):
    return rounded(control.by_progress(candidates(spark, d).select("generation").distinct(), base(spark), 31), "weight")


@query(f"WITH {TRACE}{_BASE} SELECT generation, operator, round((SELECT {_clip('avg(weight)')} FROM base), 6) AS weight FROM (SELECT DISTINCT generation FROM t), base")
def weights_equal(spark, d):
    return rounded(control.all_equal(candidates(spark, d).select("generation").distinct(), base(spark)), "weight")


@query(f"""WITH {TRACE}, g AS (SELECT generation, min(objective) AS best FROM t GROUP BY generation), h AS (SELECT *, min(best) OVER (ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
z AS (SELECT generation, generation - max(CASE WHEN before IS NULL OR best < before - 1e-12 THEN generation END) OVER (ORDER BY generation ROWS UNBOUNDED PRECEDING) AS stale FROM h),
b AS (SELECT min(generation) AS b FROM z WHERE generation >= 8 AND stale >= 2), r AS (SELECT min(generation) AS r FROM z, b WHERE generation > b AND generation / 31.0 >= 0.4 AND stale >= 3)
SELECT generation, CASE WHEN generation >= r THEN 'reinsertion' WHEN generation >= b THEN 'boundary' ELSE 'none' END AS profile FROM z, b, r""")
def guidance(spark, d):
    return control.guidance(evolve.early_stop(evolve.best_so_far(candidates(spark, d)), 5), 31)


@query("""WITH t AS (SELECT event_type AS run, floor(epoch(ts) / 86400)::BIGINT AS generation, CASE WHEN user_id % 10 <> 3 THEN value END AS objective FROM events),
g AS (SELECT run, generation, count(*) AS offspring, count(objective) AS valid, min(objective) AS best FROM t GROUP BY run, generation),
b AS (SELECT *, min(best) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER w AS i FROM g WINDOW w AS (PARTITION BY run ORDER BY generation)),
m AS (SELECT *, best IS NOT NULL AND (before IS NULL OR best < before - 1e-12) AS improves FROM b),
l AS (SELECT *, generation - max(CASE WHEN improves THEN generation END) OVER (PARTITION BY run ORDER BY generation) AS stale FROM m),
v AS (SELECT x.run, x.generation, pow(0.75, max(x.i)) + sum(0.25 * pow(0.75, x.i - y.i) * y.valid / y.offspring) AS validity FROM m x JOIN m y ON y.run = x.run AND y.i <= x.i GROUP BY x.run, x.generation)
SELECT l.run, l.generation, offspring, valid, best, least(best, before) AS best_so_far, improves, round(CASE WHEN improves AND before IS NOT NULL THEN before - best ELSE 0.0::DOUBLE END, 6) AS delta, stale, coalesce(stale >= 3, false) AS stop, round(validity, 6) AS validity FROM l JOIN v ON v.run = l.run AND v.generation = l.generation""")
def progress_of_runs(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("run"), "ts", F.when(F.col("user_id") % 10 != 3, F.col("value")).alias("objective"))
    return rounded(progress(rows), "delta", "validity")
