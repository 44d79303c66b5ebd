"""Queries of the evolutionary loop and of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractura.operators import evolve, reports
from fractura.session import read

from .inputs import FHT, SURVIVORS, trace
from .registry import query, rounded

T = "t AS (SELECT event_id AS id, day(ts)::BIGINT AS generation, event_type AS operator, value AS objective, props AS code, " + FHT + " FROM events)"

# --- evolution

SURV = T + SURVIVORS
BEST = T + ", g AS (SELECT generation, min(objective) AS best FROM t GROUP BY generation), h AS (SELECT *, min(best) OVER (ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g), w AS (SELECT generation, best, least(best, coalesce(before, best)) AS best_so_far, before IS NULL OR best < before - 1e-12 AS improves, CASE WHEN best < before - 1e-12 THEN before - best ELSE 0.0 END AS delta FROM h)"
STAT = T + ", o AS (SELECT generation, operator, count(*) AS offspring, count(objective) AS valid, min(objective) AS best, avg(objective) AS mean FROM t GROUP BY generation, operator)"


@query(f"WITH {SURV} SELECT generation, rank, id, objective, fht_50 FROM v WHERE rank <= 10")
def survivors(spark, d):
    return evolve.survivors(trace(spark, d), 10)


@query(f"WITH {SURV}, x AS (SELECT generation, id, 1.0::DOUBLE / (rank + count(*) OVER (PARTITION BY generation)) AS raw FROM v WHERE rank <= 10) SELECT generation, id, round(raw / sum(raw) OVER (PARTITION BY generation), 6) AS weight FROM x")
def parent_weights_rank(spark, d):
    return rounded(evolve.rank_weights(survivors(spark, d)), "weight")


@query(f"WITH {SURV}, x AS (SELECT generation, id, 1.0::DOUBLE / (objective + 1e-6::DOUBLE * coalesce(fht_50, 0) + 1e-6) AS raw FROM v WHERE rank <= 10) SELECT generation, id, round(raw / sum(raw) OVER (PARTITION BY generation), 6) AS weight FROM x")
def parent_weights_roulette(spark, d):
    return rounded(evolve.roulette_weights(survivors(spark, d)), "weight")


@query(f"WITH {STAT} SELECT generation, operator, offspring, valid, best, round(mean, 6) AS mean FROM o")
def operator_stats(spark, d):
    return rounded(evolve.operator_stats(trace(spark, d)), "mean")


@query(f"WITH {BEST} SELECT generation, best, best_so_far, improves, round(delta, 6) AS delta FROM w")
def best_so_far(spark, d):
    return rounded(evolve.best_so_far(trace(spark, d)), "delta")


@query(f"WITH {T} SELECT generation, round(least(greatest((quantile_cont(objective, 0.9) - quantile_cont(objective, 0.1)) / (abs(quantile_cont(objective, 0.5)) + 1e-8), 0.0), 1.0), 6) AS diversity, count(objective) / count(*) AS validity FROM t GROUP BY generation")
def population_state(spark, d):
    return rounded(evolve.population_state(trace(spark, d)), "diversity")


@query(f"WITH {BEST}, z AS (SELECT generation, generation - max(CASE WHEN improves THEN generation END) OVER (ORDER BY generation ROWS UNBOUNDED PRECEDING) AS stale FROM w) SELECT generation, stale, stale >= 5 AS stop FROM z")
def early_stop(spark, d):
    return evolve.early_stop(evolve.best_so_far(trace(spark, d)), 5)


STATE = T + """, g AS (SELECT generation, min(objective) AS best FROM t GROUP BY generation), k AS (SELECT generation, best, coalesce(lag(best, 5) OVER w, first(best) OVER w) AS old FROM g WINDOW w AS (ORDER BY generation)),
u AS (SELECT k.generation, max(q.generation) AS m FROM k LEFT JOIN g q ON q.generation < k.generation AND abs(q.best - k.best) > greatest(1e-6::DOUBLE, 1e-4::DOUBLE * abs(k.best)) GROUP BY k.generation),
y AS (SELECT u.generation, count(p.generation) AS streak FROM u LEFT JOIN g p ON p.generation < u.generation AND p.generation > coalesce(m, -1) GROUP BY u.generation),
z AS (SELECT generation, least(greatest((quantile_cont(objective, 0.9) - quantile_cont(objective, 0.1)) / (abs(quantile_cont(objective, 0.5)) + 1e-8), 0.0), 1.0) AS d, count(objective) / count(*) AS v FROM t GROUP BY generation),
st AS (SELECT z.generation, z.d, least(greatest(0.0::DOUBLE, old - best) / (abs(old) + 1e-8::DOUBLE) / 0.15::DOUBLE, 1.0) AS i, least(streak / 5, 1.0) AS s, z.v FROM z JOIN k ON k.generation = z.generation JOIN y ON y.generation = z.generation)"""


@query(f"WITH {STATE} SELECT generation, round(d, 6) AS d, round(i, 6) AS i, round(s, 6) AS s, round(v, 6) AS v FROM st")
def search_state(spark, d):
    return rounded(evolve.search_state(trace(spark, d)), "d", "i", "s", "v")


@query("WITH i AS (SELECT conv_id AS grp, turn AS pos, least(length(text), 1200) AS size FROM conversations), w AS (SELECT grp, pos, sum(size + 8) OVER x AS used, row_number() OVER x AS r FROM i WINDOW x AS (PARTITION BY grp ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)) SELECT grp, pos, used, r <= 10 AS shown FROM w WHERE (used <= 4000 AND r <= 50) OR r = 1")
def memory_window(spark, d):
    return evolve.memory_window(read(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.length("text").alias("size")), 4000)


@query("WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE label = 0), p AS (SELECT q.vec_id AS query, v.vec_id AS id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i]::DOUBLE * v.embedding[i]::DOUBLE)) AS dot FROM q JOIN embeddings v ON v.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dot DESC, id) AS rank FROM p) SELECT query, id, round(dot, 5) AS dot, rank FROM r WHERE rank <= 4")
def embedding_topk(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return evolve.top_similar(v, v.where("label = 0"), 4).withColumn("dot", F.round("dot", 5))


@query("""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, v.vec_id AS id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i]::DOUBLE * v.embedding[i]::DOUBLE)) AS dot FROM q JOIN embeddings v ON v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dot DESC, id) AS rank FROM p), w AS (SELECT vec_id AS id FROM embeddings ORDER BY label DESC NULLS LAST, vec_id LIMIT 1)
SELECT query, id, rank FROM r WHERE rank <= 4 UNION ALL SELECT q.vec_id, w.id, 5 FROM q, w""")
def embedding_parents(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("objective"))
    return evolve.similar_parents(v, v.where("id % 100 = 0"), 4)


# --- analytics

PHASE = "CASE WHEN generation BETWEEN 1 AND 10 THEN 'early' WHEN generation BETWEEN 11 AND 20 THEN 'middle' WHEN generation BETWEEN 21 AND 30 THEN 'late' ELSE 'other' END"
SCORE = "v AS (SELECT l_returnflag AS dataset, l_linestatus || '-' || (l_linenumber % 3) AS method, avg(l_discount) AS value FROM lineitem GROUP BY ALL)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("dataset"), F.concat("l_linestatus", F.lit("-"), (F.col("l_linenumber") % 3).cast("string")).alias("method")).agg(F.avg("l_discount").alias("value"))


@query(f"WITH {T}, p AS (SELECT {PHASE} AS phase, operator FROM t), g AS (SELECT phase, operator FROM (SELECT DISTINCT phase FROM p), (SELECT DISTINCT operator FROM p)), n AS (SELECT g.phase, g.operator, count(p.phase) AS n FROM g LEFT JOIN p ON p.phase = g.phase AND p.operator = g.operator GROUP BY g.phase, g.operator) SELECT phase, operator, n, round(n / sum(n) OVER (PARTITION BY phase), 6) AS share FROM n")
def phase_operator_share(spark, d):
    return rounded(reports.operator_share(trace(spark, d)), "share")


@query(f"WITH {BEST}, x AS (SELECT first(best_so_far ORDER BY generation) AS f, min(best_so_far) AS l FROM w), y AS (SELECT unnest([0.5, 0.9, 0.95, 1.0])::DOUBLE AS level) SELECT level, round(min(f - level * (f - l)), 6) AS target, min(generation) AS generation FROM w, x, y WHERE best_so_far <= f - level * (f - l) + 1e-12 GROUP BY level")
def milestones(spark, d):
    return rounded(reports.milestones(evolve.best_so_far(trace(spark, d)), [0.5, 0.9, 0.95, 1.0]), "target")


@query(f"WITH {SCORE}, m AS (SELECT *, max(CASE WHEN method = 'F-1' THEN value END) OVER (PARTITION BY dataset) AS mine, min(value) OVER (PARTITION BY dataset) AS low FROM v) SELECT dataset, method, round(value, 6) AS value, round(CASE WHEN method <> 'F-1' THEN mine - value END, 6) AS diff, round(100 * CASE WHEN method <> 'F-1' THEN mine - value END / value, 4) AS percent, round(value, 9) = round(low, 9) AS best FROM m")
def comparison_table(spark, d):
    s = scores(spark, d).withColumn("value", F.col("value"))
    return reports.compare(s, "F-1").withColumns({"value": F.round("value", 6), "diff": F.round("diff", 6), "percent": F.round("percent", 4)})


@query(f"WITH {SCORE} SELECT dataset, round(max(CASE WHEN method = 'F-1' THEN value END), 6) AS \"F-1\", round(max(CASE WHEN method = 'O-1' THEN value END), 6) AS \"O-1\" FROM v GROUP BY dataset")
def pivot_methods(spark, d):
    return rounded(reports.pivot(scores(spark, d), ["F-1", "O-1"]), "F-1", "O-1")


@query(f"""WITH {BEST}, f AS (SELECT generation, first(operator ORDER BY objective, id) AS operator FROM t WHERE objective IS NOT NULL GROUP BY generation)
SELECT coalesce(string_agg('g' || w.generation || '(' || operator || '):' || printf('%.5f', h.before) || '->' || printf('%.5f', w.best), '; ' ORDER BY w.generation), '') AS jumps
FROM w JOIN h ON h.generation = w.generation JOIN f ON f.generation = w.generation WHERE improves AND h.before IS NOT NULL""")
def narrative(spark, d):
    t = trace(spark, d)
    by = t.where("objective is not null").groupBy("generation").agg(F.min_by("operator", F.struct("objective", "id")).alias("operator"))
    curve = evolve.best_so_far(t)
    before = F.when(F.col("improves") & (F.col("delta") > 0), F.col("best") + F.col("delta"))
    return reports.narrative(curve.join(by, "generation").withColumn("before", before))
