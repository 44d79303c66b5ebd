"""Queries of trajectories, comparison tables and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fractura.operators import reports
from fractura.session import read

from .registry import query, rounded

_RUNS = """rr AS (SELECT event_type AS run, day(ts)::BIGINT AS generation, min(value) AS objective, CASE max(event_id) % 3 WHEN 0 THEN 'e1' WHEN 1 THEN 'm1' ELSE 'e2' END AS operator FROM events GROUP BY event_type, day(ts)),
rb AS (SELECT *, min(objective) OVER (PARTITION BY run ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rr WHERE generation > 0 AND objective IS NOT NULL),
tj AS (SELECT run, generation, objective, operator, least(objective, coalesce(before, objective)) AS best_so_far, before IS NULL OR objective < before - 1e-12 AS improves, CASE WHEN before IS NULL THEN 0 ELSE greatest(0, before - objective) END AS delta FROM rb)"""


def _runs(spark, d):
    e = read(spark, d, "events")
    name = F.when(F.max("event_id") % 3 == 0, "e1").when(F.max("event_id") % 3 == 1, "m1").otherwise("e2")
    return e.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("generation")).agg(F.min("value").alias("objective"), name.alias("operator"))


@query(f"WITH {_RUNS} SELECT run, generation, objective, operator, best_so_far, improves, round(delta, 6) AS delta FROM tj")
def trajectory(spark, d):
    return rounded(reports.trajectory(_runs(spark, d)), "delta")


@query(f"WITH {_RUNS} SELECT run, generation, objective AS value, coalesce(objective < lag(objective) OVER (PARTITION BY run ORDER BY generation) - 1e-12, true) AS jump FROM rr")
def jump_mask(spark, d):
    return reports.jumps(_runs(spark, d).select("run", "generation", F.col("objective").alias("value")))


@query(f"""WITH {_RUNS}, en AS (SELECT run, arg_min(best_so_far, generation) AS start, min(best_so_far) AS final, count(*) AS n FROM tj GROUP BY run),
op AS (SELECT run, operator, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, min(generation)) AS r FROM tj WHERE improves GROUP BY run, operator),
g AS (SELECT tj.run, any_value(start) AS start, any_value(final) AS final, any_value(n) AS n, min(CASE WHEN best_so_far <= start - 0.95::DOUBLE * (start - final) + 1e-12 THEN generation END) AS first_95, min(CASE WHEN abs(best_so_far - final) <= 1e-12 THEN generation END) AS first_best,
 sum(CASE WHEN improves THEN 1 ELSE 0 END)::BIGINT - 1 AS improvements, sum(CASE WHEN improves THEN delta ELSE 0 END) AS total FROM tj JOIN en ON en.run = tj.run GROUP BY tj.run)
SELECT g.run, start, final, first_95, first_best, n - first_best + 1 AS plateau, round((n - first_best + 1) / n, 6) AS plateau_ratio, improvements, round(CASE WHEN improvements > 0 THEN total / improvements ELSE 0 END, 6) AS mean_improvement, op.operator AS dominant FROM g JOIN op ON op.run = g.run AND op.r = 1""")
def run_gains(spark, d):
    return rounded(reports.gains(reports.trajectory(_runs(spark, d))), "plateau_ratio", "mean_improvement")


@query(f"WITH {_RUNS} SELECT run, min(best_so_far) AS final, sum(CASE WHEN improves THEN 1 ELSE 0 END)::BIGINT AS improvements FROM tj GROUP BY run")
def ablation(spark, d):
    return reports.ablation(reports.trajectory(_runs(spark, d)))


@query("WITH w AS (SELECT l_returnflag AS run, 't' || l_linenumber AS tag, round(avg(l_discount), 9) AS weight FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY weight DESC, tag) AS rank FROM w) SELECT run, tag, round(weight, 6) AS weight, rank FROM r WHERE rank <= 2")
def top_tags(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.concat(F.lit("t"), "l_linenumber").alias("tag"), F.col("l_discount").alias("weight"))
    return rounded(reports.top_tags(rows, [f"t{k}" for k in range(1, 8)]), "weight")


@query("SELECT lang, round(avg(try_cast(x AS DOUBLE)), 6) AS mean FROM (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 5 > 0 THEN n_chars::VARCHAR END AS x FROM documents) GROUP BY lang")
def mean_of_known(spark, d):
    x = F.when(F.col("doc_id") % 3 == 0, "none").when(F.col("doc_id") % 5 > 0, F.col("n_chars").cast("string"))
    return rounded(reports.mean_of_known(read(spark, d, "documents").select("lang", x.alias("x")), "lang", "x"), "mean")


_METHODS = ["F", "O", "none"]
_GRID = "sc AS (SELECT n_name AS dataset, l_linestatus AS method, avg(l_extendedprice) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL), gd AS (SELECT n_name AS dataset, m AS method, sc.value FROM nation, (VALUES ('F'), ('O'), ('none')) x(m) LEFT JOIN sc ON sc.dataset = n_name AND sc.method = m)"


def _grid(spark, d):
    n = read(spark, d, "nation")
    li = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"))
    scores = li.groupBy(F.col("n_name").alias("dataset"), F.col("l_linestatus").alias("method")).agg(F.avg("l_extendedprice").alias("value"))
    return reports.dense_grid(scores, n.select(F.col("n_name").alias("dataset")), _METHODS)


@query(f"WITH {_GRID} SELECT dataset, method, round(value, 4) AS value FROM gd")
def dense_grid(spark, d):
    return rounded(_grid(spark, d), "value", places=4)


@query(f"WITH {_GRID} SELECT dataset, round(min(CASE WHEN method <> 'F' THEN value END), 4) AS best_baseline, round(max(CASE WHEN method = 'F' THEN value END), 4) AS ours, round(min(CASE WHEN method <> 'F' THEN value END) - max(CASE WHEN method = 'F' THEN value END), 4) AS delta FROM gd GROUP BY dataset")
def best_baseline(spark, d):
    return rounded(reports.lead(_grid(spark, d), "F"), "best_baseline", "ours", "delta", places=4)


@query(f"""WITH {_GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY method = 'F' DESC, value, method) AS line, min(value) OVER (PARTITION BY dataset) AS low, max(CASE WHEN method = 'F' THEN value END) OVER (PARTITION BY dataset) AS mine FROM gd WHERE value IS NOT NULL)
SELECT dataset, line, '| ' || CASE WHEN line = 1 THEN '**' || dataset || '**' ELSE '' END || ' | ' || CASE WHEN method = 'F' THEN '**F**' ELSE method END || ' | ' || CASE WHEN value = low THEN '**' || printf('%.4f', value) || '**' ELSE printf('%.4f', value) END
 || ' | ' || CASE WHEN method = 'F' OR mine IS NULL THEN '-' ELSE printf('%.4f', mine - value) END || ' | ' || CASE WHEN method = 'F' OR mine IS NULL THEN '-' ELSE printf('%.2f', 100 * (mine - value) / value) END || ' |' AS text FROM r""")
def markdown_table(spark, d):
    return reports.markdown(reports.compare(_grid(spark, d).where("value is not null"), "F"), "F")


@query("SELECT doc_id, CASE WHEN x IS NULL THEN '-' WHEN x = floor(x) THEN floor(x)::BIGINT::VARCHAR ELSE printf('%.1f', x) END AS number, CASE WHEN x - 500 > 0 THEN '+' ELSE '' END || printf('%.3f', x - 500) AS delta FROM (SELECT doc_id, n_chars / 4 AS x FROM documents)")
def formatted_numbers(spark, d):
    x = F.col("n_chars") / 4
    return read(spark, d, "documents").select("doc_id", reports.formatted(x).alias("number"), reports.signed(x - 500, False).alias("delta"))


@query("SELECT c_custkey, contains(lower(c_name), 'sample') AS is_sample, CASE WHEN c_name LIKE '%\\_sample' ESCAPE '\\' OR c_name LIKE '%\\_sampled' ESCAPE '\\' THEN 0 WHEN c_name LIKE '%4000%' THEN 1 ELSE 2 END AS variant FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || '_Sample' WHEN c_custkey % 4 = 1 THEN c_name || '_sampled' WHEN c_custkey % 4 = 2 THEN c_name || '4000' ELSE c_name END AS c_name FROM customer)")
def variants(spark, d):
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 0, "_Sample").when(k == 1, "_sampled").when(k == 2, "4000").otherwise(""))
    return read(spark, d, "customer").select("c_custkey", reports.is_sample(name).alias("is_sample"), reports.variant_rank(name).alias("variant"))


@query("SELECT n_nationkey AS key, min(s_suppkey) AS s_suppkey, arg_min(s_name, s_suppkey) AS s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def first_match(spark, d):
    keys = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"))
    rows = read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey", "s_name")
    return reports.first_match(keys, rows, "key", "s_suppkey")
