"""Queries of texts: tokens, similarity, basins, answers, and traces of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractura.operators import candidates as C
from fractura.operators import text
from fractura.session import read

from .registry import query, rounded

_PATTERN = "[a-z_][a-z0-9_]*|\\p{Nd}+(?:\\.\\p{Nd}+)?"


def _tokens(rows: str, code: bool = False) -> str:
    """SQL of (id, token) from the name of (id, x) rows."""
    first = ", list_transform(list_filter(p, lambda t: length(t) > 6), lambda t: substr(t, 1, 6))" if code else ", []"
    parts = "list_filter(flatten(list_transform(list_filter(p, lambda t: contains(t, '_')), lambda t: string_split(t, '_'))), lambda t: t <> '')"
    return f"SELECT id, unnest(list_concat(p, list_concat({parts}{first}))) AS token FROM (SELECT id, regexp_extract_all(lower(x), '{_PATTERN}') AS p FROM {rows})"


def _vectors(name: str, rows: str, code: bool = False) -> str:
    """SQL tables that end with ``name`` (id, token, w)."""
    f, n = f"{name}_f", f"(SELECT count(*) FROM {rows})"
    return f"""{f} AS (SELECT id, token, count(*) AS n FROM ({_tokens(rows, code)}) GROUP BY id, token),
{name}_x AS (SELECT id, token, n / sum(n) OVER (PARTITION BY id) * (ln((1 + {n}) / (1 + count(*) OVER (PARTITION BY token))) + 1) AS x FROM {f}),
{name} AS (SELECT id, token, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM {name}_x)"""


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_ITEMS = "items AS (SELECT item_id AS id, text AS x FROM benchmark)"
_TFIDF = f"{_ITEMS}, {_vectors('w', 'items')}"
_COS = _TFIDF + ", j AS (SELECT p.id AS a, q.id AS b, sum(p.w * q.w) AS cosine FROM w p JOIN w q ON p.token = q.token AND p.id < q.id GROUP BY p.id, q.id)"
_BASIN = _COS + """, l AS (SELECT a, b FROM j WHERE cosine >= 0.15 UNION ALL SELECT b, a FROM j WHERE cosine >= 0.15), r(a, b) AS (SELECT id, id FROM items UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
bas AS (SELECT a AS doc_id, dense_rank() OVER (ORDER BY min(b)) AS basin FROM r GROUP BY a)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents")
def normalise(spark, d):
    return read(spark, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("t"))


@query(f"WITH z AS (SELECT doc_id, {_squeezed('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 180 THEN rtrim(substr(t, 1, 177)) || '...' ELSE t END AS t FROM z")
def snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), 180).alias("t"))


@query(f"WITH docs AS (SELECT doc_id AS id, text AS x FROM documents), k AS ({_tokens('docs')}) SELECT token, count(*) AS n, count(DISTINCT id) AS docs FROM k GROUP BY token")
def token_counts(spark, d):
    each = text.tokens(read(spark, d, "documents")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"WITH docs AS (SELECT doc_id AS id, text AS x FROM documents), k AS ({_tokens('docs', True)}) SELECT token, count(*) AS n FROM k GROUP BY token")
def token_counts_of_code(spark, d):
    return text.tokens(read(spark, d, "documents"), True).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_TFIDF} SELECT id AS doc_id, token, round(w, 6) AS w FROM w")
def tfidf(spark, d):
    return rounded(text.tfidf(items(spark, d)), "w")


@query(f"WITH {_COS} SELECT a, b, round(cosine, 6) AS cosine FROM j WHERE cosine >= 0.05")
def pair_cosine(spark, d):
    return rounded(text.cosines(text.tfidf(items(spark, d)), 0.05), "cosine")


@query(f"WITH RECURSIVE {_BASIN} SELECT doc_id, basin FROM bas")
def basins(spark, d):
    i = items(spark, d)
    return text.basins(i, text.cosines(text.tfidf(i), 0.15))


@query(f"WITH RECURSIVE {_BASIN}, c AS (SELECT basin, count(*) AS n FROM bas GROUP BY basin), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT count(*) AS basins, round(sum(p * p), 6) AS hhi, round(max(p), 6) AS largest, round(exp(-sum(p * ln(p))), 6) AS effective FROM p")
def basin_concentration(spark, d):
    return rounded(text.concentration(basins(spark, d)), "hhi", "largest", "effective")


# --- answers

_RAW = "raw AS (SELECT doc_id, concat('Thought: none', chr(10), 'Reflection: ', coalesce(text, ''), chr(10), 'Algorithm Description: {', source, '}', chr(10), 'Code: ```python', chr(10), 'def f(x):', chr(10), '    return ', doc_id, chr(10), '```') AS raw FROM documents)"


def _raw(spark, d):
    parts = ("Thought: none\nReflection: ", F.coalesce("text", F.lit("")), "\nAlgorithm Description: {", F.coalesce("source", F.lit("")), "}\nCode: ```python\ndef f(x):\n    return ", F.col("doc_id").cast("string"), "\n```")
    return read(spark, d, "documents").select("doc_id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("raw"))


@query(f"""WITH {_RAW} SELECT doc_id, {_squeezed("regexp_extract(raw, '(?is)Reflection:\\s*(.*?)(?:\\s*Algorithm Description:|\\s*Code:|$)', 1)")} AS reflection,
 {_squeezed("regexp_extract(raw, '(?is)Algorithm Description:\\s*\\{?(.*?)\\}?(?:\\s*Code:|$)', 1)")} AS description, trim(regexp_extract(raw, '(?is)Code:\\s*```(?:python)?\\s*(.*?)```', 1), chr(10) || ' ') AS code FROM raw""")
def parsed_answers(spark, d):
    rows = _raw(spark, d)
    return rows.select("doc_id", *(c.alias(k) for k, c in C.parsed(F.col("raw")).items()))


@query(f"WITH {_RAW} SELECT doc_id, nullif(regexp_replace(regexp_extract(raw, '(?is)Reflection\\s*:\\s*(.*?)(?:\\n\\s*(?:Analysis|Thought|Reflection|AwareProfile|Algorithm Description|Code)\\s*:|\\z)', 1), '^\\s+|\\s+$', '', 'g'), '') AS field FROM raw")
def labelled_field(spark, d):
    return _raw(spark, d).select("doc_id", C.labelled(F.col("raw"), "Reflection").alias("field"))


@query(f"WITH {_RAW} SELECT doc_id, trim(list_last(regexp_extract_all(raw, '(?s)\\{{(.*?)\\}}', 1))) AS description, trim(list_last(regexp_extract_all(raw, '(?s)```python(.*?)```', 1)), chr(10) || ' ') AS code FROM raw")
def answer_parts(spark, d):
    return _raw(spark, d).select("doc_id", C.description(F.col("raw")).alias("description"), C.code(F.col("raw")).alias("code"))


@query(f"SELECT doc_id, CASE WHEN length({_squeezed('coalesce(source, chr(32))')}) > length({_squeezed('coalesce(text, chr(32))')}) THEN {_squeezed('coalesce(source, chr(32))')} ELSE {_squeezed('coalesce(text, chr(32))')} END AS longest FROM documents")
def longest_text(spark, d):
    return read(spark, d, "documents").select("doc_id", C.longest(F.col("text"), F.col("source")).alias("longest"))


@query("SELECT doc_id, 'Improve on ' || doc_id || ' from ' || coalesce(source, '') || ' (' || coalesce(lang, '') || '):' || chr(10) || coalesce(text, '') AS prompt FROM documents")
def prompts(spark, d):
    made = C.prompt("Improve on {id} from {source} ({lang}):\n{text}", id=F.col("doc_id"), source=F.col("source"), lang=F.col("lang"), text=F.col("text"))
    return read(spark, d, "documents").select("doc_id", made.alias("prompt"))


_TAGS = {"first": ["the", "le ", "der"], "second": ["ion", "ment", "ung"], "third": [r"\d", "http"]}


def _tags_sql() -> str:
    hit = lambda c, p: f"CASE WHEN regexp_matches({c}, '{p}') THEN 1 ELSE 0 END"
    score = lambda ps: " + ".join(f"2.0::DOUBLE * {hit('a', p)} + CASE WHEN a <> '' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * {hit('c', p)}" for p in ps)
    rows = " UNION ALL ".join(f"SELECT id, '{t}' AS tag, {score(ps)} AS s FROM z" for t, ps in _TAGS.items())
    return f"WITH z AS (SELECT doc_id AS id, lower(coalesce(source, '')) AS a, lower(coalesce(text, '')) AS c FROM documents), s AS ({rows}), q AS (SELECT *, sum(s) OVER (PARTITION BY id) AS total FROM s) SELECT id, tag, round(CASE WHEN total <= 0 THEN CASE WHEN tag = 'second' THEN 1 ELSE 0 END ELSE s / total END, 6)::DOUBLE AS weight FROM q"


@query(_tags_sql())
def tag_weights(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("description"), F.col("text").alias("code"))
    return rounded(C.tag_weights(rows, _TAGS, "second"), "weight")


# --- traces of candidates

_TRACE = f"""cand AS (SELECT turn AS generation, conv_id AS id, CASE WHEN role <> 'system' THEN (length(text) % 97) / 97.0::DOUBLE END AS objective, CASE WHEN role = 'user' THEN text END AS description, CASE WHEN role = 'assistant' THEN text END AS reflection, text AS code FROM conversations),
tr AS (SELECT *, row_number() OVER (ORDER BY generation, id) AS step FROM cand WHERE generation > 0 AND objective IS NOT NULL),
co AS (SELECT id, coalesce(arg_max(description, length(description) * 1000000 - step), '') AS description, coalesce(arg_max(reflection, length(reflection) * 1000000 - step), '') AS reflection, coalesce(arg_max(code, length(code) * 1000000 - step), '') AS code
 FROM (SELECT id, step, {_squeezed('description')} AS description, {_squeezed('reflection')} AS reflection, code FROM tr) GROUP BY id),
v1 AS (SELECT id, description AS x FROM co), v2 AS (SELECT id, reflection AS x FROM co), v3 AS (SELECT id, code AS x FROM co),
{_vectors('w1', 'v1')}, {_vectors('w2', 'v2')}, {_vectors('w3', 'v3', True)}, wv AS (SELECT 1 AS v, * FROM w1 UNION ALL SELECT 2, * FROM w2 UNION ALL SELECT 3, * FROM w3),
pd AS (SELECT a.id AS a, b.id AS b, greatest(0.0::DOUBLE, 1 - coalesce(dot, 0) / 3) AS distance FROM co a JOIN co b ON a.id < b.id LEFT JOIN (SELECT p.id AS a, q.id AS b, sum(p.w * q.w) AS dot FROM wv p JOIN wv q ON p.v = q.v AND p.token = q.token AND p.id < q.id GROUP BY p.id, q.id) s ON s.a = a.id AND s.b = b.id),
nl AS (SELECT a, b FROM pd WHERE distance <= 0.42 UNION ALL SELECT b, a FROM pd WHERE distance <= 0.42), rb(a, b) AS (SELECT id, id FROM co UNION SELECT rb.a, nl.b FROM rb JOIN nl ON nl.a = rb.b), ba AS (SELECT a AS id, dense_rank() OVER (ORDER BY min(b)) AS basin FROM rb GROUP BY a),
mr AS (SELECT tr.*, ba.basin FROM tr JOIN ba ON ba.id = tr.id),
dp AS (SELECT x.generation, avg(CASE WHEN x.id = y.id THEN 0.0 ELSE pd.distance END) AS div_pair FROM tr x JOIN tr y ON y.generation = x.generation AND x.step < y.step LEFT JOIN pd ON pd.a = least(x.id, y.id) AND pd.b = greatest(x.id, y.id) GROUP BY x.generation),
gs AS (SELECT mr.generation, count(*) AS population_size, min(objective) AS best, count(DISTINCT mr.basin) AS basins, (SELECT count(*) FROM (SELECT basin, min(generation) AS g FROM mr GROUP BY basin) f WHERE f.g = mr.generation) AS novel_basins FROM mr GROUP BY mr.generation),
gt AS (SELECT gs.*, coalesce(dp.div_pair, 0) AS div_pair, min(best) OVER (ORDER BY gs.generation) AS best_so_far, sum(novel_basins) OVER (ORDER BY gs.generation)::BIGINT AS basins_so_far FROM gs LEFT JOIN dp ON dp.generation = gs.generation),
cb AS (SELECT a.step, b.basin, count(*) AS c FROM mr a JOIN mr b ON b.step <= a.step GROUP BY a.step, b.basin), eb AS (SELECT step, count(*) AS basins_so_far, exp(-sum(c / step * ln(c / step))) AS effective FROM cb GROUP BY step),
ps AS (SELECT mr.step, generation, id, objective, min(objective) OVER (ORDER BY mr.step) AS best_so_far, basin, basins_so_far, effective FROM mr JOIN eb ON eb.step = mr.step)"""


def _candidates(spark, d):
    text_, role = F.col("text"), F.col("role")
    rows = read(spark, d, "conversations").select(F.col("turn").alias("generation"), F.col("conv_id").alias("index"), F.col("conv_id").alias("id"), F.when(role != "system", (F.length(text_) % 97) / 97.0).alias("objective"), F.when(role == "user", text_).alias("description"), F.when(role == "assistant", text_).alias("reflection"), text_.alias("code"))
    return C.trace(rows)


def _views(spark, d):
    """The trace, its candidates' vectors and their basins."""
    rows = _candidates(spark, d)
    docs = C.collapsed(rows)
    weights = C.vectors(docs)
    found = text.basins(docs.select(F.col("id").alias("doc_id")), C.near_pairs(weights)).withColumnRenamed("doc_id", "id")
    return rows, weights, found


@query(f"WITH RECURSIVE {_TRACE} SELECT step, generation, id, round(objective, 6) AS objective FROM tr")
def trace_steps(spark, d):
    return rounded(_candidates(spark, d).select("step", "generation", "id", "objective"), "objective")


@query(f"WITH RECURSIVE {_TRACE} SELECT id, description, reflection, code FROM co")
def collapsed_candidates(spark, d):
    return C.collapsed(_candidates(spark, d))


@query(f"WITH RECURSIVE {_TRACE} SELECT a, b, round(distance, 6) AS distance FROM pd WHERE distance <= 0.42")
def near_candidates(spark, d):
    return rounded(C.near_pairs(C.vectors(C.collapsed(_candidates(spark, d)))), "distance")


@query(f"WITH RECURSIVE {_TRACE} SELECT id, basin FROM ba")
def view_basins(spark, d):
    return _views(spark, d)[2]


@query(f"WITH RECURSIVE {_TRACE} SELECT generation, round(div_pair, 6) AS div_pair FROM gt")
def generation_diversity(spark, d):
    rows = _candidates(spark, d)
    return rounded(C.mean_distance(rows, C.vectors(C.collapsed(rows))), "div_pair")


@query(f"WITH RECURSIVE {_TRACE} SELECT generation, population_size, round(best, 6) AS best, round(best_so_far, 6) AS best_so_far, round(div_pair, 6) AS div_pair, novel_basins, basins, basins_so_far FROM gt")
def generation_summary(spark, d):
    rows, weights, found = _views(spark, d)
    return rounded(C.generation_summary(rows, found, C.mean_distance(rows, weights)), "best", "best_so_far", "div_pair")


@query(f"WITH RECURSIVE {_TRACE} SELECT step, generation, id, round(objective, 6) AS objective, round(best_so_far, 6) AS best_so_far, basin, basins_so_far, round(effective, 6) AS effective FROM ps")
def step_summary(spark, d):
    rows, _, found = _views(spark, d)
    return rounded(C.step_summary(rows, found), "objective", "best_so_far", "effective")


@query(f"""WITH RECURSIVE {_TRACE}, en AS (SELECT (SELECT arg_min(best, generation) FROM gs) AS start, (SELECT min(objective) FROM tr) AS final), lv AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS level)
SELECT level, round(min(start - level * greatest(0.0, start - final)), 6) AS target, round(any_value(start), 6) AS start, round(any_value(final), 6) AS final, min(step) AS step, arg_min(generation, step) AS generation, arg_min(basins_so_far, step) AS basins_so_far
FROM ps, en, lv WHERE best_so_far <= start - level * greatest(0.0, start - final) + 1e-12 GROUP BY level""")
def milestone_complexity(spark, d):
    rows, weights, found = _views(spark, d)
    by_step = C.step_summary(rows, found)
    return rounded(C.complexity(C.generation_summary(rows, found, C.mean_distance(rows, weights)), by_step), "target", "start", "final")


@query(f"""WITH RECURSIVE {_TRACE}, qc AS (SELECT quantile_cont(objective, 0.1) AS q10, quantile_cont(objective, 0.25) AS q25, count(*) AS n FROM tr), bs AS (SELECT basin, count(*) / any_value(n) AS share, max(CASE WHEN objective <= q10 THEN 1 ELSE 0 END) AS t10, max(CASE WHEN objective <= q25 THEN 1 ELSE 0 END) AS t25 FROM mr, qc GROUP BY basin)
SELECT count(*) AS basins, round(sum(share * share), 6) AS hhi, round(max(share), 6) AS largest, sum(t10)::BIGINT AS top10, sum(t25)::BIGINT AS top25, round(sum(t10) / count(*), 6) AS top10_share, round(sum(t25) / count(*), 6) AS top25_share FROM bs""")
def basin_quality(spark, d):
    rows, _, found = _views(spark, d)
    return rounded(C.quality(rows, found), "hhi", "largest", "top10_share", "top25_share")


@query("WITH s AS (SELECT event_type AS arm, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events), n AS (SELECT min(c) AS budget FROM (SELECT count(*) AS c FROM s GROUP BY arm)) SELECT arm, id, step FROM s, n WHERE step <= budget")
def matched_arms(spark, d):
    w = C.Window.partitionBy("event_type").orderBy("event_id")
    rows = read(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("id"), F.row_number().over(w).cast("long").alias("step"))
    return C.matched(rows, "arm")
