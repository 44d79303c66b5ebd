"""Graphs and traces that queries derive from whole tables, and the same as SQL.

Each SQL text ends with c (g, src, dst: canonical edges), s (g, node, other: both ways), n (g, node) and d (g, node, degree).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fractura.operators import graph
from fractura.session import read

_ENDS = """, s AS (SELECT g, src AS node, dst AS other FROM c UNION ALL SELECT g, dst, src FROM c), n AS (SELECT DISTINCT g, node FROM s),
d AS (SELECT g, node, count(*) AS degree FROM s GROUP BY g, node)"""
_CANONICAL = "SELECT DISTINCT g, least(x, y) AS src, greatest(x, y) AS dst FROM e WHERE x <> y"

#: Parts and the suppliers that lineitem has them from.
PART_SUPP = f"e AS (SELECT 'ps' AS g, 2 * l_partkey AS x, 2 * l_suppkey + 1 AS y FROM lineitem), c AS ({_CANONICAL}){_ENDS}"
#: Six graphs, one a type of part: brands and the sizes they come in.
TYPES = f"e AS (SELECT p_type AS g, 2 * substr(p_brand, 7)::BIGINT AS x, 2 * p_size::BIGINT + 1 AS y FROM part), c AS ({_CANONICAL}){_ENDS}"
#: A forest: regions, nations, suppliers and customers.
PLACES = f"""e AS (SELECT 'places' AS g, 4 * n_regionkey::BIGINT AS x, 4 * n_nationkey::BIGINT + 1 AS y FROM nation
 UNION ALL SELECT 'places', 4 * s_suppkey + 2, 4 * s_nationkey::BIGINT + 1 FROM supplier
 UNION ALL SELECT 'places', 4 * c_custkey + 3, 4 * c_nationkey::BIGINT + 1 FROM customer), c AS ({_CANONICAL}){_ENDS}"""
#: Customers whose orders follow each other; the weight of an edge is the largest price of a first order.
CHAIN = f"""e AS (SELECT 'chain' AS g, a.o_custkey AS x, b.o_custkey AS y, a.o_totalprice AS w FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1),
c AS ({_CANONICAL}), cw AS (SELECT g, least(x, y) AS src, greatest(x, y) AS dst, max(w) AS weight FROM e WHERE x <> y GROUP BY ALL){_ENDS}"""

#: From any of them: what each node reaches (r), its component (k) and their sizes (z).
REACH = """, r(g, a, b) AS (SELECT g, node, node FROM n UNION SELECT r.g, r.a, s.other FROM r JOIN s ON s.g = r.g AND s.node = r.b),
k AS (SELECT g, a AS node, min(b) AS component FROM r GROUP BY g, a), z AS (SELECT g, component, count(*) AS size FROM k GROUP BY g, component)"""
#: Distances (y: g, a, x, l) of all pairs: one frontier a round, from all nodes.
DISTANCES = """, w(g, a, x, l) AS (SELECT g, node, node, 0 FROM n
 UNION SELECT w.g, w.a, s.other, l + 1 FROM w JOIN s ON s.g = w.g AND s.node = w.x JOIN top ON top.g = w.g WHERE l < top.most),
y AS (SELECT g, a, x, min(l) AS l FROM w GROUP BY g, a, x)"""
#: An order by falling degree (o), and cp and lcc after each of its steps (u).
RANK = ", o AS (SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY degree DESC, node) AS step, 'static' AS strategy FROM d)"
STEPS = """, gr AS (SELECT o.strategy, s.g, s.node, s.other, least(x.step, o.step) AS death FROM s JOIN o ON o.g = s.g AND o.node = s.node JOIN o x ON x.g = s.g AND x.node = s.other AND x.strategy = o.strategy),
t AS (SELECT g, strategy, unnest(range(0, count(*)::BIGINT + 1)) AS step FROM o GROUP BY g, strategy),
q0(g, strategy, step, a, b) AS (SELECT t.g, t.strategy, t.step, o.node, o.node FROM t JOIN o ON o.g = t.g AND o.strategy = t.strategy AND o.step > t.step
 UNION SELECT q0.g, q0.strategy, q0.step, q0.a, gr.other FROM q0 JOIN gr ON gr.g = q0.g AND gr.strategy = q0.strategy AND gr.node = q0.b AND gr.death > q0.step),
q AS (SELECT g, strategy, step, a, count(*) AS size FROM q0 GROUP BY ALL),
u AS (SELECT t.g, t.strategy, t.step, coalesce(sum(size - 1) // 2, 0)::BIGINT AS cp, coalesce(max(size), 0)::BIGINT AS lcc FROM t LEFT JOIN q ON q.g = t.g AND q.strategy = t.strategy AND q.step = t.step GROUP BY ALL)"""
#: The metric record (m) of each order.
METRICS = """, v AS (SELECT *, max(step) OVER w AS n, max(CASE WHEN step = 0 THEN cp END) OVER w AS c0, max(CASE WHEN step = 0 THEN lcc END) OVER w AS l0, greatest(1, floor(0.15 * max(step) OVER w))::BIGINT AS k FROM u WINDOW w AS (PARTITION BY g, strategy)),
m AS (SELECT g AS graph_id, strategy, sum(CASE WHEN step > 0 THEN cp / c0 END) / max(n) AS anc, sum(CASE WHEN step BETWEEN 1 AND k THEN cp / c0 END) / max(k) AS anc_prefix_k,
 coalesce(min(CASE WHEN step > 0 AND cp / c0 <= 0.5 THEN step END), max(n)) AS fht_50, coalesce(min(CASE WHEN step > 0 AND cp / c0 <= 0.1 THEN step END), max(n)) AS fht_10,
 max(CASE WHEN step = k THEN lcc END) / max(n) AS lcc_at_k, max(k) AS k FROM v GROUP BY g, strategy)"""
#: Hitting times of a candidate; some have none.
FHT = "CASE WHEN user_id % 7 <> 0 THEN user_id % 50 END AS fht_50, user_id % 90 AS fht_10"
#: Survivors (v) of a trace (t), ranked.
SURVIVORS = """, a AS (SELECT *, row_number() OVER (PARTITION BY generation, code ORDER BY id) AS r FROM t WHERE objective IS NOT NULL AND code IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY generation, objective ORDER BY fht_50 NULLS LAST, fht_10 NULLS LAST, id) AS q FROM a WHERE r = 1),
v AS (SELECT generation, row_number() OVER (PARTITION BY generation ORDER BY objective) AS rank, id, objective, fht_50 FROM b WHERE q = 1)"""
#: A trace: candidates (events) by generation (their day) and operator.
TRACE = """t AS (SELECT event_id AS id, day(ts)::BIGINT AS generation, CASE event_type WHEN 'view' THEN 'm1' WHEN 'click' THEN 'm2' WHEN 'purchase' THEN 'e1' WHEN 'signup' THEN 'e2' ELSE 'i1' END AS operator,
 CASE WHEN user_id % 10 = 3 THEN NULL ELSE value END AS objective, props AS code, user_id / 10.0::DOUBLE AS time, """ + FHT + " FROM events)"
#: Base weights of its operators.
BASE = {"e1": 0.5, "e2": 0.6, "i1": 0.45, "m1": 0.55, "m2": 0.4}


def distances(most: str = "(SELECT max(c0) FROM (SELECT count(*) AS c0 FROM n GROUP BY g))") -> str:
    """DISTANCES up to ``most`` (at first the number of nodes, so all)."""
    return f", top AS (SELECT DISTINCT g, {most} AS most FROM n)" + DISTANCES


def _edges(rows: DataFrame, name: Column, x: Column, y: Column) -> DataFrame:
    return graph.canonical(rows.select(name.alias("graph_id"), x.cast("long").alias("src"), y.cast("long").alias("dst")))


def part_supp(spark: SparkSession, d: str) -> DataFrame:
    return _edges(read(spark, d, "lineitem"), F.lit("ps"), 2 * F.col("l_partkey"), 2 * F.col("l_suppkey") + 1)


def types(spark: SparkSession, d: str) -> DataFrame:
    return _edges(read(spark, d, "part"), F.col("p_type"), 2 * F.substring("p_brand", 7, 9).cast("long"), 2 * F.col("p_size").cast("long") + 1)


def places(spark: SparkSession, d: str) -> DataFrame:
    name, key = F.lit("places"), lambda c, k: 4 * F.col(c).cast("long") + k
    nation = _edges(read(spark, d, "nation"), name, key("n_regionkey", 0), key("n_nationkey", 1))
    supplier = _edges(read(spark, d, "supplier"), name, key("s_suppkey", 2), key("s_nationkey", 1))
    return nation.unionByName(supplier).unionByName(_edges(read(spark, d, "customer"), name, key("c_custkey", 3), key("c_nationkey", 1)))


def weighted_chain(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, src, dst, weight)."""
    o = read(spark, d, "orders")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("y"))
    pairs = o.select("o_orderkey", F.col("o_custkey").alias("x"), "o_totalprice").join(nxt, "o_orderkey").where("x <> y")
    return pairs.groupBy(F.lit("chain").alias("graph_id"), F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.max("o_totalprice").alias("weight"))


def chain(spark: SparkSession, d: str) -> DataFrame:
    return weighted_chain(spark, d).select("graph_id", "src", "dst")


def static(edges: DataFrame) -> DataFrame:
    return graph.static_order(graph.degree(edges), F.col("degree")).withColumn("strategy", F.lit("static"))


def _times() -> list[Column]:
    return [F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 50).alias("fht_50"), (F.col("user_id") % 90).alias("fht_10")]


def trace(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.dayofmonth("ts").cast("long").alias("generation"), F.col("event_type").alias("operator"), F.col("value").alias("objective"), F.col("props").alias("code"), *_times())


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The trace with names of operators, times, and candidates that failed (a null objective)."""
    kind = F.col("event_type")
    name = F.when(kind == "view", "m1").when(kind == "click", "m2").when(kind == "purchase", "e1").when(kind == "signup", "e2").otherwise("i1")
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.dayofmonth("ts").cast("long").alias("generation"), name.alias("operator"), F.when(F.col("user_id") % 10 != 3, F.col("value")).alias("objective"), F.col("props").alias("code"), (F.col("user_id") / 10.0).alias("time"), *_times())


def base(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BASE.items()), "operator string, weight double")
