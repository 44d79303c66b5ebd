"""Queries of graph primitives, orders, metrics, perturbations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fractura.operators import communities, distances as large, graph, orders, partition, perturb, samplers, search
from fractura.session import read

from .inputs import CHAIN, METRICS, PART_SUPP, PLACES, RANK, REACH, STEPS, TYPES, chain, distances, part_supp, places, static, types, weighted_chain
from .registry import query, rounded

# --- local


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, src, dst FROM c")
def edges_canonical(spark, d):
    return part_supp(spark, d)


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, node, degree FROM d")
def degree(spark, d):
    return graph.degree(part_supp(spark, d))


@query("WITH w AS (SELECT 2 * l_partkey AS node, l_discount AS x FROM lineitem UNION ALL SELECT 2 * l_suppkey + 1, l_discount FROM lineitem) SELECT 'ps' AS graph_id, node, round(sum(x), 6) AS strength FROM w GROUP BY node")
def strength(spark, d):
    e = read(spark, d, "lineitem").select(F.lit("ps").alias("graph_id"), (2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"), F.col("l_discount").alias("weight"))
    return rounded(graph.strength(e), "strength")


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, node, degree::DOUBLE AS strength FROM d")
def strength_of_unit_weights(spark, d):
    return graph.strength(perturb.unit_weights(part_supp(spark, d)))


@query(f"WITH {TYPES} SELECT g AS graph_id, count(*) AS n_nodes, (sum(degree) // 2)::BIGINT AS n_edges, round(avg(degree), 6) AS avg_degree, round(var_pop(degree), 6) AS degree_variance FROM d GROUP BY g")
def degree_stats(spark, d):
    return rounded(graph.degree_stats(types(spark, d)), "avg_degree", "degree_variance")


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, src, dst FROM c WHERE src IN (SELECT node FROM d WHERE degree >= 25) AND dst IN (SELECT node FROM d WHERE degree >= 25)")
def induced_subgraph(spark, d):
    e = part_supp(spark, d)
    return graph.induced(e, graph.degree(e).where("degree >= 25"))


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, src, dst FROM c WHERE src NOT IN (SELECT node FROM d WHERE degree BETWEEN 25 AND 100) AND dst NOT IN (SELECT node FROM d WHERE degree BETWEEN 25 AND 100)")
def node_removal(spark, d):
    e = part_supp(spark, d)
    return graph.without_nodes(e, graph.degree(e).where("degree between 25 and 100"))


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, src, dst FROM c WHERE (src, dst) NOT IN (SELECT least(2 * l_partkey, 2 * l_suppkey + 1), greatest(2 * l_partkey, 2 * l_suppkey + 1) FROM lineitem WHERE l_returnflag = 'R')")
def edge_removal(spark, d):
    gone = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("ps").alias("graph_id"), (2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))
    return graph.without_edges(part_supp(spark, d), gone)


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, src, dst FROM c UNION SELECT g, least(src, dst + 2), greatest(src, dst + 2) FROM c WHERE src <> dst + 2")
def edge_insertion(spark, d):
    e = part_supp(spark, d)
    return graph.with_edges(e, e.select("graph_id", "src", (F.col("dst") + 2).alias("dst")))


_TRIANGLES = f"{CHAIN}, tri AS (SELECT x.node, count(*) AS n FROM s x JOIN s y ON x.node = y.node AND x.other < y.other JOIN c ON c.src = x.other AND c.dst = y.other GROUP BY x.node), cl AS (SELECT d.g, d.node, CASE WHEN degree < 2 THEN 0 ELSE 2 * coalesce(n, 0) / (degree * (degree - 1)) END AS clustering FROM d LEFT JOIN tri ON tri.node = d.node)"


@query(f"WITH {_TRIANGLES} SELECT g AS graph_id, node, round(clustering, 6) AS clustering FROM cl")
def clustering(spark, d):
    return rounded(graph.clustering(chain(spark, d)), "clustering")


@query(f"WITH {_TRIANGLES} SELECT g AS graph_id, round(avg(clustering), 6) AS avg_clustering FROM cl GROUP BY g")
def avg_clustering(spark, d):
    return rounded(graph.clustering(chain(spark, d)).groupBy("graph_id").agg(F.avg("clustering").alias("avg_clustering")), "avg_clustering")


@query(f"""WITH {CHAIN}, sw AS (SELECT src AS node, dst AS other, weight / (SELECT max(weight) FROM cw) AS w FROM cw UNION ALL SELECT dst, src, weight / (SELECT max(weight) FROM cw) FROM cw),
tri AS (SELECT x.node, sum(cbrt(x.w * y.w * z.w)) AS n FROM sw x JOIN sw y ON x.node = y.node AND x.other < y.other JOIN sw z ON z.node = x.other AND z.other = y.other GROUP BY x.node)
SELECT d.g AS graph_id, d.node, round(CASE WHEN degree < 2 THEN 0 ELSE 2 * coalesce(n, 0) / (degree * (degree - 1)) END, 6) AS clustering FROM d LEFT JOIN tri ON tri.node = d.node""")
def weighted_clustering(spark, d):
    return rounded(graph.weighted_clustering(weighted_chain(spark, d)), "clustering")


@query(f"WITH {PART_SUPP}, a AS (SELECT avg(degree) AS m FROM d) SELECT s.g AS graph_id, s.node, round(avg(CASE WHEN d.degree <= a.m THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS fragility FROM s JOIN d ON d.node = s.other, a GROUP BY s.g, s.node")
def fragility(spark, d):
    return rounded(graph.fragility(part_supp(spark, d)), "fragility")


# --- components, cores, paths


@query(f"WITH RECURSIVE {PLACES}{REACH} SELECT g AS graph_id, node, component FROM k")
def components(spark, d):
    return graph.components(places(spark, d))


@query(f"WITH RECURSIVE {PLACES}{REACH}, ed AS (SELECT g, count(*) AS m FROM c GROUP BY g) SELECT z.g AS graph_id, count(*) AS n_components, max(size) AS largest, sum(size * (size - 1) // 2)::BIGINT AS connected_pairs, count(*) = 1 AS connected, max(m) = sum(size) - count(*) AS forest FROM z JOIN ed ON ed.g = z.g GROUP BY z.g")
def pairwise_connectivity(spark, d):
    return graph.pairwise_connectivity(places(spark, d))


@query(f"WITH RECURSIVE {PLACES}{REACH} SELECT g AS graph_id, node FROM k WHERE component = (SELECT component FROM z ORDER BY size DESC, component LIMIT 1)")
def largest_component(spark, d):
    return graph.largest_component(places(spark, d))


#: k-cores of all k at once: every round the edges at nodes of a smaller degree go, until there are none.
_CORES = f"""{TYPES}, ks AS (SELECT unnest(range(1, (SELECT max(degree) FROM d) + 1))::BIGINT AS k),
pe(i, k, g, node, other) AS (SELECT 0, k, g, node, other FROM s, ks UNION ALL SELECT i + 1, k, g, node, other
 FROM (SELECT *, min(dn) OVER (PARTITION BY k, g) AS weak FROM (SELECT *, count(*) OVER (PARTITION BY k, g, node) AS dn, count(*) OVER (PARTITION BY k, g, other) AS dx FROM pe))
 WHERE weak < k AND dn >= k AND dx >= k),
ends AS (SELECT k, g, node, count(*) AS dn, i FROM pe GROUP BY ALL), lasts AS (SELECT k, g, max(i) AS i FROM ends GROUP BY k, g),
whole AS (SELECT ends.k, ends.g FROM ends JOIN lasts ON lasts.k = ends.k AND lasts.g = ends.g AND lasts.i = ends.i GROUP BY ends.k, ends.g HAVING min(dn) >= ends.k),
cores AS (SELECT d.g, d.node, coalesce(max(whole.k), 0) AS core FROM d LEFT JOIN (ends JOIN lasts ON lasts.k = ends.k AND lasts.g = ends.g AND lasts.i = ends.i JOIN whole ON whole.k = ends.k AND whole.g = ends.g) ON ends.g = d.g AND ends.node = d.node GROUP BY d.g, d.node)"""


@query(f"WITH RECURSIVE {_CORES} SELECT g AS graph_id, node, core FROM cores")
def core_numbers(spark, d):
    return graph.core_numbers(types(spark, d))


@query(f"WITH RECURSIVE {_CORES} SELECT g AS graph_id, max(core) AS max_core FROM cores GROUP BY g")
def max_core(spark, d):
    return graph.core_numbers(types(spark, d)).groupBy("graph_id").agg(F.max("core").alias("max_core"))


@query(f"WITH RECURSIVE {_CORES} SELECT g AS graph_id, node FROM cores WHERE core >= 4")
def four_core(spark, d):
    return graph.k_core(types(spark, d), 4)


@query(f"WITH RECURSIVE {_CORES} SELECT g AS graph_id, node FROM cores WHERE core >= 2")
def two_core(spark, d):
    return graph.k_core(types(spark, d), 2)


#: Trees of regions are two levels deep, so no distance there is over 4.
_NEAR = f"{PLACES}{REACH}{distances('4')}, big AS (SELECT component FROM z ORDER BY size DESC, component LIMIT 1), yb AS (SELECT y.* FROM y JOIN k ON k.node = y.a WHERE k.component = (SELECT component FROM big))"


@query(f"WITH RECURSIVE {_NEAR} SELECT g AS graph_id, a AS source, x AS node, l AS distance FROM yb WHERE l = 3")
def bfs_boundary(spark, d):
    e = places(spark, d)
    return graph.boundary(e, graph.largest_component(e), 3)


@query(f"WITH RECURSIVE {_NEAR} SELECT g AS graph_id, round(avg(l), 6) AS avg_path, max(l) AS diameter FROM yb WHERE a <> x GROUP BY g")
def apl_diameter(spark, d):
    return rounded(graph.path_lengths(places(spark, d)), "avg_path")


@query(f"""WITH RECURSIVE {_NEAR}, pr AS (SELECT g, min(node) AS a, max(node) AS b FROM k GROUP BY g, component),
p(g, a, b, position, node) AS (SELECT pr.g, pr.a, pr.b, y.l, pr.b FROM pr JOIN y ON y.g = pr.g AND y.a = pr.a AND y.x = pr.b
 UNION ALL SELECT p.g, p.a, p.b, p.position - 1, min(s.other) FROM p JOIN s ON s.g = p.g AND s.node = p.node JOIN y ON y.g = p.g AND y.a = p.a AND y.x = s.other AND y.l = p.position - 1 GROUP BY p.g, p.a, p.b, p.position)
SELECT g AS graph_id, a AS source, b AS target, position, node FROM p""")
def shortest_path(spark, d):
    e = places(spark, d)
    pairs = graph.components(e).groupBy("graph_id", "component").agg(F.min("node").alias("source"), F.max("node").alias("target"))
    return graph.shortest_path(e, pairs.select("graph_id", "source", "target"))


_ALL = f"{TYPES}{distances()}"


@query(f"WITH RECURSIVE {_ALL}, nn AS (SELECT g, count(*) AS n FROM n GROUP BY g) SELECT y.g AS graph_id, a AS node, round(CASE WHEN sum(l) = 0 THEN 0 ELSE (count(*) - 1.0::DOUBLE) / (max(n) - 1) * ((count(*) - 1.0::DOUBLE) / sum(l)) END, 6) AS closeness FROM y JOIN nn ON nn.g = y.g GROUP BY y.g, a")
def closeness(spark, d):
    return rounded(graph.closeness(types(spark, d)), "closeness")


_BETWEEN = f"""{_ALL}, sg(g, a, x, l, paths) AS (SELECT g, node, node, 0, 1.0::DOUBLE FROM n
 UNION ALL SELECT sg.g, sg.a, s.other, sg.l + 1, sum(sg.paths) FROM sg JOIN s ON s.g = sg.g AND s.node = sg.x JOIN y ON y.g = sg.g AND y.a = sg.a AND y.x = s.other AND y.l = sg.l + 1 GROUP BY sg.g, sg.a, s.other, sg.l),
bt AS (SELECT u.g, u.x AS node, sum(u.paths * v.paths / w2.paths) / 2 AS betweenness FROM sg u JOIN sg v ON v.g = u.g AND v.a = u.x AND v.l > 0 JOIN sg w2 ON w2.g = u.g AND w2.a = u.a AND w2.x = v.x AND w2.l = u.l + v.l WHERE u.l > 0 GROUP BY u.g, u.x),
bc AS (SELECT n.g, n.node, coalesce(betweenness, 0.0::DOUBLE) AS betweenness FROM n LEFT JOIN bt ON bt.g = n.g AND bt.node = n.node)"""


@query(f"WITH RECURSIVE {_BETWEEN} SELECT g AS graph_id, node, round(betweenness, 6) AS betweenness FROM bc")
def betweenness(spark, d):
    return rounded(graph.betweenness(types(spark, d)), "betweenness")


_ENDS = "cz AS (SELECT g, a, min(x) AS component, count(*) AS size, max(l) AS far FROM y GROUP BY g, a), dz AS (SELECT g, component, max(far)::BIGINT AS diameter, row_number() OVER (PARTITION BY g ORDER BY max(size) DESC, component) AS r FROM cz GROUP BY g, component)"


@query(f"WITH RECURSIVE {_ALL}, {_ENDS} SELECT g AS graph_id, diameter FROM dz WHERE r = 1")
def diameters(spark, d):
    return large.diameters(types(spark, d)).select("graph_id", "diameter")


@query(f"WITH RECURSIVE {_NEAR}, {_ENDS} SELECT g AS graph_id, diameter FROM dz WHERE r = 1")
def diameter_of_places(spark, d):
    return large.diameters(places(spark, d)).select("graph_id", "diameter")


@query()
def betweenness_of_chain(spark, d):
    return rounded(large.drawn_betweenness(chain(spark, d), 0.1), "betweenness", "bound")


@query()
def closeness_of_chain(spark, d):
    return rounded(large.closeness(chain(spark, d)), "closeness")


_SUMMARY = f"""{_BETWEEN}, {_CORES[len(TYPES) + 2 :]}, hq AS (SELECT g, quantile_cont(betweenness, 0.9) AS cut FROM bc GROUP BY g),
hs AS (SELECT bc.g, avg(CASE WHEN round(betweenness, 9) > round(cut, 9) THEN 1.0 ELSE 0.0 END) AS share FROM bc JOIN hq ON hq.g = bc.g GROUP BY bc.g),
cz AS (SELECT g, a AS node, min(x) AS component, count(*) AS size FROM y GROUP BY g, a), bz AS (SELECT g, component FROM (SELECT g, component, row_number() OVER (PARTITION BY g ORDER BY size DESC, component) AS r FROM cz) WHERE r = 1),
pl AS (SELECT y.g, avg(l) AS apl, max(l) AS dia FROM y JOIN cz ON cz.g = y.g AND cz.node = y.a JOIN bz ON bz.g = y.g AND bz.component = cz.component WHERE y.a <> y.x GROUP BY y.g)"""


@query(f"""WITH RECURSIVE {_SUMMARY} SELECT d.g AS graph_id, round(avg(degree), 6) AS avg_degree, round(var_pop(degree), 6) AS degree_variance, round(coalesce(max(apl), 0), 6) AS apl_lcc, coalesce(max(dia), 0) AS diameter_lcc,
 (SELECT max(core) FROM cores WHERE cores.g = d.g) AS max_core, round(max(share), 6)::DOUBLE AS bridge_ratio FROM d JOIN hs ON hs.g = d.g LEFT JOIN pl ON pl.g = d.g GROUP BY d.g""")
def graph_summary(spark, d):
    return rounded(graph.summary(types(spark, d)), "avg_degree", "degree_variance", "apl_lcc", "bridge_ratio")


@query(f"""WITH RECURSIVE {_BETWEEN}, {_CORES[len(TYPES) + 2 :]} SELECT d.g AS graph_id, d.node, degree, 0.0::DOUBLE AS clustering, core, round(betweenness, 6) AS betweenness FROM d JOIN cores ON cores.g = d.g AND cores.node = d.node JOIN bc ON bc.g = d.g AND bc.node = d.node""")
def node_features(spark, d):
    return rounded(graph.features(types(spark, d)), "betweenness")


#: Rounds of plain iteration, far beyond what the ranks and vectors need to settle to nine places.
_RANKS = """, nn AS (SELECT g, count(*)::DOUBLE AS n FROM n GROUP BY g), p(i, g, node, rank) AS (SELECT 0, n.g, node, 1 / nn.n FROM n JOIN nn ON nn.g = n.g
 UNION ALL SELECT i + 1, s.g, s.other, 0.15::DOUBLE / max(nn.n) + 0.85::DOUBLE * sum(rank / degree) FROM p JOIN s ON s.g = p.g AND s.node = p.node JOIN d ON d.g = p.g AND d.node = p.node JOIN nn ON nn.g = p.g WHERE i < 160 GROUP BY i, s.g, s.other)
SELECT g AS graph_id, node, round(rank, 6) AS rank FROM p WHERE i = 160"""


@query(f"WITH RECURSIVE {TYPES}{_RANKS}")
def pagerank(spark, d):
    return rounded(graph.pagerank(types(spark, d)), "rank")


@query(f"WITH RECURSIVE {CHAIN}{_RANKS}")
def pagerank_of_chain(spark, d):
    return rounded(graph.pagerank(chain(spark, d)), "rank")


_POWER = """, p(i, g, node, x) AS (SELECT 0, n.g, n.node, 1.0::DOUBLE / cn.n FROM n JOIN (SELECT g, count(*) AS n FROM n GROUP BY g) cn ON cn.g = n.g
 UNION ALL SELECT i + 1, g, node, v / sqrt(sum(v * v) OVER (PARTITION BY g)) FROM (SELECT i, p.g, sw.other AS node, sum(p.x * sw.w) AS v FROM p JOIN sw ON sw.g = p.g AND sw.node = p.node WHERE i < 400 GROUP BY i, p.g, sw.other))
SELECT g AS graph_id, node, round(x, 6) AS centrality FROM p WHERE i = 400"""


@query(f"WITH RECURSIVE {TYPES}, sw AS (SELECT g, node, other, 1.0::DOUBLE AS w FROM s UNION ALL SELECT g, node, node, 20.0 FROM n){_POWER}")
def eigenvector(spark, d):
    return rounded(graph.eigenvector(types(spark, d)), "centrality")


@query(f"WITH RECURSIVE {CHAIN}, sw AS (SELECT g, src AS node, dst AS other, weight / 100000 AS w FROM cw UNION ALL SELECT g, dst, src, weight / 100000 FROM cw UNION ALL SELECT g, node, node, 20.0 FROM n){_POWER}")
def weighted_eigenvector(spark, d):
    return rounded(graph.eigenvector(weighted_chain(spark, d).withColumn("weight", F.col("weight") / 100000), "weight"), "centrality")


# --- orders and metrics


@query(f"WITH {PART_SUPP}{RANK} SELECT g AS graph_id, node, step, strategy FROM o")
def order_static_degree(spark, d):
    return static(part_supp(spark, d))


_STATIC = f"WITH RECURSIVE {TYPES}{RANK}{STEPS}{METRICS}"


@query(f"{_STATIC} SELECT g AS graph_id, strategy, step, cp, lcc FROM u")
def step_series(spark, d):
    e = types(spark, d)
    return orders.step_series(e, static(e))


_RECORD = "graph_id, strategy, round(anc, 6) AS anc, round(anc_prefix_k, 6) AS anc_prefix_k, fht_50, fht_10, round(lcc_at_k, 6) AS lcc_at_k, k"


@query(f"{_STATIC} SELECT {_RECORD} FROM m")
def anc_static_degree(spark, d):
    e = types(spark, d)
    return rounded(orders.evaluate(e, static(e)), "anc", "anc_prefix_k", "lcc_at_k")


#: Steps of the forest of places: what is left hangs together below the last ancestor that is still joined; it is three levels deep.
_PLACES = f"""WITH {PLACES}{RANK}, pa AS (SELECT s.g, s.node, s.other AS parent FROM s WHERE s.node % 4 > 1 OR (s.node % 4 = 1 AND s.other % 4 = 0)),
ln AS (SELECT o.g, o.strategy, o.node, o.step AS s0, p.parent AS n1, o1.step AS s1, q.parent AS n2, o2.step AS s2 FROM o LEFT JOIN pa p ON p.node = o.node LEFT JOIN o o1 ON o1.node = p.parent LEFT JOIN pa q ON q.node = p.parent LEFT JOIN o o2 ON o2.node = q.parent),
t AS (SELECT g, strategy, unnest(range(0, count(*)::BIGINT + 1)) AS step FROM o GROUP BY g, strategy),
q AS (SELECT t.g, t.strategy, t.step, CASE WHEN s1 > t.step THEN CASE WHEN s2 > t.step THEN n2 ELSE n1 END ELSE node END AS top, count(*) AS size FROM t JOIN ln ON ln.s0 > t.step GROUP BY ALL),
u AS (SELECT t.g, t.strategy, t.step, coalesce(sum(size * (size - 1) // 2), 0)::BIGINT AS cp, coalesce(max(size), 0)::BIGINT AS lcc FROM t LEFT JOIN q ON q.g = t.g AND q.step = t.step GROUP BY ALL){METRICS}"""


@query(f"{_PLACES} SELECT g AS graph_id, strategy, step, cp, lcc FROM u")
def step_series_of_places(spark, d):
    e = places(spark, d)
    return orders.step_series(e, static(e))


@query(f"{_PLACES} SELECT {_RECORD} FROM m")
def anc_of_places(spark, d):
    e = places(spark, d)
    return rounded(orders.evaluate(e, static(e)), "anc", "anc_prefix_k", "lcc_at_k")


@query()
def anc_of_chain(spark, d):
    e = chain(spark, d)
    return rounded(orders.evaluate(e, static(e)), "anc", "anc_prefix_k", "lcc_at_k")


@query(f"{_STATIC} SELECT g AS graph_id, strategy, max(step) AS steps, round(sum(cp / c0) / max(step), 6) AS anc FROM v WHERE step BETWEEN 1 AND 20 GROUP BY g, strategy")
def anc_of_a_prefix(spark, d):
    e = types(spark, d)
    return rounded(orders.prefix_anc(e, static(e).where("step <= 20")), "anc")


_CURVE = _STATIC + ", p AS (SELECT g, strategy, step, step / n AS removed, lcc / l0 AS lcc_ratio, cp / c0 AS cp_ratio FROM v WHERE step <= least(n, ceil(n * 0.7)))"
_CUT = _CURVE + ", ct AS (SELECT p.*, min(CASE WHEN cp_ratio <= 0.05 THEN step END) OVER (PARTITION BY g, strategy) AS stop FROM p), cc AS (SELECT *, least(greatest(cp_ratio, 1e-4), 1.0) AS cp_clipped FROM ct WHERE step <= coalesce(stop, step))"


@query(f"{_CURVE} SELECT g AS graph_id, strategy, step, round(removed, 6) AS removed, round(lcc_ratio, 6) AS lcc_ratio, round(cp_ratio, 6) AS cp_ratio FROM p")
def dismantling_curve(spark, d):
    return rounded(orders.curve(step_series(spark, d)), "removed", "lcc_ratio", "cp_ratio")


@query(f"{_CUT} SELECT g AS graph_id, strategy, step, round(cp_clipped, 6) AS cp_clipped FROM cc")
def curve_truncated(spark, d):
    return rounded(orders.truncated(orders.curve(step_series(spark, d)), 0.05), "cp_clipped")


@query(f"{_CUT} SELECT strategy, round(greatest(1e-4, min(cp_clipped) * 0.85), 6) AS y_min, round(least(1.1, max(cp_clipped) * 1.03), 6) AS y_max FROM cc WHERE step BETWEEN 3 AND 12 GROUP BY strategy")
def early_window(spark, d):
    points = orders.truncated(orders.curve(step_series(spark, d)), 0.05)
    return rounded(orders.window_limits(points, "step", "cp_clipped", 3, 12), "y_min", "y_max")


@query(f"WITH {PART_SUPP}{RANK} SELECT s.g AS graph_id, s.node, max(x.step) AS step, round(avg(CASE WHEN y.step > x.step THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS ratio FROM s JOIN o x ON x.node = s.node JOIN o y ON y.node = s.other GROUP BY s.g, s.node")
def unvisited_ratio(spark, d):
    e = part_supp(spark, d)
    return rounded(orders.unvisited_ratio(graph.symmetric(e), static(e)), "ratio")


@query("SELECT event_id, event_type, round(CASE WHEN count(*) OVER g = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY event_type ORDER BY value) - 1 + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2) / (count(*) OVER g - 1) END, 6) AS percentile FROM events WINDOW g AS (PARTITION BY event_type)")
def percentile_rank(spark, d):
    return rounded(orders.percentile_rank(read(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value").drop("value"), "percentile")


_STAGED = f"""{TYPES}{RANK}, nn AS (SELECT g, count(*) AS n FROM n GROUP BY g), bd(stage, low, high) AS (VALUES (1, 0.0, 0.1), (2, 0.1, 0.2), (3, 0.2, 0.4), (4, 0.4, 0.6), (5, 0.6, 1.0)),
sl AS (SELECT g, n, stage, floor(low::DOUBLE * n) AS start, CASE WHEN stage = 5 THEN n ELSE least(n, greatest(floor(high::DOUBLE * n), floor(low::DOUBLE * n) + 1)) END AS stop FROM nn, bd),
sd AS (SELECT o.*, sl.stage FROM o JOIN sl ON sl.g = o.g AND o.step > sl.start AND o.step <= sl.stop)"""


@query(f"WITH {_STAGED} SELECT g AS graph_id, node, step, strategy, stage FROM sd")
def stages(spark, d):
    return orders.stages(static(types(spark, d)))


@query(f"""WITH {_STAGED}, rt AS (SELECT s.g, s.node, avg(CASE WHEN y.step > x.step THEN 1.0 ELSE 0.0 END) AS ratio FROM s JOIN o x ON x.g = s.g AND x.node = s.node JOIN o y ON y.g = s.g AND y.node = s.other GROUP BY s.g, s.node),
f AS (SELECT sd.strategy, sd.stage, d.degree::DOUBLE AS x, 'degree' AS feature FROM sd JOIN d ON d.g = sd.g AND d.node = sd.node UNION ALL SELECT sd.strategy, sd.stage, rt.ratio, 'ratio' FROM sd JOIN rt ON rt.g = sd.g AND rt.node = sd.node)
SELECT strategy, stage, feature, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM f GROUP BY strategy, stage, feature""")
def stage_summary(spark, d):
    e = types(spark, d)
    o = static(e)
    rows = orders.stages(o).join(graph.degree(e), ["graph_id", "node"]).join(orders.unvisited_ratio(graph.symmetric(e), o).drop("step"), ["graph_id", "node"])
    return rounded(orders.stage_summary(rows, ["degree", "ratio"]), "mean", "std")


# --- adaptive strategies

_SCORE = "CASE st WHEN 'degree' THEN al WHEN 'seed_unvisited' THEN al WHEN 'seed_fewest_visited' THEN al - (deg - al) / 100000.0::DOUBLE WHEN 'seed_sqrt' THEN al * sqrt(deg) ELSE al + ln(deg) END"
_ADAPTIVE = f"""{TYPES}, sts(st) AS (VALUES ('degree'), ('seed_unvisited'), ('seed_fewest_visited'), ('seed_sqrt'), ('seed_log')),
al(i, st, g, node, other, deg) AS (SELECT 0, st, d.g, d.node, x.other, d.degree FROM sts, d JOIN (SELECT g, node, other FROM s UNION ALL SELECT g, node, NULL FROM n) x ON x.g = d.g AND x.node = d.node
 UNION ALL SELECT i + 1, st, g, node, other, deg FROM (SELECT *, first_value(node) OVER (PARTITION BY st, g ORDER BY {_SCORE} DESC, node) AS v FROM (SELECT *, count(other) OVER (PARTITION BY st, g, node) AS al FROM al))
 WHERE node <> v AND (other IS NULL OR other <> v)),
po AS (SELECT i, st, g, node, any_value(deg) AS deg, count(other) AS al FROM al GROUP BY i, st, g, node),
ao AS (SELECT g, st AS strategy, node, i + 1 AS step FROM (SELECT *, row_number() OVER (PARTITION BY i, st, g ORDER BY {_SCORE} DESC, node) AS r FROM po) WHERE r = 1)"""
_CORE_FIRST = """, ce(i, g, node, other) AS (SELECT 0, g, node, other FROM s UNION ALL SELECT i + 1, g, node, other
 FROM (SELECT *, min(dn) OVER (PARTITION BY g) AS weak, first_value(node) OVER (PARTITION BY g ORDER BY dn DESC, node) AS v FROM (SELECT *, count(*) OVER (PARTITION BY g, node) AS dn, count(*) OVER (PARTITION BY g, other) AS dx FROM ce))
 WHERE CASE WHEN weak < 2 THEN dn >= 2 AND dx >= 2 ELSE node <> v AND other <> v END),
cp AS (SELECT i, g, node, count(*) AS dn FROM ce GROUP BY i, g, node), ck AS (SELECT *, min(dn) OVER (PARTITION BY i, g) AS weak, row_number() OVER (PARTITION BY i, g ORDER BY dn DESC, node) AS r FROM cp),
pk AS (SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY i) AS step FROM ck WHERE weak >= 2 AND r = 1),
lf AS (SELECT n.g, n.node, count(x.other) AS deg FROM n LEFT JOIN (SELECT s.* FROM s LEFT JOIN pk ON pk.g = s.g AND pk.node = s.other WHERE pk.node IS NULL) x ON x.g = n.g AND x.node = n.node WHERE (n.g, n.node) NOT IN (SELECT (g, node) FROM pk) GROUP BY n.g, n.node),
co AS (SELECT g, 'core' AS strategy, node, step FROM pk UNION ALL SELECT lf.g, 'core', lf.node, coalesce(pn, 0) + row_number() OVER (PARTITION BY lf.g ORDER BY deg DESC, lf.node) FROM lf LEFT JOIN (SELECT g, count(*) AS pn FROM pk GROUP BY g) q ON q.g = lf.g)"""


@query(f"WITH RECURSIVE {_ADAPTIVE}{_CORE_FIRST} SELECT g AS graph_id, strategy, node, step FROM ao UNION ALL SELECT g, strategy, node, step FROM co")
def adaptive_orders(spark, d):
    return orders.orders(types(spark, d), ["degree", "core", "seed_unvisited", "seed_fewest_visited", "seed_sqrt", "seed_log"])


_SCORED = f"WITH RECURSIVE {_ADAPTIVE}{_CORE_FIRST}, o AS (SELECT g, strategy, node, step FROM ao WHERE strategy = 'degree' UNION ALL SELECT g, strategy, node, step FROM co){STEPS}{METRICS}"


@query(f"{_SCORED} SELECT {_RECORD} FROM m")
def strategies_by_type(spark, d):
    e = types(spark, d)
    return rounded(orders.evaluate(e, orders.orders(e, ["degree", "core"])), "anc", "anc_prefix_k", "lcc_at_k")


@query(f"{_SCORED} SELECT strategy, round(avg(anc), 6) AS anc, round(stddev_pop(anc), 6) AS anc_std, round(avg(anc_prefix_k), 6) AS anc_prefix_k, round(avg(fht_50), 6) AS fht_50, round(avg(fht_10), 6) AS fht_10, round(avg(lcc_at_k), 6) AS lcc_at_k, arg_max(k, graph_id) AS k FROM m GROUP BY strategy")
def instance_summary(spark, d):
    e = types(spark, d)
    return rounded(orders.summary(orders.evaluate(e, orders.orders(e, ["degree", "core"]))), "anc", "anc_std", "anc_prefix_k", "fht_50", "fht_10", "lcc_at_k")


@query()
def strategies_other(spark, d):
    e = types(spark, d)
    return rounded(orders.evaluate(e, orders.orders(e, ["influence", "min_sum", "betweenness", "closeness", "pagerank", "belief"])), "anc", "anc_prefix_k", "lcc_at_k")


@query(f"""WITH {TYPES}, nb AS (SELECT s.g, s.node, avg(d.degree) AS near FROM s JOIN d ON d.g = s.g AND d.node = s.other GROUP BY s.g, s.node),
f AS (SELECT d.g, d.node, degree, near, min(degree) OVER w AS d0, max(degree) OVER w AS d1, min(near) OVER w AS n0, max(near) OVER w AS n1 FROM d JOIN nb ON nb.g = d.g AND nb.node = d.node WINDOW w AS (PARTITION BY d.g)),
sc AS (SELECT g, node, round(0.7::DOUBLE * CASE WHEN d1 - d0 < 1e-12 THEN 0 ELSE (degree - d0) / (d1 - d0)::DOUBLE END + -0.3::DOUBLE * CASE WHEN n1 - n0 < 1e-12 THEN 0 ELSE (near - n0) / (n1 - n0) END, 9) AS score FROM f)
SELECT g AS graph_id, node, row_number() OVER (PARTITION BY g ORDER BY score DESC, node) AS step FROM sc""")
def fused_order(spark, d):
    e = types(spark, d)
    deg = graph.degree(e)
    near = graph.symmetric(e).join(deg.toDF("graph_id", "other", "near"), ["graph_id", "other"]).groupBy("graph_id", "node").agg(F.avg("near").alias("near"))
    return orders.fused_order(deg.join(near, ["graph_id", "node"]), {"degree": 0.7, "near": -0.3})


@query(f"WITH {TYPES}, r AS (SELECT g AS graph_id, node, degree, row_number() OVER (PARTITION BY g ORDER BY degree, node) AS rank FROM d) SELECT * FROM r WHERE rank <= 5")
def best_k(spark, d):
    return orders.best_k(graph.degree(types(spark, d)), "degree", 5, "node")


@query(f"WITH {PART_SUPP}{RANK}, f AS (SELECT node, step FROM o WHERE step <= 20) SELECT n.g AS graph_id, n.node, row_number() OVER (ORDER BY f.step NULLS LAST, n.node) AS step FROM n LEFT JOIN f ON f.node = n.node")
def order_completion(spark, d):
    e = part_supp(spark, d)
    return search.completed(static(e).where("step <= 20"), graph.nodes(e))


_RULE = f"""{TYPES}, ru(i, g, node, other) AS (SELECT 0, g, node, other FROM (SELECT g, node, other FROM s UNION ALL SELECT g, node, NULL FROM n)
 UNION ALL SELECT i + 1, g, node, other FROM (SELECT *, first_value(node) OVER (PARTITION BY g ORDER BY al, node DESC) AS v FROM (SELECT *, count(other) OVER (PARTITION BY g, node) AS al FROM ru)) WHERE node <> v AND (other IS NULL OR other <> v))"""


@query(f"WITH RECURSIVE {_RULE}, pk AS (SELECT g, node, i + 1 AS step, row_number() OVER (PARTITION BY g, i ORDER BY count(other), node DESC) AS r FROM ru GROUP BY g, i, node) SELECT g AS graph_id, 'least' AS strategy, node, step FROM pk WHERE r = 1")
def order_by_rule(spark, d):
    return orders.by_rules(types(spark, d), {"least": lambda adj, left: min(left, key=lambda v: (len(adj[v]), -v))}, residual=True)


@query(f"WITH {TYPES}{RANK} SELECT g AS graph_id, 'broken' AS strategy, node, step FROM o")
def order_by_failing_rule(spark, d):
    return orders.by_rules(types(spark, d), {"broken": lambda adj, left: 1 // 0})


@query()
def random_tie_attacks(spark, d):
    return rounded(orders.attacks(types(spark, d), [1, 2]), "cost")


@query()
def cut_orders(spark, d):
    e = types(spark, d)
    return rounded(orders.evaluate(e, orders.orders(e, ["ratio_cut", "cut_reinsertion"])), "anc", "anc_prefix_k", "lcc_at_k")


@query()
def annealed_orders(spark, d):
    return rounded(search.best_of(search.searched(types(spark, d), "anneal", [1, 2, 3], steps=100)), "anc")


@query()
def bred_orders(spark, d):
    return rounded(search.best_of(search.searched(types(spark, d), "breed", [1, 2], generations=10)), "anc")


# --- perturbation and sampling


@query(f"WITH {PART_SUPP}, r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 42, src, dst)), src, dst) AS r, count(*) OVER () AS n FROM c) SELECT g AS graph_id, src, dst FROM r WHERE r > greatest(1, round(n * 0.2))")
def perturb_edges(spark, d):
    return perturb.drop_edges(part_supp(spark, d), 0.2, 42)


@query(f"WITH {PART_SUPP}, r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 43, node)), node) AS r, count(*) OVER () AS n FROM n), gone AS (SELECT node FROM r WHERE r <= greatest(1, round(n * 0.1))) SELECT g AS graph_id, src, dst FROM c WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)")
def perturb_nodes(spark, d):
    e = part_supp(spark, d)
    return graph.without_nodes(e, perturb.pick_nodes(graph.nodes(e), 0.1, 43))


@query(f"""WITH {TYPES}, ix AS (SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY node) AS i, count(*) OVER (PARTITION BY g) AS n FROM n), want AS (SELECT g, greatest(1, round(count(*) * 0.1))::BIGINT AS want FROM c GROUP BY g),
tr AS (SELECT want.g, want, unnest(range(1, 64 * want + 1)) AS try FROM want),
dr AS (SELECT tr.g, want, try, ('0x' || substr(md5(concat_ws('|', 44, 'l', tr.g, try)), 1, 12))::BIGINT % n + 1 AS l, ('0x' || substr(md5(concat_ws('|', 44, 'r', tr.g, try)), 1, 12))::BIGINT % n + 1 AS r FROM tr JOIN (SELECT DISTINCT g, n FROM ix) nn ON nn.g = tr.g),
pr AS (SELECT dr.g, least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst, min(try) AS try, any_value(want) AS want FROM dr JOIN ix a ON a.g = dr.g AND a.i = dr.l JOIN ix b ON b.g = dr.g AND b.i = dr.r WHERE l <> r GROUP BY ALL),
nw AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.g ORDER BY try) AS k FROM pr ANTI JOIN c ON c.g = pr.g AND c.src = pr.src AND c.dst = pr.dst) SELECT g AS graph_id, src, dst FROM nw WHERE k <= want""")
def noise_edges(spark, d):
    return perturb.noise_edges(types(spark, d), 0.1, 44)


_UNIFORM = "('0x' || substr(md5(concat_ws('|', {}, src, dst)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"WITH {PART_SUPP} SELECT g AS graph_id, src, dst, round(greatest(0.05, 1 + 0.3::DOUBLE * sqrt(-2 * ln(1 - {_UNIFORM.format(45)})) * cos(2 * pi() * {_UNIFORM.format(46)})), 6) AS weight FROM c")
def weight_jitter(spark, d):
    return rounded(perturb.jitter(part_supp(spark, d), 0.3, 45), "weight")


@query("SELECT kind, level::DOUBLE AS level, replicate, 7 + 1000 * (li + 1) + 100 * (ki + 1) + replicate - 1 AS seed FROM (VALUES ('node_delete', 0), ('edge_delete', 1), ('edge_add', 2)) k(kind, ki), (VALUES (0.01, 0), (0.05, 1), (0.2, 2)) l(level, li), (SELECT unnest(range(1, 6)) AS replicate)")
def condition_grid(spark, d):
    return perturb.conditions(spark, ["node_delete", "edge_delete", "edge_add"], [0.01, 0.05, 0.2], 5, 7)


_CHANGED = """r AS (SELECT l_returnflag AS dataset, CASE WHEN l_linenumber = 1 THEN 'clean' ELSE 'k' || l_linestatus END AS kind, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber // 3 END::DOUBLE AS level, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END::BIGINT AS replicate, avg(l_discount) AS anc FROM lineitem GROUP BY ALL),
ch AS (SELECT r.*, anc - base AS delta, CASE WHEN base > 0 THEN 100 * (anc - base) / base ELSE 0 END AS delta_percent FROM r JOIN (SELECT dataset, any_value(anc) AS base FROM r WHERE kind = 'clean' GROUP BY dataset) b ON b.dataset = r.dataset)"""


def _records(spark, d):
    li, first = read(spark, d, "lineitem"), F.col("l_linenumber") == 1
    kind = F.when(first, "clean").otherwise(F.concat(F.lit("k"), "l_linestatus"))
    level = F.when(first, 0).otherwise(F.floor(F.col("l_linenumber") / 3)).cast("double")
    return li.groupBy(F.col("l_returnflag").alias("dataset"), kind.alias("kind"), level.alias("level"), F.when(first, 0).otherwise(F.col("l_linenumber")).cast("long").alias("replicate")).agg(F.avg("l_discount").alias("anc"))


@query(f"WITH {_CHANGED} SELECT dataset, kind, level, replicate, round(anc, 6) AS anc, round(delta, 6) AS delta, round(delta_percent, 4) AS delta_percent FROM ch")
def change_to_clean(spark, d):
    return rounded(rounded(perturb.changes(_records(spark, d)), "anc", "delta"), "delta_percent", places=4)


@query(f"WITH {_CHANGED} SELECT dataset, kind, level, round(avg(anc), 6) AS anc, round(avg(delta_percent), 4) AS delta_percent FROM ch GROUP BY dataset, kind, level")
def means_by_level(spark, d):
    return rounded(rounded(perturb.by_level(perturb.changes(_records(spark, d))), "anc"), "delta_percent", places=4)


@query()
def robustness_sweep(spark, d):
    return perturb.sweep(types(spark, d), ["node_delete", "edge_delete", "edge_add"], [0.05, 0.2], 2)


_TOP = f"{TYPES}, rk AS (SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY degree DESC, node) AS r FROM d), tp AS (SELECT g, node FROM rk WHERE r <= 30), ic AS (SELECT c.* FROM c JOIN tp a ON a.g = c.g AND a.node = c.src JOIN tp b ON b.g = c.g AND b.node = c.dst)"


@query(f"WITH {_TOP} SELECT g AS graph_id, src, dst FROM ic")
def sample_degree(spark, d):
    e = types(spark, d)
    return graph.induced(e, perturb.top_degree(graph.degree(e), 30))


@query(f"WITH RECURSIVE {_CORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY core DESC, ('0x' || substr(md5(concat_ws('|', 47, node)), 1, 12))::BIGINT, node) AS r FROM cores) SELECT g AS graph_id, node, core FROM rk WHERE r <= 30")
def sample_core(spark, d):
    return perturb.top_core(graph.core_numbers(types(spark, d)), 30, 47)


@query()
def samples(spark, d):
    return samplers.sample(types(spark, d), [*samplers.SAMPLERS, "by_community"], 40)


@query(f"""WITH RECURSIVE {_TOP}, si AS (SELECT g, src AS node, dst AS other FROM ic UNION ALL SELECT g, dst, src FROM ic), dg AS (SELECT tp.g, tp.node, count(si.other) AS k FROM tp LEFT JOIN si ON si.g = tp.g AND si.node = tp.node GROUP BY tp.g, tp.node),
wi(g, a, x, l) AS (SELECT g, node, node, 0 FROM tp UNION SELECT wi.g, wi.a, si.other, l + 1 FROM wi JOIN si ON si.g = wi.g AND si.node = wi.x WHERE l < 30), yi AS (SELECT g, a, x, min(l) AS l FROM wi GROUP BY g, a, x),
ap AS (SELECT g, avg(CASE WHEN a <> x THEN l END) AS apl, count(*) = 900 AS connected FROM yi GROUP BY g)
SELECT dg.g AS graph_id, 'degree' AS sampler, count(*) AS n_nodes, (sum(k) // 2)::BIGINT AS n_edges, max(k) AS max_degree, round(avg(k), 6) AS mean_degree, 0.0::DOUBLE AS clustering, any_value(connected) AS connected, CASE WHEN any_value(connected) THEN round(any_value(apl), 6) END AS avg_path FROM dg JOIN ap ON ap.g = dg.g GROUP BY dg.g""")
def sample_quality(spark, d):
    e = types(spark, d)
    picked = perturb.top_degree(graph.degree(e), 30).select("graph_id", F.lit("degree").alias("sampler"), "node")
    return rounded(samplers.quality(e, picked), "mean_degree", "avg_path")


@query()
def samples_quality(spark, d):
    e = types(spark, d)
    return rounded(samplers.quality(e, samplers.sample(e, [*samplers.SAMPLERS, "by_community"], 40)), "mean_degree", "clustering", "avg_path")


# --- communities, cuts


@query(f"""WITH {PLACES}, ma AS (SELECT s.g, s.node, CASE WHEN s.node % 4 = 1 THEN s.node ELSE min(s.other) END AS community FROM s GROUP BY s.g, s.node),
xe AS (SELECT c.g, a.community AS x, b.community AS y FROM c JOIN ma a ON a.node = c.src JOIN ma b ON b.node = c.dst), xm AS (SELECT count(*) AS m FROM xe),
xt AS (SELECT g, community, sum(tot) AS tot, sum(half) / 2 AS inside FROM (SELECT g, x AS community, 1 AS tot, (x = y)::INT AS half FROM xe UNION ALL SELECT g, y, 1, (x = y)::INT FROM xe) GROUP BY g, community)
SELECT g AS graph_id, count(*) AS n_communities, round(sum(inside / m - (tot / (2.0::DOUBLE * m)) * (tot / (2.0::DOUBLE * m))), 6) AS modularity FROM xt, xm GROUP BY g""")
def modularity_by_nation(spark, d):
    e = places(spark, d)
    own = graph.symmetric(e).groupBy("graph_id", "node").agg(F.min("other").alias("least"))
    parts = own.select("graph_id", "node", F.when(F.col("node") % 4 == 1, F.col("node")).otherwise(F.col("least")).alias("community"))
    return rounded(communities.modularity(e, parts), "modularity")


@query()
def communities_of_places(spark, d):
    e = places(spark, d)
    return communities.louvain(e)


@query()
def bisection_of_chain(spark, d):
    return partition.bisection(chain(spark, d))


#: Rounds that take the edges whose draw is the smallest at both ends, among the edges of the chain whose ends are of different parity.
_MATCHED = f"""{CHAIN}, mt(i, g, node, other, rk) AS (SELECT 0, g, node, other, md5(concat_ws('|', 48, least(node, other), greatest(node, other))) FROM s WHERE node % 2 <> other % 2
 UNION ALL SELECT i + 1, g, node, other, rk FROM (SELECT *, max(hit) OVER (PARTITION BY g, node) AS cn, max(hit) OVER (PARTITION BY g, other) AS co
 FROM (SELECT *, (rk = min(rk) OVER (PARTITION BY g, node) AND rk = min(rk) OVER (PARTITION BY g, other))::INT AS hit FROM mt)) WHERE cn = 0 AND co = 0),
hits AS (SELECT g, node, other FROM (SELECT *, min(rk) OVER (PARTITION BY i, g, node) AS r1, min(rk) OVER (PARTITION BY i, g, other) AS r2 FROM mt) WHERE rk = r1 AND rk = r2)"""


def _parity(spark, d):
    e = chain(spark, d)
    return e, graph.nodes(e).select("graph_id", "node", (F.col("node") % 2).alias("side"))


@query(f"WITH RECURSIVE {_MATCHED} SELECT g AS graph_id, node FROM hits")
def cut_cover(spark, d):
    return partition.cut_cover(*_parity(spark, d), 48)


@query(f"WITH RECURSIVE {_MATCHED} SELECT g AS graph_id, node AS u, other AS v FROM hits WHERE node < other")
def cut_matching(spark, d):
    e, _ = _parity(spark, d)
    cut = e.where("src % 2 <> dst % 2").select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    return partition.matching(cut.withColumn("rank", perturb.draw(48, "u", "v")))
