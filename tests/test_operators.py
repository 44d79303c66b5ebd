import collections
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from fractura.operators import candidates, control, graph, orders, perturb, reports, samplers, text
from fractura.operators import kernels as K
from fractura.sources import graphs, records

RING = [("r", k, (k + 1) % 12) for k in range(12)]
EDGES = "graph_id string, src long, dst long"


def adj(edges):
    return K.adjacency(*zip(*edges, strict=True))


def ring(spark):
    return graph.canonical(spark.createDataFrame(RING, EDGES))


# --- own strategies


def test_rules_and_their_fallbacks():
    a = adj([(0, 1), (1, 2), (2, 3), (3, 4)])
    assert K.by_rule(a, lambda g, left: left[-1]) == [4, 3, 2, 1, 0]
    assert K.by_rule(a, lambda g, left: 1 // 0) == [1, 2, 3, 0, 4]
    with pytest.raises(ValueError):
        K.by_rule(a, lambda g, left: 0)
    assert K.by_rule(a, lambda g, left: 0, robust=True) == [0, 1, 2, 3, 4]
    assert K.by_rule(a, lambda g, left: 99, residual=True) == [0, 1, 2, 3, 4]
    seen = []
    K.by_rule(a, lambda g, left: seen.append(len(g)) or left[0], residual=True)
    assert seen == [5, 4, 3, 2, 1]


def test_random_ties_are_permutations_of_equal_cost():
    a = adj([(k, (k + 1) % 6) for k in range(6)])
    found = [K.by_random_ties(a, K.degree_of, s) for s in range(5)]
    assert all(sorted(f) == sorted(a) for f in found) and len(set(map(tuple, found))) > 1


def test_weighted_eigenvector_falls_back_to_a_dense_solver():
    edges = [(0, 1), (1, 2), (0, 2), (2, 3)]
    w = {(0, 1): 2.0, (1, 2): 1.0, (0, 2): 1.0, (2, 3): 0.5}
    one, two = K.weighted_eigenvector_of(adj(edges), w), K.weighted_eigenvector_of(adj(edges), w, rounds=1)
    assert one == pytest.approx(two, abs=1e-4)


def test_prefix_of_an_order(spark):
    o = spark.createDataFrame([("r", "s", 0, 1), ("r", "s", 6, 2)], "graph_id string, strategy string, node long, step long")
    assert [tuple(r) for r in orders.prefix_anc(ring(spark), o).collect()] == [("r", "s", 2, pytest.approx((55 + 20) / 2 / 66))]


# --- perturbations and samples


def test_noise_edges_are_new_and_as_many_as_asked(spark):
    e = ring(spark)
    for share in (0.01, 0.5, 2.0):
        got = perturb.noise_edges(e, share, 3).collect()
        assert len(set(got)) == len(got) == max(1, round(12 * share)) and all(r.src < r.dst for r in got)
        assert not {(r.src, r.dst) for r in got} & {(r.src, r.dst) for r in e.collect()}
    whole = perturb.noise_edges(e, 100.0, 3).collect()
    assert len(whole) <= 12 * 11 / 2 - 12


@pytest.mark.parametrize("n", [1, 7, 500])
def test_shares_in_parts_equal_a_sort(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("graph_id"), F.col("id").alias("node"))
    got = sorted(r.node for r in perturb.first_share(rows, 0.3, 5, "node").collect())
    want = [r.node for r in rows.orderBy(perturb.draw(5, "node"), "node").limit(max(1, round(n * 0.3))).collect()]
    assert got == sorted(want)


def test_repair_keeps_or_joins_parts(spark):
    graphs = {"path": [(k, k + 1) for k in range(20)], "apart": [(0, 1), (1, 2), (5, 6), (8, 9), (9, 10)], "square": [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (4, 5)]}
    e = spark.createDataFrame([(g, *x) for g, some in graphs.items() for x in some], "graph_id string, src long, dst long")
    cases = [("path", "a", [0, 1, 2, 3, 9], [0, 1, 2, 3]), ("path", "b", [0, 1, 5, 10, 15, 20], list(range(21))), ("path", "c", [3, 4], [3, 4]), ("apart", "a", [0, 2, 5, 8, 10], [0, 1, 2]), ("square", "a", [0, 2, 5, 7], [0, 1, 2, 3, 4, 5])]
    picked = spark.createDataFrame([(g, s, v) for g, s, some, _ in cases for v in some], "graph_id string, sampler string, node long")
    got = collections.defaultdict(list)
    for r in samplers.repaired(e, picked).collect():
        got[r.graph_id, r.sampler].append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == {(g, s): want for g, s, _, want in cases}


def test_core_sample_takes_the_core_first():
    a = adj([*itertools.combinations(range(4), 2), (3, 4), (4, 5)])
    assert sorted(samplers.by_core(a, 4, random.Random(1))) == [0, 1, 2, 3]


def test_sweep_has_each_condition_and_its_change(spark):
    rows = perturb.sweep(ring(spark), ["node_delete", "edge_add"], [0.1, 0.3], 2).collect()
    assert len(rows) == 1 + 2 * 2 * 2
    clean = next(r for r in rows if r.kind == "clean")
    assert clean.delta == 0 and all(r.delta == pytest.approx(r.anc - clean.anc) and r.delta_percent == pytest.approx(100 * r.delta / clean.anc) for r in rows)


# --- control


def test_rewards_by_hand(spark):
    rows = [(1, "e1", 4, 3, 2, 8.0, 10.0, 4.0), (1, "m1", 0, 0, 0, None, 8.0, 0.0), (2, "e1", 1, 0, 0, None, 8.0, 3.0)]
    stats = spark.createDataFrame(rows, "generation long, operator string, offspring long, valid long, accepted long, best double, best_before double, time_total double")
    got = {(r.generation, r.operator): r.reward for r in control.rewards(stats).collect()}
    assert got[1, "e1"] == pytest.approx(1.6 * 0.2 + 0.5 * 0.5 + 0.2 * 0.75 - 0.3 * 0.25 - 0.15 * 0.5)
    assert got[1, "m1"] == 0 and got[2, "e1"] == pytest.approx(-0.3 - 0.15 * 0.75)


def test_a_phase_is_held(spark):
    rows = [(1, 1.0, 0.5, 0.2), (2, 0.5, 1.0, 0.2), (3, 0.5, 1.0, 0.2), (4, 0.95, 1.0, 0.97), (5, 1.2, 1.0, 0.0)]
    scores = spark.createDataFrame(rows, "generation long, explore double, transition double, exploit double")
    got = [r.phase for r in control.held_phase(scores).orderBy("generation").collect()]
    assert got == ["explore", "explore", "transition", "transition", "explore"]


def test_errors_of_candidates_are_kept(spark):
    rows = control.evaluated(spark.createDataFrame([(0,), (3,)], "x long"), lambda r: 1 / r["x"], "x long").collect()
    assert {(r.x, r.objective, r.error) for r in rows} == {(0, None, "ZeroDivisionError: division by zero"), (3, 0.33333, None)}


# --- texts and reports


def test_tokens_by_hand(spark):
    row = spark.createDataFrame([("def best_of_Nodes(x1): 2.5 _a",)], "t string").select(text.words(F.col("t")).alias("plain"), text.words(F.col("t"), True).alias("code")).first()
    plain = ["def", "best_of_nodes", "x1", "2.5", "_a", "best", "of", "nodes", "a"]
    assert sorted(row.plain) == sorted(plain) and sorted(row.code) == sorted([*plain, "best_o"])


def test_candidates_of_cosines_lose_no_pair(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, weights=range(30, 0, -1), k=12))) for k in range(60)], "doc_id long, text string")
    w = text.tfidf(docs)
    every = w.toDF("a", "token", "wa").join(w.toDF("b", "token", "wb"), "token").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    for least in (0.3, 0.6):
        want = {(r.a, r.b) for r in every.where(F.col("cosine") >= least).collect()}
        assert {(r.a, r.b) for r in text.cosines(w, least).collect()} == want


def test_answers_fall_back(spark):
    rows = ["{one} x {two}```python\na = 1\n```", "text  ##\ndef f(x):\n  return 1", "no code", "import os\nreturn 3\nrest"]
    got = spark.createDataFrame([(r,) for r in rows], "r string").select(candidates.description(F.col("r")), candidates.code(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("two", "a = 1"), ("text", "def f(x):\n  return 1"), ("no code", None), ("import os\nreturn 3\nrest", "import os\nreturn 3")]


def test_default_tag_and_no_description(spark):
    rows = spark.createDataFrame([(1, "a bridge", "degree"), (2, "", "degree core"), (3, None, None)], "id long, description string, code string")
    got = {(r.id, r.tag): r.weight for r in candidates.tag_weights(rows).collect() if r.weight}
    assert got == {(1, "Bridge / Boundary"): pytest.approx(2 / 2.6), (1, "Core / Degree"): pytest.approx(0.6 / 2.6), (2, "Core / Degree"): 1.0, (3, candidates.DEFAULT_TAG): 1.0}


def test_mean_of_known_skips_texts(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", None), ("a", "3"), ("b", "nan")], "k string, v string")
    assert {r.k: r["mean"] for r in reports.mean_of_known(rows, "k", "v").collect()} == {"a": 2.0, "b": None}


# --- sources


def test_gml_weights_names_and_instances(spark, tmp_path):
    (tmp_path / "g_0").write_text('graph [\n node [\n id 7\n label "a"\n weight 1.5\n ]\n node [\n id 5\n label "b"\n ]\n edge [\n source 7\n target 5\n weight 2e1\n ]\n]')
    nodes, edges = graphs.gml(spark, str(tmp_path / "g_0"))
    assert {(r.node, r.label, r.weight) for r in nodes.collect()} == {(0, "a", 1.5), (1, "b", None)}
    assert [(r.src, r.dst, r.weight) for r in edges.collect()] == [(0, 1, 20.0)]
    assert [graphs.synthetic_folder(n) for n in ("synthetic_ws_100-200", "synthetic_uniform_1000", "synthetic_a_b_07")] == [("ws", "100-200"), ("uniform_cost", "1000"), ("a_b", "7")]
    with pytest.raises(ValueError):
        graphs.synthetic_folder("synthetic_ws")
    paths = spark.createDataFrame([("/x/g_10",), ("/x/g_2",), ("/x/g_2_b",), ("/x/g_z",), ("/x/h_1",)], "path string")
    assert [r.path for r in graphs.instances(paths).orderBy("instance").collect()] == ["/x/g_2", "/x/g_2_b", "/x/g_10", "/x/g_z"]
    assert [r.path for r in graphs.instances(paths, most=1, once=True).collect()] == ["/x/g_2"]


def test_relabel_and_edge_list_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("g", 30, 10), ("g", 20, 10)], EDGES)
    small = graphs.relabel(graph.canonical(e), graph.nodes(e))
    assert {(r.src, r.dst) for r in small.collect()} == {(0, 1), (0, 2)}
    graphs.write_edge_list(small, str(tmp_path / "e"))
    assert {(r.src, r.dst) for r in graphs.edge_list(spark, str(tmp_path / "e")).collect()} == {(0, 1), (0, 2)}


def test_populations_and_reflections(spark, tmp_path):
    c = lambda uid, obj: {"algorithm": "a", "code": f"c{uid}", "objective": obj, "unique_id": uid, "other_inf": {"operator": "e1", "parent": ["x"]}}
    (tmp_path / "population_generation_1.json").write_text(json.dumps([c("u1", 0.5), c("u2", None), c("u3", 0.25)]))
    (tmp_path / "population_generation_2.json").write_text(json.dumps(c("u4", 0.125)))
    rows = records.populations(spark, str(tmp_path))
    assert {(r.generation, r["index"], r.unique_id, r.objective, r.other_inf.operator) for r in rows.collect()} == {(1, 1, "u1", 0.5, "e1"), (1, 2, "u2", None, "e1"), (1, 3, "u3", 0.25, "e1"), (2, 1, "u4", 0.125, "e1")}
    assert {r.unique_id for r in records.best_of_each(rows).collect()} == {"u3", "u4"} and records.resumed(rows, 2).count() == 1
    steps = candidates.trace(rows.withColumnRenamed("unique_id", "id")).collect()
    assert [(r.id, r.step) for r in sorted(steps, key=lambda r: r.step)] == [("u1", 1), ("u3", 2), ("u4", 3)]
    records.write_json(rows, str(tmp_path / "out"), "generation")
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "generation_1.json").write_text(json.dumps([{"offspring_unique_id": "u1", "llm_reflection": "old"}, {"offspring_unique_id": ""}]))
    (folder / "generation_2.json").write_text(json.dumps([{"offspring_unique_id": "u1", "llm_reflection": "new"}]))
    assert [(r.offspring_unique_id, r.llm_reflection) for r in records.reflections(spark, str(folder)).collect()] == [("u1", "new")]


def test_payloads_seeds_and_latest(spark):
    rows = [(1, '[{"objective": 2, "code": "a"}, {"objective": 1, "code": "b"}]'), (2, '{"code": "c"}'), (3, '{"llm_raw_response": "x ```python\\n d \\n``` y"}'), (4, '[{"code": "e"}, {"code": "f"}]')]
    frame = lambda r: spark.createDataFrame(r, "id long, payload string")
    assert {r.id: r.code for r in records.code_of(frame(rows)).collect()} == {1: "b", 2: "c", 3: "d", 4: "f"}
    with pytest.raises(Exception, match="no code in payload 9"):
        records.code_of(frame([(9, "{}")])).collect()
    listed = spark.createDataFrame([(1, "a", None), (2, None, "f")], "id long, code string, source string")
    files = spark.createDataFrame([("f", "b")], "source string, code string")
    assert {r.id: r.code for r in records.seeds(listed, files).collect()} == {1: "a", 2: "b"}
    with pytest.raises(Exception, match="seed without code: 2"):
        records.seeds(listed, files.limit(0)).collect()
    paths = spark.createDataFrame([("p_generation_9.json",), ("p_generation_10.json",), ("x.json",)], "path string")
    assert [tuple(r) for r in records.latest(paths).collect()] == [("p_generation_10.json", 10)]
    out = spark.createDataFrame([("d", "s", 0.5, None), ("e", "s", None, "boom")], "dataset string, strategy string, objective double, error string")
    got = {r.dataset: json.loads(r.payload) for r in records.results(out).collect()}
    assert got["d"]["objective"] == 0.5 and got["d"]["status"] == "success" and got["e"] == {"strategy": "s", "dataset": "e", "status": "failed", "error": "boom"}


def test_csv_and_cache(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('﻿"name","x"\n"a","1.5"\nb,-\nc,\n'.encode())
    assert [tuple(r) for r in records.csv(spark, str(tmp_path / "t.csv"), "name string, x double").collect()] == [("a", 1.5), ("b", None), ("c", None)]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for signature in ({"version": "1"}, {"version": "1"}, {"version": "2"}):
        assert records.cached(spark, str(tmp_path / "cache"), signature, make).count() == 3
    assert len(made) == 2
