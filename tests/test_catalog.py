import glob
import os

import duckdb
import pytest

from fractura import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, DATA)
    rows, cols = got.collect(), sorted(got.columns)
    if name not in plans.SQL:
        assert cols
        return
    want = db.sql(plans.SQL[name])
    names = list(want.columns)
    assert sorted(names) == cols
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(r[c] for c in cols) for r in rows), key=key)
    b = sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=key)
    assert a == b


def test_edge_list_and_gml(spark, tmp_path):
    from fractura.sources import graphs

    (tmp_path / "a.txt").write_text("1 2\n2 1 x\n\n3\n2 3\n4 4\n")
    assert sorted(map(tuple, graphs.edge_list(spark, str(tmp_path / "a.txt")).collect())) == [("g", 1, 2), ("g", 2, 3)]
    (tmp_path / "g_0").write_text('graph [\n node [\n id 7\n label "a"\n ]\n node [\n id 5\n ]\n edge [\n source 7\n target 5\n ]\n]')
    nodes, edges = graphs.gml(spark, str(tmp_path / "g_0"))
    assert sorted((r.id, r.node) for r in nodes.collect()) == [(5, 1), (7, 0)]
    assert [(r.src, r.dst) for r in edges.collect()] == [(0, 1)]


def test_stream_equals_batch(spark, tmp_path):
    from fractura.streaming.trace import windowed_stats

    events = spark.read.parquet(f"{DATA}/events.parquet")
    os.makedirs(tmp_path / "in")
    os.symlink(f"{DATA}/events.parquet", tmp_path / "in/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_stats(stream).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("stats").collect())) == sorted(map(str, windowed_stats(events).collect()))
