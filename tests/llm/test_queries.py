import glob
import os

import corpus_pipeline
import duckdb
import pytest
from fractura.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, DATA), db.sql(queries.SQL[name])
    cols, names = sorted(got.columns), list(want.columns)
    assert cols == sorted(names)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=key)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.keep(stage(spark, before, DATA), "stage")
        if k < 4:
            assert after.columns == docs.columns and after.count() <= before.count()
            before = after
    left = {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == left and len(left) > 100
    assert corpus_pipeline.STAGES[2][1](spark, before.limit(0), DATA).count() == 0


def test_stages_on_strange_rows(spark):
    """Copies, rows without or with repeated ids, a long text in no language."""
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    some = base.where("doc_id < 60 and n_chars between 300 and 3000").collect()
    one = max(some, key=lambda r: len(r.text))
    row = lambda d, t: (d, t, "en", "s", len(t))
    far = "".join(chr(0x4E00 + k * 37 % 20000) for k in range(400))
    rows = [tuple(r) for r in some] + [row(5001, one.text), row(5002, one.text + " tail"), row(None, one.text), row(5003, far), row(5004, "first text here"), row(5004, "another text there"), row(5005, "12 34 !!")]
    docs = spark.createDataFrame(rows, base.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = [(r.doc_id, r.text) for r in stages["language ID"](spark, docs, DATA).collect()]
    assert len(kept) == len(rows) - 2 and not {5003, 5005} & {d for d, _ in kept}
    left = [(r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, docs, DATA).collect()]
    ids = [d for d, _ in left]
    assert ids.count(None) == 1 and not {5001, 5002} & set(ids) and ids.count(5004) == 1 and (5004, "another text there") in left
    texts = {r.doc_id: r.text for r in stages["suffix-array dedup"](spark, spark.createDataFrame([row(1, "x" * 10 + one.text), row(2, "y" * 10 + one.text), row(None, one.text)], base.schema), DATA).collect()}
    assert texts[1] == "x" * 10 + one.text and texts[2] == "y" * 10 and texts[None] == one.text


def test_folds_and_query_sets(spark):
    import zlib

    rest = lambda d, n: zlib.crc32(str(d).encode()) % n
    five = queries.QUERIES["op5_language_id"](spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(five) == len(lang) and all(r.held_out == (rest(r.doc_id, 3) == 1) for r in five)
    held = [r for r in five if r.held_out and lang[r.doc_id] is not None]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    seven = queries.QUERIES["op7_toxicity"](spark, DATA).collect()
    assert len(seven) == len(lang) and all(r.held_out == (rest(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in seven)
    three = queries.QUERIES["op3_vantage_point_search"](spark, DATA).collect()
    asked = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r.query_id for r in three} <= asked and all(r.vec_id != r.query_id and 1 <= r["rank"] <= 20 for r in three)


def test_queries_on_strange_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, null, empty and very long texts, columns named like results."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{DATA}/documents.parquet")
    row = base.where("doc_id = 5").collect()[0]
    make = lambda d, t: (d, t, row.lang, row.source, len(t or ""))
    odd = [tuple(row), make(None, row.text), make(None, row.text), make(5, "other words here"), make(90001, None), make(90002, ""), make(90003, (row.text + " ") * 400)]
    named = {c: F.lit(9) for c in ("score", "predicted", "held_out", "lang_pred", "piece", "length", "n_tokens")}
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns(named)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    n = docs.count()
    for name in ("op5_language_id", "op7_toxicity"):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        none = [r for r in got if r.doc_id is None]
        assert len(got) == n and len(none) == 2 and all(r.held_out is None for r in none)
        alike = [r.score for r in got if r.doc_id is None or r.doc_id == 5]
        assert all(0 <= r.score <= 1 for r in got) and sum(s == pytest.approx(none[0].score, abs=1e-5) for s in alike) >= 4
        by_id = {r.doc_id: r for r in got}
        assert {90001, 90002, 90003} <= set(by_id) and by_id[90001].score == pytest.approx(by_id[90002].score, abs=1e-5)
    hist = queries.QUERIES["op2_token_counts"](spark, str(tmp_path))
    assert hist.columns and hist.count() > 1
    pieces = queries.QUERIES["op8_best_fit_packing"](spark, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in pieces) == n
    assert [(r.piece, r.length) for r in pieces if r.doc_id in (90001, 90002)] == [(0, 1)] * 2
    rows = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    at = {}
    for seq, offset, length in rows:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length
    assert max(at.values()) <= 1024
