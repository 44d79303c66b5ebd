import itertools
import random

import pytest

from fractura.operators import candidates, sparse


def _docs(spark, n=60):
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400))}"
    rows = []
    for i in range(n):
        views = [" ".join(word() for _ in range(rng.randrange(12, 30))) for _ in range(3)]
        if i % 3 == 1:  # near copies of the row before, some without a view
            views = [v if rng.random() < 0.7 else v.rsplit(" ", 4)[0] for v in rows[-1][1:]]
            views[rng.randrange(3)] = "" if i % 2 else "only here"
        rows.append((i, *views))
    return spark.createDataFrame(rows, "id long, description string, reflection string, code string")


@pytest.mark.parametrize("tile", [7, 4_096])
def test_products_of_tiles_lose_no_pair(spark, tile, monkeypatch):
    monkeypatch.setattr(sparse, "HASH", 0)  # all tokens of one number of rows share a hash, and are told apart
    weights = candidates.vectors(_docs(spark))
    rows = weights.collect()
    known = {}
    for r in rows:
        known.setdefault(r.id, {})[r.view, r.token] = r.w
    every = {(a, b): sum(w * known[b].get(t, 0) for t, w in known[a].items()) for a, b in itertools.combinations(sorted(known), 2)}
    for least in (0.3, 1.74):
        got = {(r.a, r.b): r.dot for r in sparse.products(weights, least, candidates.VIEWS, tile).collect()}
        assert got == {p: pytest.approx(x) for p, x in every.items() if x >= least}
        assert got


def test_only_near_pairs_are_shuffled(spark):
    """Candidates that share common tokens met their whole vectors in a join of rows before: more rows than pairs times tokens."""
    weights = candidates.vectors(_docs(spark))
    plan = candidates.near_pairs(weights)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert candidates.near_pairs(weights).count() < 60


def test_no_vectors(spark):
    none = spark.createDataFrame([], "view string, id long, token string, w double")
    assert candidates.near_pairs(none).count() == 0
