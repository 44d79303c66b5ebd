"""Pairs of sparse vectors with a large inner product, tile against tile.

Rows are dealt into parts, and each two parts, or one with itself, meet in one task, so that each pair of rows meets once. What is shuffled
are vectors, as often as there are parts, never pairs; a task holds two parts and as many sums at once as ``SUMS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fractura.session import stored

#: Rows of a part, about; sums and products that a task holds at once.
TILE, SUMS = 4_096, 4_000_000
#: Bits of a key below the number of rows a token is in: of a hash, of a number that tells tokens of one hash apart, and of the view.
HASH, RANK, VIEW = 26, 10, 2
LOW = HASH + RANK + VIEW
#: Rounding lowers a sum by less than this.
SLACK = 1e-9


def packed(weights: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """(id, keys, ws) from (view, id, token, w): keys are in the order of the numbers of rows that tokens are in, one a token of a view. Tokens
    of a single row meet nothing and go."""
    df = weights.groupBy("view", "token").agg(F.count("*").alias("df")).where("df > 1")
    view = sum((F.when(F.col("view") == v, k).otherwise(0) for k, v in enumerate(views)), F.lit(0)).cast("long")
    df = df.withColumn("hash", F.xxhash64("token").bitwiseAND(F.lit((1 << HASH) - 1)))
    rank = F.row_number().over(Window.partitionBy("df", "hash", "view").orderBy("token")) - 1
    alone = F.when(rank < 1 << RANK, rank.cast("long")).otherwise(F.raise_error(F.lit("too many tokens of one hash")).cast("long"))
    key = F.shiftleft("df", LOW).bitwiseOR(F.shiftleft("hash", RANK + VIEW)).bitwiseOR(F.shiftleft(alone, VIEW)).bitwiseOR(view)
    keys = df.select("view", "token", key.alias("k"))
    each = weights.join(keys, ["view", "token"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("x"))
    return each.select("id", F.col("x.k").alias("keys"), F.col("x.w").alias("ws"))


class Part:
    """The vectors of one part."""

    def __init__(self, rows: pa.Table):
        keys, ws = (rows.column(c).combine_chunks() for c in ("keys", "ws"))
        self.id = rows.column("id").to_numpy()
        self.size = np.diff(keys.offsets.to_numpy())
        self.key, self.w = keys.flatten().to_numpy(), ws.flatten().to_numpy()
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.first = np.cumsum(self.size) - self.size

    def level(self, least: float, most: float) -> float:
        """How frequent tokens may be so that most rows have too little behind them to reach ``least`` with any row of squared norm ``most``."""
        square = np.cumsum(self.w**2)
        total = np.bincount(self.row, self.w**2, len(self.size))
        behind = np.repeat(np.cumsum(total), self.size) - square
        cut = np.zeros(len(self.size), np.int64)
        np.maximum.at(cut, self.row, np.where(behind + self.w**2 >= least * least / most, self.key >> LOW, 0))
        return float(np.quantile(cut, 0.95)) if len(cut) else 0.0

    def behind(self, level: float, views: int) -> np.ndarray:
        """(rows, views): the norms of what is more frequent than ``level``."""
        far = (self.key >> LOW) > level
        at = self.row[far] * views + (self.key[far] & ((1 << VIEW) - 1))
        return np.sqrt(np.bincount(at, self.w[far] ** 2, len(self.size) * views)).reshape(-1, views)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def pairs(x: Part, y: Part, least: float, views: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(a, bs, products): rows of x with the rows of y whose product with it is ``least``. Sums over rare tokens and a bound on the rest tell
    which pairs are summed up whole."""
    level = max(x.level(least, views), y.level(least, views))
    fx, fy = x.behind(level, views), y.behind(level, views)
    rare = np.flatnonzero((y.key >> LOW) <= level)
    rare = rare[np.argsort(y.key[rare], kind="stable")]
    known, start, count = np.unique(y.key[rare], return_index=True, return_counts=True)
    row_y, w_y = y.row[rare], y.w[rare]
    own, at = _met(x.key, known, np.flatnonzero((x.key >> LOW) <= level))
    work = np.bincount(x.row[own], count[at], len(x.size)) + len(y.size)
    group = (np.cumsum(work) // SUMS).astype(np.int64)
    edges = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)] if len(group) else [0]
    entry = np.searchsorted(x.row[own], np.arange(len(x.size) + 1))
    every, place = np.unique(y.key, return_inverse=True)
    shared, spot = _met(x.key, every, np.arange(len(x.key)))
    first = np.searchsorted(x.row[shared], np.arange(len(x.size) + 1))
    mark = np.zeros(len(every))
    for a0, a1 in zip(edges[:-1], edges[1:], strict=True):
        e = slice(entry[a0], entry[a1])
        n = count[at[e]]
        to = _spread(start[at[e]], n)
        sums = np.bincount((np.repeat(x.row[own[e]], n) - a0) * len(y.size) + row_y[to], np.repeat(x.w[own[e]], n) * w_y[to], (a1 - a0) * len(y.size)).reshape(a1 - a0, -1)
        a, b = np.nonzero(sums + fx[a0:a1] @ fy.T >= least - SLACK)
        if x is y:
            a, b = a[b > a + a0], b[b > a + a0]
        cuts = [*np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), len(a)] if len(a) else []
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(a[c]) + a0
            mine = slice(first[k], first[k + 1])
            mark[spot[mine]] = x.w[shared[mine]]
            for f in range(c, d, 4_096):
                some = b[f : min(f + 4_096, d)]
                of = _spread(y.first[some], y.size[some])
                dot = np.bincount(np.repeat(np.arange(len(some)), y.size[some]), mark[place[of]] * y.w[of], len(some))
                near = dot >= least - SLACK
                if near.any():
                    yield k, some[near], dot[near]
            mark[spot[mine]] = 0


def _met(keys: np.ndarray, known: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``some`` whose keys are known, and where."""
    at = np.searchsorted(known, keys[some])
    hit = np.flatnonzero(at < len(known))
    hit = hit[known[at[hit]] == keys[some[hit]]]
    return some[hit], at[hit]


def _tile(least: float, views: int) -> Callable[[pa.Table], pa.Table]:
    def found(t: pa.Table) -> pa.Table:
        part, names = t.column("part").to_numpy(), [t.column(c)[0].as_py() for c in ("x", "y")]
        x = Part(t.filter(pa.array(part == names[0])))
        y = x if names[0] == names[1] else Part(t.filter(pa.array(part == names[1])))
        a, b, dots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, near, dot in pairs(x, y, least, views):
            a.append(np.full(len(near), x.id[k]))
            b.append(y.id[near])
            dots.append(dot)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "dot": np.concatenate(dots)})

    return found


def products(weights: DataFrame, least: float, views: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """(a, b, dot), a < b, ids being longs: all pairs whose inner product over all views reaches ``least`` (above 0). Weights (view, id, token, w)
    are positive and of norm 1 in each view; there are 4 views at most."""
    rows = stored(packed(weights, views))
    parts = max(1, -(-rows.count() // tile))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = dealt.select(F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "id", "keys", "ws")
    return met.groupBy("x", "y").applyInArrow(_tile(least, len(views)), "a long, b long, dot double")
