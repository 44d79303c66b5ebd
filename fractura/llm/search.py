"""Nearest neighbours: vantage-point trees per shard for inner products, and multi-index hashing for binary codes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

SHARD_ROWS, QUERY_ROWS, LEAF = 8_192, 4_096, 96
FACTOR = 1.35
SEGMENT_BITS = 16


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: not null, not all zero, only finite components, of the commonest length."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == (sizes[0].n if sizes else 0))


def _distinct(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value, ids): for each distinct value its k + 1 smallest ids, which are all that a search for k can return."""
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy(value).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return top.groupBy(value).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _sharded(values: DataFrame, value: str, shard_rows: int) -> DataFrame:
    n = max(1, values.count() // shard_rows)
    return values.withColumn("shard", F.pmod(F.xxhash64(value), F.lit(n)).cast("int"))


def _pairs(index: DataFrame, queries: DataFrame, value: str, query_rows: int) -> DataFrame:
    """(shard, index, queries): each shard's index beside each block of queries."""
    n = max(1, queries.count() // query_rows)

    def packed(t: pa.Table) -> pa.Table:
        return pa.table({"queries": pa.array([pickle.dumps((t.column("vec_id").to_numpy(), np.array(t.column(value).to_pylist())))], pa.binary())})

    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n))).groupBy("block").applyInArrow(packed, "queries binary")
    last = index.agg(F.max("shard")).first()[0]
    return blocks.where(F.lit(last is not None)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0)))).join(index, "shard")


def _best(query_id: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, own: bool) -> list[np.ndarray]:
    """The k best (query_id, vec_id, score) rows of each query, larger scores first, smaller ids on ties.

    ids: (queries, candidates, copies), -1 for none; score: (queries, candidates). own: whether a query's own row may be returned.
    """
    q = np.broadcast_to(query_id[:, None, None], ids.shape)
    s = np.broadcast_to(score[..., None], ids.shape)
    good = (ids >= 0) & (s > -np.inf) & (own | (ids != q))
    q, i, s = q[good], ids[good], s[good]
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return [x[rank < k] for x in (q, i, s)]


def _ids(rows: list[list[int]], k: int) -> np.ndarray:
    out = np.full((len(rows), k + 1), -1, np.int64)
    for n, x in enumerate(rows):
        out[n, : len(x)] = x
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- vantage-point trees ----------------------------------------------------------------------------------------------


class VantageTree:
    """Over unit-free points: each node splits its points at the median distance from a vantage point and knows the range of
    distances on either side. Points are made from vectors so that Euclidean order is the order of inner products."""

    def __init__(self, vectors: np.ndarray, top: float, leaf: int = LEAF, seed: int = 3):
        self.vectors, self.top = vectors, top
        self.points = np.concatenate([vectors, np.sqrt(np.maximum(top**2 - (vectors**2).sum(axis=1), 0))[:, None]], axis=1)
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.order = np.arange(len(vectors))
        self.root = self._build(np.arange(len(vectors)), leaf, rng)

    def _build(self, rows: np.ndarray, leaf: int, rng) -> int:
        at = len(self.nodes)
        if len(rows) <= leaf:
            self.nodes.append((rows,))
            return at
        sample = self.points[rng.choice(rows, min(len(rows), 64), replace=False)]
        picks = rng.choice(rows, 8)
        spread = [np.linalg.norm(sample - self.points[p], axis=1).std() for p in picks]
        center = self.points[picks[int(np.argmax(spread))]]
        d = np.linalg.norm(self.points[rows] - center, axis=1)
        order = np.argsort(d, kind="stable")
        rows, d, half = rows[order], d[order], len(rows) // 2
        self.nodes.append(())
        sides = [(self._build(rows[a:b], leaf, rng), d[a], d[b - 1]) for a, b in ((0, half), (half, len(rows)))]
        self.nodes[at] = (None, center, *sides)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(queries, k) rows and their inner products, unordered; -1 and -inf where there are fewer.

        Bounds come from the leaf on a query's side of all nodes; then every node is visited once, by all queries that may find something
        there. A side is left out if its nearest possible distance, times ``factor``, is over the k-th best so far; 1 is exact. What leaves
        give below a query's bound is gathered, and bounds are set anew when there is much of it, for all queries at once.
        """
        norm = np.maximum(np.linalg.norm(queries, axis=1), 1e-300)
        self.q = np.concatenate([queries * (self.top / norm)[:, None], np.zeros((len(queries), 1))], axis=1)
        self.k, self.kth = k, np.full(len(queries), np.inf)
        self.held, self.new, self.fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        self.seen = np.full(len(queries), -1)
        self._nearest_leaf(self.root, np.arange(len(queries)))
        self._settle()
        self._visit(self.root, np.arange(len(queries)), factor)
        who, place = self._settle()
        rows = np.full((len(queries), k), -1)
        rows[who, place] = self.held[1]
        score = np.full(rows.shape, -np.inf)
        for n in range(k):
            has = rows[:, n] >= 0
            score[has, n] = (queries[has] * self.vectors[rows[has, n]]).sum(axis=1)
        return rows, score

    def _settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Keeps the k nearest found of each query, and from them its bound; returns whose they are, and their places."""
        who, row, d = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((d, who))
        who, row, d = who[order], row[order], d[order]
        n = np.bincount(who, minlength=len(self.kth))
        place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        last = place == self.k - 1
        self.kth[who[last]] = d[last]
        good = place < self.k
        self.held, self.new, self.fresh = (who[good], row[good], d[good]), [], 0
        return who[good], place[good]

    def search_ties(self, queries: np.ndarray, k: int, factor: float = 1.0, more: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which queries, rows, inner products) with all that tie with a query's k-th product: ``more`` rows than k are looked for, and
        twice as many again for the queries whose last one found still ties, until none does or all rows are found."""
        who, n = np.arange(len(queries)), len(self.vectors)
        while len(who):
            m = min(n, k + more)
            row, score = self.search(queries[who], m, factor)
            near = 1e-9 * self.top * np.linalg.norm(queries[who], axis=1)
            kth = np.partition(score, max(m - k, 0), axis=1)[:, max(m - k, 0)]
            tied = (m < n) & (kth > -np.inf) & (kth <= score.min(axis=1) + near)
            yield who[~tied], row[~tied], score[~tied]
            who, more = who[tied], more + m

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        d = np.maximum(2 * self.top**2 - 2 * self.q[who] @ self.points[rows].T, 0)
        i, j = np.nonzero(d < self.kth[who][:, None])
        self.new.append((who[i], rows[j], d[i, j]))
        self.fresh += len(i)
        if self.fresh > 2 * self.k * len(self.kth):
            self._settle()

    def _nearest_leaf(self, at: int, who: np.ndarray) -> None:
        node = self.nodes[at]
        if not len(who):
            return
        if len(node) == 1:
            self.seen[who] = at
            self._leaf(node[0], who)
            return
        _, center, (low, _, low_max), (high, high_min, _) = node
        inner = np.linalg.norm(self.q[who] - center, axis=1) < (low_max + high_min) / 2
        self._nearest_leaf(low, who[inner])
        self._nearest_leaf(high, who[~inner])

    def _visit(self, at: int, who: np.ndarray, factor: float) -> None:
        node = self.nodes[at]
        if len(node) == 1:
            self._leaf(node[0], who[self.seen[who] != at])
            return
        _, center, *sides = node
        dist = np.linalg.norm(self.q[who] - center, axis=1)
        for child, a, b in sides:
            gap = np.maximum(0, np.maximum(a - dist, dist - b))
            some = who[gap * factor <= np.sqrt(self.kth[who])]
            if len(some):
                self._visit(child, some, factor)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k vectors of the largest inner product found, its own row left out.

    Equal vectors are searched once and stand for their smallest ids; different vectors that tie at the last rank are all looked for.
    Trees are built once per shard and kept; every row is in one.
    Vectors null, zero, with null or non-finite components, or of another length than the commonest take no part, on either side; an
    empty table gives no rows. A query id that is repeated asks with the smallest of its vectors.
    """
    points = keep(_distinct(_usable(vectors, vec_id, embedding), "v", k), "points")
    top = points.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0

    def build(t: pa.Table) -> pa.Table:
        tree = VantageTree(np.array(t.column("v").to_pylist(), float), top * (1 + 1e-9))
        return pa.table({"shard": t.column("shard")[:1].combine_chunks(), "index": pa.array([pickle.dumps((tree, _ids(t.column("ids").to_pylist(), k)))], pa.binary())})

    index = keep(_sharded(points, "v", shard_rows).groupBy("shard").applyInArrow(build, "shard int, index binary"), "trees")
    asked = _usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ix, qs in zip(b.column("index"), b.column("queries"), strict=True):
                (tree, ids), (qid, q) = pickle.loads(ix.as_py()), pickle.loads(qs.as_py())
                for low in range(0, len(qid), 1024):
                    for who, row, score in tree.search_ties(q[low : low + 1024], k + 1, factor):
                        got = _best(qid[low + who], np.where(row[..., None] >= 0, ids[row], -1), score, k, False)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    found = _pairs(index, asked, "v", query_rows).select("index", "queries").mapInArrow(look, "query_id long, vec_id long, score double")
    return _ranked(found, k)


# --- multi-index hashing ----------------------------------------------------------------------------------------------


class MultiIndex:
    """Codes of 64 bits as words of uint64, indexed by each of their 16-bit segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.m = codes.shape[1] * 64 // SEGMENT_BITS
        seg = self.segments(codes)
        self.order = [np.argsort(seg[:, j], kind="stable") for j in range(self.m)]
        self.start = [np.searchsorted(seg[:, j][self.order[j]], np.arange((1 << SEGMENT_BITS) + 1)) for j in range(self.m)]

    @staticmethod
    def segments(codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view("<u2").reshape(len(codes), -1).astype(np.int64)

    @staticmethod
    def flips(radius: int) -> np.ndarray:
        return np.array([sum(1 << i for i in c) for c in combinations(range(SEGMENT_BITS), radius)], np.int64)

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes up to the k-th smallest distance (ties included).

        Segment by segment and radius by radius: once j segments are done at radius r, no code within m * r + j - 1 is missing;
        the search ends when the k-th verified distance is within that.
        """
        seen = np.zeros(len(self.codes), bool)
        rows, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k = min(k, len(self.codes))
        count = np.zeros(self.codes.shape[1] * 64 + 1, np.int64)
        seg = self.segments(code[None])[0]
        for radius in range(SEGMENT_BITS + 1):
            flip = self.flips(radius)
            for j in range(self.m):
                v = seg[j] ^ flip
                a, b = self.start[j][v], self.start[j][v + 1]
                n = b - a
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                new = self.order[j][at]
                new = new[~seen[new]]
                seen[new] = True
                d = np.bitwise_count(self.codes[new] ^ code).sum(axis=1).astype(np.int64)
                rows.append(new)
                dist.append(d)
                count += np.bincount(d, minlength=len(count))
                kth = int(np.searchsorted(np.cumsum(count), k))
                if k and count.sum() >= k and kth <= self.m * radius + j:
                    r, d = np.concatenate(rows), np.concatenate(dist)
                    return r[d <= kth], d[d <= kth]
        return np.concatenate(rows), np.concatenate(dist)


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, code array<long>): a bit for each component, set where it is positive; words of 64 bits, the last filled with 0."""
    v = _usable(vectors, vec_id, embedding)
    bit = F.transform("v", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 64).cast("int")), lambda w: F.aggregate(F.slice(F.col("bits"), w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, x: s + x))
    return v.withColumn("bits", bit).select("vec_id", words.alias("code"))


def hamming_nearest(codes: DataFrame, queries: DataFrame, k: int, shard_rows: int = 4 * SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, distance): each query's k codes of the smallest Hamming distance, exact, its own row left out, ties to smaller ids.

    codes, queries: (vec_id, code array<long>), all of one length. Equal codes are searched once and stand for their smallest ids. A query
    id that is repeated asks with the smallest of its codes.
    """
    points = keep(_distinct(codes.where("vec_id is not null and code is not null"), "code", k), "codes")

    def build(t: pa.Table) -> pa.Table:
        index = MultiIndex(np.array(t.column("code").to_pylist(), np.int64).view(np.uint64))
        return pa.table({"shard": t.column("shard")[:1].combine_chunks(), "index": pa.array([pickle.dumps((index, _ids(t.column("ids").to_pylist(), k)))], pa.binary())})

    index = keep(_sharded(points, "code", shard_rows).groupBy("shard").applyInArrow(build, "shard int, index binary"), "multi")
    asked = queries.where("vec_id is not null and code is not null").groupBy("vec_id").agg(F.min("code").alias("code"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ix, qs in zip(b.column("index"), b.column("queries"), strict=True):
                (multi, ids), (qid, q) = pickle.loads(ix.as_py()), pickle.loads(qs.as_py())
                known: dict[bytes, tuple] = {}
                out = []
                for i, c in zip(qid, q.astype(np.int64).view(np.uint64), strict=True):
                    if c.tobytes() not in known:
                        known[c.tobytes()] = multi.search(c, k + 1)
                    row, d = known[c.tobytes()]
                    out.append(_best(np.array([i]), ids[row][None], -d[None].astype(float), k, False))
                if out:
                    got = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    found = _pairs(index, asked, "code", query_rows).select("index", "queries").mapInArrow(look, "query_id long, vec_id long, score double")
    return _ranked(found, k).select("query_id", "rank", "vec_id", (-F.col("score")).cast("int").alias("distance"))


# --- queries ----------------------------------------------------------------------------------------------------------


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_nearest(codes, codes.where("vec_id % 100 = 0"), 10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: CASE WHEN (q.e[i] > 0) <> (c.e[i] > 0) THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
