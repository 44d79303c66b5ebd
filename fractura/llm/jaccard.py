"""Jaccard join of word n-gram sets by chosen paths.

Sets are embedded by minhash: coordinate i of two sets is equal with the probability of their Jaccard similarity, so (i, value) pairs
are tokens that similar sets share. A path picks coordinates at random (by its own hash, alike for all sets); each picked token leads
to a bucket. All pairs of a bucket are compared on their signatures, each pair in the first bucket that both sets share; buckets of
more than ``local`` sets, or of long texts, are compared in blocks, by as many tasks. Runs repeat with other paths until a pair at the threshold is missed with a probability below ``1 - recall``. Sets with a likely partner then
meet their texts, and all likely pairs of a bucket are verified on the whole sets there: what leaves the bucket are numbers of links
and a forest of links, which makes the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999
HASHES, BRANCH = 256, 1.6
#: Sets whose signatures are compared at once.
SMALL = 512
#: Sets of a bucket that is compared inside one task: 4 MB of signatures; and characters of their texts, whose hashes the task holds.
LOCAL, LOCAL_CHARS = 8_192, 32_000_000
SEED = 5
#: Ids of candidates that are broadcast at most (8 MB); with more of them, texts are shuffled to meet them.
BROADCAST_IDS = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_space: list[np.ndarray] = []


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's runs of ``width`` words (lower case, split at white space). A text of fewer words has one
    run, of all its words; a text without words, or null, has none."""
    if not _space:
        _space.append(np.array([chr(i).isspace() for i in range(0x10000)]))
    low = [(t or "").lower() for t in texts]
    c = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    solid = ~_space[0][np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    size = np.flatnonzero(edge == -1) - start
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    first = np.cumsum(size) - size
    v = _mix((c[solid].astype(np.uint64) + np.uint64(1)) * _M)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _M, np.uint64))
    word = _mix(np.add.reduceat(v * power[np.arange(len(v)) - np.repeat(first, size)], first))
    cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in low]))
    out, at = [], 0
    for end in cut.tolist():
        w, at = word[at:end], end
        k = min(width, len(w))
        if not k:
            out.append(w)
            continue
        h = w[: len(w) - k + 1]
        for i in range(1, k):
            h = _mix(h * _M + w[i : len(w) - k + 1 + i])
        out.append(np.unique(h))
    return out


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, np.uint64)


def minhash(s: np.ndarray, co) -> np.ndarray:
    """HASHES values."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 512):
        low = np.minimum(low, (s[k : k + 512, None] * co[0] + co[1]).min(axis=0))
    return _mix(low)


def _groups(sizes: np.ndarray, most: int = 1_000_000) -> Iterator[slice]:
    group = np.cumsum(sizes) // most
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    for a, b in zip(cut, [*cut[1:], len(group)], strict=True):
        yield slice(int(a), int(b))


def sketches(docs: DataFrame, doc_id: str, text: str, width: int, runs: int) -> DataFrame:
    """(doc_id, key, sig, paths, chars) of each row: key stands for the whole set (texts without words: for the document), sig holds 16 bits
    of each minhash value, paths the first buckets of all runs, from whole values; both are null without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        co, roots = _coefficients(), _mix(np.arange(1, runs + 1, dtype=np.uint64) * _M)
        r, i = np.nonzero(picked(roots, BRANCH))
        start = _mix(roots[r] + _M + i.astype(np.uint64))
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            keys, sigs, paths, chars = [], [], [], [len(t or "") for t in texts]
            for part in _groups(np.array(chars, np.int64)):
                for d, s in zip(ids[part], shingle_sets(texts[part], width), strict=True):
                    keys.append(hashlib.blake2b(s.tobytes() if len(s) else f"none {d}".encode(), digest_size=16).digest())
                    low = minhash(s, co) if len(s) else None
                    sigs.append((low >> np.uint64(48)).astype("<u2").tobytes() if len(s) else None)
                    paths.append(_mix(start * _M ^ low[i]).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(chars, pa.int64())], ["doc_id", "key", "sig", "paths", "chars"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(rows, "doc_id long, key binary, sig binary, paths array<long>, chars long")


def picked(path: np.ndarray, branch: float) -> np.ndarray:
    """(paths, HASHES): which coordinates each path picks; ``branch`` of them are expected."""
    i = np.arange(HASHES, dtype=np.uint64)
    return _mix(path[:, None] * _M + _mix(i + np.uint64(77))) < np.uint64(int(branch / HASHES * 2**64))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


class Group:
    """The sets of one bucket, or of one block of a large one: (path, block, part, rep, sig, paths) rows, each rep once, sorted."""

    def __init__(self, t: pa.Table, least: int, tile: int):
        self.rep, head = np.unique(t.column("rep").to_numpy(), return_index=True)
        self.rows = t.take(pa.array(head))
        self.path, self.block = (t.column(c)[0].as_py() for c in ("path", "block"))
        self.sig = _signatures(self.rows.column("sig"))
        self.part = self.rows.column("part").to_numpy()
        self.least, self.tile = least, tile

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(a, bs): for each set the later ones that are candidates and that this bucket answers for. Of the buckets that two sets
        share, only the one of the smallest path does, so that each pair is met once; in a block of two parts, pairs go across."""
        n = len(self.sig)
        ids = self._before()
        mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
        two = self.part.min() != self.part.max()
        for x in range(0, n, self.tile):
            own = range(x, min(x + self.tile, n))
            near: list[list[np.ndarray]] = [[] for _ in own]
            for y in range(x, n, self.tile):
                tile = self.sig[y : y + self.tile]
                for a in own:
                    same = (tile == self.sig[a]).view(np.uint64).reshape(len(tile), 2, -1).sum(axis=2, dtype=np.uint64)
                    count = ((same * np.uint64(0x0101010101010101)) >> np.uint64(56)).sum(axis=1)
                    near[a - x].append(np.flatnonzero(count >= self.least) + y)
            for a in own:
                b = np.concatenate(near[a - x])
                b = b[b > a]
                if two:
                    b = b[self.part[b] != self.part[a]]
                if len(b):
                    mark[ids[a]] = True
                    mark[0] = False
                    b = b[~mark[ids[b]].any(axis=1)]
                    mark[ids[a]] = False
                if len(b):
                    yield a, b

    def _before(self) -> np.ndarray:
        """(sets, most): numbers from 1 of each set's paths below this bucket's, filled up with 0."""
        paths = self.rows.column("paths").combine_chunks()
        flat, size = paths.flatten().to_numpy(), np.diff(paths.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        low = flat < self.path
        number = np.unique(flat[low], return_inverse=True)[1] + 1
        row = row[low]
        count = np.bincount(row, minlength=len(size))
        out = np.zeros((len(size), max(1, int(count.max(initial=0)))), np.int64)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = number
        return out


FOUND = "path long, block int, part int, rep long, sig binary, paths array<long>"
LINK = "a long, b long, jaccard double, n long"


def _with_candidates(least: int, tile: int):
    """The rows of a group that are in one of its candidates at least."""

    def found(t: pa.Table) -> pa.Table:
        g = Group(t, least, tile)
        some = np.zeros(len(g.rep), bool)
        for a, b in g.pairs():
            some[a] = some[b] = True
        return g.rows.filter(pa.array(some))

    return found


def _verified(least: int, tile: int, width: int, threshold: float, every: bool):
    """(a, b, jaccard) of the links of a group, on whole sets: all of them, or a forest of them that joins what they join; and
    (a, n): how many links each set has here."""

    def found(t: pa.Table) -> pa.Table:
        g = Group(t, least, tile)
        sets = []
        texts = g.rows.column("text").to_pylist()
        for part in _groups(np.array([len(x or "") for x in texts], np.int64)):
            sets += shingle_sets(texts[part], width)
        size = np.array([len(s) for s in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        first = np.cumsum(size) - size
        has = np.zeros(int(number.max(initial=0)) + 1, np.int8)
        n_links, tree, out = np.zeros(len(sets), np.int64), np.arange(len(sets)), []
        for a, b in g.pairs():
            own = number[first[a] : first[a] + size[a]]
            has[own] = 1
            both = np.zeros(len(b), np.int64)
            for part in _groups(size[b]):
                k = size[b[part]]
                at = np.cumsum(k) - k
                both[part] = np.add.reduceat(has[number[np.arange(int(k.sum())) + np.repeat(first[b[part]] - at, k)]], at, dtype=np.int64)
            has[own] = 0
            union = size[a] + size[b] - both
            near = both >= threshold * union - 1e-12
            b, share = b[near], (both / union)[near]
            n_links[a] += len(b)
            n_links[b] += 1
            keep = np.arange(len(b))
            if not every:
                trees, keep = np.unique(tree[b], return_index=True)
                keep = keep[trees != tree[a]]
                tree[np.isin(tree, trees)] = tree[a]
            out += zip(g.rep[np.full(len(keep), a)].tolist(), g.rep[b[keep]].tolist(), share[keep].tolist(), [None] * len(keep), strict=True)
        linked = np.flatnonzero(n_links)
        out += zip(g.rep[linked].tolist(), [None] * len(linked), [None] * len(linked), n_links[linked].tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({c: pa.array(x, k) for (c, k), x in zip((("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()), ("n", pa.int64())), cols, strict=True)})

    return found


def blocks(rows: DataFrame, local: int, chars: int = LOCAL_CHARS) -> DataFrame:
    """Buckets of more than ``local`` sets, or of texts of more than ``chars`` characters in all (rows: (path, rep, sig, paths, count, chars),
    the last two of the bucket), are dealt into parts of about half of that, and each two parts, or one with itself, make a block, so that
    all pairs meet in exactly one block; smaller buckets are one block."""
    most = F.greatest(F.col("count") / local, F.col("chars") / chars)
    parts = F.when(most > 1, F.ceil(2 * most)).otherwise(1).cast("int")
    own = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep", "path"), F.col("parts")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    return met.select("path", block.alias("block"), "part", "rep", "sig", "paths")


def least_equal(threshold: float, recall: float) -> int:
    """Equal coordinates of a candidate: a pair at the threshold has fewer with a tenth of the probability that may be missed at most."""
    below, k = (1 - threshold) ** HASHES, 0
    while below <= (1 - recall) / 10 and k < HASHES:
        k += 1
        below += math.comb(HASHES, k) * threshold**k * (1 - threshold) ** (HASHES - k)
    return k


def runs_needed(threshold: float, recall: float) -> int:
    """Runs that miss a pair at the threshold with nine tenths of ``1 - recall`` at most. Each bucket is compared whole, so that there is
    one level to survive: a pair is missed if it agrees in none of the coordinates picked, those of all runs."""
    most, runs = 0.9 * (1 - recall), 0
    while True:
        runs += 1
        roots = _mix(np.arange(1, runs + 1, dtype=np.uint64) * _M)
        own = picked(roots, BRANCH).any(axis=0).sum()
        if math.exp(-BRANCH * threshold * runs) <= most and (1 - threshold) ** int(own) <= most:
            return runs


def linked(sets: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, threshold: float, least: int, small: int, local: int, every: bool, chars: int = LOCAL_CHARS) -> DataFrame:
    """(a, b, jaccard, n): links and, where b is null, numbers of links of a, among (rep, sig, paths, chars) rows of distinct sets. Only sets
    with a candidate meet their texts."""
    level = sets.select(F.explode("paths").alias("path"), "rep", "chars")
    size = level.groupBy("path").agg(F.count("*").alias("count"), F.sum("chars").alias("chars")).where("count > 1")
    rows = keep(level.drop("chars").join(size, "path").join(sets.drop("chars"), "rep").select("path", "rep", "sig", "paths", "count", "chars"), "buckets")
    dealt = blocks(rows, local, chars)
    some = keep(dealt.groupBy("path", "block").applyInArrow(_with_candidates(least, small), FOUND), "candidates")
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    ids = keep(some.select("rep").distinct(), "ids")
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rep", "left_semi")
    full = some.join(texts, "rep")
    return keep(full.groupBy("path", "block").applyInArrow(_verified(least, small, width, threshold, every), LINK), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component. Each round every node goes to the least node around it and
    edges are contracted, so that they get few soon; only whether any are left comes to the driver."""
    edges = keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    label: DataFrame | None = None
    while True:
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        step = keep(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("at"), F.least("u", "v").alias("to")), "steps")
        if label is None:
            label = step.toDF("node", "label")
        else:
            label = keep(label.join(step.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        moved = edges.join(step.toDF("u", "x"), "u").join(step.toDF("v", "y"), "v").where("x <> y")
        edges = keep(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        if not edges.limit(1).count():
            return label


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, local: int = LOCAL, every: bool = False, chars: int = LOCAL_CHARS) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, class_id (smallest doc_id of its class: texts joined by links, or with equal sets), n_links
    (links of its set to other sets), n_copies (rows with the same set), for each row. links: (a, b, jaccard) between the
    smallest documents of two distinct sets, all verified; with ``every`` all of them, else of each bucket a forest that joins the
    same sets. ``n_links`` counts all of them either way.

    Rows without words (null, empty) are in no class but their own. Rows with a null id take no part. Repeated rows count as copies.
    """
    docs = docs.where(F.col(doc_id).isNotNull())
    runs = runs_needed(threshold, recall)
    each = keep(sketches(docs, doc_id, text, width, runs), "sketches")
    classes = keep(each.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("paths").alias("paths"), F.max("chars").alias("chars")), "classes")
    sets = classes.where("sig is not null").select("rep", "sig", "paths", "chars")
    found = linked(sets, docs, doc_id, text, width, threshold, least_equal(threshold, recall), small, local, every, chars)
    links = found.where("b is not null").select("a", "b", "jaccard")
    degree = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    label = components(links).toDF("rep", "label")
    info = classes.select("key", "rep", "n_copies").join(degree, "rep", "left").join(label, "rep", "left")
    members = each.select("doc_id", "key").join(info, "key").select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return members, links


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))[0]
