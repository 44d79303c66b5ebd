"""Near-duplicate vectors of one label by products of int8 tiles.

Vectors are scaled to length 1 and rounded to int8 steps of their own; the length of what rounding took away is known for each vector, so the
product of two codes misses the cosine by at most (1 + e) f + e, e and f being those lengths. A product of codes above the threshold by more
than that is a link, one below by more is none. Only tile pairs with a product between meet the vectors themselves, and only those pairs of
them are computed in full. Equal vectors are one, with a number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .jaccard import components

THRESHOLD = 0.93
#: Vectors and components of a tile at most; a product of tiles has ROWS^2 numbers.
ROWS, COMPONENTS = 2_048, 2_000_000
#: Components whose int8 products a float32 sum holds exactly.
EXACT = 1_024
SLACK = 1e-12
TILE = "grp string, dim int, tile int, parts int, rep binary, key binary, copies binary, codes binary, step binary, lost binary, vectors binary"
LINK = "grp string, dim int, lo int, hi int, a_rep long, a_key long, b_rep long, b_key long, n long, unsure boolean"


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, step, lost): v / |v| is codes * step but for a vector of length ``lost``."""
    unit = scaled(v)
    unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None])
    rest = unit - codes * step[:, None]
    return codes.astype(np.int8), step, np.sqrt((rest * rest).sum(axis=1))


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row by a power of two such that its largest component is near 1: squares neither overflow nor vanish, no bit is lost."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes, as whole numbers: sums over EXACT components stay below 2^24, where float32 is exact."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


class Side:
    """A tile in numpy."""

    def __init__(self, row: dict):
        n = len(row["step"]) // 8
        self.rep, self.key, self.copies = (np.frombuffer(row[c], np.int64) for c in ("rep", "key", "copies"))
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, -1)
        self.step, self.lost = (np.frombuffer(row[c]) for c in ("step", "lost"))
        self.vectors = scaled(np.frombuffer(row["vectors"]).reshape(n, -1)) if row.get("vectors") else None


def verdicts(a: Side, b: Side, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sure, unsure): pairs that are links whatever rounding took away, and pairs that may be. ``same``: one tile, each pair once."""
    near = code_products(a.codes, b.codes) * a.step[:, None] * b.step
    off = (1 + a.lost[:, None]) * b.lost + a.lost[:, None] + SLACK
    sure, unsure = near - off >= threshold, near + off >= threshold
    unsure &= ~sure
    return (np.triu(sure, 1), np.triu(unsure, 1)) if same else (sure, unsure)


def in_full(a: Side, b: Side, maybe: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs of ``maybe`` whose cosine, from the vectors themselves in double precision, is at the threshold or above."""
    out = np.zeros_like(maybe)
    i, j = np.nonzero(maybe)
    x, y = (np.sqrt((s.vectors * s.vectors).sum(axis=1)) for s in (a, b))
    most = max(1, COMPONENTS // a.vectors.shape[1])
    for k in range(0, len(i), most):
        p, q = i[k : k + most], j[k : k + most]
        out[p, q] = (a.vectors[p] * b.vectors[q]).sum(axis=1) / (x[p] * y[q]) >= threshold
    return out


def _rows(head: dict, a: Side, b: Side, links: np.ndarray, same: bool, unsure: bool) -> pa.Table:
    """What leaves a tile pair: numbers of links by vector, a forest of links that joins what all of them join, and whether pairs are
    left to compute in full."""
    n, m = links @ b.copies, links.T @ a.copies
    some = np.flatnonzero(links.any(axis=1))
    tree = np.arange(len(b.rep)) if same else np.arange(len(a.rep) + len(b.rep))
    shift = 0 if same else len(a.rep)
    edges = []
    for i in some.tolist():
        j = np.flatnonzero(links[i])
        trees, first = np.unique(tree[j + shift], return_index=True)
        first = first[trees != tree[i]]
        tree[np.isin(tree, trees)] = tree[i]
        edges += [(i, int(x)) for x in j[first]]
    out: dict[str, list] = {c: [] for c in ("a_rep", "a_key", "b_rep", "b_key", "n", "unsure")}

    def add(rep, key, rep2, key2, count, open_):
        for c, x in zip(out, (rep, key, rep2, key2, count, open_), strict=True):
            out[c].append(x)

    for side, count in ((a, n), (b, m)):
        for i in np.flatnonzero(count).tolist():
            add(int(side.rep[i]), int(side.key[i]), None, None, int(count[i]), None)
    for i, j in edges:
        add(int(a.rep[i]), int(a.key[i]), int(b.rep[j]), int(b.key[j]), None, None)
    if unsure:
        add(None, None, None, None, None, True)
    size = len(out["n"])
    types = [pa.int64()] * 5 + [pa.bool_()]
    named = [pa.array([head[c]] * size, k) for c, k in (("grp", pa.string()), ("dim", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()))]
    return pa.Table.from_arrays([*named, *(pa.array(x, k) for x, k in zip(out.values(), types, strict=True))], [x.split()[0] for x in LINK.split(", ")])


def _of_pair(threshold: float, whole: bool):
    """Links of a pair of tiles that are sure by their codes or, ``whole``, those that the vectors decide."""

    def made(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["tile"])
        sides, same = [Side(r) for r in rows], len(rows) == 1
        a, b = sides[0], sides[-1]
        sure, unsure = verdicts(a, b, threshold, same)
        links = in_full(a, b, unsure, threshold) if whole else sure
        return _rows(rows[0], a, b, links, same, not whole and bool(unsure.any()))

    return made


def _packed(t: pa.Table) -> pa.Table:
    """One row for a tile, its vectors by id, so that both passes see one order."""
    t = t.sort_by([("rep", "ascending"), ("key", "ascending")])
    v = np.array(t.column("v").to_pylist(), float)
    codes, step, lost = quantised(v)
    cols = [t.column(c).to_numpy().astype(np.int64) for c in ("rep", "key", "copies")] + [codes, step, lost, v]
    names = [x.split()[0] for x in TILE.split(", ")]
    head = [t.column(c)[:1].combine_chunks() for c in names[:4]]
    return pa.Table.from_arrays([*head, *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in cols)], names)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rows: int = ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: vectors of one label and length with a cosine of ``threshold`` or more are linked.

    Vectors that are null, zero or hold null or non-finite components, and rows without a label or an id, link with nothing; each is its own
    component. Rows given twice are copies of each other, and so linked. An empty table gives no rows; other columns are not looked at.

    All tiles of a label meet, which is the method: the work grows with the square of a label's distinct vectors, in pieces that never grow.
    """
    each = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("grp"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("grp").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    keys = {"h1": F.when(good, F.xxhash64("grp", "v")), "h2": F.when(good, F.xxhash64(F.lit(7), "v", "grp"))}
    each = each.withColumns(keys)
    first = [F.first(c).alias(c) for c in ("grp", "v")]
    classes = keep(each.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *first).withColumn("dim", F.size("v")), "classes")

    size = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(COMPONENTS) / F.col("dim"))))
    parts = classes.groupBy("grp", "dim").agg(F.ceil(F.count("*") / F.first(size)).cast("int").alias("parts"))
    dealt = classes.join(parts, ["grp", "dim"]).withColumn("tile", F.pmod(F.xxhash64("h2"), F.col("parts")).cast("int"))
    tiles = keep(dealt.select("grp", "dim", "tile", "parts", "rep", F.col("h1").alias("key"), "copies", "v").groupBy("grp", "dim", "tile").applyInArrow(_packed, TILE), "tiles")

    met = tiles.drop("vectors").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    pair = ["grp", "dim", "lo", "hi"]
    by_code = keep(met.groupBy(*pair).applyInArrow(_of_pair(threshold, False), LINK), "by_code")
    between = by_code.where("unsure").select(*pair, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("tile"))
    in_doubt = between.join(tiles, ["grp", "dim", "tile"]).groupBy(*pair).applyInArrow(_of_pair(threshold, True), LINK)
    found = by_code.where("unsure is null").unionByName(keep(in_doubt, "in_full"))

    node = lambda x: F.struct(F.col(f"{x}_rep").alias("rep"), F.col(f"{x}_key").alias("key"))
    label_of = components(found.where("b_rep is not null").select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.rep").alias("rep"), F.col("node.key").alias("h1"), F.col("label.rep").alias("first"))
    linked = found.where("n is not null").groupBy(F.col("a_rep").alias("rep"), F.col("a_key").alias("h1")).agg(F.sum("n").alias("n"))
    more = classes.select("h1", "h2", "rep", "copies").join(linked, ["rep", "h1"], "left").join(label_of, ["rep", "h1"], "left").where("copies > 1 or n is not null")
    out = each.select("vec_id", "h1", "h2").join(more, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("first", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.size * b.size) >= {THRESHOLD}
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
