"""How far the sources of a language differ in their words, and which words set a source apart, in exact whole numbers.

Terms are counted by language, source and term, first in parts of a task's rows; the rest is plain relational. Sources are crossed with the
terms their language keeps, so that terms which a source lacks count 0; the dense table meets itself on language and term; differences are summed up and ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keep

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What each byte of a text becomes: letters lower case, other ASCII a space that terms are cut at, bytes of other characters stay.
TERMS_ONLY = bytes(k if k > 127 or chr(k) in LOWER else k + 32 if chr(k) in UPPER else 32 for k in range(256))
#: Bytes of text that are counted at once.
PART = 16_000_000
#: Documents of a language that a term must be in, and the ranks of terms that are returned.
LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Parts that the terms of a language are dealt into where they meet its sources.
SALTS = 64


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of some rows by language and source; other rows of the same task may give the same terms again."""
    for b in batches:
        texts = b.column(2).to_pylist()
        part = np.cumsum([len(t) for t in texts]) // PART
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            first, size = int(rows[0]), len(rows)
            found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
            for lang, source, text in zip(b.column(0).slice(first, size).to_pylist(), b.column(1).slice(first, size).to_pylist(), texts[first : first + size], strict=True):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(TERMS_ONLY).split()
                n.update(terms)
                docs.update(set(terms))
            for (lang, source), (n, docs) in found.items():
                terms = list(n) or [None]
                each = [pa.array([v] * len(terms), pa.string()) for v in (lang, source)]
                counts = [pa.array([c.get(t) for t in terms], pa.int64()) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays([*each, pa.array(terms, pa.binary()), *counts], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and rows it is in. A source without any term has one row of a null term."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    rows = found.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), in decimals that hold any corpus's counts."""
    whole = lambda c: c.cast("decimal(20,0)")
    c, t = whole(count + 2), whole(total + 2 * kept)
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * c, t)


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): the square is at most SCALE^2, which a long holds."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the summed difference of a source to each other source of its language, all
    ranks, 0 where the language keeps no term. Part ``term``: the ``top`` terms that a source uses more than its language does.

    A null text, language or source counts as an empty one; an empty or term-less text still makes its source occur; each row is a
    document of its own, given twice or not. Ties in value go by item. An empty table gives no rows; other columns are not looked at.
    """
    counts = keep(term_counts(docs, text, lang, source), "term_counts")
    by_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
    vocabulary = keep(by_lang.where(F.col("docs") >= least_docs).select("lang", "term", "all_n"), "vocabulary")
    kept = counts.join(vocabulary.select("lang", "term"), ["lang", "term"])
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "all_total"])
    groups = keep(groups, "groups")

    salted = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dense = spread.join(salted, ["lang", "salt"]).join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    n = F.coalesce("n", F.lit(0))
    dense = dense.select("lang", "source", "term", n.alias("n"), share(n, F.col("total"), F.col("kept")).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("kept")).alias("q"))
    dense = keep(dense, "dense")

    x, y = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("a", "p"), ("b", "q")))
    met = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(difference(F.col("p"), F.col("q"))).alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    same = groups.where("kept = 0").select("lang", "source")
    bare = same.join(same.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = met.withColumn("e", ends).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").unionByName(bare)
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH f AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS found FROM documents
), g AS (SELECT DISTINCT lang, source FROM f
), o AS (SELECT lang, source, unnest(found) AS term FROM f
), c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL
), d AS (SELECT lang, unnest(list_distinct(found)) AS term FROM f
), v AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}
), size AS (SELECT lang, count(*) AS v FROM v GROUP BY lang
), w AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), a AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY ALL
), p AS (
  SELECT w.*, (1 + {SCALE}::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY w.lang, source) + 2 * v))::HUGEINT AS p FROM w JOIN size ON size.lang = w.lang
), q AS (
  SELECT a.*, (1 + {SCALE}::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY a.lang) + 2 * v))::HUGEINT AS q FROM a JOIN size ON size.lang = a.lang
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
  LEFT JOIN (SELECT i.lang, i.source AS a, j.source AS b, sum((i.p - j.p) * (i.p - j.p) // (i.p + j.p)) AS value FROM p i JOIN p j ON j.lang = i.lang AND j.term = i.term GROUP BY ALL) s
  ON s.lang = x.lang AND s.a = x.source AND s.b = y.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
