"""Spelling variants: words one edit apart, each led to a much more frequent near word, over all words of a corpus.

Of two words one edit apart, either the first half or the rest is equal in both, halves taken from the length of the shorter one. So each
word is sent to a shard by each of its possible halves, and every near pair meets in exactly one shard. There the words' remaining parts
are indexed by their positional bigrams: a word merges the postings of its own bigrams, as far as position and length allow, and words met
as often as one edit leaves at least are verified. A shard of too many words is split in the same way by halves of what remains.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep

RUN = "[A-Za-zÀ-ÿ]+"
#: What runs are cut at: splitting a text costs a tenth of matching in it.
BETWEEN = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in SLIP loses a code point; words have LEAST code points and OCCUR occurrences at least; a form is TIMES as frequent.
SLIP, LEAST, OCCUR, TIMES = 199, 6, 5, 5
#: Words of a shard that is not split further.
LOCAL = 8_192
FOUND = "word string, n_near long, form_n long, form string"


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, occur: int = OCCUR) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased from A to Z, some with one code point deleted, as counted."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.translate(text, UPPER, LOWER), BETWEEN)).alias("run"))
    runs = runs.where(F.length("run") >= least).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")
    return runs.select(word).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occur)


def halves(rows: DataFrame) -> DataFrame:
    """(shard, low, high, word, n): ``low`` and ``high`` code points at the ends of a word are alike in its whole shard. Each word goes to four
    shards: as the shorter or equal one of a pair and as the longer one, by the first half and by the rest of what is not alike yet."""
    left = F.length("word") - F.col("low") - F.col("high")
    short = F.explode(F.array(left, left - 1)).alias("short")
    rows = rows.select("shard", "low", "high", "word", "n", short).where("short >= 1").withColumn("half", F.floor(F.col("short") / 2).cast("int"))
    first = F.substring("word", F.col("low") + 1, F.col("half"))
    rest = F.substring("word", F.length("word") - F.col("high") - (F.col("short") - F.col("half")) + 1, F.col("short") - F.col("half"))
    name = lambda side, part: F.concat_ws("|", "shard", F.concat(F.col("short").cast("string"), F.lit(side), part))
    ends = F.array(
        F.struct(name("<", first).alias("shard"), (F.col("low") + F.col("half")).alias("low"), F.col("high")),
        F.struct(name(">", rest).alias("shard"), F.col("low"), (F.col("high") + F.col("short") - F.col("half")).alias("high")),
    )
    return rows.select(F.explode(ends).alias("e"), "word", "n").select("e.shard", "e.low", "e.high", "word", "n")


def shards(found: DataFrame, local: int = LOCAL) -> DataFrame:
    """Rows of ``halves``, split until no shard has more than ``local`` words, or nothing to split by: then at most two code points of its
    words differ, so that the alphabet bounds it."""
    rows = keep(halves(found.select(F.lit("").alias("shard"), F.lit(0).alias("low"), F.lit(0).alias("high"), "word", "n")), "shards")
    done = None
    while True:
        large = keep(rows.groupBy("shard").agg(F.count("*").alias("size"), F.max(F.length("word") - F.col("low") - F.col("high")).alias("left")).where((F.col("size") > local) & (F.col("left") > 2)).select("shard"), "large")
        if not large.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, "shard", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = keep(halves(rows.join(large, "shard", "left_semi")), "shards")


def one_edit(a: str, b: str) -> bool:
    """Whether b, no shorter than a, is a with one code point replaced or inserted."""
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _level(name: str) -> tuple[str, int, int]:
    """Side, shorter length and first half of one level of a shard's name."""
    side = "<" if "<" in name else ">"
    short = int(name.split(side, 1)[0])
    return side, short, short // 2


def answers(a: str, b: str, shard: str) -> bool:
    """Whether this is the shard of all that a pair shares which counts it: one that is named by the length of a, which is no longer than
    b, and one by a rest only where the first halves differ."""
    low = high = 0
    for level in shard.split("|")[1:]:
        side, short, half = _level(level)
        if len(a) - low - high != short:
            return False
        if side == "<":
            low += half
        elif a[low : low + half] == b[low : low + half]:
            return False
        else:
            high += short - half
    return True


def near_pairs(shard: str, low: int, high: int, some: list[tuple[str, int]]) -> Iterator[tuple[int, int]]:
    """(i, j) of the rows of a shard that are one edit apart, each pair in one shard.

    Rows go by length, so that each one looks up those before it: at a length of one less or the same. One edit changes two of a part's
    bigrams (ends count as letters) and moves the others by one place at most.
    """
    some.sort(key=lambda r: (len(r[0]), r[0]))
    parts = [w[low : len(w) - high] for w, _ in some]
    side, short, half = _level(shard.rsplit("|", 1)[-1])
    shorter = low + high + (short - half if side == "<" else half)
    postings: dict[tuple[str, int], list[int]] = {}
    for i, part in enumerate(parts):
        grams = [(x + y, k) for k, (x, y) in enumerate(itertools.pairwise(f"<{part}>"))]
        need = len(part) - 1
        if need < 1:
            met: Iterator[tuple[int, int]] = ((j, 1) for j in range(i))
        else:
            lists = [postings[g, k + move] for g, k in grams for move in (-1, 0, 1) if (g, k + move) in postings]
            met = ((j, sum(1 for _ in same)) for j, same in itertools.groupby(heapq.merge(*lists)))
        for j, count in met:
            if count >= need and some[j][0] != some[i][0] and one_edit(parts[j], part) and answers(some[j][0], some[i][0], shard):
                yield j, i
        if len(some[i][0]) == shorter:
            for g in grams:
                postings.setdefault(g, []).append(i)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's words with numbers of near words and the most frequent one; rows of a shard follow each other."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("shard", "low", "high", "word", "n")), strict=True)

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])

    out: list[tuple] = []
    for (shard, low, high), group in itertools.groupby(rows(), key=lambda r: r[:3]):
        some = [r[3:] for r in group]
        if len(some) < 2:
            continue
        best: dict[int, tuple] = {}
        for pair in near_pairs(shard, low, high, some):
            for i, j in (pair, pair[::-1]):
                n, top = best.get(i, (0, (0, "")))
                best[i] = (n + 1, min(top, (-some[j][1], some[j][0])))
        out += [(some[i][0], n, -top[0], top[1]) for i, (n, top) in best.items()]
        if len(out) > 10_000:
            yield packed(out)
            out = []
    if out:
        yield packed(out)


def near_words(found: DataFrame, local: int = LOCAL) -> DataFrame:
    """(word, n_near, form_n, form) of words with near words; form is the most frequent of them, by code points on ties."""
    dealt = shards(found, local).repartition("shard").sortWithinPartitions("shard")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    met = dealt.mapInArrow(_met, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return met.select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far each round."""
    at = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = keep(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, occur: int = OCCUR, times: int = TIMES, local: int = LOCAL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words.

    Null and empty texts have no words, a null id counts as an empty text, rows given twice count twice; of near words that are equally
    frequent the smallest by code points is the form. An empty table gives no rows; other columns are not looked at.
    """
    found = keep(words(docs, doc_id, text, least, occur), "words")
    near = found.join(keep(near_words(found, local), "near"), "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    near = keep(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms")
    last = roots(near.where("form is not null").select("word", "form"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


#: Words one edit apart, by what is left of them without one code point each. crc32 by its bits, eight a byte.
OP11_SQL = rf"""
WITH RECURSIVE crc(b, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), codes AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents)
  WHERE length(run) >= {LEAST} GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs
), h AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, codes
), made AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h
), w AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OCCUR}
), del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM del a JOIN del b ON b.d = a.d AND b.i = a.i AND b.word <> a.word
  UNION SELECT a.word, w.word, w.n FROM del a JOIN w ON w.word = a.d
  UNION SELECT w.word, a.word, a.n FROM del a JOIN w ON w.word = a.d
), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word
), up(word, last) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.last WHERE f.form IS NOT NULL
)
SELECT f.word AS word, f.form AS form, up.last AS root, f.n AS n, f.n_near AS n_near, f.form_n AS form_n FROM f JOIN up ON up.word = f.word JOIN f g ON g.word = up.last WHERE g.form IS NULL
"""
