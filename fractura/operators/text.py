"""Text operators: normalising, tokens, TF-IDF, cosine, basins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fractura.session import settle

from .graph import components, static_order

TOKEN = r"[a-z_][a-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)?"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, limit: int) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def words(text: Column, code: bool = False) -> Column:
    """The tokens of a text, repeats kept: names and numbers of the lower-cased text, then the parts of names between ``_``, and, in the
    code view, the first six letters of longer tokens."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    parts = F.filter(F.flatten(F.transform(F.filter(plain, lambda t: t.contains("_")), lambda t: F.split(t, "_"))), lambda t: t != "")
    views = [plain, parts]
    if code:
        views.append(F.transform(F.filter(plain, lambda t: F.length(t) > 6), lambda t: F.substring(t, 1, 6)))
    return F.concat(*views)


def tokens(docs: DataFrame, code: bool = False) -> DataFrame:
    """(doc_id, token): all tokens of each text."""
    return docs.select("doc_id", F.explode(words(F.col("text"), code)).alias("token"))


def tfidf(docs: DataFrame, code: bool = False) -> DataFrame:
    """(doc_id, token, w): tf = count / length, idf = ln((1 + N) / (1 + df)) + 1, vectors of norm 1; texts without tokens have no rows."""
    tf = tokens(docs, code).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    size = tf.groupBy("doc_id").agg(F.sum("n").alias("size"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    idf = df.crossJoin(F.broadcast(total)).select("token", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(size, "doc_id").join(idf, "token").select("doc_id", "token", (F.col("n") / F.col("size") * F.col("idf")).alias("x"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "token", (F.col("x") / F.col("norm")).alias("w"))


def prefixes(weights: DataFrame, least: float) -> DataFrame:
    """The tokens, rarest first, behind which too little of a vector is left for a cosine of ``least`` by itself: two vectors that reach
    it share one of these."""
    df = weights.groupBy("token").agg(F.count("*").alias("df"))
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id").orderBy(F.desc("df"), F.desc("token")))
    return weights.join(df, "token").withColumn("rest", rest).where(F.col("rest") >= least * least - 1e-9).select("doc_id", "token")


def candidates(weights: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: pairs that may reach a cosine of ``least``."""
    some = prefixes(weights, least)
    return some.toDF("a", "token").join(some.toDF("b", "token"), "token").where("a < b").select("a", "b").distinct()


def dots(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs that share a token."""
    one = pairs.join(weights.toDF("a", "token", "wa"), "a")
    return one.join(weights.toDF("b", "token", "wb"), ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def cosines(weights: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine), a < b, of pairs that reach ``least`` (above 0). Only pairs with a common token in their prefixes are computed."""
    weights = settle(weights)
    return dots(weights, candidates(weights, least)).where(F.col("cosine") >= least)


def basins(docs: DataFrame, similar: DataFrame) -> DataFrame:
    """(doc_id, basin): single-linkage classes of documents over similar pairs, numbered from 1 by their smallest ids."""
    c = components(similar.select(F.lit("g").alias("graph_id"), F.col("a").alias("src"), F.col("b").alias("dst")))
    first = docs.select("doc_id").join(c.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("first"))
    heads = first.where("doc_id = first").select(F.lit("g").alias("graph_id"), F.col("first").alias("node"), F.lit(0).alias("zero"))
    number = static_order(heads, F.col("zero")).select(F.col("node").alias("first"), F.col("step").alias("basin"))
    return first.join(number, "first").select("doc_id", "basin")


def concentration(assigned: DataFrame) -> DataFrame:
    """Basins, sum of squared shares, largest share, effective number exp(entropy)."""
    n = assigned.groupBy("basin").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    p = n.crossJoin(F.broadcast(total)).select((F.col("n") / F.col("t")).alias("p"))
    return p.agg(F.count("*").alias("basins"), F.sum(F.col("p") * F.col("p")).alias("hhi"), F.max("p").alias("largest"), F.exp(-F.sum(F.col("p") * F.log("p"))).alias("effective"))
