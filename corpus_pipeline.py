"""A corpus pipeline in five stages: language, toxicity, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractura.llm import jaccard, language, suffix, tokens, toxicity
from fractura.llm.common import documents, keep

#: SQL can't express the models, the encoding or the packing. Tests hold the operators against brute force, and the stages on tables with
#: null and repeated ids and planted copies, strange texts and toxic texts.
ORACLE_SQL = None


#: A text of this many characters that has a smaller cosine to every language is in none of them.
LONG, RESEMBLES = 200, 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is recognised. Those without a letter go, and those that are long enough to tell and resemble
    no language; profiles are learned from all its rows with a language."""
    found = language.identify(docs, language.learn(docs))
    strange = (F.length("text") >= LONG) & (F.col("cosine") < RESEMBLES)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & ~strange).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored below 0.5 by the model of the labelled documents."""
    return toxicity.score(docs, toxicity.learn(spark, sf_dir)).where("predicted = 0").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each class of the Jaccard join. Of rows with one id the smallest text stays; rows without
    an id are in no class and stay."""
    first = jaccard.join(docs)[0].where("doc_id = class_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "text"]
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r"))
    return one.select("r.*").select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated strings out of the texts; documents of which nothing but white space is left go. Rows without an id stay as they are."""
    named = docs.where("doc_id is not null")
    texts = keep(suffix.repeats(named, kept="text").select("doc_id", "kept_text"), "texts")
    out = named.drop("text", "n_chars").join(texts, "doc_id").withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.trim("text") != "").select(docs.columns).unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences."""
    return tokens.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
