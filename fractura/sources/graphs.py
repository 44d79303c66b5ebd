"""Edge lists and GML files as DataFrames, and their sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fractura.operators.graph import canonical, static_order


def edge_list(spark: SparkSession, path: str, graph_id: str = "g") -> DataFrame:
    """Lines of two integers and anything behind them; blank and short lines are skipped."""
    hit = lambda k: F.regexp_extract("value", r"^\s*(-?\d+)\s+(-?\d+)", k)
    rows = spark.read.text(path).where(hit(1) != "")
    return canonical(rows.select(F.lit(graph_id).alias("graph_id"), hit(1).cast("long").alias("src"), hit(2).cast("long").alias("dst")))


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").text(path)


def gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GML files, one graph a file, named by its path: nodes (graph_id, id, node, label, weight) are numbered from 0 in
    file order, edges (graph_id, src, dst, weight) have the largest weight where a pair is repeated, null where none is given."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("graph_id"), F.col("value").alias("t"))
    blocks = lambda kind: files.select("graph_id", F.posexplode(F.regexp_extract_all("t", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\]"), F.lit(1))).alias("pos", "b"))
    part = lambda name: F.regexp_extract("b", rf"\b{name}\s+(-?\d+)", 1).cast("long")
    weight = F.nullif(F.regexp_extract("b", r"\bweight\s+(-?[\d.]+(?:[eE][-+]?\d+)?)", 1), F.lit("")).cast("double").alias("weight")
    label = F.nullif(F.regexp_extract("b", r'\blabel\s+"([^"]*)"', 1), F.lit("")).alias("label")
    nodes = blocks("node").select("graph_id", part("id").alias("id"), F.col("pos").cast("long").alias("node"), label, weight)
    edges = blocks("edge").select("graph_id", part("source").alias("s"), part("target").alias("d"), weight)
    for c, to in (("s", "src"), ("d", "dst")):
        edges = edges.join(nodes.select("graph_id", F.col("id").alias(c), F.col("node").alias(to)), ["graph_id", c])
    both = edges.where("src <> dst").groupBy("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return nodes, both.agg(F.max("weight").alias("weight"))


def synthetic_folder(name: str) -> tuple[str, str]:
    """(type, size) of a dataset name synthetic_<type>_<size or low-high>; the type ``uniform`` is stored as ``uniform_cost``."""
    hit = re.fullmatch(r"[^_]+_(.+)_(\d+|\d+-\d+)", name)
    if not hit:
        raise ValueError(f"not a name of a synthetic dataset: {name}")
    kind, size = hit.groups()
    return "uniform_cost" if kind == "uniform" else kind, size if "-" in size else str(int(size))


def instances(paths: DataFrame, most: int | None = None, once: bool = False) -> DataFrame:
    """(path, instance) of files named g_<number>, numbered from 0 by that number, others last; the first ``most``. ``once``: only names
    that begin so, and of one number the first by name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    strict, loose = F.regexp_extract(name, r"^g_(\d+)", 1), F.regexp_extract(name, r"^g_(\d+)(?:_.*)?$", 1)
    number = F.nullif(strict if once else loose, F.lit("")).cast("long")
    rows = paths.where(name.startswith("g_")).withColumns({"_n": F.coalesce(number, F.lit(10**9)), "_name": name})
    if once:
        first = F.row_number().over(Window.partitionBy("_n").orderBy("_name"))
        rows = rows.where(strict != "").withColumn("_r", first).where("_r = 1")
    rows = rows.withColumn("instance", (F.row_number().over(Window.orderBy("_n", "_name")) - 1).cast("long"))
    return (rows if most is None else rows.where(F.col("instance") < most)).select("path", "instance")


def relabel(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbers nodes from 0 by rising id, per graph."""
    to = static_order(nodes.withColumn("zero", F.lit(0)), F.col("zero")).withColumn("n", F.col("step") - 1)
    for c in ("src", "dst"):
        edges = edges.join(to.select("graph_id", F.col("node").alias(c), F.col("n").alias(f"new_{c}")), ["graph_id", c])
    return edges.select("graph_id", F.col("new_src").cast("long").alias("src"), F.col("new_dst").cast("long").alias("dst"))
