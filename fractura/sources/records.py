"""Records of experiments as files: populations, reflections, payloads, seeds, tables, curves and features, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENERATION = r"generation_(-?\d+)\.json$"
CANDIDATE = "algorithm string, code string, objective double, other_inf struct<operator:string,parent:array<string>,anc_prefix_k:double,fht_50:double,fht_10:double,lcc_at_k_frac:double,k:long>, time_select double, time_anc double, unique_id string, llm_raw_response string, llm_reflection string"
REFLECTION = "generation_in long, generation_out long, operator string, offspring_unique_id string, objective double, llm_raw_response string, llm_reflection string"


def generation_of(path: Column) -> Column:
    """The number at the end of a snapshot's name; null for other files."""
    return F.nullif(F.regexp_extract(path, GENERATION, 1), F.lit("")).cast("long")


def _arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each element of JSON files that hold a list or a single record: generation, index (from 1), and the fields."""
    files = spark.read.text(path, wholetext=True).select(generation_of(F.input_file_name()).alias("generation"), F.trim("value").alias("value"))
    listed = F.when(F.substring("value", 1, 1) == "[", F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    rows = files.select("generation", F.posexplode(F.from_json(listed, f"array<struct<{schema.replace(' string', ':string').replace(' double', ':double').replace(' long', ':long').replace(' struct<', ':struct<')}>>")).alias("index", "r"))
    return rows.select("generation", (F.col("index") + 1).cast("long").alias("index"), "r.*")


def populations(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of population snapshots (lists) and best files (single records)."""
    return _arrays(spark, path, CANDIDATE)


def reflections(spark: SparkSession, path: str) -> DataFrame:
    """One row for each offspring id of reflection logs; that of the latest generation wins."""
    rows = _arrays(spark, path, REFLECTION).where(F.coalesce(F.trim("offspring_unique_id"), F.lit("")) != "")
    last = F.row_number().over(Window.partitionBy("offspring_unique_id").orderBy(F.desc("generation"), F.desc("index")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def resumed(snapshots: DataFrame, generation: int) -> DataFrame:
    """The population to go on from: that of the given generation."""
    return snapshots.where(F.col("generation") == generation).drop("generation")


def best_of_each(snapshots: DataFrame) -> DataFrame:
    """The best candidate of each generation, the first of equal ones."""
    rank = F.row_number().over(Window.partitionBy("generation").orderBy(F.col("objective").asc_nulls_last(), "index"))
    return snapshots.withColumn("_r", rank).where("_r = 1").drop("_r")


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, a folder for each value of ``by``."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def results(evaluated: DataFrame) -> DataFrame:
    """(dataset, payload): a JSON record for each dataset, strategy and objective; failed ones have a null objective and their error."""
    ok = F.col("error").isNull()
    return evaluated.select("dataset", F.to_json(F.struct("strategy", "dataset", F.when(ok, "success").otherwise("failed").alias("status"), F.when(ok, F.col("objective")).alias("objective"), "error")).alias("payload"))


def code_of(payloads: DataFrame) -> DataFrame:
    """(id, code) of payloads (id, payload: JSON text): of a list the entry of the smallest objective (the last one if none has any);
    its code, else the fenced block of its raw answer. A payload without either is an error."""
    listed = F.when(F.substring(F.trim("payload"), 1, 1) == "[", F.col("payload")).otherwise(F.concat(F.lit("["), "payload", F.lit("]")))
    kind = "array<struct<objective:double,code:string,llm_raw_response:string>>"
    rows = payloads.select("id", F.from_json(listed, kind).alias("list"))
    some = F.filter("list", lambda x: x.objective.isNotNull())
    best = F.array_min(F.transform(some, lambda x: x.objective))
    pick = F.coalesce(F.try_element_at(F.filter(some, lambda x: x.objective == best), F.lit(1)), F.try_element_at("list", F.lit(-1)))
    fenced = F.regexp_extract(F.col("r.llm_raw_response"), r"(?s)```python\s*(.*?)```", 1)
    code = F.coalesce(F.col("r.code"), F.nullif(F.regexp_replace(fenced, r"^\s+|\s+$", ""), F.lit("")))
    return rows.select("id", pick.alias("r")).select("id", F.coalesce(code, F.raise_error(F.concat(F.lit("no code in payload "), F.col("id").cast("string")))).alias("code"))


def seeds(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(id, code) of seeds (id, code, source): their own code, else that of the file named (files: source, code); neither is an error."""
    met = listed.join(files.select("source", F.col("code").alias("_theirs")), "source", "left")
    missing = F.raise_error(F.concat(F.lit("seed without code: "), F.col("id").cast("string")))
    return met.select("id", F.coalesce("code", "_theirs", missing).alias("code"))


def latest(paths: DataFrame) -> DataFrame:
    """(path, generation) of the snapshot of the largest generation among (path)."""
    return paths.withColumn("generation", generation_of(F.col("path"))).where("generation is not null").orderBy(F.desc("generation"), "path").limit(1)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, quoted or not, with or without a byte order mark; empty cells and ``-`` are null. Columns are taken by
    their names in the header."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    cell = lambda c: F.when(F.trim(c).isin("", "-"), None).otherwise(F.trim(c))
    return raw.select(*(cell(F.col(f"`{name}`")).cast(kind).alias(name) for name, kind in (part.strip().rsplit(" ", 1) for part in schema.split(","))))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def cached(spark: SparkSession, path: str, signature: dict[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gave when it last ran for the same signature (names and texts); made anew and written where there is nothing to read
    or the signature differs. The signature is written last, so that a broken write is never taken for a whole one."""
    wanted = sorted(signature.items())
    try:
        found = sorted((r.name, r.value) for r in spark.read.schema("name string, value string").json(f"{path}/signature").collect())
        if found == wanted:
            return spark.read.parquet(f"{path}/rows")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.createDataFrame([], "name string, value string").write.mode("overwrite").json(f"{path}/signature")
    make().write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame(wanted, "name string, value string").write.mode("overwrite").json(f"{path}/signature")
    return spark.read.parquet(f"{path}/rows")
