"""Sessions and tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What streams with state of their own need (``streaming.progress``).
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(name: str = "fractura", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` takes dots as double underscores."""
    b = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.streaming.stateStore.providerClass": ROCKS}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only a session of one machine (tests) may go without: it gets a folder of its
    own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith(("local[", "local,")) and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fractura-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, large: bool = False) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder. For long loops: a checkpoint hands on what the optimiser inferred about its
    columns, which doubles with each renaming join until planning takes longer than the work; a table hands on its size only. ``large``: rows
    of megabytes are written one by one, as thousands would be read at once."""
    path = f"{_shared(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", 1) if large else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more, and lets Spark clean the shuffle files of what is no longer referred to."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for name in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if not name.rpartition("/")[2].startswith("stored-"):
                raise ValueError(f"{name} is no table of stored()")
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        sc._jvm.System.gc()
