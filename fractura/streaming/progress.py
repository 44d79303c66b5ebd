"""The state of several runs over their generations, from a stream or a batch of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fractura.operators.control import averaged

#: Less than this is no improvement.
LEAST = 1e-12
SCHEMA = "run string, generation long, offspring long, valid long, best double, best_so_far double, improves boolean, delta double, stale long, stop boolean, validity double"


def generations(candidates: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(run, generation, offspring, valid, best) of candidates(run, ts, objective). A generation is a window of ``width`` (hours, days or
    other fixed lengths), counted from 1970. In a stream it is given out once, when the watermark has passed its end; rows that come
    more than ``late`` behind are left out if their generation has been closed."""
    rows = candidates.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    window = rows.groupBy("run", F.window("ts", width).alias("w")).agg(F.count("*").alias("offspring"), F.count("objective").alias("valid"), F.min("objective").alias("best"))
    start, end = F.unix_seconds("w.start"), F.unix_seconds("w.end")
    return window.select("run", F.floor(start / (end - start)).cast("long").alias("generation"), "offspring", "valid", F.col("best").cast("double").alias("best"))


class Runs(StatefulProcessor):
    """A run's best, the generation that improved on it last, and the average validity. Generations close in their order, so those of one
    batch are sorted and follow all earlier ones."""

    def __init__(self, patience: int, keep: float):
        self.patience, self.keep = patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "best double, last long, validity double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best, last, validity = self.state.get() if self.state.exists() else (None, None, 1.0)
        out = []
        for r in sorted(rows, key=lambda r: r.generation):
            better = r.best is not None and (best is None or r.best < best - LEAST)
            delta = best - r.best if better and best is not None else 0.0
            last = r.generation if better else last
            best = r.best if best is None else best if r.best is None else min(best, r.best)
            validity = self.keep * validity + (1 - self.keep) * r.valid / r.offspring
            stale = None if last is None else r.generation - last
            out.append(Row(run=key[0], generation=r.generation, offspring=r.offspring, valid=r.valid, best=r.best, best_so_far=best, improves=better, delta=delta, stale=stale, stop=stale is not None and stale >= self.patience, validity=validity))
        self.state.update((best, last, validity))
        return iter(out)

    def close(self) -> None:
        pass


def progress(candidates: DataFrame, patience: int = 3, keep: float = 0.75, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """A row for each run and generation that has candidates: their number, the valid ones (with an objective) and their best, the best so
    far, whether it improves (strictly, by 1e-12) and by how much, generations since the last improvement (null before the first), whether they
    reach the patience, and the exponential average of validity from 1.

    The same for a batch and for a stream, which gives out generations as they close (append mode) and needs the RocksDB state store
    (``session`` sets it). Candidates are counted by generation before they meet their run, so that a large run sends one row a generation.
    """
    g = generations(candidates, width, late)
    if candidates.isStreaming:
        return g.groupBy("run").transformWithState(Runs(patience, keep), SCHEMA, "append", "none")
    w = Window.partitionBy("run").orderBy("generation")
    before = F.min("best").over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.col("best").isNotNull() & (F.col("_b").isNull() | (F.col("best") < F.col("_b") - LEAST))
    rows = g.withColumn("_b", before).withColumn("improves", better)
    last = F.max(F.when(F.col("improves"), F.col("generation"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"stale": F.col("generation") - last, "v": F.col("valid") / F.col("offspring"), "best_so_far": F.least("best", "_b"), "delta": F.when(F.col("improves") & F.col("_b").isNotNull(), F.col("_b") - F.col("best")).otherwise(0.0)})
    rows = averaged(rows, {"v": 1.0}, keep, ("run",)).withColumnRenamed("v", "validity")
    return rows.withColumn("stop", F.coalesce(F.col("stale") >= patience, F.lit(False))).select("run", "generation", "offspring", "valid", "best", "best_so_far", "improves", "delta", "stale", "stop", "validity")
