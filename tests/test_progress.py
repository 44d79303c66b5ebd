"""The state of runs: by hand, and a stream of shuffled files that is stopped and goes on from its checkpoint against the batch."""

import datetime
import random

from fractura.streaming.progress import progress

SCHEMA = "run string, ts timestamp, objective double"


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def key(rows, first):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r.run, r.generation - first, *r[2:])) for r in rows)


def test_by_hand(spark):
    rows = [("a", at(0), None), ("a", at(1), 5.0), ("a", at(1, 3), 4.0), ("a", at(2), 4.0), ("a", at(4), None), ("a", at(4, 1), 6.0), ("a", at(5), 1.0), ("b", at(1), 7.0)]
    got = progress(spark.createDataFrame(rows, SCHEMA), patience=3, keep=0.5).collect()
    first = min(r.generation for r in got)
    assert key(got, first) == [
        ("a", 0, 1, 0, None, None, False, 0.0, None, False, 0.5),
        ("a", 1, 2, 2, 4.0, 4.0, True, 0.0, 0, False, 0.75),
        ("a", 2, 1, 1, 4.0, 4.0, False, 0.0, 1, False, 0.875),
        ("a", 4, 2, 1, 6.0, 4.0, False, 0.0, 3, True, 0.6875),
        ("a", 5, 1, 1, 1.0, 1.0, True, 3.0, 0, False, 0.84375),
        ("b", 1, 1, 1, 7.0, 7.0, True, 0.0, 0, False, 1.0),
    ]


def test_a_stream_equals_the_batch_after_a_restart(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"r{rnd.randrange(4)}", at(day, rnd.randrange(24)), rnd.choice([None, round(rnd.random() * 9, 2)])) for day in range(12) for _ in range(15)]
    halves = ([r for r in rows if r[1] < at(6)], [r for r in rows if r[1] >= at(6)])
    src, out, end = str(tmp_path / "in"), str(tmp_path / "out"), ("end", at(40), 1.0)
    for half, more in zip(halves, ([], [end]), strict=True):
        rnd.shuffle(half)
        spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if more:
            spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = progress(spark.readStream.schema(SCHEMA).parquet(src))
        q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    # far behind the watermark by now: left out
    spark.createDataFrame([("r0", at(1), -1.0)], SCHEMA).write.mode("append").parquet(src)
    q = progress(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r for r in spark.read.parquet(out).collect() if r.run != "end"]
    want = progress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(want) > 40 and key(got, 0) == key(want, 0)
