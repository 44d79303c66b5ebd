"""Candidates that never end, die, eat memory or start others."""

import os
import subprocess
import time

import pytest

from fractura.operators import control
from fractura.operators.trials import Trials


def candidate():
    """A function of its own, so that executors need not import this module."""

    def misbehave(row):
        x = row["x"]
        if x == 1:
            while True:
                pass
        if x == 2:
            os._exit(3)
        if x == 3:
            return len(bytearray(1 << 31))
        if x == 4:
            return None
        if x == 5:
            subprocess.run(["sleep", "987"])
        if x == 6:
            raise ValueError("six")
        return x / 3

    return misbehave


WANT = {
    0: (0.0, None),
    1: (None, "Timeout after 1s"),
    2: (None, "Ended with 3"),
    3: (None, "MemoryError: "),
    4: (None, "No result"),
    5: (None, "Timeout after 1s"),
    6: (None, "ValueError: six"),
    7: (2.33333, None),
    8: (2.66667, None),
}


def test_all_rows_get_an_answer():
    began = time.time()
    with Trials(candidate(), 1.0, 1 << 29) as trial:
        assert {x: trial({"x": x}) for x in WANT} == WANT
        child = trial.child.pid
    assert time.time() - began < 20
    with pytest.raises(ProcessLookupError):
        os.kill(child, 0)
    running = [open(f"/proc/{p}/cmdline", "rb").read() for p in os.listdir("/proc") if p.isdigit() and os.path.exists(f"/proc/{p}/cmdline")]
    assert b"sleep\x00987\x00" not in running


def test_candidates_beside_them_are_kept(spark):
    rows = spark.createDataFrame([(x, "code") for x in range(9)], "x long, code string").repartition(3)
    got = control.evaluated(rows, candidate(), "x long, code string", 1.0, 1 << 29).collect()
    assert {r.x: (r.objective, r.error) for r in got} == WANT and {r.code for r in got} == {"code"}
    none = control.evaluated(rows.where("x > 99"), candidate(), "x long, code string", 1.0)
    assert none.columns == ["x", "code", "objective", "error"] and none.collect() == []
