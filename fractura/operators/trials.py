"""Calls that may not end, run in a child process that its parent can kill."""

from __future__ import annotations

import multiprocessing
import os
import resource
import signal
from collections.abc import Callable
from multiprocessing.connection import Connection

#: The child's own alarm rings this many seconds after its parent should have killed it, so that none outlives a lost parent.
GRACE = 5.0


def _serve(pipe: Connection, score: Callable[[dict], float], timeout: float, memory: int | None) -> None:
    os.setsid()
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    if memory is not None:
        with open("/proc/self/statm") as f:
            now = int(f.read().split()[0]) * os.sysconf("SC_PAGE_SIZE")
        resource.setrlimit(resource.RLIMIT_AS, (now + memory, now + memory))
    while True:
        try:
            row = pipe.recv()
        except EOFError:
            return
        signal.setitimer(signal.ITIMER_REAL, timeout + GRACE)
        try:
            value = score(row)
            out = (None, "No result") if value is None else (round(float(value), 5), None)
        except Exception as e:  # noqa: BLE001
            out = (None, f"{type(e).__name__}: {e}")
        signal.setitimer(signal.ITIMER_REAL, 0)
        pipe.send(out)


class Trials:
    """(objective, error) of a row by ``score``. A child process, forked at the first row, scores one row after the other; one that gives
    no answer in ``timeout`` seconds is killed with all it has started, and the next row gets a new one. Leaving the context ends it."""

    def __init__(self, score: Callable[[dict], float], timeout: float, memory: int | None = None):
        self.score, self.timeout, self.memory = score, timeout, memory
        self.child, self.pipe = None, None

    def __enter__(self) -> Trials:
        return self

    def __exit__(self, *_) -> None:
        self._end()

    def __call__(self, row: dict) -> tuple[float | None, str | None]:
        if self.child is None or not self.child.is_alive():
            self._end()
            forked = multiprocessing.get_context("fork")
            self.pipe, theirs = forked.Pipe()
            self.child = forked.Process(target=_serve, args=(theirs, self.score, self.timeout, self.memory), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send(row)
            if self.pipe.poll(self.timeout):
                return self.pipe.recv()
        except (EOFError, OSError):
            self.child.join(GRACE)
            code = self.child.exitcode
            self._end()
            return None, f"Ended with {code}"
        self._end()
        return None, f"Timeout after {self.timeout:g}s"

    def _end(self) -> None:
        if self.child is None:
            return
        try:
            os.killpg(self.child.pid, signal.SIGKILL)
        except ProcessLookupError:
            self.child.kill()
        self.child.join()
        self.pipe.close()
        self.child = None
