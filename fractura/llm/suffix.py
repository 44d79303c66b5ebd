"""Removal of byte strings that an earlier document already has, by longest previous factors over a sparse suffix array.

A byte goes if a string of ``span`` bytes that covers it also starts in a document with a smaller id (the longest previous factor
there is ``span`` or more). Each such string is found by its anchor, its ``gram``-byte substring of least hash: equal strings have
equal anchors. So only suffixes that start near anchors (about one place in 16) have to be brought together:

1. Documents are written in blocks of some MB to a table in the shared warehouse, bucketed by block, so that later steps meet them
   where they lie. Each block sends, for each distinct anchor with its whole neighbourhood (all strings that have this anchor),
   two hashes and its smallest document.
2. Where a neighbourhood has a smaller document elsewhere, all its strings are earlier ones: done. Where an anchor has several
   neighbourhoods, the first document of each sends the neighbourhood's bytes, and their suffixes are sorted (but for those whose
   string has a hash of its own, which repeat nothing); in suffix order the
   previous or next entry of a smaller document with a common prefix of ``span`` bytes marks a repeat.
3. Each block marks covered bytes and gives its documents.

A block sends each anchor once, however often it occurs there, so no anchor floods a task. Neighbourhoods are compared by 128 bits of
hashes in step 2's first part, by their bytes in the second.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep, shared_dir

SPAN, GRAM = 50, 20
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place on: polynomials of random byte values, doubled in width step by step, mixed at the end."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h, width, at, out, base = _BYTE[data], 1, 0, None, int(_A)
    while True:
        if n & width:
            part = h[at : at + size]
            out = part if out is None else out * np.uint64(base) + part
            at += width
        if 2 * width > n:
            return _mix(out)
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % 2**64


class Anchors:
    """Anchors of a block: documents lie one behind the other in ``data``, document k from ends[k-1] to ends[k].

    Of each anchor: place p, hash key (mixed anew, as least hashes are all small), document number doc and its id, and the starts first..last of the strings that have it.
    """

    STEP = 1 << 15

    def __init__(self, data: np.ndarray, ends: np.ndarray, ids: np.ndarray, span: int = SPAN, gram: int = GRAM):
        self.span, self.reach = span, span - gram
        self.padded = np.concatenate([np.zeros(self.reach, np.uint8), data, np.zeros(span, np.uint8)])
        w, high = span - gram + 1, np.uint64(0xFFFFFFFF00000000)
        places, keys, firsts, lasts = [], [], [], []
        number = np.arange(self.STEP + span, dtype=np.uint64)
        for low in range(0, max(0, len(data) - span + 1), self.STEP):
            h = gram_hashes(data[low : low + self.STEP + span - 1], gram)
            best, width = (h & high) | number[: len(h)], 1
            while 2 * width <= w:
                best, width = np.minimum(best[width:], best[:-width]), 2 * width
            if width < w:
                best = np.minimum(best[w - width :], best[: width - w])
            place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
            stop = low + len(place)
            for e in ends[np.searchsorted(ends, low + 1) : np.searchsorted(ends, stop + span)].tolist():
                place[max(0, e - span + 1 - low) : max(0, min(e, stop) - low)] = -1
            begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            end = np.append(begin[1:], len(place)) - 1
            use = place[begin] >= 0
            begin, end = begin[use], end[use]
            keys.append(_mix(h[place[begin]] * _B))
            places.append(place[begin] + low)
            firsts.append(begin + low)
            lasts.append(end + low)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        p, key, first, last = cat(places, np.int64), cat(keys, np.uint64), cat(firsts, np.int64), cat(lasts, np.int64)
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (first[1:] != last[:-1] + 1)])[: len(p)]
        self.p, self.key, self.first = p[new], key[new], first[new]
        self.last = last[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)] if len(p) else last
        self.doc = np.searchsorted(ends, self.first, "right")
        self.id = ids[self.doc]
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.left = np.minimum(self.p - begins[self.doc], self.reach)
        self.right = np.minimum(ends[self.doc] - self.p, span)
        self.context = self._contexts()
        order = np.argsort(self.key, kind="stable")
        k = self.key[order]
        same = np.concatenate([[False], k[1:] == k[:-1]])[: len(k)]
        again = np.flatnonzero(same | np.append(same[1:], False)[: len(k)])
        part = order[again]
        order[again] = part[np.lexsort((self.id[part], self.context[part], self.key[part]))]
        c = self.context[order]
        head = ~same | np.concatenate([[True], c[1:] != c[:-1]])[: len(k)]
        #: of each distinct neighbourhood, in order of key: its first anchor (of the smallest document)
        self.head = order[head]
        self.cls = np.empty(len(order), np.int64)
        self.cls[order] = np.cumsum(head) - 1

    def bytes_of(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, reach + span) bytes of the neighbourhoods; places outside the document are 0."""
        out = np.lib.stride_tricks.sliding_window_view(self.padded, self.reach + self.span)[self.p[anchors]]
        edge = np.flatnonzero((self.left[anchors] < self.reach) | (self.right[anchors] < self.span))
        at = np.arange(-self.reach, self.span)
        a = anchors[edge]
        out[edge] *= (at >= -self.left[a, None]) & (at < self.right[a, None])
        return out

    def _contexts(self) -> np.ndarray:
        h = self.left.astype(np.uint64) * _A + self.right.astype(np.uint64)
        for low in range(0, len(h), 1 << 12):
            part = np.arange(low, min(len(h), low + (1 << 12)))
            b = self.bytes_of(part)
            if b.shape[1] % 8:
                b = np.concatenate([b, np.zeros((len(b), -b.shape[1] % 8), np.uint8)], axis=1)
            x = h[part]
            for column in np.ascontiguousarray(b.view("<u8").T):
                x = _mix(x * _B + column)
            h[part] = x
        return h


def _rows(t) -> Iterator[dict]:
    for k in range(t.num_rows):
        yield t.slice(k, 1).to_pylist()[0]


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["data"], np.uint8), np.frombuffer(row["ends"], np.int64), np.frombuffer(row["ids"], np.int64)


def _slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for sorted keys: buckets are ranges of keys."""
    if not len(keys):
        return []
    at = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return [(int(at[a]), int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(at)], strict=True)]


def write_blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The documents as a table bucketed by block, a row a block; and the number of buckets of keys.

    The table has as many buckets as Spark allows (spark.sql.sources.bucketing.maxBuckets) or fewer, of about four blocks; with more
    blocks than that a task reads more of them, one after another.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for _, t in held], dtype=np.int64)
            ids = np.array([LAST if d is None else d for d, _ in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), pa.array([b"".join(t for _, t in held)], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], ["block", "data", "ends", "ids"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                held.append((d, t.as_py() or b""))
                size += len(held[-1][1])
                if size >= block_bytes:
                    yield row()
                    n, held, size = n + 1, [], 0
        if held:
            yield row()

    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    parts = int(min(most, max(8, total // (4 * block_bytes))))
    name = f"blocks_{uuid.uuid4().hex}"
    packed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pack, "block long, data binary, ends binary, ids binary")
    packed.write.bucketBy(parts, "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), int(max(1, total // BUCKET_BYTES))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, kept: str = "digest") -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and by ``kept`` either kept_sha256
    ("digest"), the removed [from, to) ``spans`` ("spans") or ``kept_text`` ("text": the remaining bytes; a character that lost
    some of its bytes is left out).

    Null texts are empty; a null id counts as the largest. Rows of one id do not count as earlier than each other. Texts of less
    than ``span`` bytes stay.
    """
    blocks, buckets = write_blocks(docs, doc_id, text, block_bytes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                a = Anchors(*_read(row), span, gram)
                cut = _slices(a.key[a.head], buckets)
                pick = lambda x: pa.array([x[a.head[i:j]].tobytes() for _, i, j in cut], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cut], pa.int32()), pa.array([row["block"]] * len(cut), pa.int64()), pick(a.key), pick(a.context), pick(a.id)], ["bucket", "block", "key", "context", "id"])

    sent = blocks.mapInArrow(send, "bucket int, block long, key binary, context binary, id binary")
    reply = "round int, bucket int, block long, answer binary"

    def compare(t: pa.Table) -> pa.Table:
        rows = t.sort_by("block").to_pylist()
        size = [len(r["key"]) // 8 for r in rows]
        key, context, ids = (np.frombuffer(b"".join(r[c] for r in rows), k) for c, k in (("key", np.uint64), ("context", np.uint64), ("id", np.int64)))
        order = np.lexsort((ids, context, key))
        k, c, d = key[order], context[order], ids[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
        run = np.cumsum(new) - 1
        earliest = d[new][run]
        several = (np.bincount(np.cumsum(new_key) - 1, new) > 1)[np.cumsum(new_key) - 1]
        answer = np.empty(len(order), np.uint8)
        answer[order] = np.where(earliest < d, 1, np.where(several, 2, 0))
        cut = np.cumsum(size)
        return pa.table({"round": pa.array([1] * len(rows), pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int64()), "answer": pa.array([answer[b - n : b].tobytes() for n, b in zip(size, cut, strict=True)], pa.binary())})

    def answers(rows: list[dict], round_: int) -> np.ndarray:
        return np.frombuffer(b"".join(r["answer"] for r in sorted((r for r in rows if r["round"] == round_), key=lambda r: r["bucket"])), np.uint8 if round_ == 1 else np.uint32)

    first = keep(sent.groupBy("bucket").applyInArrow(compare, reply), "replies")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, block, n, context, window, ids = [], [], [], [], [], []
        for row in _rows(left):
            a = Anchors(*_read(row), span, gram)
            want = a.head[answers(right.to_pylist(), 1) == 2]
            for k, i, j in _slices(a.key[want], buckets):
                w = want[i:j]
                bucket.append(k)
                block.append(row["block"])
                context.append(a.bytes_of(w).tobytes())
                window.append(np.stack([a.first[w] - a.p[w] + a.reach, a.last[w] - a.p[w] + a.reach], axis=1).astype(np.uint8).tobytes())
                ids.append(a.id[w].tobytes())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int64()), "context": pa.array(context, pa.binary()), "window": pa.array(window, pa.binary()), "id": pa.array(ids, pa.binary())})

    asked = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask, "bucket int, block long, context binary, window binary, id binary")

    def settle(t: pa.Table) -> pa.Table:
        rows = t.sort_by("block").to_pylist()
        size = [len(r["id"]) // 8 for r in rows]
        ids = np.frombuffer(b"".join(r["id"] for r in rows), np.int64)
        context = np.frombuffer(b"".join(r["context"] for r in rows), np.uint8).reshape(len(ids), -1)
        window = np.frombuffer(b"".join(r["window"] for r in rows), np.uint8).reshape(-1, 2).astype(np.int64)
        entry = np.repeat(np.arange(len(ids)), window[:, 1] - window[:, 0] + 1)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(window[:, 1] - window[:, 0] + 1) - (window[:, 1] - window[:, 0] + 1), window[:, 1] - window[:, 0] + 1) + window[entry, 0]
        h = gram_hashes(context.reshape(-1), span)[entry * context.shape[1] + at]
        order = np.argsort(h, kind="stable")
        same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
        twice = np.sort(order[same | np.append(same[1:], False)])
        repeat = np.zeros(len(entry), bool)
        repeat[twice] = previous_factor(np.lib.stride_tricks.sliding_window_view(context, span, axis=1)[entry[twice], at[twice]], ids[entry[twice]]) >= span
        mask = np.zeros(len(ids), np.uint32)
        np.bitwise_or.at(mask, entry[repeat], np.uint32(1) << at[repeat].astype(np.uint32))
        cut = np.cumsum(size)
        return pa.table({"round": pa.array([2] * len(rows), pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int64()), "answer": pa.array([mask[b - n : b].tobytes() for n, b in zip(size, cut, strict=True)], pa.binary())})

    second = asked.groupBy("bucket").applyInArrow(settle, reply)
    fields = {"digest": ("kept_sha256 string", pa.string()), "spans": ("spans array<struct<start:long,stop:long>>", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "text": ("kept_text string", pa.string())}

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in _rows(left):
            data, ends, ids = _read(row)
            a, got = Anchors(data, ends, ids, span, gram), right.to_pylist()
            one, two = answers(got, 1), answers(got, 2)
            mask = np.zeros(len(a.head), np.uint32)
            mask[one == 2] = two
            mask[one == 1] = 0xFFFFFFFF
            smallest = a.id[a.head][a.cls]
            of_anchor = np.where(a.id > smallest, np.uint32(0xFFFFFFFF), mask[a.cls])
            step = np.zeros(len(data) + 1, np.int32)
            whole = of_anchor == 0xFFFFFFFF
            np.add.at(step, a.first[whole], 1)
            np.add.at(step, a.last[whole] + span, -1)
            some = np.flatnonzero(~whole & (of_anchor > 0))
            k, bit = np.nonzero((of_anchor[some, None] >> np.arange(a.reach + 1, dtype=np.uint32)) & np.uint32(1))
            gone = a.p[some][k] - a.reach + bit
            np.add.at(step, gone, 1)
            np.add.at(step, gone + span, -1)
            cover = np.cumsum(step[:-1]) > 0
            low = 0
            for d, high in zip(ids.tolist(), ends.tolist(), strict=True):
                c = cover[low:high]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8))).reshape(-1, 2)
                body = data[low:high]
                rest = body[~c].tobytes() if len(edge) else body.tobytes()
                last = hashlib.sha256(rest).hexdigest() if kept == "digest" else rest.decode("utf-8", "ignore") if kept == "text" else [{"start": int(x), "stop": int(y)} for x, y in edge]
                out.append((None if d == LAST else d, high - low, int(c.sum()), len(edge), last))
                low = high
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", fields[kept][0].split()[0]), cols, (*[pa.int64()] * 4, fields[kept][1]), strict=True)})

    replies = first.unionByName(keep(second, "replies"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, {fields[kept][0]}")


def previous_factor(strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of the (n, width) byte strings: the longest prefix it shares with a string of a smaller id.

    Strings are sorted (suffix order); common prefixes of neighbours follow; the nearest entry of a smaller id before or behind an
    entry has the longest common prefix with it among all of smaller ids.
    """
    n, width = strings.shape
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    order = np.lexsort((ids, *padded.view(">u8").T[::-1]))
    s, d = strings[order], ids[order]
    same = s[1:] == s[:-1]
    lcp = np.where(same.all(axis=1), width, same.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for way in (1, -1):
        x, link = (d, lcp) if way == 1 else (d[::-1], lcp[::-1])
        to = np.arange(n) - 1
        shared = np.concatenate([[0], link]).astype(np.int64)
        live = np.flatnonzero((to >= 0) & (shared > 0))
        while True:
            live = live[(to[live] >= 0) & (shared[live] > 0)]
            go = live[x[to[live]] >= x[live]]
            if not len(go):
                break
            t = to[go]
            shared[go], to[go] = np.minimum(shared[go], shared[t]), to[t]
            live = go
        found = np.where((to >= 0) & (x[np.maximum(to, 0)] < x), shared, 0)
        out = np.maximum(out, found if way == 1 else found[::-1])
    back = np.empty(n, np.int64)
    back[order] = out
    return back


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
