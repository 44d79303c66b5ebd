"""Byte-level BPE ids, the exact length histogram, and packing by dominance reduction and best fit."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keep

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
END_ID = 2
_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids, equal to those of the vocabulary's tokenizers file with add_special_tokens=False.

    The same ranks are applied by the faster library; a text that spells out the special token goes to the tokenizers file.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list = []

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text:
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=())

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


# --- token counts -----------------------------------------------------------------------------------------------------


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): documents by exact encoded length; a null text counts as empty (length 0), each of repeated rows for itself.
    An empty table gives no row."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            found, n = np.unique(np.fromiter((len(encode(t.as_py() or "")) for t in b.column(0)), np.int64, b.num_rows), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["n_tokens", "n"])

    return docs.select(F.col(text)).mapInArrow(lengths, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame, width: int = 1024) -> DataFrame:
    """For each length L in the histogram, taken as a context limit: how many documents and tokens lie at or above L and below it,
    and the corpus total when each document is cut to L tokens.

    Sums run in two levels (inside blocks of ``width`` lengths, then over block totals), so that no task sorts the whole histogram.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / width)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c + k) for c in "dt" for k, w in (("_above", above), ("_below", below))))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    under = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d_above")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("t_above")).alias("tokens_at_least"),
        (F.coalesce(F.sum("n_docs").over(under), F.lit(0)) + F.col("d_below")).alias("docs_below"),
        (F.coalesce(F.sum("tokens").over(under), F.lit(0)) + F.col("t_below")).alias("tokens_below"),
    )
    return out.withColumn("truncated_total", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).withColumn("quantile", (F.col("docs_below") + F.col("n_docs")) / (F.col("docs_below") + F.col("docs_at_least")))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, and tokens left when each document is cut to ``limit``."""
    cut = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_total"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length L such that a share of at least ``q`` of the documents have at most L tokens (null for no documents)."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


# --- best-fit packing -------------------------------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and then END_ID, cut into ``limit`` ids where longer; the first piece takes what is over.

    A null text is empty: one piece, of END_ID alone. Rows of one id, or of none, are cut each for itself. An empty table gives no row.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                at, n = 0, len(ids) % limit or limit
                for k in range(-(-len(ids) // limit)):
                    rows.append((d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at, n = at + n, limit
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _most(count: dict[int, int], lengths: list[int], room: int) -> int:
    """The largest sum up to ``room`` that some of the items reach (a bit for each sum)."""
    reach, mask = 1, (1 << (room + 1)) - 1
    for s in lengths:
        if s > room:
            break
        n, k = min(count[s], room // s), 1
        while n > 0:
            k = min(k, n)
            reach |= (reach << (k * s)) & mask
            n, k = n - k, 2 * k
        if reach >> room:
            return room
    return reach.bit_length() - 1


def plan_bins(hist: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Packs a histogram of lengths; works on counts, so its cost depends on ``capacity`` only, not on how many items there are.

    First the dominance reduction: an item j with the largest item k that still fits beside it is fixed for good if no set of other
    items fills more of the room beside j than k does: whatever a packing puts beside j could stand in k's place. The remainder is
    packed by best-fit decreasing, over groups of bins in the same state. Returns (length, first rank, items, items a bin, first bin,
    offset) entries, which deal out items of a length by their rank, and the number of bins.
    """
    count = {s: n for s, n in sorted(hist.items()) if n > 0}
    used = dict.fromkeys(count, 0)
    entries, bins = [], 0

    def deal(s: int, n: int, per_bin: int, first: int, offset: int) -> None:
        entries.append((s, used[s], n, per_bin, first, offset))
        used[s] += n
        count[s] -= n

    live = sorted(count)
    changed = True
    while changed:
        changed = False
        for j in sorted(live, reverse=True):
            while count[j]:
                room = capacity - j
                at = bisect_left(live, room + 1) - 1
                while at >= 0 and count[live[at]] <= (live[at] == j):
                    at -= 1
                if at < 0:
                    n = count[j]
                    deal(j, n, 1, bins, 0)
                    bins, changed = bins + n, True
                    break
                k = live[at]
                if k < room:
                    count[j] -= 1
                    most = _most(count, live, room)
                    count[j] += 1
                    if most > k:
                        break
                n = count[j] // 2 if k == j else min(count[j], count[k])
                if k == j:
                    deal(j, 2 * n, 2, bins, 0)
                else:
                    deal(j, n, 1, bins, 0)
                    deal(k, n, 1, bins, j)
                bins, changed = bins + n, True
        live = [s for s in live if count[s]]

    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for s in reversed(live):
        while count[s]:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                room, first, n, fresh = capacity, bins, -(-count[s] // (capacity // s)), True
                bins += n
            else:
                room = rooms[at]
                (first, n), fresh = groups[room].pop(), False
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // s
            full = min(n, count[s] // each)
            if full:
                deal(s, full * each, each, first, capacity - room)
                leave(room - each * s, first, full)
            rest = n - full
            if rest and count[s]:
                k = count[s]
                deal(s, k, k, first + full, capacity - room)
                leave(room - k * s, first + full, 1)
                full, rest = full + 1, rest - 1
            if not fresh:
                leave(room, first + full, rest)
    return entries, bins


def best_fit_pack(pieces: DataFrame, capacity: int, rows_a_task: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), lengths from 1 to ``capacity``.

    Only the histogram of lengths (``capacity`` rows at most) comes to the driver. Each piece gets its rank among those of its length
    from counts by (length, salt), so that a length that very many pieces have is split over tasks; then the plan, which is as
    bounded as the histogram, deals out the ranks. Equal lengths: any of them may take a place.
    """
    spark = pieces.sparkSession
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if hist and not 1 <= min(hist) <= max(hist) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    entries, _ = plan_bins(hist, capacity)
    salts = max(1, sum(hist.values()) // rows_a_task)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    start = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = salted.join(start, ["length", "salt"]).withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1 + F.col("ahead")).drop("salt", "ahead")
    plan = np.array(sorted(entries), np.int64).reshape(-1, 6)
    places = spark.sparkContext.broadcast(plan)
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        span = int(p[:, 1].max(initial=0)) + 1 if len(p) else 1
        wide = float(span) * (capacity + 1) < 2**62
        keys = p[:, 0] * span + p[:, 1] if wide else None
        for b in batches:
            s, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            if wide:
                at = np.searchsorted(keys, s * span + np.minimum(r, span - 1), "right") - 1
            else:
                at = np.array([bisect_left(p[:, :2].tolist(), [int(x), int(y) + 1]) - 1 for x, y in zip(s, r, strict=True)], np.int64)
            e = p[at] if len(at) else p[:0]
            i = r - e[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(e[:, 4] + i // np.maximum(e[:, 3], 1)), pa.array(e[:, 5] + i % np.maximum(e[:, 3], 1) * s)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


# --- queries ----------------------------------------------------------------------------------------------------------


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(documents(spark, sf_dir)))


def pack_documents(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents with their places. The pieces (numbers only) are kept in the shared folder, so that texts are encoded once."""
    return best_fit_pack(keep(cut_pieces(docs, capacity), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
