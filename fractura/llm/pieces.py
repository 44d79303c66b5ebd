"""SentencePiece encoding and decoding of texts of any length, by a max-plus scan over chunks.

A BPE segmentation is the only one in which each two neighbouring pieces are what BPE makes of their own concatenation. So it is a
path of score 0 (all others: minus infinity) through a lattice whose states are (end position, last piece), and chunks of a giant
text can be read independently: each gives a transfer matrix from the pieces that may cross its left end to those that may cross its
right end. Matrices combine associatively; from the states so fixed each chunk is then traced back on its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep

MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 16_384
SPACE = "▁"
#: Neighbours that are combined at once in the tree of matrices.
FAN = 64
#: Chunks whose matrices are combined in one task.
CHUNKS_A_TASK = 500
#: Chunks whose two states are broadcast at most (about 24 MB); with more of them, chunks are shuffled to meet their states.
BROADCAST_CHUNKS = 1_000_000
_models: dict[str, PieceModel] = {}


class PieceModel:
    """A BPE model file with byte fallback: pieces and scores, whole-word encoding, and the lattice at chunk ends."""

    def __init__(self, model: str, words_kept: int = 300_000):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        ids = range(self.sp.get_piece_size())
        plain = [i for i in ids if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        self.id = {self.sp.id_to_piece(i): i for i in plain}
        self.score = {p: self.sp.get_score(i) for p, i in self.id.items()}
        self.byte = [self.sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.reach = max(map(len, self.id), default=1)
        self.bytes_of = [self.sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for i, k in enumerate(self.byte):
            self.bytes_of[k] = bytes([i])
        for i in ids:
            if self.sp.is_control(i):
                self.bytes_of[i] = b""
        self.marked = np.array([self.sp.id_to_piece(i).startswith(SPACE) for i in ids])
        self.words: dict[str, bytes] = {}
        self.words_kept = words_kept
        self.pairs: dict[tuple[str, str], bool] = {}

    # whole words

    def ids(self, text: str) -> bytes:
        """Little-endian uint32 ids of a text without leading mark: words between single spaces are independent of each other."""
        if "  " in text or SPACE in text or text[:1] in ("", " ") or text[-1] == " ":
            return np.array(self.sp.encode(text), "<u4").tobytes()
        words = text.split(" ")
        found = list(map(self.words.get, words))
        if None not in found:
            return b"".join(found)
        if len(self.words) > self.words_kept:
            self.words.clear()
        gaps = [k for k, x in enumerate(found) if x is None]
        new = list(dict.fromkeys([words[k] for k in gaps]))
        ids = np.array(self.sp.encode(" ".join(new)), "<u4")
        first = (np.flatnonzero(self.marked[ids]) * 4).tolist()
        flat = ids.tobytes()
        self.words.update(zip(new, map(flat.__getitem__, map(slice, first, [*first[1:], len(flat)])), strict=True))
        for k in gaps:
            found[k] = self.words[words[k]]
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes; the mark in front of the first word goes."""
        out = b"".join([self.bytes_of[i] for i in ids.tolist()])
        return out[1:] if out[:1] == b" " else out

    # the lattice

    def bpe(self, text: str) -> list[str]:
        """Plain BPE of a short string: the best-scored neighbours merge first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[m], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.score]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a."""
        if (a, b) not in self.pairs:
            if len(self.pairs) > self.words_kept:
                self.pairs.clear()
            self.pairs[a, b] = self.bpe(a + b) == [a, b]
        return self.pairs[a, b]

    def from_(self, text: str, at: int) -> list[str]:
        """Pieces that start at a place (a character outside the model is a piece of its own)."""
        out = [p for n in range(1, self.reach + 1) if at + n <= len(text) and (p := text[at : at + n]) in self.id]
        return out if text[at] in self.id else [text[at], *out]

    def piece_ids(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.byte[x] for x in piece.encode()]


def model(name: str) -> PieceModel:
    if name not in _models:
        _models[name] = PieceModel(name)
    return _models[name]


#: A place where pieces always end: no piece holds a mark behind another character.
SYNC = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def crossing(m: PieceModel, left: str, right: str) -> list[tuple[int, str]]:
    """States at a chunk end: (how far back the last piece before it starts, that piece). left, right: what stands around the end."""
    text, b = left + right, len(left)
    return [(b - at, p) for at in range(max(0, b - m.reach), b) for p in m.from_(text, at) if at + len(p) >= b]


def forward(m: PieceModel, text: str, starts: dict[tuple[int, str], int], stop: int) -> tuple[dict[tuple[int, str], int], dict]:
    """Boolean max-plus pass: from states (end, last piece) with a bit for each origin to the states whose piece starts before
    ``stop`` and ends at or after it. Returns those and, for tracing back, the predecessors of each state."""
    open_: dict[int, dict[str, int]] = {}
    for (end, p), bits in starts.items():
        open_.setdefault(end, {})[p] = bits
    done: dict[tuple[int, str], int] = {}
    back: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for at in range(min(open_, default=stop), stop):
        here = open_.pop(at, None)
        if not here:
            continue
        for q in m.from_(text, at):
            bits = 0
            for p, x in here.items():
                if not p or m.fits(p, q):
                    bits |= x
                    back.setdefault((at + len(q), q), []).append((at, p))
            if bits:
                if at + len(q) >= stop:
                    done[at + len(q), q] = done.get((at + len(q), q), 0) | bits
                else:
                    spot = open_.setdefault(at + len(q), {})
                    spot[q] = spot.get(q, 0) | bits
    for end, here in open_.items():
        for p, x in here.items():
            if end >= stop:
                done[end, p] = done.get((end, p), 0) | x
    return done, back


def trace(back: dict, state: tuple[int, str], first: set[tuple[int, str]], feasible) -> list[str]:
    """The pieces from a start state to ``state``; feasible(start) tells which start is the right one."""
    stack = [(state, ())]
    while stack:
        s, tail = stack.pop()
        if s in first and feasible(s):
            out: list[str] = []
            while tail:
                p, tail = tail
                out.append(p)
            return out
        for before in back.get(s, ()):
            stack.append((before, (s[1], tail)))
    raise ValueError("no segmentation")


def _lattice(m: PieceModel, left: str, body: str, right: str, last: bool):
    """Entry states, and where the first and last sure piece ends of the chunk are (positions in left+body+right)."""
    text, b, e = left + body + right, len(left), len(left) + len(body)
    entry = [(0, "")] if not left else crossing(m, left, body + right)
    ends = {(b - o + len(p), p): k for k, (o, p) in enumerate(entry)} if left else {(0, ""): 0}
    low = max((s for s, _ in ends), default=b)
    first = SYNC.search(text, max(low, b), e)
    end = text.rfind(SPACE, max(low, b), e)
    while end > 0 and text[end - 1] == SPACE:
        end = text.rfind(SPACE, max(low, b), end)
    sync = [first.start(), end] if first else []
    return text, b, e, entry, ends, sync


def transfer(m: PieceModel, left: str, body: str, right: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]], list[list[bool]]]:
    """The transfer matrix of a chunk: entry states, exit states, and whether a path joins them."""
    text, b, e, entry, ends, sync = _lattice(m, left, body, right, not right)
    starts = {s: 1 << k for s, k in ends.items()}
    leave = crossing(m, left + body, right) if right else [(0, "")]
    if sync:
        reach, _ = forward(m, text, starts, sync[0])
        bits = 0
        for (end, _), x in reach.items():
            bits |= x if end == sync[0] else 0
        done, _ = forward(m, text, {(sync[-1], ""): bits}, e)
    else:
        done, _ = forward(m, text, starts, e)
    if right:
        got = [done.get((e - o + len(p), p), 0) for o, p in leave]
    else:
        got = [0]
        for x in done.values():
            got[0] |= x
    return entry, leave, [[bool(x >> k & 1) for x in got] for k in range(len(entry))]


def backtrace(m: PieceModel, left: str, body: str, right: str, entry: int, leave: int) -> bytes:
    """Ids of the pieces that start in the chunk, given its entry and exit states (numbers)."""
    text, b, e, states, ends, sync = _lattice(m, left, body, right, not right)
    start = next(s for s, k in ends.items() if k == entry)

    def path(begin: tuple[int, str], stop: int, goal) -> bytes:
        done, back = forward(m, text, {begin: 1}, stop)
        state = next(s for s in done if goal(s))
        pieces = [] if state == begin else trace(back, state, {begin}, lambda _: True)
        return np.array([i for p in pieces for i in m.piece_ids(p)], "<u4").tobytes()

    if right:
        o, p = crossing(m, left + body, right)[leave]
        goal = lambda s: s == (e - o + len(p), p)
    else:
        goal = lambda s: True
    if not sync:
        return path(start, e, goal)
    middle = text[sync[0] : sync[-1]]
    return path(start, sync[0], lambda s: s[0] == sync[0]) + (m.ids(middle[1:].replace(SPACE, " ")) if middle else b"") + path((sync[-1], ""), e, goal)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two transfer matrices (0 and minus infinity as true and false); associative."""
    return (a.astype(np.int32) @ b.astype(np.int32)) > 0


def choose(matrices: list[np.ndarray], first: int, last: int) -> list[tuple[int, int]]:
    """Entry and exit state of each part on the one path from state ``first`` to state ``last``: suffix products meet the path so far."""
    after = [np.arange(matrices[-1].shape[1]) == last]
    for x in reversed(matrices):
        after.append(x[:, after[-1]].any(axis=1))
    after.reverse()
    state, out = first, []
    for k, x in enumerate(matrices):
        nxt = np.flatnonzero(x[state] & after[k + 1])
        if len(nxt) != 1:
            raise ValueError("not one segmentation")
        out.append((state, int(nxt[0])))
        state = int(nxt[0])
    return out


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row.matrix, np.uint8).reshape(row.n_in, -1) > 0


MATRIX = "row long, part int, n_in int, matrix binary"


def fixed_states(matrices: DataFrame, parts: int, fan: int = FAN, tasks: int = 8) -> DataFrame:
    """(row, part, entry, leave) from (row, part, n_in, matrix): a tree over each row's parts. Upwards, up to ``fan`` neighbours are
    combined to one matrix, until a row has a single one; downwards, each node's two states give those of its children. ``parts`` is
    the largest number of parts of a row, ``tasks`` what a level is dealt out to: small as matrices are, they take their time."""
    import pandas as pd

    def up(pdf):
        rows = list(pdf.sort_values("part").itertuples())
        total = _matrix(rows[0])
        for r in rows[1:]:
            total = combine(total, _matrix(r))
        return pd.DataFrame({"row": [rows[0].row], "part": [rows[0].part // fan], "n_in": [len(total)], "matrix": [total.astype(np.uint8).tobytes()]})

    def down(pdf):
        rows = list(pdf.sort_values("part").itertuples())
        found = choose([_matrix(r) for r in rows], int(rows[0].entry), int(rows[0].leave))
        return pd.DataFrame({"row": rows[0].row, "part": [r.part for r in rows], "entry": [a for a, _ in found], "leave": [b for _, b in found]})

    above = F.floor(F.col("part") / fan).cast("int")
    dealt = lambda df: df.repartition(tasks, "row", "above")
    levels = [matrices]
    while parts > 1:
        levels.append(keep(dealt(levels[-1].withColumn("above", above)).groupBy("row", "above").applyInPandas(up, MATRIX), "matrices"))
        parts = -(-parts // fan)
    states = levels[-1].select("row", "part", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in levels[-2::-1]:
        own = level.withColumn("above", above).join(states.select("row", F.col("part").alias("above"), "entry", "leave"), ["row", "above"])
        states = dealt(own).groupBy("row", "above").applyInPandas(down, "row long, part int, entry int, leave int")
    return states


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_name: str = MODEL, chunk_chars: int = CHUNK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row, chunk, n_chunks, ids array<int>, and the ``carry`` columns): the ids of each row's text, a row for each chunk of
    ``chunk_chars`` characters.

    Ids equal the library's encode(text). Null counts as empty: one chunk without ids. Repeated and null ids of documents are kept
    apart by ``row``, a number of its own for each row of the input. Texts of one chunk are encoded where they are. Giant ones are cut
    in one pass and their chunks written to the shared folder; only the small matrices are brought together, in a tree.
    """
    size, reach = F.length("_t"), 64
    number = F.monotonically_increasing_id()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), *(F.col(c) for c in carry))
    short = base.where(size <= chunk_chars).select("doc_id", (number * 2).alias("row"), *carry, "_t")
    giant = base.where(size > chunk_chars).select("doc_id", (number * 2 + 1).alias("row"), *carry, "_t")
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in short.schema.fields[:-1])
    names = short.columns[:-1]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            yield _out(b.columns[:-1], names, [0] * b.num_rows, [1] * b.num_rows, [m.ids(t) if t else b"" for t in b.column("_t").to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t = SPACE + b.column("_t")[k].as_py().replace(" ", SPACE)
                n = -(-len(t) // chunk_chars)
                for low in range(0, n, 64):
                    at = range(low, min(n, low + 64))
                    parts = [[t[max(0, c * chunk_chars - reach) : c * chunk_chars] for c in at], [t[c * chunk_chars : (c + 1) * chunk_chars] for c in at], [t[(c + 1) * chunk_chars : (c + 1) * chunk_chars + reach] for c in at]]
                    same = [pa.compute.take(x, pa.array([k] * len(at))) for x in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(list(at), pa.int32()), pa.array([n] * len(at), pa.int32()), *(pa.array(x, pa.string()) for x in parts)], [*names, "part", "n_chunks", "left", "body", "right"])

    chunks = keep(giant.mapInArrow(cut, f"{head}part int, n_chunks int, left string, body string, right string").repartition("row", "part"), "chunks")
    most = chunks.agg(F.max("n_chunks"), F.count("*")).first()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            found = [transfer(m, *x)[2] for x in zip(*(b.column(c).to_pylist() for c in ("left", "body", "right")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), pa.array([len(x) for x in found], pa.int32()), pa.array([bytes(np.array(x, np.uint8).tobytes()) for x in found], pa.binary())], ["row", "part", "n_in", "matrix"])

    states = keep(fixed_states(keep(chunks.mapInArrow(matrices, MATRIX), "matrices"), most[0] or 0, tasks=max(8, most[1] // CHUNKS_A_TASK)), "states")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            found = [backtrace(m, *x) for x in zip(*(b.column(c).to_pylist() for c in ("left", "body", "right", "entry", "leave")), strict=True)]
            yield _out([b.column(c) for c in names], names, b.column("part"), b.column("n_chunks"), found)

    schema = f"{head}chunk int, n_chunks int, ids array<int>"
    met = chunks.join(F.broadcast(states) if most[1] <= BROADCAST_CHUNKS else states, ["row", "part"])
    return short.mapInArrow(whole, schema).unionByName(met.mapInArrow(traced, schema))


def _out(same: list, names: list[str], chunk, n_chunks, ids: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
    as_int = lambda x: x if isinstance(x, pa.Array) else pa.array(x, pa.int32())
    return pa.RecordBatch.from_arrays([*same, as_int(chunk), as_int(n_chunks), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*names, "chunk", "n_chunks", "ids"])


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if v & 1:
            out ^= row
        v >>= 1
    return out


def crc32_joined(a: int, b: int, b_bytes: int) -> int:
    """crc32 of two strings one behind the other, from theirs and the length of the second: a is carried over that many zero bytes by
    squarings of the matrix of one zero bit over GF(2)."""
    shift = [0xEDB88320, *(1 << k for k in range(31))]
    bits = 8 * b_bytes
    while bits:
        if bits & 1:
            a = _times(shift, a)
        shift = [_times(shift, x) for x in shift]
        bits >>= 1
    return a ^ b


def digest(encoded: DataFrame, model_name: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row that was encoded (doc_id, row, ``carry``): counts, crc32 of all ids in order, and size and crc32 of the decoded
    text. Each chunk gives numbers only; those of a giant text are joined in order, so that no row holds all its ids."""
    names = ["doc_id", "row", *carry]
    head = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in names)
    parts = ["n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32"]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            out, chunk = [], b.column("chunk").to_numpy()
            offsets, values = b.column("ids").offsets.to_numpy(), b.column("ids").values.to_numpy()
            for k in range(b.num_rows):
                ids = values[offsets[k] : offsets[k + 1]].astype("<u4")
                text = m.decode(ids) if chunk[k] == 0 else b"".join([m.bytes_of[i] for i in ids.tolist()])
                out.append((len(ids), zlib.crc32(ids.tobytes()), len(text), zlib.crc32(text)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), b.column("chunk"), b.column("n_chunks"), *(pa.array(c, pa.int64()) for c in cols)], [*names, "chunk", "n_chunks", *parts])

    each = encoded.select(*names, "chunk", "n_chunks", "ids").mapInArrow(numbers, f"{head}chunk int, n_chunks int, " + ", ".join(f"{c} long" for c in parts))
    together = each.groupBy("row").agg(*(F.first(c).alias(c) for c in (*names[:1], *carry, "n_chunks")), F.array_sort(F.collect_list(F.struct("chunk", *parts))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column("parts").to_pylist():
                n, c, size, d = (row[0][x] for x in parts)
                for p in row[1:]:
                    c, d = crc32_joined(c, p["ids_crc32"], 4 * p["n_tokens"]), crc32_joined(d, p["decoded_crc32"], p["decoded_bytes"])
                    n, size = n + p["n_tokens"], size + p["decoded_bytes"]
                out.append((n, c, size, d))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), b.column("n_chunks"), *(pa.array(c, pa.int64()) for c in cols)], [*names, "n_chunks", *parts])

    return together.mapInArrow(joined, f"{head}n_chunks int, " + ", ".join(f"{c} long" for c in parts))


def decode(encoded: DataFrame, model_name: str = MODEL) -> DataFrame:
    """(doc_id, row, chunk, n_chunks, text binary): the UTF-8 bytes of each chunk; a character that is cut by a chunk end is whole again when chunks are joined."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "chunk", "n_chunks"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for b in batches:
            out = []
            for chunk, ids in zip(b.column("chunk").to_pylist(), b.column("ids").to_pylist(), strict=True):
                text = b"".join(m.bytes_of[i] for i in ids)
                out.append(text[1:] if chunk == 0 and text[:1] == b" " else text)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], [*names, "text"])

    return encoded.select(*names, "ids").mapInArrow(texts, f"doc_id {kind}, row long, chunk int, n_chunks int, text binary")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole documents and their decoding, as digests; ``round_trip`` holds the decoded text against the given one. Each row
    of the table gives one row, whatever its id."""
    given = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("given")
    docs = documents(spark, sf_dir).select("doc_id", "text", given)
    out = digest(encode(docs, carry=("given",)), carry=("given",))
    return out.withColumn("round_trip", F.col("given") == F.col("decoded_crc32")).drop("given", "row")
