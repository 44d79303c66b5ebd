"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

Each word gives the network its own evidence (smoothed log odds in the labelled sample) and its characters' (the log odds of its
3- to 6-character grams, largest and mean). All windows of 32 words, 16 apart, are scored; a text's score is that of its worst window.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, table
from .language import letter_table

WINDOW, STRIDE = 32, 16
HIDDEN, INPUTS = 8, 6
GRAMS = (3, 4, 5, 6)
#: Bounds of the sample the model is fitted to: rows of each label, and characters of a row (longer ones are left out of the fit only).
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 40_000
SEED = 11
#: Characters that are split into words at once.
GROUP_CHARS = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words (runs of letters, lower case) of some texts, in order: hashes, n-gram hashes with the word they belong to, text numbers."""

    hash: np.ndarray
    grams: dict[int, np.ndarray]
    gram_word: dict[int, np.ndarray]
    text: np.ndarray
    per_text: np.ndarray


def split(texts: list[str | None]) -> Words:
    low = [(t or "").lower() for t in texts]
    c = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[c]
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    v = c[letter].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(size) - size
    at = np.arange(len(v)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _M, np.uint64))
        h = _mix(np.add.reduceat(_mix(v) * power[at], first)) if len(v) else np.zeros(0, np.uint64)
        grams, owner = {}, {}
        g = v.copy()
        for n in range(2, max(GRAMS) + 1):
            g = g[:-1] * _M + v[n - 1 :] if len(g) > 1 else g[:0]
            if n in GRAMS:
                inside = at[: len(g)] + n <= size[word[: len(g)]]
                grams[n], owner[n] = _mix(g[inside] + np.uint64(n)), word[: len(g)][inside]
    ends = np.cumsum([len(t) + 1 for t in low])
    text = np.searchsorted(ends, start, "right")
    return Words(h, grams, owner, text, np.bincount(text, minlength=len(texts)))


class Odds:
    """Log odds by 64-bit hash, in a table of four places a key; a key whose place is taken has the next free one. Hashes that are not in
    it give 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(16, int(4 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        self.used = np.zeros(1 << bits, bool)
        keys, at = np.unique(keys, return_index=True)
        values, slot = values[at], keys & self.mask
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            first &= ~self.used[slot]
            self.key[slot[first]], self.value[slot[first]], self.used[slot[first]] = keys[first], values[first], True
            keys, values, slot = keys[~first], values[~first], (slot[~first] + np.uint64(1)) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        hit = self.key[slot] == h
        out = np.where(hit, self.value[slot], np.float32(0))
        open_ = np.flatnonzero(~hit & self.used[slot])
        while len(open_):
            slot = (slot if len(slot) == len(open_) else slot[open_]) + np.uint64(1) & self.mask
            want, found = h[open_], self.key[slot]
            hit = (found == want) & self.used[slot]
            out[open_[hit]] = self.value[slot[hit]]
            more = ~hit & self.used[slot]
            open_, slot = open_[more], slot[more]
        return out


class Counts:
    """In how many texts of each label a hash occurs."""

    def __init__(self, toxic: np.ndarray):
        self.toxic = toxic
        self.key, self.n1, self.n0 = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.t1, self.t0 = toxic.sum(), len(toxic) - toxic.sum()

    def add(self, text: np.ndarray, h: np.ndarray) -> None:
        """Hashes of some whole texts (their numbers beside)."""
        text, h = _distinct(text, h)
        key, at = np.unique(np.concatenate([self.key, h]), return_inverse=True)
        y = self.toxic[text]
        n1, n0 = (np.bincount(at, np.concatenate([n, m]), len(key)).astype(np.int32) for n, m in ((self.n1, y), (self.n0, 1 - y)))
        self.key, self.n1, self.n0 = key, n1, n0

    def odds(self, n1, n0, t1, t0):
        return np.clip(np.log((n1 + 1) / (t1 + 2)) - np.log((n0 + 1) / (t0 + 2)), -6, 6)

    def table(self) -> Odds:
        v = self.odds(self.n1, self.n0, self.t1, self.t0)
        use = (np.abs(v) > 0.9) & (self.n1 + self.n0 > 1)
        return Odds(self.key[use], v[use].astype(np.float32))

    def without(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log odds of hashes in texts of label y, when each text's own count is left out."""
        at = np.searchsorted(self.key, h)
        n1, n0 = self.n1[at] - y, self.n0[at] - (1 - y)
        v = self.odds(n1, n0, self.t1 - y, self.t0 - (1 - y))
        return np.where((n1 + n0 > 0) & (np.abs(v) > 0.9), v, 0).astype(np.float32)


def inputs(w: Words, word_odds, gram_odds) -> np.ndarray:
    """(words, INPUTS) features."""
    n = len(w.hash)
    x = np.zeros((n, INPUTS), np.float32)
    if not n:
        return x
    x[:, 0] = word_odds(w.hash)
    total, count = np.zeros(n), np.zeros(n)
    for k, g in enumerate(GRAMS):
        o, owner = gram_odds(w.grams[g]), w.gram_word[g]
        if len(o):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            top = np.maximum.reduceat(o, first)
            if k:
                x[owner[first], k] = top
            total[owner[first]] += np.add.reduceat(o, first)
            count += np.bincount(owner, minlength=n)
    x[:, 4] = total / np.maximum(count, 1)
    x[:, 5] = 1
    return x * np.float32(0.3)


def windows(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each window; a text without words has one empty window; each word is in one window at least."""
    n = np.maximum(1, -(-np.maximum(per_text - (WINDOW - STRIDE), 0) // STRIDE))
    text = np.repeat(np.arange(len(per_text)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(per_text) - per_text
    return text, begin[text] + k * STRIDE, np.minimum(per_text[text] - k * STRIDE, WINDOW)


def gather(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = first[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW) < size[:, None]
    padded = x if len(x) else np.zeros((1, INPUTS), np.float32)
    return np.where(mask[..., None], padded[np.where(mask, at, 0)], 0), mask


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """Two gated recurrent layers side by side (one reads backwards), attention pooling, a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        mat = lambda *s: (rng.normal(0, 0.4, s)).astype(np.float32)
        self.p = {f"{n}{d}": mat(*s) for d in "fb" for n, s in (("W", (INPUTS, 3 * HIDDEN)), ("U", (HIDDEN, 3 * HIDDEN)), ("c", (3 * HIDDEN,)))}
        self.p |= {"A": mat(2 * HIDDEN, HIDDEN), "v": mat(HIDDEN), "o": mat(2 * HIDDEN), "b": np.zeros(1, np.float32)}

    def layer(self, x, mask, d, keep):
        W, U, c, H = self.p["W" + d], self.p["U" + d], self.p["c" + d], HIDDEN
        n, T, _ = x.shape
        h, hs, saved = np.zeros((n, H), np.float32), np.zeros((n, T, H), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = x[:, t] @ W + c
            u = h @ U[:, : 2 * H]
            z, r = _sigmoid(a[:, :H] + u[:, :H]), _sigmoid(a[:, H : 2 * H] + u[:, H:])
            rh = r * h
            q = np.tanh(a[:, 2 * H :] + rh @ U[:, 2 * H :])
            m = mask[:, t, None]
            new = np.where(m, (1 - z) * h + z * q, h)
            if keep:
                saved.append((t, h, z, r, q, rh, m))
            h = new
            hs[:, t] = h
        return hs, saved

    def forward(self, x, mask, keep=False):
        f, sf = self.layer(x, mask, "f", keep)
        b, sb = self.layer(x, mask, "b", keep)
        h = np.concatenate([f, b], axis=2)
        k = np.tanh(h @ self.p["A"])
        e = np.where(mask, k @ self.p["v"], -30)
        w = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = (w[..., None] * h).sum(axis=1)
        return pooled @ self.p["o"] + self.p["b"][0], (sf, sb, h, k, w, pooled)

    def gradients(self, x, mask, y):
        logit, (sf, sb, h, k, w, pooled) = self.forward(x, mask, True)
        p, H, g = self.p, HIDDEN, {n: np.zeros_like(v) for n, v in self.p.items()}
        dl = (_sigmoid(logit) - y) / len(y)
        g["b"][0], g["o"] = dl.sum(), pooled.T @ dl
        dp = dl[:, None] * p["o"]
        dw = (h * dp[:, None]).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nth,nt->h", k, de)
        dk = de[..., None] * p["v"] * (1 - k * k)
        g["A"] = np.einsum("nti,ntj->ij", h, dk)
        dh = w[..., None] * dp[:, None] + dk @ p["A"].T
        for d, saved, part in (("f", sf, dh[..., :H]), ("b", sb, dh[..., H:])):
            U, back = p["U" + d], np.zeros((len(y), H), np.float32)
            for t, h0, z, r, q, rh, m in reversed(saved):
                back = back + part[:, t]
                dn = np.where(m, back, 0)
                dq = dn * z * (1 - q * q)
                drh = dq @ U[:, 2 * H :].T
                dz, dr = dn * (q - h0) * z * (1 - z), drh * h0 * r * (1 - r)
                a = np.concatenate([dz, dr, dq], axis=1)
                g["W" + d] += x[:, t].T @ a
                g["c" + d] += a.sum(axis=0)
                g["U" + d][:, : 2 * H] += h0.T @ a[:, : 2 * H]
                g["U" + d][:, 2 * H :] += rh.T @ dq
                back = np.where(m, 0, back) + dn * (1 - z) + drh * r + a[:, : 2 * H] @ U[:, : 2 * H].T
        return g

    def fit(self, x, mask, y, epochs: int, rng, state: dict, rate: float = 0.01, batch: int = 256) -> None:
        """Adam steps over shuffled batches."""
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                i = order[k : k + batch]
                g = self.gradients(x[i], mask[i], y[i])
                state["t"] = t = state.get("t", 0) + 1
                for n, v in g.items():
                    m, s = state.get(n, (0, 0))
                    state[n] = m, s = 0.9 * m + 0.1 * v, 0.999 * s + 0.001 * v * v
                    self.p[n] = (self.p[n] - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


@dataclass
class Model:
    network: Network
    words: Odds
    grams: Odds
    shift: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text."""
        w = split(texts)
        top = _worst(self.network, inputs(w, self.words, self.grams), w.per_text)
        return _sigmoid(top.astype(float) + self.shift)


def _worst(network: Network, x: np.ndarray, per_text: np.ndarray, argmax: bool = False):
    """The largest window logit of each text (or which window has it), over all windows."""
    text, first, size = windows(per_text)
    logit = np.concatenate([network.forward(*gather(x, first[k : k + 4096], size[k : k + 4096]))[0] for k in range(0, len(text), 4096)] or [np.zeros(0, np.float32)])
    if argmax:
        order = np.lexsort((logit, text))
        last = np.flatnonzero(np.concatenate([text[order][1:] != text[order][:-1], [True]])) if len(order) else order
        return order[last], text, first, size
    top = np.full(len(per_text), -np.inf, np.float32)
    np.maximum.at(top, text, logit)
    return top


def train(texts: list[str | None], toxic: np.ndarray, seed: int = SEED) -> Model:
    """Fits counts and network. A training text's own label never enters its own inputs (its count is left out of the log odds).

    Inputs of all words, 24 bytes each, are in a temporary file, so that memory is that of the texts, their counts and their windows."""
    rng, toxic = np.random.default_rng(seed), np.asarray(toxic, np.int64)
    words, grams, sizes, heats = Counts(toxic), Counts(toxic), [], []
    group = np.cumsum([len(t or "") for t in texts]) // GROUP_CHARS
    groups = [np.flatnonzero(group == g) for g in np.unique(group)]
    for g in groups:
        w = split([texts[k] for k in g])
        words.add(g[w.text], w.hash)
        grams.add(np.concatenate([g[w.text[w.gram_word[n]]] for n in GRAMS]), np.concatenate([w.grams[n] for n in GRAMS]))
    with tempfile.TemporaryFile() as file:
        for g in groups:
            w = split([texts[k] for k in g])
            y = toxic[g[w.text]]
            gram_y = iter([y[w.gram_word[n]] for n in GRAMS])
            part = inputs(w, lambda h, y=y: words.without(h, y), lambda h, gram_y=gram_y: grams.without(h, next(gram_y)))
            file.write(part)
            heats.append(part[:, :5].max(axis=1))
            sizes.append(w.per_text)
        file.flush()
        per_text, heat = np.concatenate(sizes), np.concatenate(heats)
        x = np.memmap(file, np.float32, "r", shape=(len(heat), INPUTS)) if len(heat) else np.zeros((0, INPUTS), np.float32)
    network, state = Network(seed), {}
    text, first, size = windows(per_text)
    for step in range(4):
        if step == 0:
            heats = np.array([heat[a : a + n].max() if n > 0 else 0 for a, n in zip(first, size, strict=True)])
            order = np.lexsort((heats, text))
            chosen = order[np.flatnonzero(np.concatenate([text[order][1:] != text[order][:-1], [True]]))]
        else:
            chosen = _worst(network, x, per_text, argmax=True)[0]
        some = rng.integers(0, len(text), len(texts))
        some = some[toxic[text[some]] == 0]
        use = np.concatenate([chosen, some])
        network.fit(*gather(x, first[use], size[use]), toxic[text[use]].astype(np.float32), max(4, 150 * 256 // max(1, len(use))), rng, state)
    top = _worst(network, x, per_text)
    cuts = np.unique(np.quantile(top, np.linspace(0, 1, 2001)))
    miss = [(toxic[top < c].sum() / max(1, toxic.sum())) + ((1 - toxic[top >= c]).sum() / max(1, (1 - toxic).sum())) for c in cuts]
    good = np.flatnonzero(np.array(miss) <= min(miss) + 1e-9)
    cut = float(cuts[good].mean())
    return Model(network, words.table(), grams.table(), -cut)


def _distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, text))
    t, h = text[order], h[order]
    first = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    return t[first], h[first]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """Fits to at most ``rows`` documents of each label (those of the smallest hash of their key), none longer than ``chars`` characters.

    Only keys meet the labels in a shuffle; texts are then read for the keys picked, whose number is bounded by ``rows``, and come to the
    driver a partition at a time. Rows without key, label or text are not used; of rows with one key the smallest text and the larger label are taken. None if a label has no rows.
    """
    spark = docs.sparkSession
    usable = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= chars)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    marked = labels.where(F.col(toxic).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(toxic).cast("long")).alias("y"))
    known = marked.join(usable.select("k"), "k", "left_semi")
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows).collect()]
    if len({r.y for r in picked}) < 2:
        return None
    few = F.broadcast(spark.createDataFrame(picked, known.schema))
    sample = usable.join(few, "k").groupBy("k", "y").agg(F.min("t").alias("t")).orderBy("y", F.xxhash64("k"), "k").toLocalIterator()
    texts, toxic = zip(*((r.t, r.y) for r in sample), strict=True)
    return train(list(texts), np.array(toxic))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1; without a model 0) and ``predicted`` (1 from 0.5 on) to the rows; columns of these names are replaced.

    Null and empty texts are scored as one empty window, texts of any length by all their windows; rows of one text get
    one score, but for the rounding of single precision, which depends on the texts beside them.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.zeros(b.num_rows)
            sizes = pa.compute.fill_null(pa.compute.utf8_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // GROUP_CHARS
            for g in np.unique(group) if m is not None else ():
                rows = np.flatnonzero(group == g)
                s[rows] = m.score(b.column(at).slice(rows[0], len(rows)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scored, f"{kinds}, score double, predicted int")


def learn(spark: SparkSession, sf_dir: str) -> Model | None:
    """From the labelled documents outside the held-out fold."""
    return fit(documents(spark, sf_dir), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents. One without id is in no fold: nothing is learned from it, and its held_out is null."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, learn(spark, sf_dir)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
