"""Language identification by hyperdimensional profiles.

Each letter has a random vector of -1 and 1; a trigram's vector binds (multiplies) its letters' vectors, each permuted (rotated) by
its place; a text bundles (adds) its trigrams' vectors, and so does a language. A text gets the language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold

DIMENSIONS = 1024
SEED = 7
UNDETERMINED = "und"
SHARPNESS = 25.0
#: Trigrams whose vectors are multiplied at once, and letters whose vectors are kept.
BLOCK, LETTERS_KEPT = 8_192, 20_000
#: Trigrams that are counted at once.
GROUP_CODES = 2_000_000
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """Trigram codes (21 bits a letter) of the lower-cased text; runs of other characters than letters count as one gap, 0; none for a
    text without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.where(letter_table()[points], points, 0).astype(np.int64)
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:] if len(s) > 2 else np.zeros(0, np.int64)


class Vectors:
    """Trigram vectors, made when first asked for from those of their letters, each of which has its own; at most ``kept`` stay."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED, kept: int = 50_000):
        self.dimensions, self.seed, self.kept = dimensions, seed, kept
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.zeros((0, dimensions), np.int8)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """A row for each code point (or gap): -1 and 1 at random, from the seed and the point."""
        own, at = np.unique(points, return_inverse=True)
        if len(self.letter) + len(own) > LETTERS_KEPT:
            self.letter = {}
        for p in own.tolist():
            if p not in self.letter:
                self.letter[p] = np.random.default_rng([self.seed, p]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return np.stack([self.letter[p] for p in own.tolist()])[at]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code (distinct codes, ``BLOCK`` of them at most)."""
        if len(self.row) + len(codes) > self.kept:
            self.row, self.table = {}, self.table[:0]
        new = np.array([c for c in codes.tolist() if c not in self.row], np.int64)
        if len(new):
            a, b, c = (self.letters((new >> k) & 0x1FFFFF) for k in (42, 21, 0))
            self.row |= {x: len(self.table) + k for k, x in enumerate(new.tolist())}
            self.table = np.concatenate([self.table, np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c])
        return self.table[[self.row[x] for x in codes.tolist()]]


def bundle(counts: list[tuple[np.ndarray, np.ndarray]], vectors: Vectors) -> np.ndarray:
    """A vector for each text from its (distinct codes, counts), the weights square roots of counts; ``BLOCK`` codes at a time."""
    codes, at = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    text = np.repeat(np.arange(len(counts)), [len(c) for c, _ in counts])
    root = np.sqrt(np.concatenate([n for _, n in counts])).astype(np.float32)
    out = np.zeros((len(counts), vectors.dimensions), np.float32)
    for low in range(0, len(codes), BLOCK):
        part = codes[low : low + BLOCK]
        mine = (at >= low) & (at < low + BLOCK)
        weight = np.zeros((len(counts), len(part)), np.float32)
        weight[text[mine], at[mine] - low] = root[mine]
        out += weight @ vectors.of(part).astype(np.float32)
    return out


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A unit vector for each language, from every row with a language and letters. Trigrams are counted by task, then by language;
    what comes to the driver is ``dimensions`` numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(found: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for name, codes in found.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n, pa.int64())], ["lang", "code", "n"])

        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            held = 0
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found.setdefault(name, []).append(codes := trigrams(t.as_py()))
                held += len(codes)
                if held > GROUP_CODES:
                    yield from counted(found)
                    found, held = {}, 0
            yield from counted(found)

    def profile(pdf):
        import pandas as pd

        v, total = Vectors(dimensions, seed), np.zeros(dimensions)
        for k in range(0, len(pdf), BLOCK):
            part = pdf.iloc[k : k + BLOCK]
            total += np.sqrt(part.n.to_numpy(float)) @ v.of(part.code.to_numpy()).astype(float)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "profile": [total / (np.linalg.norm(total) or 1)]})

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang), F.col(text))
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").applyInPandas(profile, "lang string, profile array<double>").collect()
    return {r.lang: np.array(r.profile) for r in sorted(found, key=lambda r: r.lang)}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Adds lang_pred, score (softmax of the scaled cosines, 0 to 1) and cosine to the rows.

    A null text, one without letters, and any text where nothing was learned get ``und`` and 0. Ties go to the first language by name.
    Columns of the same names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "cosine")
    names = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.array([profiles[n] for n in names], np.float32).reshape(len(names), dimensions)))
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(dimensions, seed)
        names, table = shared.value
        for b in batches:
            best, share, cosine = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            for low in range(0, b.num_rows, 128):
                texts = b.column(at).slice(low, 128).to_pylist()
                codes = [np.unique(trigrams(t or ""), return_counts=True) for t in texts]
                rows = [k for k, c in enumerate(codes) if len(c[0]) and names]
                if not rows:
                    continue
                x = bundle([codes[k] for k in rows], v)
                cos = (x @ table.T) / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
                e = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
                top = cos.argmax(axis=1)
                for k, t in zip(rows, top, strict=True):
                    best[low + k] = names[t]
                pick = np.arange(len(rows))
                share[low + np.array(rows)], cosine[low + np.array(rows)] = (e / e.sum(axis=1, keepdims=True))[pick, top], cos[pick, top]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(share), pa.array(cosine)], [*b.schema.names, "lang_pred", "score", "cosine"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{kinds}, lang_pred string, score double, cosine double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents. One without id is in no fold: nothing is learned from it, and its held_out is null."""
    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(fold("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cosine")
