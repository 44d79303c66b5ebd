"""The operators 11 to 13 against brute force, on strange rows, and with limits small enough that every path is taken."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fractura.llm import divergence, spelling, tiles

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling variants


def edits(a, b):
    """Levenshtein distance, by the book."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spelled(docs, least, occur, times):
    count = collections.Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= occur}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and edits(w, x) == 1] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


@pytest.mark.parametrize("local", [8_192, 3])
def test_variants_against_brute_force(frame, local):
    rng = random.Random(local)
    base = ["".join(rng.choice("abÉé") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    made = list(base)
    for w in base:
        k = rng.randrange(len(w))
        made += [w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[:k] + "y" + w[k + 1 :]]
    texts = [(d, " ".join(rng.choice(made if rng.random() < 0.4 else base[: 1 + rng.randrange(len(base))]) for _ in range(60))) for d in range(60)]
    texts += [(None, "ABABABAB, Aaaaaa!"), (7, None), (8, ""), (9, "aaaaaa " * 5_000), (9, "aaaaaa " * 5_000), (10, "éÉéÉéÉ1éÉéÉéÉ×÷ÿ"), (11, "naïve ŀong Ωmega")]
    docs = frame([(d, t, None, None, 0) for d, t in texts])
    got = spelling.variants(docs, occur=2, times=2, local=local).collect()
    want = spelled(texts, 6, 2, 2)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == want
    assert len({w[2] for w in want if w[2] != w[0]}) > 5 and any(w[1] and w[1] != w[2] for w in want)
    assert not spelling.variants(docs.limit(0)).collect()


def test_every_near_pair_is_met_once(spark):
    words = ["".join(x) for n in (3, 4) for x in itertools.product("ab", repeat=n)] + ["abcabcabc", "abcabcab", "abcabcabcd", "xbcabcabc"]
    found = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = {w: sum(edits(w, x) == 1 for x in words) for w in words}
    for local in (1, 4, 100):
        got = {r.word: r.n_near for r in spelling.near_words(found, local).collect()}
        assert got == {w: n for w, n in want.items() if n}


# --- near-duplicate vectors


def linked(rows, threshold):
    """(n_links, component) by row number, from all pairs in double precision."""
    ok = [v is not None and label is not None and d is not None and None not in v and np.isfinite(v).all() and any(v) for d, v, label in rows]
    near = collections.defaultdict(list)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        out.append((rows[i][0], len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [2_048, 7])
def test_near_vectors_against_brute_force(spark, rows):
    rng = np.random.default_rng(rows)
    made = []
    for k in range(12):
        center = rng.normal(size=24)
        for _ in range(8):
            made.append((len(made), (center + rng.normal(size=24) * 0.27 * np.linalg.norm(center) / np.sqrt(24)).tolist(), k % 3))
    one = made[5][1]
    made += [(900, one, 1), (900, one, 1), (901, [x * 3 for x in one], 1), (902, one, None), (None, one, 1), (903, None, 1), (904, [0.0] * 24, 1), (905, [None, *one[1:]], 1), (906, [float("nan"), *one[1:]], 1)]
    made += [(907, [float("inf"), *one[1:]], 1), (908, one[:5], 1), (909, one[:5], 1), (910, [], 1), (911, [x * 1e300 for x in one], 1), (912, [x * 1e-300 for x in one], 1), (913, [-x for x in one], 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").withColumns({"n": F.lit(1), "rep": F.lit("x"), "tile": F.lit("y")})
    got = tiles.near_duplicates(df, rows=rows).collect()
    want = linked(made, 0.93)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    assert 20 < sum(n > 0 for _, n, _ in want) < len(want)
    assert not tiles.near_duplicates(df.limit(0)).collect()


def test_int8_bound_holds_and_is_needed():
    """No pair outside the doubtful ones is judged otherwise than in full, at thresholds all over; some doubtful ones are."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 1_500)) * np.exp(rng.normal(size=(60, 1)))
    v[30:] = v[:30] + rng.normal(size=(30, 1_500)) * 0.4
    codes, step, lost = tiles.quantised(v)
    side = tiles.Side({"rep": np.arange(60).tobytes(), "key": np.arange(60).tobytes(), "copies": np.ones(60, int).tobytes(), "codes": codes.tobytes(), "step": step.tobytes(), "lost": lost.tobytes(), "vectors": v.tobytes()})
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    exact = unit @ unit.T
    assert (tiles.code_products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    doubted = 0
    for threshold in np.linspace(-0.1, 1, 45):
        sure, unsure = tiles.verdicts(side, side, threshold, False)
        assert (exact[sure] >= threshold - 1e-12).all() and (exact[~sure & ~unsure] < threshold + 1e-12).all()
        doubted += unsure.sum()
        full = tiles.in_full(side, side, unsure, threshold)
        assert (exact[full] >= threshold - 1e-12).all() and (exact[unsure & ~full] < threshold + 1e-12).all()
    assert doubted


# --- source divergence


def audited(docs, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, df, sources = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        found = [x.translate(AZ) for x in term.findall(text or "")]
        count[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, some in sources.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        total = collections.Counter()
        for s in some:
            total.update({t: count[lang, s][t] for t in kept})
        p = {}
        for s, c in [(s, count[lang, s]) for s in some] + [(None, total)]:
            size = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}
        far = lambda x, y: (x - y) ** 2 // (x + y)
        for s in some:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o) for o in some if o != s)
            terms = sorted((-far(p[s][t], p[None][t]), t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "pair", o, -v, r) for r, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, -v, r) for r, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_divergence_against_brute_force(spark, frame):
    rng = random.Random(3)
    some = ["the", "Of", "naïve", "été", "東京", "ß", "x", "İstanbul", "ſ", "K", "áb", "😀", "don't", "a1b", "_z", " q"]
    docs = [(" ".join(rng.choice(some[: rng.randint(2, len(some))]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["s", "t", "ü", None])) for _ in range(160)]
    docs += [(None, "en", "empty"), ("", "xx", "a"), ("12 ;", "xx", "b"), (None, "yy", None), ("the " * 20_000, "en", "long"), ("rare word", "zz", "one"), docs[0], docs[0]]
    df = frame([(k % 100, t, lang, s, 0) for k, (t, lang, s) in enumerate(docs)]).withColumns({"term": F.lit(1), "n": F.lit("x"), "salt": F.lit(2), "kept": F.lit(0)})
    got = sorted(map(tuple, divergence.audit(df, least_docs=4, top=3).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == audited(docs, 4, 3)
    assert ("xx", "a", "pair", "b", 0, 1) in got and not divergence.audit(df.limit(0)).collect()


def test_shares_of_counts_beyond_a_long(spark):
    """At corpora of 10^15 terms the numerator needs 26 digits."""
    n, total, kept = 7 * 10**14 + 3, 10**15 + 9, 123_456_789
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


@pytest.mark.parametrize("part", [1, 16_000_000])
def test_terms_of_a_source_leave_a_part_counted(monkeypatch, part):
    monkeypatch.setattr(divergence, "PART", part)
    texts = ["The the THE\x00endé Énd", "", "x1y你好\x7fz the", "123 !?", "\U0001f600 a\u0085b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["e"] * 5), pa.array(["s", "s", "t", "u", "s"]), pa.array([t.encode() for t in texts], pa.binary())], ["lang", "source", "text"])
    got = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    n, docs = collections.Counter(), collections.Counter()
    for s, t in zip("sstus", texts, strict=True):
        terms = re.findall(divergence.TERM, t.translate(str.maketrans(divergence.UPPER, divergence.LOWER)))
        n.update((s, x) for x in terms)
        docs.update({(s, x) for x in terms})
    for want, name in ((n, "n"), (docs, "docs")):
        have = collections.Counter()
        for r in got:
            have[r["source"], r["term"] and r["term"].decode()] += r[name] or 0
        assert {k: v for k, v in have.items() if v} == want
    assert (("u", None) in {(r["source"], r["term"]) for r in got}) and (part == 1 or len(got) == len(n) + 1)
