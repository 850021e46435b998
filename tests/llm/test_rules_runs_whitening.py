"""Quality rules, periodic runs and whitening against brute force, on odd and on empty tables."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opsloom.llm import periods, quality, queries, whitening

from . import plain

SF = "/root/testdata/sf0.001"

# --- 11 -------------------------------------------------------------------------------


def counted(text):
    w, lines = plain.words(text), [x for x in (text or "").split("\n") if plain.words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def verdicts(rows, good, buckets, lose):
    """{(doc_id, text): (features, base_failed, kept)} of (doc_id, text) rows."""

    def grams(text):
        h = [zlib.crc32(x.encode()) for x in plain.words(text)]
        return [x % buckets for x in h] + [(x * 1_000_003 + y) % buckets for x, y in zip(h, h[1:], strict=False)]

    raw, of = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in good:
            of.update(grams(t))
    n, k = sum(raw.values()) + buckets, sum(of.values()) + buckets
    weight = {b: math.floor((math.log((of[b] + 1) / k) - math.log((c + 1) / n)) * 1e6 + 0.5) for b, c in raw.items()} if any(of.values()) else Counter()
    total = {t: sum(weight[b] for b in grams(t)) for _, t in rows}
    bins = sorted(math.floor(total[t] / len(grams(t)) / 1000) for d, t in rows if d in good and grams(t))
    cut = None
    if bins:
        low, middle = (bins[min(len(bins) - 1, math.floor(q * len(bins)))] for q in (lose, 0.5))
        cut = (2 * low - middle) * 1000
    out = {}
    for d, t in rows:
        f = counted(t)
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        out[d, t] = (*f, failed, not failed and (cut is None or total[t] >= len(grams(t)) * cut))
    return out


def assessed(docs, trusted, **settings):
    got = quality.assess(docs, quality.fit(docs, trusted, **settings))
    return got, Counter(((r.doc_id, r.text), tuple(r[c] for c in (*quality.FEATURES, "base_failed", "kept"))) for r in got.collect())


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if i % 4 == 0:
            words += ["#$%", "|", "<>"] * rng.randrange(1, 12)
        if i % 5 == 0:
            words += words[: rng.randrange(8, 20)] * rng.randrange(1, 4)
        text = "".join(w + rng.choice([" ", " ", "\n", "\t \n", "\r\n"]) for w in words)
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, " \n\n "), (3, rows[3][1]), (203, "é\U0001f600 " * 30), (None, "a b " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = {i for i in range(120) if i % 4}
    trusted = quality.trusted_ids(spark.createDataFrame([(i, 1) for i in good] + [(0, 0), (None, 1), (1, 1)], "doc_id long, quality int"))
    for buckets, lose in ((quality.BUCKETS, 0.01), (97, 0.2)):
        want = verdicts(rows, good, buckets, lose)
        _, got = assessed(docs, trusted, buckets=buckets, lose=lose)
        assert got == Counter(((d, t), want[d, t]) for d, t in rows)
        assert {k for *_, k in want.values()} == {True, False}


def test_repeated_windows(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 40)] + ["x " * n for n in range(7, 20)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: r.n_repeat_words for r in quality.features(rows).collect()}
    assert got == {i: counted(t)[4] for i, t in enumerate(texts)}


def test_quality_on_odd_tables(spark, odd, odd_rows, no_id, empty):
    trusted = spark.createDataFrame([(5,), (10,), (None,)], "doc_id long")
    got, rows = assessed(odd, trusted)
    assert set(odd.columns) <= set(got.columns) and rows.total() == len(odd_rows)
    assert {(d, f[:5]) for (d, _), f in rows} == {(d, counted(t)) for d, t, _, _ in odd_rows}
    assert assessed(no_id, trusted)[1].total() == 3
    assert assessed(empty, trusted)[1].total() == 0
    assert all(f[-1] != f[-2] for _, f in assessed(odd, trusted.where("false"))[1])  # nobody is trusted: only the base rules decide
    clash = odd.withColumns({c: F.lit("x") for c in ("bucket", "good", "n", "w", "bin", "mean", "weights", "llr", "__words", "__sum", "__i")})
    assert assessed(clash, trusted)[1] == rows


def test_labels_rank_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    model = quality.fit(docs, quality.trusted_ids(labels.where(half)))
    got = quality.assess(docs, model).where("not base_failed").join(labels.where(~half), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.95 and share.get(0, 0) < 0.2


# --- 12 -------------------------------------------------------------------------------


def runs_of(s, times=4, least=6):
    found = {}
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((a, n, p) for (a, n), p in found.items())


def described(words):
    runs = runs_of(words)
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    shown, kept = "".join(f"{a},{n},{p}\n" for a, n, p in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *top, plain.sha(shown), plain.sha(kept), shown, kept)


def test_common_extensions():
    rng = random.Random(7)
    for _ in range(60):
        s = np.array([rng.randrange(1, 3) for _ in range(rng.randrange(1, 150))] + [9])
        pairs = [(i, j) for i in range(0, len(s), 3) for j in range(len(s)) if i != j]
        if not pairs:
            continue
        i, j = np.array(pairs).T
        ahead = periods.Extensions(s)

        def plainly(a, b):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            return k

        assert ahead.common(i, j).tolist() == [plainly(a, b) for a, b in pairs]


def test_cover_brings_every_pair_together():
    for a in range(periods.MODULUS):
        for b in range(periods.MODULUS):
            step = int(periods.STEP[a, b])
            assert {(a + step) % periods.MODULUS, (b + step) % periods.MODULUS} <= set(periods.COVER)


@pytest.mark.parametrize("pairs", [5, 1 << 20])
def test_runs_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periods, "PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(250):
        batch = []
        for _ in range(rng.randrange(1, 6)):
            s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.choice([0, 1, 5, 6, 7, 13, 40, 120]))]
            if s and rng.random() < 0.6:
                a, p = rng.randrange(len(s)), rng.randrange(1, 9)
                s = [x if i < a else s[a + (i - a) % min(p, len(s) - a)] for i, x in enumerate(s)]
            batch.append(np.array(batch[-1] if batch and rng.random() < 0.2 else s, np.int64))
        got = periods.find_runs(batch)
        rows = list(zip(got.text.tolist(), got.start.tolist(), got.length.tolist(), got.period.tolist(), strict=True))
        assert rows == [(k, *r) for k, s in enumerate(batch) for r in runs_of(s.tolist())]


def test_runs_of_documents(spark, odd, odd_rows, no_id, empty):
    got = periods.periodic_runs(odd)
    names = periods.RESULT.fieldNames()
    assert Counter((r.doc_id, tuple(r[n] for n in names)) for r in got.collect()) == Counter((d, described(plain.words(t))) for d, t, _, _ in odd_rows)
    assert periods.periodic_runs(empty).count() == 0
    rows = periods.periodic_runs(no_id, periods.planted(F.col("doc_id"), F.col("text"))).collect()
    assert sorted(r.n_runs for r in rows) == [0, 0, 0] and {r.collapsed for r in rows} == {"", "some words without an id"}
    clash = odd.withColumns({c: F.lit("x") for c in (*names, "__first", "__turn")})
    assert periods.periodic_runs(clash).columns == [*odd.columns, *names]


def test_planted_periods(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    odd_space = "a b  c\x1cd\x85 e"  # only the six ASCII characters separate words
    assert periods.periodic_runs(spark.createDataFrame([(odd_space,)], "text string")).first().collapsed == odd_space
    rows = docs.collect()
    hit = 0
    for d, text in rows:
        w, h = plain.words(text), zlib.crc32(str(d).encode())
        g = h // 10
        if len(w) > 3000:
            continue
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            hit += 1
        assert tuple(got[d])[1:] == described(w)[:7]
    assert hit and len(got) == len(rows)


# --- 13 -------------------------------------------------------------------------------


def whitened_plainly(vectors, k):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return deviation, centred @ u / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_whitening_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(60, d)) * np.linspace(3, 1, d) + 50).astype(np.float32).astype(float)
    bad = [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] * d), (903, [math.inf] + [0.0] * (d - 1)), (904, [0.5] * (d + 1)), (905, [-1e300] * d)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + bad
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, whitened string").repartition(4)
    got = whitening.whiten(table, components=8)
    deviation, want, explained = whitened_plainly(vectors, 8)
    rows = {r.vec_id: r for r in got.collect()}
    assert rows.keys() == set(range(60))
    assert [rows[i].deviation for i in range(60)] == deviation and rows[0].n == 60
    have = np.array([rows[i].whitened for i in range(60)])
    sign = np.sign((have * want).sum(axis=0))
    assert np.abs(have * sign - want).max() < 1e-9 and np.abs(np.array(rows[0].explained) - explained).max() < 1e-12
    assert rows[0].identity_error < 1e-9
    long_form = whitening.components_of(got).collect()
    assert Counter(r.component for r in long_form) == {c: 60 for c in range(1, min(8, d) + 1)}


def test_whitening_on_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema), components=3).collect()
    assert run([]) == [] and run([(1, None), (2, [None])]) == [] and run([(1, [])]) == []
    one = run([(1, [1.0, 2.0])])
    assert one[0].deviation == 0 and one[0].whitened == [None, None] and one[0].explained == [0.0, 0.0] and one[0].identity_error == 0.0
    assert [r.whitened[1] for r in run([(i % 3, [float(i), 2.0 * i]) for i in range(6)])] == [None] * 6  # rank 1
    same = run([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 2.0])])
    assert Counter(r.vec_id for r in same) == {1: 2, None: 1}
    ties = run([(i, [float(i == 0), float(i == 1), float(i == 2), float(i == 3)]) for i in range(4)])
    assert len(ties) == 4 and max(abs(x) for r in ties for x in r.whitened) < 2 and ties[0].identity_error < 1e-9
    big = run([(i, [float(i % 2) * 1e8, float(i)]) for i in range(8)])  # products beyond doubles are exact
    n, s = 8, 4 * (1024 * 10**8 + 100000) + 4 * 100000
    first = next(r for r in big if r.vec_id == 0)
    assert first.deviation is None and n * 100000 - s != 0


def test_leading_vectors():
    rng = np.random.default_rng(3)
    for t in range(60):
        d, k = int(rng.integers(1, 30)), int(rng.integers(1, 9))
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        spectrum = [rng.normal(size=d) ** 2 * 1e6, np.repeat([4.0, 4.0, 1.0, 0.0], d)[::4][:d], 1 + 1e-13 * rng.normal(size=d), np.where(np.arange(d) < 3, 7.0, 0.0)][t % 4]
        m = (q * spectrum) @ q.T
        m = (m + m.T) / 2
        values, u = whitening.leading_vectors(m, k)
        scale, k = np.abs(m).max(), min(k, d)
        assert np.abs(values - np.sort(np.linalg.eigvalsh(m))[::-1][:k]).max() <= 1e-12 * d * scale
        assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and np.abs(m @ u - u * values).max() <= 1e-12 * d * scale


def test_whitening_query(spark):
    rows = queries.QUERIES["op13_embedding_whitening"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    deviation, want, explained = whitened_plainly([vectors[i] for i in ids], 8)
    assert len(rows) == 8 * len(ids)
    have = np.zeros((len(ids), 8))
    place = {i: k for k, i in enumerate(ids)}
    for r in rows:
        have[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]] and abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((have * want).sum(axis=0))
    assert np.abs(have * sign - want).max() < 1e-8
