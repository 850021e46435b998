"""The text operators against brute force, on odd and on empty tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsloom.llm import chat, decontaminate, exact_dedup, jaccard, language, line_runs, mixing, queries, secret_scan, tokens, toxicity, warc

from . import plain
from .conftest import PASSAGE

SF = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# --- tokens ---------------------------------------------------------------------------


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_words_and_shingles(monkeypatch, segment):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["".join(rng.choice("aBb \n\té€") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "x" * 300]
    h, rows = tokens.words(pa.array(texts).slice(0))
    want = [(w, i) for i, t in enumerate(texts) for w in plain.words((t or "").translate(plain.FOLD))]
    assert rows.tolist() == [i for _, i in want]
    names = {}
    assert all(names.setdefault(w, x) == x for (w, _), x in zip(want, h.tolist(), strict=True))
    assert len(set(names.values())) == len(names)
    for k in (1, 2, 4):
        got = tokens.gram_sets(pa.array(texts), k)
        for t, g in zip(texts, got, strict=True):
            w = plain.words((t or "").translate(plain.FOLD))
            assert len(g) == len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else ())


def test_byte_ngrams(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 5)
    texts = ["abcabc", "", "ab", "xxabc", None, "ABC"]
    got = Counter()
    for ids, rows in tokens.byte_ngrams(pa.array(texts), 3, 20):
        got.update(zip(rows.tolist(), ids.tolist(), strict=True))
    assert Counter(r for r, _ in got.elements()) == {0: 4, 3: 3, 5: 1}
    abc = next(i for r, i in got if r == 5)
    assert got[0, abc] == 2 and got[3, abc] == 1


@pytest.mark.parametrize("segment", [1, 5, 1 << 20])
def test_char_ngrams(monkeypatch, segment):
    """Equal n-grams of folded characters share a bucket, others do not; short and null texts have fewer or none."""
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    texts = ["Été été", "", "ab", "\U0001f600x\u4e2d\u6587 y", None, "ÉTÉ\tété", "a" * 9, "\u4e2d"]
    got = Counter()
    for ids, rows in tokens.char_ngrams(pa.array(texts), (2, 3), 30):
        got.update(zip(rows.tolist(), ids.tolist(), strict=True))
    folded = [(t or "").lower().replace("\t", " ") for t in texts]
    want = Counter((r, t[i : i + n]) for r, t in enumerate(folded) for n in (2, 3) for i in range(len(t) - n + 1))
    assert sorted((r, c) for (r, _), c in got.items()) == sorted((r, c) for (r, _), c in want.items())
    assert {(i, c) for (r, i), c in got.items() if r == 0} == {(i, c) for (r, i), c in got.items() if r == 5}
    assert len({i for _, i in got}) == len({g for _, g in want})


# --- 1 --------------------------------------------------------------------------------


def test_water_fill_equals_rounds(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {f"s{i}": rng.randrange(0, 500) for i in range(9)}
        weights = {s: rng.choice([0.0, 1.0, 2.0, 7.0]) for s in sizes}
        weights["s0"] = 1.0
        table = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight double")
        got = {r.source: r.target for r in mixing.water_fill(table, 1.5, 2.0).collect()}
        want = plain.water_fill(sizes, weights, 1.5, 2.0)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mix(spark, odd, odd_rows, empty, no_id):
    got = mixing.mix(odd, (5.0, 2.0, 1.0))
    rows = rows_of(got, "doc_id", "source", "size", "source_size", "target", "taken")
    assert Counter((r[0], r[2]) for r in rows) == Counter((d, len(plain.words(t))) for d, t, _, _ in odd_rows)
    taken, target = Counter(), {}
    for _, s, size, _, goal, n in rows:
        assert 0 <= n <= 2 * size
        taken[s] += n
        target[s] = goal
    assert all(abs(taken[s] - int(target[s])) <= 1 for s in target)
    assert sorted(rows, key=str) == sorted(rows_of(mixing.mix(odd.repartition(7), (5.0, 2.0, 1.0)), "doc_id", "source", "size", "source_size", "target", "taken"), key=str)
    made = mixing.materialise(got)
    words = Counter()
    for s, t in rows_of(made, "source", "text"):
        words[s] += len(plain.words(t))
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(empty, (1.0,)).count() == 0
    assert mixing.mix(no_id, (1.0,)).count() == 3
    named = odd.withColumns({c: F.lit("x") for c in ("end", "part", "of", "whole", "rest", "at", "bucket", "n", "weight", "cap", "ratio", "left", "clamped", "total")})
    assert sorted(rows_of(mixing.mix(named, (5.0, 2.0, 1.0)), "doc_id", "end", "taken"), key=str) == sorted(((r[0], "x", r[5]) for r in rows), key=str)
    weights = spark.createDataFrame([("b", 3.0), (None, 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(odd, weights).where("taken > 0").collect()} == {"b", None}


# --- 2 --------------------------------------------------------------------------------


def test_warc_derivatives_and_files(spark, tmp_path):
    html = "<html><title>T &amp; U</title><script>x<y</script><p>Ein <b>Wort</b><br>zwei<!-- n --></p><a href='/q'>l</a>\r\n\r\nend</html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://b/", ""), (1, "http://a/", html)], "page_id long, url string, html string")
    source = warc.responses(pages)
    got = warc.derive(source)
    rows = {(r.page_id, r.type): r for r in got.collect()}
    assert got.count() == 8 and len(rows) == 6
    text = rows[1, "conversion"]
    assert text.block == "T & U\nEin Wort\nzwei\nl\nend"
    ids = {r.page_id: (r.record_id, r.headers["WARC-Payload-Digest"]) for r in source.collect()}
    for (page, _), r in rows.items():
        assert r.refers_to == ids[page][0] and r.headers["WARC-Source-Payload-Digest"] == ids[page][1]
        assert r.headers["WARC-Block-Digest"] == "sha256:" + plain.sha(r.block)
    about = rows[1, "metadata"].block
    assert f"conversion-id: {text.record_id}\r\n" in about and "http-content-type: text/html; charset=utf-8\r\n" in about and "outlinks: 1\r\n" in about
    path = str(tmp_path / "warc")
    warc.write(source.select(*[c for c in source.columns if c != "page_id"]).unionByName(got.drop("page_id"), allowMissingColumns=True), path)
    back = warc.read(spark, path)
    key = lambda df: Counter((r.record_id, r.type, r.refers_to, r.block, tuple(sorted(r.headers.items()))) for r in df.collect())
    assert key(back.where("type <> 'response'")) == key(got)
    assert key(warc.derive(back)) == key(got)
    assert warc.derive(source.where("false")).count() == 0
    odd = spark.createDataFrame([("r", "response", None, None, None, None), ("q", "request", None, None, {}, "x")], warc.RECORD)
    assert {r.block for r in warc.derive(odd).where("type = 'conversion'").collect()} == {""}


def test_a_shared_passage_is_compared_once(spark):
    """3000 documents and 3000 items that share one passage: nine million pairs, one comparison."""
    rng = random.Random(4)
    tail = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))
    docs = spark.createDataFrame([(i, f"{tail()} {PASSAGE} {tail()}") for i in range(3000)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(i, f"{PASSAGE} {tail()}") for i in range(3000)], "item_id long, text string").repartition(4)
    start = time.perf_counter()
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert time.perf_counter() - start < 60
    assert decontaminate.report(docs.where("doc_id < 20"), items).agg(F.min("n_items"), F.max("n_items")).first()[:] == (3000, 3000)


def test_stages_of_exact_dedup(spark):
    """Each stage hashes only what the one before left."""
    texts = ["a" * 300 + "x", "a" * 300 + "x", "a" * 300 + "y", "b" * 301, "c" * 10, "d" * 10, "e" * 7, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = exact_dedup._rows(docs)
    lengths = exact_dedup.shared_lengths(rows)
    assert {r.k_len for r in lengths.collect()} == {301, 10, 0}
    keys = exact_dedup.shared_prefixes(rows, lengths)
    assert sorted(r.p_len for r in keys.collect()) == [0, 301]
    got = exact_dedup.resolve(docs).collect()
    assert sorted(r.doc_id for r in got if r.digest is not None) == [0, 1, 2, 7, 8]
    assert sorted(r.doc_id for r in got if not r.kept) == [1, 8]
    least = spark.createDataFrame([(-(2**63), "t"), (2**63 - 1, "t"), (0, "t")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.resolve(least).collect()} == {-(2**63)}


def test_warc_extra_columns_and_bad_records(spark, tmp_path):
    import gzip

    names = ["source", "r", "text", "body", "raw", "given", "payload", "about", "page_id", "__x"]
    rows = spark.createDataFrame([("<a>", "response", "u", "d", None, "HTTP/1.1 200 OK\r\n\r\n<p>x</p>", *names)], warc.RECORD + "".join(f", `{c}` string" for c in names))
    for r in warc.derive(rows).collect():
        assert [r[c] for c in names] == names and r.refers_to == "<a>"
    good = "WARC/1.1\r\nwarc-type:response\r\nWARC-record-ID:<g{i}>\r\nContent-length: 2\r\n\r\nab\r\n\r\n"
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nX: \xff\xfe\r\nContent-Length: -4x\r\n\r\njunk\r\n\r\n"
    loose = b"no record at all\r\nsecond line\r\n"
    data = good.format(i=1).encode() + bad + loose + good.format(i=2).replace("ab", "cd").encode() + b"WARC/1.0\r\nX: \xff\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 99\r\n\r\nshort"
    path = tmp_path / "w"
    path.mkdir()
    (path / "a.warc").write_bytes(data)
    packed = b"".join(gzip.compress(good.format(i=i).encode()) for i in (3, 4))
    (path / "b.warc.gz").write_bytes(packed)
    (path / "c.warc.gz").write_bytes(packed[:-20])
    (path / "d.warc").write_bytes(b"")
    got = Counter((r.record_id, r.type, r.block) for r in warc.read(spark, str(path)).collect())
    assert got == {("<g1>", "response", "ab"): 1, ("<g2>", "response", "cd"): 1, ("<g3>", "response", "ab"): 2, ("<g4>", "response", "ab"): got["<g4>", "response", "ab"]}
    reasons = Counter(r.reason.split(":")[0] for r in warc.read_rejects(spark, str(path)).collect())
    assert reasons["bad length"] == 1 and reasons["no length"] == 1 and reasons["cut short"] == 1 and reasons["broken file"] == 1


def test_warc_keeps_named_fields_and_bytes(spark, tmp_path):
    body = bytes(range(256)) * 3 + b"\r\n\r\n\xf0\xff"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + body
    fields = ["WARC-Type: response", "WARC-Record-ID: <a>", "WARC-Target-URI: u", "WARC-Date: d", "Content-Type: application/http", "WARC-IP-Address: 10.0.0.1", "WARC-Concurrent-To: <b>", "WARC-Concurrent-To: <c>", "WARC-Block-Digest: sha256:x"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes("\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    path = str(tmp_path / "out")
    source = warc.read(spark, str(tmp_path / "in"))
    warc.write(source, path)
    for got in (source, warc.read(spark, path)):
        row = got.select(F.col("block").cast("binary").alias("block"), "headers", warc.http_body(F.col("block")).cast("binary").alias("body")).first()
        assert row.block == block and row.body == body
        assert row.headers["WARC-Concurrent-To"] == "<b>\r\n<c>"
        out = {r.type: r.headers for r in warc.derive(got).select("type", "headers").collect()}
        assert out["metadata"]["WARC-Source-IP-Address"] == "10.0.0.1" and out["metadata"]["WARC-Source-Concurrent-To"] == "<b>\r\n<c>"
        assert out["metadata"]["WARC-Source-Block-Digest"] == "sha256:x" and out["metadata"]["Source-Content-Type"] == "application/http"
        assert out["metadata"]["WARC-Source-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part*")).count(b"WARC-Concurrent-To: <") == 2


# --- 3 --------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, odd, odd_rows, empty, no_id):
    rng = random.Random(5)
    items = [(1, PASSAGE), (2, "too short to search"), (3, None), (4, PASSAGE), (5, " ".join(PASSAGE.split()[4:16])), (None, "x " * 20), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noisy = []
    for i in range(60):
        part = PASSAGE.split()[rng.randrange(10) : rng.randrange(14, 30)]
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "noise"
        noisy.append((1000 + i, " ".join(["w1,"] * rng.randrange(3) + part + ["w2"] * rng.randrange(3))))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(noisy, "doc_id long, text string"))
    seeds = decontaminate.Seeds()
    got = {r.doc_id: set(r["items"]) for r in decontaminate.report(docs, bench, seeds).collect()}
    known = [(1, PASSAGE), (5, items[4][1])]
    want = {d: plain.overlaps(t, known, 12, 3, 13, 80) for d, t in [*[(r[0], r[1]) for r in odd_rows if r[0] != 10], *noisy]}
    assert {d: got[d] for d in want} == want
    assert not got[10]
    assert sum(map(bool, want.values())) > 20
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r[0] for r in rows_of(kept, "doc_id")) == sorted(r[0] for r in odd_rows if not want.get(r[0]))
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.decontaminate(no_id, bench).count() == 3
    assert decontaminate.decontaminate(odd, bench.where("false")).count() == len(odd_rows)


def near(text, test):
    """By the rule alone: 13 neighbouring words (all of a shorter item), 80 % equal."""
    doc, test = text.split(), test.split()
    w = min(13, len(test))
    pairs = ((doc[i : i + w], test[j : j + w]) for i in range(len(doc) - w + 1) for j in range(len(test) - w + 1))
    return any(100 * sum(map(str.__eq__, a, b)) >= 80 * w for a, b in pairs)


def test_decontamination_finds_all_that_the_rule_accepts(spark):
    rng = random.Random(17)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (12, 13, 15, 17, 20, 40)]
    copies = []
    for n, text in items:
        places = [c for r in (2, 3) for c in itertools.combinations(range(n), r)]
        for places in rng.sample(places, 60):
            copies.append((n, [f"new{k}" if k in places else w for k, w in enumerate(text.split())]))
    copies += [(40, [f"new{k}" if k % 5 == r else w for k, w in enumerate(items[-1][1].split())]) for r in range(5)]
    rows = [(i, n, " ".join(["before"] * rng.randrange(3) + w + ["after"] * rng.randrange(3))) for i, (n, w) in enumerate(copies)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: [n] if near(t, dict(items)[n]) else [] for i, n, t in rows}
    assert got == want
    assert 200 < sum(map(bool, want.values())) < len(rows)
    for w, spare in ((13, 2), (12, 2), (9, 1), (4, 0), (30, 6)):
        groups, left_out = decontaminate.masks(w, spare)
        free = [{k for g in out for k in range(*groups[g])} for out in left_out]
        assert all(any(set(c) <= f for f in free) for c in itertools.combinations(range(w), min(spare, 3)))
        assert len(left_out) <= decontaminate.MASKS and groups[0][0] == 0 and groups[-1][1] == w


def test_decontamination_of_short_and_unspaced_items(spark):
    item = [" ".join(f"s{n}w{k}" for k in range(n)) for n in range(12)]
    han, thai, rare = "今天的天气非常好我们一起去公园散步吧", "สวัสดีวันนี้อากาศดีมาก", "\U00020000\U00020001\U00020002\U00020003"
    items = [(n, item[n]) for n in range(1, 12)] + [(20, han), (21, thai), (22, rare), (30, " .,! "), (31, None), (None, "no id here")]
    rows = [(n, f"before {item[n].upper()}, after", [n]) for n in range(1, 12)]
    rows += [(100 + n, "before " + item[n].rsplit(" ", 1)[0] + " other", []) for n in range(2, 12)]
    rows += [(200, "前言" + han + "。后记", [20]), (201, "前言" + han.replace("公", "花") + "后", [20]), (202, han[:9] + "前言" + han[9:11], [])]
    rows += [(203, "กก" + thai + "กก", [21]), (204, "x" + rare + "y", [22]), (205, rare[:3], []), (206, None, []), (207, "no id here", [])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontaminate.report(docs, bench).collect()} == {i: want for i, _, want in rows}
    assert {r.item_id for r in decontaminate.unsearched(bench).collect()} == {30, 31, None}
    assert decontaminate.unsearched(bench.where("false")).count() == 0


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_words_of_scripts_without_spaces(monkeypatch, segment):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["".join(rng.choice("aBé .今天のกမខ\U00020000\U0001f600") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, ""]
    alone = "[今天のกမខ\U00020000]"
    h, rows = tokens.words(pa.array(texts), tokens.PUNCT, alone=True)
    want = [(w, i) for i, t in enumerate(texts) for w in re.findall(alone + "|[aébB\U0001f600]+", (t or "").translate(plain.FOLD))]
    assert rows.tolist() == [i for _, i in want]
    names = {}
    assert all(names.setdefault(w, x) == x for (w, _), x in zip(want, h.tolist(), strict=True))
    assert len(set(names.values())) == len(names)


# --- 4 --------------------------------------------------------------------------------


def test_secret_scan_equals_brute_force(spark, odd, odd_rows, empty, no_id):
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABC123DEF", "0123456789abcdef", "deadbeef", "é", "\U0001f600", "\n", "eyJabcdef.eyJabcdef.", "ghp_" + "x9" * 18]
    more = [(2000 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(150)]
    docs = odd.select("doc_id", "text", "secrets").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("secrets", F.lit("s")))
    got = Counter((r.doc_id, tuple((s.start, s.rank, s.kind, s.end) for s in r.secrets)) for r in secret_scan.scan(docs).collect())
    want = Counter((d, tuple(plain.secrets(t, secret_scan.RULES))) for d, t in [*[r[:2] for r in odd_rows], *more])
    assert got == want
    assert sum(len(k[1]) for k in want) > 150
    assert secret_scan.scan(empty).count() == 0
    assert secret_scan.scan(no_id).count() == 3


def test_trigram_queries_are_mandatory():
    rng = random.Random(4)
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert q["hex"] == [] and q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"api", "pi_", "i_k", "_ke", "key"}) in q["assign"]
    bits = ["password", "passwd", "secret", "TOKEN", "apikey", "api_key", "=", ":", "abcdefghijkl", "AKIA", "XY12", "-----BEGIN ", "PRIVATE KEY-----", "gho_", "eyJa", ".", " "]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(8))
        for r in secret_scan.RULES:
            if q[r.kind] and re.search(r.pattern, text):
                assert any(all(g in text.lower() for g in alt) for alt in q[r.kind])


def test_trigram_queries_of_counted_groups_are_mandatory():
    """Random patterns of groups, classes and counts, with texts made to match them."""
    rng = random.Random(21)

    def part(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind == 0:
            word = "".join(rng.choice("abcXY_") for _ in range(rng.randrange(1, 4)))
            return word, lambda: word
        if kind == 1:
            chars = rng.choice(["ab", "xyz", "AbC", "abcdefghijkl"])
            return f"[{chars}]", lambda: rng.choice(chars)
        subs = [part(depth - 1) for _ in range(rng.randrange(1, 4))]
        if kind == 2:
            return "(?:" + "|".join(p for p, _ in subs) + ")", lambda: rng.choice(subs)[1]()
        low = rng.randrange(4)
        high = low + rng.choice([0, 0, 1, 3])
        body, make = "".join(p for p, _ in subs), lambda: "".join(m() for _, m in subs)
        return f"(?:{body}){{{low},{max(1, high)}}}", lambda: "".join(make() for _ in range(rng.randint(low, max(1, high))))

    asked = 0
    for _ in range(1500):
        parts = [part(3) for _ in range(rng.randrange(1, 4))]
        pattern = "".join(p for p, _ in parts)
        query = secret_scan.trigram_query(pattern)
        asked += bool(query)
        for _ in range(10):
            text = "".join(m() for _, m in parts)
            assert re.fullmatch(pattern, text)
            assert not query or any(all(g in text.lower() for g in alt) for alt in query)
    assert asked > 100
    for pattern, text in (("(?:abc|def){2}[0-9]+", "abcdef9"), ("key[ab]{3}z", "keyabaz")):
        query = secret_scan.trigram_query(pattern)
        assert query and any(all(g in text for g in alt) for alt in query)
    assert secret_scan.trigram_query("(?:abc){1000}") == [frozenset({"abc", "bca", "cab"})]


# --- 5 --------------------------------------------------------------------------------


def test_exact_dedup(odd, odd_rows, empty, no_id):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    size = Counter(norm(t) for _, t, _, _ in odd_rows)
    best = {}
    for d, t, _, _ in odd_rows:
        best[norm(t)] = min(best.get(norm(t), (1, 0)), (-len(t or ""), d))
    got = exact_dedup.resolve(odd, digest_all=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got) == Counter((d, best[norm(t)][1], size[norm(t)], plain.sha(norm(t))) for d, t, _, _ in odd_rows)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(b[1] for b in best.values())
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r[0] for r in rows_of(kept, "doc_id")) == sorted(b[1] for b in best.values())
    assert exact_dedup.dedup(empty).count() == 0
    assert exact_dedup.dedup(no_id).count() == 2
    twice = odd.unionByName(odd)
    assert exact_dedup.dedup(twice).count() == len(best)


# --- 6 --------------------------------------------------------------------------------


def random_sets(rng, n):
    base = [rng.sample(range(1 << 40), rng.randrange(1, 60)) for _ in range(max(1, n // 6))]
    out = set()
    while len(out) < n:
        s = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            s[rng.randrange(len(s))] = rng.randrange(1 << 40)
        out.add(frozenset(s[: rng.randrange(max(1, len(s) - 6), len(s) + 1)]))
    return [np.array(sorted(s), np.uint64) for s in out]


@pytest.mark.parametrize("bucket", [1, 8, 64])
@pytest.mark.parametrize("measure", [jaccard.Measure(5, 80, 100), jaccard.Measure(4, 85, 100), jaccard.Measure(3, 50, 100)])
def test_tree_links_equal_all_pairs(monkeypatch, measure, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rng = random.Random(measure.num)
    for n in (1, 2, 3, 40, 120, 200):
        sets = random_sets(rng, n)
        lab = np.arange(n)
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if measure.den * both >= measure.num * (len(sets[i]) + len(sets[j]) - both):
                    lab[lab == max(lab[i], lab[j])] = min(lab[i], lab[j])
        assert jaccard.PrefixTree(sets).link(np.arange(n), measure).tolist() == lab.tolist()


@pytest.mark.parametrize("cells", [1, 2000, 8_000_000])
def test_many_sets_walk_the_tree_together(monkeypatch, cells):
    """the sets of a family are compared by tables, not one after the other; links are those of single walks."""
    walks, walk = [], jaccard.PrefixTree._probe
    monkeypatch.setattr(jaccard.PrefixTree, "_probe", lambda self, x, *a: (walks.append(x), walk(self, x, *a)))
    monkeypatch.setattr(jaccard, "PROBE_CELLS", cells, raising=False)
    rng, measure = random.Random(cells), jaccard.Measure(5, 80, 100)
    base = rng.sample(range(1 << 40), 60)
    sets = [np.array(sorted({*rng.sample(base, rng.randrange(40, 58)), *rng.sample(range(1 << 40), 3)}), np.uint64) for _ in range(150)]
    n = np.array([len(s) for s in sets])
    low = [s[: int((k - measure.least(k) + 1 + measure.spare(k)))] for s, k in zip(sets, n, strict=True)]
    for held, sizes in ((sets, None), (low, n)):
        walks.clear()
        together = jaccard.PrefixTree(held, sizes).link(np.arange(150), measure)
        assert len(walks) <= 3
        with monkeypatch.context() as m:
            m.setattr(jaccard, "FEW_PROBES", 1000, raising=False)
            assert together.tolist() == jaccard.PrefixTree(held, sizes).link(np.arange(150), measure).tolist()
        assert 1 < len(set(together.tolist())) < 150 or sizes is not None


@pytest.mark.parametrize("bucket", [1, 64])
def test_signature_links_hold_all_links(monkeypatch, bucket):
    """What is known in part is joined at least where the sets link, and not everywhere."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    measure = jaccard.Measure(4, 85, 100)
    rng = random.Random(12)
    for _ in range(20):
        sets = random_sets(rng, 60)
        n = np.array([len(s) for s in sets])
        low = [s[: int((k - measure.least(k) + 1 + measure.spare(k)))] for s, k in zip(sets, n, strict=True)]
        exact = jaccard.PrefixTree(sets).link(np.arange(60), measure)
        may = jaccard.PrefixTree(low, n).link(np.arange(60), measure)
        assert len(set(zip(exact.tolist(), may.tolist(), strict=True))) == len(set(exact.tolist()))
        assert len(set(may.tolist())) > 1


def test_prefix_keys_meet():
    """Any two similar sets share a key, whatever the frequencies."""
    rng = random.Random(8)
    for measure in (jaccard.Measure(5, 80, 100), jaccard.Measure(4, 85, 100)):
        for _ in range(3000):
            a = set(rng.sample(range(400), rng.randrange(1, 120)))
            b = set(a)
            for _ in range(rng.randrange(14)):
                b.discard(rng.randrange(400))
                if rng.random() < 0.7:
                    b.add(rng.randrange(400))
            if not b or measure.den * len(a & b) < measure.num * len(a | b):
                continue
            df = [rng.choice([2, 3, 500]) for _ in range(400)]
            keys = []
            for s in (a, b):
                n = np.array([len(s)])
                low = sorted(s)[: int((n - measure.least(n) + 1 + measure.spare(n))[0])]
                keep = len(low) - int(measure.spare(measure.least(n))[0])
                keys.append(set(sorted(low, key=lambda x: (df[x], x))[:keep]))
            assert keys[0] & keys[1]


@pytest.mark.parametrize("local", [0, 1000])
def test_roots(spark, monkeypatch, local):
    monkeypatch.setattr(jaccard, "LOCAL_LINKS", local)
    rng = random.Random(local)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1050)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = dict(rows_of(jaccard._roots(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert {x: got.get(x, x) for x in up} == {x: root(x) for x in up}
    assert jaccard._roots(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("chunk", "local"), [(4096, 500_000), (3, 500_000), (4096, 0)])
def test_components_equal_all_pairs(spark, odd, odd_rows, monkeypatch, chunk, local):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard, "LOCAL_LINKS", local)
    rng = random.Random(9)
    family = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(50)]
    more = []
    for i in range(60):
        w = list(family)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(50)] = f"x{rng.randrange(1000)}"
        more.append((3000 + i, " ".join(w[: 50 - rng.randrange(6)])))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for measure in (jaccard.Measure(4, 85, 100), jaccard.Measure(5, 80, 100)):
        got = Counter(rows_of(jaccard.components(docs, measure), "doc_id", "n_shingles", "component_id"))
        assert got == plain.components([r[:2] for r in odd_rows] + more, measure.words, measure.num, measure.den)


def test_a_cut_family_meets_once(spark, monkeypatch):
    """chunks of a family of near copies meet by the block, not once for each of its shingles."""
    rows, write = [], jaccard.stored
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 20)

    def stored(df, label="table", keep=False):
        out = write(df, label, keep)
        rows.extend([out.count()] if label == "jaccard-again" else [])
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(200)] = f"x{rng.randrange(10000)}"
        docs.append((i, " ".join(w)))
    got = Counter(rows_of(jaccard.components(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id"))
    assert got == plain.components(docs, 5, 80, 100) and 1 < len({c for _, _, c in got}) < 60
    assert 0 < sum(rows) <= 60 * 4


def test_jaccard_edges(spark, odd, empty, no_id):
    assert jaccard.components(empty).count() == 0
    got = sorted(rows_of(jaccard.components(no_id), "doc_id", "n_shingles", "component_id"), key=str)
    assert got == [(1, 0, 1), (None, 0, None), (None, 1, None)]
    kept = jaccard.dedup(odd)
    assert kept.columns == odd.columns and {5, 9}.isdisjoint({r[0] for r in rows_of(kept, "doc_id")} - {5})
    # one doc_id with two texts links the groups of both
    text = [" ".join(f"{p}{i}" for i in range(20)) for p in "ab"]
    same = spark.createDataFrame([(1, text[0]), (2, text[0]), (2, text[1]), (3, text[1])], "doc_id long, text string")
    assert {r[0] for r in rows_of(jaccard.components(same), "component_id")} == {1}


# --- 7 and 10 -------------------------------------------------------------------------


def _labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice("the of a on tree house river walks quickly under".split()) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.25
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vilegrub", "vilegrim", "snotbag"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_and_handles_odd_rows(spark, odd, empty, no_id):
    rows = _labelled(600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (9999, 1), (0, None)], "doc_id long, toxic int")
    held = {r[0]: r[1] for r in rows_of(docs.withColumn("o", toxicity.held_out()), "doc_id", "o")}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}
    model = toxicity.fit(toxicity.labelled(docs.where(~toxicity.held_out()), labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [(got[i].predicted == y) for i, _, y in rows if held[i]]
    assert sum(right) / len(right) > 0.97
    odd_scores = toxicity.score(odd, model)
    assert set(odd_scores.columns) == set(odd.columns)
    assert all(0 <= r[0] <= 1 and r[1] == (r[0] >= 0.5) for r in rows_of(odd_scores, "score", "predicted"))
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(no_id, model).count() == 3
    none = toxicity.fit(toxicity.labelled(empty, labels))
    assert {r[1] for r in rows_of(toxicity.score(odd, none), "score", "predicted")} <= {0, 1}
    few = toxicity.fit(toxicity.labelled(docs, labels), rows=200)
    again = {r.doc_id: r.predicted for r in toxicity.score(docs, few).collect()}
    assert sum(again[i] == y for i, _, y in rows) / len(rows) > 0.9


def test_toxicity_keeps_rare_toxic_ngrams(spark):
    """However many frequent n-grams lean to clean, those of rare toxic words stay in the model."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    clean = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(1500)]
    both = "tree house river walk quick under stone water".split()
    vile = ["zqxvilg", "grubwyz", "snotqaj", "kkworpz", "jyxmuck", "vuzzfip", "qibblat", "xodrekk"]
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        w = rng.choices(both, k=20)
        w += [rng.choice(vile)] if bad else rng.sample(clean, 300)
        if i % 12 == 6:
            w += rng.sample(clean, 100)
        rows.append((i, " ".join(rng.sample(w, len(w))), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    assert np.count_nonzero(model.weights) > 4096
    for word in vile:
        of = {int(i) for ids, _ in tokens.char_ngrams(pa.array([word]), toxicity.ORDERS, toxicity.BITS) for i in ids}
        assert sum(model.weights[i] > 0 for i in of) >= 4
    place = toxicity._places(model.weights != 0)
    texts = [r[1] for r in rows[:20]] + ["", None]
    ids, sizes = toxicity._buckets(pa.array(texts), place)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        of = {int(i) for found, _ in tokens.char_ngrams(pa.array([text or ""]), toxicity.ORDERS, toxicity.BITS) for i in found}
        assert sorted(got.tolist()) == sorted(int(place[i]) for i in of if place[i] >= 0)


def test_toxicity_cut_and_sums():
    """The cut has the best F1 of all cuts; sums of sliced lists are those of the texts."""
    rng = random.Random(5)
    for _ in range(30):
        z = np.array([rng.choice([-3.0, -1.5, -1.0, -0.5, 0.25]) + rng.choice([0, rng.random() / 9]) for _ in range(40)])
        y = np.array([float(rng.random() < (0.7 if v > -1.2 else 0.1)) for v in z])
        y[0] = 1.0
        f1 = lambda c: 2 * y[z >= c].sum() / ((z >= c).sum() + y.sum())
        cut = toxicity._cut(z, y, lowest=-9.0)
        assert cut == 0.0 or f1(cut) >= max(f1(c) for c in z) - 1e-12
        assert -2.0 <= toxicity._cut(z, y) <= 0.0
    lists = pa.chunked_array([pa.array([[0, 2], [], [1]], pa.list_(pa.int32())), pa.array([[2], [0, 1]], pa.list_(pa.int32())).slice(1)])
    assert toxicity._sums(lists, np.array([1.0, 10.0, 100.0])).tolist() == [101.0, 0.0, 10.0, 11.0]


def test_language_learns_and_handles_odd_rows(spark, odd, empty, no_id):
    rng = random.Random(4)
    vocab = {"aa": "alor bemi cotu dera".split(), "bb": "xyth wronk vlach zzut".split(), "cc": "ñoña güíro êtrè çaá".split()}
    rows = [(i, " ".join(rng.choice(vocab[v]) for _ in range(rng.randrange(3, 40))), v) for i, v in enumerate(rng.choices(list(vocab), k=400))]
    rows += [(900, None, "aa"), (901, "alor", None), (902, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where(~toxicity.held_out(4, 2)), per_lang=60, draws=80)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    test = [(i, v) for i, t, v in rows if t and v and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == v for i, v in test) / len(test) > 0.97
    assert got[900].lang_pred == got[902].lang_pred == "und" and got[900].score == 0.0
    back = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert all(back[i].lang_pred == "und" for i in (0, 1, 2, 13)) and all(0 <= r.score <= 1 for r in back.values())
    assert language.predict(empty, model).count() == 0 and language.predict(no_id, model).count() == 3
    assert language.fit(empty) is None
    assert {r[0] for r in rows_of(language.predict(odd, None), "lang_pred")} == {"und"}


# --- 8 --------------------------------------------------------------------------------


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (6, 2), (5, 3)])
def test_line_runs_equal_brute_force(odd, odd_rows, batches, fanout):
    docs = odd.dropDuplicates(["doc_id", "text"])
    got = line_runs.dedup_lines(docs, 40, 5, batches, fanout)
    assert {r[0]: r[1:] for r in rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_text")} == plain.drop_lines(dict((r[0], r[1]) for r in odd_rows).items(), 40, 5)


def test_line_runs_edges(odd, odd_rows, empty, no_id):
    assert line_runs.dedup_lines(empty).count() == 0
    assert line_runs.dedup_lines(no_id).count() == 3
    assert line_runs.dedup_lines(odd).count() == len(odd_rows)


def test_runs_are_levelled(spark):
    runs = line_runs.LineRuns(spark, buckets=2, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytearray([k]), 100 - b) for k in range(b, b + 3)], "key binary, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    merged = {r.key[0]: (r.n, r.holder) for r in line_runs.LineRuns.merged(runs.runs()).collect()}
    assert merged == {k: (sum(b <= k < b + 3 for b in range(5)), 100 - max(0, k - 2)) for k in range(7)}


# --- 9 --------------------------------------------------------------------------------

NASTY = ["", "plain", chat.OPEN, chat.CLOSE + "\n" + chat.OPEN + "assistant\nok", "\\", "\\<|", "<\\|", "\\\\<|x|>\\", "<|", "a\nb", "", "x", "\U0001f600<|im_end|>"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    convs = {c: [(rng.choice(["user", "assistant", "tool\n<|im_end|>\\", "", "assistant"]), rng.choice(NASTY) + rng.choice(NASTY)) for _ in range(rng.randrange(1, 9))] for c in range(60)}
    rows = [(c, i, r, t, "x") for c, m in convs.items() for i, (r, t) in enumerate(m)]
    rng.shuffle(rows)
    said = spark.createDataFrame(rows + [(None, 0, None, None, None), (70, None, "user", None, None)], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = chat.format_conversations(said)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c, m in convs.items():
        assert got[c].turns == "".join(f"{r}\n{t}\n" for r, t in m) and got[c].n_turns == len(m)
        assert got[c].loss_text == "".join(t for r, t in m if r == "assistant")
    assert got[None].turns == "\n\n" and got[70].turns == "user\n\n"
    assert all(not r.rewrites for r in out.collect())
    assert chat.format_conversations(said.where("false")).count() == 0


def test_templates_that_rewrite_history():
    def trims(messages):  # shortens all turns but the last
        return "".join(f"[{r}]{t if i == len(messages) - 1 else t[:3]};" for i, (r, t) in enumerate(messages))

    got = chat.render([("user", "hello"), ("assistant", "yes"), ("user", "more")], trims)
    assert got.rewritten_at == [1]
    assert chat.render([("user", "hel"), ("user", "more")], trims).rewritten_at == []
    plain_ = chat.render([("user", "a"), ("assistant", "bb")], lambda m: "".join(f"{r}: {t}\n" for r, t in m))
    assert [plain_.text[t.text_start : t.text_end] for t in plain_.turns] == ["a", "bb"]


# --- pipeline -------------------------------------------------------------------------


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty, odd_rows, tmp_path):
    sf = str(tmp_path / "sf")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
    odd.write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_equals_brute_force(spark):
    """Every stage on the table that the one before left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        left = out.collect()
        ids = {r.doc_id for r in left}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum(d not in ids for d, y in labels.items() if not y) <= 0.02 * len(labels)
        elif name == "exact_dedup":
            best = {}
            for d, r in before.items():
                k = "".join(plain.words(r.text))
                best[k] = min(best.get(k, (1, 0)), (-len(r.text or ""), d))
            assert ids == {b[1] for b in best.values()}
        elif name == "ngram_jaccard":
            assert ids == {c for _, _, c in plain.components([(d, r.text) for d, r in before.items()], 5, 80, 100)}
        elif name == "decontaminate":
            assert ids == {d for d, r in before.items() if not plain.overlaps(r.text, bench, 12, 3, 13, 80)}
        else:
            sizes, got, weights = Counter(), Counter(), {}
            for r in before.values():
                sizes[r.source] += len(plain.words(r.text))
            for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
                weights[s] = (5.0, 2.0, 1.0)[i % 3]
            for r in left:
                got[r.source] += len(plain.words(r.text))
            want = plain.water_fill(sizes, weights, 1.5, 2.0)
            assert all(abs(got[s] - want[s]) <= 1 for s in want)
        docs = out


def test_queries_of_brute_forced_operators(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(rows_of(queries.QUERIES["op6_ngram_jaccard"](spark, SF), "doc_id", "n_shingles", "component_id"))
    assert got == plain.components(docs, 4, 85, 100)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r.doc_id: r["items"] for r in queries.QUERIES["op3_decontaminate"](spark, SF).collect()}
    assert found == {d: ",".join(map(str, sorted(plain.overlaps(t, bench, 12, 3, 13, 80)))) for d, t in docs}


def test_language_sample_is_bounded(spark):
    """Of a dirty column of languages the most frequent are learned, and the sample keeps its bound."""
    rows = [(i, f"alpha beta {'gamma' if i % 2 else 'delta'} " * 5, ("aa" if i % 2 else "bb") if i < 200 else f"x{i}") for i in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100, languages=2)
    assert model.langs == ("aa", "bb")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op10_language"](spark, sf).where("held_out").collect()
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) / len(got) > 0.97
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = [r for r in queries.QUERIES["op7_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in scored) / len(scored) > 0.88


def test_held_out_recall_of_toxic_rows(spark):
    """On labels of which some are noise: most toxic rows are caught, few clean ones, and toxic rows rank first."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = [(r.score, r.predicted, toxic[r.doc_id]) for r in queries.QUERIES["op7_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    bad, clean = ([p for _, p, y in scored if y == want] for want in (1, 0))
    assert sum(bad) / len(bad) > 0.75 and sum(clean) / len(clean) < 0.02
    top = sorted(scored, reverse=True)[: 2 * len(bad)]
    assert sum(y for _, _, y in top) / len(bad) > 0.85
