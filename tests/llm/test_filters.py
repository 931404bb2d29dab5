"""Decontamination, quality, URLs, licences, personal data and packing, with their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from metrolith.llm import common
from metrolith.llm import op02_decontamination as op2
from metrolith.llm import op03_quality as op3
from metrolith.llm import op07_url_filter as op7
from metrolith.llm import op08_licenses as op8
from metrolith.llm import op09_pii as op9
from metrolith.llm import op10_packing as op10

SCHEMA = "doc_id bigint, text string, terms int, score string, spans string, word int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", None, None) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (2, "short ITEM"), (3, None), (4, ""), (5, "été 9x"), (None, "one two"), (10, "no such words here at all")]
DOCS = [
    (1, "Zero one, two THREE four five six seven eight nine ten. eleven twelve thirteen"),
    (2, "a short item; another short\nitem short"), (3, None), (4, ""), (5, "x" * 5000), (5, "été 9X"), (6, "one two three four five six seven eight nine"),
    (None, "short item"), (7, "short item " * 300), (8, "short"), (9, "item"),
]


def brute_hits(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, who = words(text), set(), set()
        for item_id, item in items:
            t = words(item)
            if item_id is None or not t:
                continue
            n = min(window, len(t))
            for i in range(len(t) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == t[i : i + n]:
                        hit |= set(range(j, j + n))
                        who.add(str(item_id))
        ids = ",".join(sorted(who))
        out.append((doc_id, len(w), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 1])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(op2, "BLOCK_WORDS", block)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = op2.decontaminate(spark, op2.build_index(frame(spark, DOCS)), items).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(DOCS, ITEMS)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_items for r in op2.decontaminate(spark, op2.build_index(frame(spark, DOCS)), none).collect()} == {0}
    assert op2.decontaminate(spark, op2.build_index(frame(spark, [])), items).count() == 0


def test_phrase_and_proximity_matches(spark):
    docs = frame(spark, [(1, "red fox x x blue"), (2, "red blue fox"), (3, "blue " + "x " * 30 + "red fox")])
    items = spark.createDataFrame([(1, "red fox blue"), (2, "red fox")], "item_id bigint, text string")
    got = {(r.kind, r.doc_id, r.item_id) for r in op2.matches(spark, op2.build_index(docs), items, slop=4).collect()}
    assert {g for g in got if g[0] == "phrase"} == {("phrase", 1, "2"), ("phrase", 3, "2")}
    assert {g for g in got if g[0] == "near"} == {("near", 1, "1"), ("near", 1, "2"), ("near", 2, "1"), ("near", 2, "2"), ("near", 3, "2")}


def test_quality_network_learns_and_differentiates():
    rng = np.random.default_rng(0)
    texts = [("ab cd ef " * int(rng.integers(1, 90)) + ("%%%" if i % 2 else "")).encode() for i in range(60)]
    labels = np.array([1.0 - i % 2 for i in range(60)], np.float32)
    net = op3.Network().fit(texts, labels, steps=150)
    scores = net.scores(texts + [b""], net.tables())
    assert ((scores[:60] >= 0.5) == (labels == 1)).mean() > 0.95
    assert 0 <= scores[60] <= 1
    # The gradient agrees with differences of the loss.
    net = op3.Network(3)
    for p in net.p.values():
        p += 0.01

    def loss():
        s = net.scores(texts[:8], net.tables())
        y = labels[:8]
        return -(y * np.log(s) + op3.REJECT_WEIGHT * (1 - y) * np.log(1 - s)).mean() + 0.5e-4 * (net.p["out"] ** 2).sum()

    grads = net.gradients(texts[:8], labels[:8])
    for name, at in (("out", 3), ("bias", 0), ("shift", 2)):
        eps = 1e-3
        net.p[name][at] += eps
        up = loss()
        net.p[name][at] -= 2 * eps
        down = loss()
        net.p[name][at] += eps
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3


def test_chunks_cover_the_whole_text():
    text = bytes(range(256)) * 5
    rows, of = op3.chunks([b"", text, b"x"])
    assert of.tolist() == [1] * -(-len(text) // op3.CHUNK) + [2]
    covered = rows[of == 1][:, : op3.CHUNK].ravel()
    assert bytes(covered[covered != op3.PAD].tolist()) == text
    assert (rows[of == 1][:-1, op3.CHUNK :] == rows[of == 1][1:, : op3.WIDTH - 1]).all()


def test_scores_against_a_plain_convolution():
    rng = np.random.default_rng(4)
    net = op3.Network(8)
    net.p["shift"] += rng.normal(0, 0.3, op3.FILTERS).astype(np.float32)
    texts = [b"", b"x", b"\0\0", "é word ".encode() * 9, bytes(rng.integers(0, 256, 256).tolist()), bytes(rng.integers(0, 256, 1031).tolist())]
    for text, score in zip(texts, net.scores(texts, net.tables()), strict=True):
        pooled = []
        for a in range(0, len(text), op3.CHUNK):
            best = np.full(op3.FILTERS, -np.inf)
            for i in range(a, a + op3.CHUNK):
                sums = np.zeros(op3.FILTERS)
                for tap in range(op3.WIDTH):
                    if i + tap < len(text):
                        sums += net.p["embed"][text[i + tap]].astype(float) @ net.p["taps"][tap].astype(float)
                best = np.maximum(best, sums)
            pooled.append(np.maximum(best + net.p["shift"], 0))
        features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) if pooled else np.zeros(2 * op3.FILTERS)
        assert abs(score - 1 / (1 + np.exp(-(features @ net.p["out"] + net.p["bias"][0])))) < 1e-4


def test_training_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op3.Network, "fit", lambda self, texts, labels: seen.append((sorted(texts), labels)) or self)
    rows = [(1, "same text")] * 50 + [(1, f"one id, text {i}") for i in range(40)] + [(2, "z" * 900), (3, None), (None, "n")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (9, 1)], "doc_id bigint, quality int")
    monkeypatch.setattr(op3, "held_out", lambda c: c.isNull())
    op3.train(frame(spark, rows), labels, rows=20)
    assert len(seen[0][0]) == 20 and len(seen[0][1]) == 20
    monkeypatch.setattr(op3, "TRAIN_BYTES", 100)
    op3.train(frame(spark, rows), labels)
    assert 0 < sum(map(len, seen[1][0])) <= 100 and b"z" * 900 not in seen[1][0]


def test_quality_edge_cases(spark):
    docs = frame(spark, [(i, "good text " * 5 if i % 2 else "b@d!! " * 5) for i in range(30)] + [(50, None), (51, ""), (None, "x"), (1, "again")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    net = op3.train(docs, labels)
    got = op3.score(docs, net).collect()
    assert len(got) == 34 and all(0 <= r.score <= 1 for r in got)
    assert op3.train(docs, labels.limit(0)) is None
    assert {r.score for r in op3.score(docs, None).collect()} == {0.5}
    assert op3.score(docs.limit(0), net).count() == 0
    assert op3.accepted(docs, net).columns == docs.columns
    held = {r.doc_id: r.h for r in docs.select("doc_id", op3.held_out(docs.doc_id).alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(30))


def test_held_out_quality(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op3.op3_quality_classifier(spark, d).collect()}
    labels = duckdb.connect().execute(f"select doc_id, quality from '{d}/labels.parquet'").fetchall()
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


URLS = [
    (1, "http://Blog.Example.COM/en/100"), (2, "https://example.com/en/77?x=1"), (3, "http://a.example.net/de/8#t"), (4, "http://net/de/8"), (5, "http://x.org/es/"),
    (6, None), (7, "no scheme"), (8, "http://xcom/en/1"), (9, "ftp://h?q/en/"), (10, "http://example.com"), (11, "a://b://c/d"), (12, "http://h/EN/#f"), (13, "http://h/a\nb?c"), (1, "http://Blog.Example.COM/en/100"),
]


def brute_rule(host, path):
    fits = [r for r in op7.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x", None) for i, u in URLS], "page_id bigint, url string, host string, score string")
    bias, weights = op7.train(spark, spark.createDataFrame(op7.LABELLED, "label int, url string"))
    got = op7.judge(pages, bias, weights).collect()
    assert len(got) == len(URLS)
    by = {r.page_id: r for r in got}
    for i, url in URLS:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        rule = brute_rule(host, path)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule and rule[1] + rule[2])
        assert by[i].verdict == (rule[0] if rule else "block" if by[i].score >= 0.5 else "allow")
    assert op7.judge(pages.limit(0), bias, weights).count() == 0
    assert op7.train(spark, spark.createDataFrame([], "label int, url string"))[0] < 0


def test_url_scores_against_a_plain_regression(spark):
    """The same descent over explicit feature vectors; only the buckets come from the operator's hash."""
    labelled = spark.createDataFrame(op7.LABELLED, "label int, url string")
    pages = spark.createDataFrame([(i, u) for i, u in URLS if i != 1] + [(100 + i, u) for i, (_, u) in enumerate(op7.LABELLED)], "page_id bigint, url string")

    def vectors(df):
        from pyspark.sql import functions as F

        rows = df.select(*df.columns, op7.grams(*op7.parts(F.col("url"))).alias("g")).collect()
        x = np.zeros((len(rows), op7.BUCKETS))
        for r, row in enumerate(rows):
            for b in row.g:
                x[r, b] += 1 / len(row.g)
        return rows, x

    rows, x = vectors(labelled)
    y, w, bias = np.array([r.label for r in rows], float), np.zeros(op7.BUCKETS), 0.0
    for _ in range(op7.ITERATIONS):
        error = 1 / (1 + np.exp(-(op7.SCALE * x @ w + bias))) - y
        w = (1 - op7.RATE * op7.DECAY) * w - op7.RATE * x.T @ error / len(y)
        bias = (1 - op7.RATE * op7.DECAY) * bias - op7.RATE * error.mean()
    rows, x = vectors(pages)
    expected = {r.page_id: 1 / (1 + np.exp(-(op7.SCALE * v @ w + bias))) for r, v in zip(rows, x, strict=True)}
    got = {r.page_id: r.score for r in op7.judge(pages, *op7.train(spark, labelled)).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in expected.items())


def test_url_regression_fits_its_table(spark):
    pages = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(op7.LABELLED)], "page_id bigint, url string")
    got = {r.page_id: r.score for r in op7.judge(pages, *op7.train(spark, spark.createDataFrame(op7.LABELLED, "label int, url string")), rules=()).collect()}
    assert all((got[i] >= 0.5) == (y == 1) for i, (y, _) in enumerate(op7.LABELLED))


def brute_license(text):
    lines = [w for w in map(words, (text or "").split("\n")) if w]
    sets = {n: set(zip(w, w[1:], strict=False)) for n, w in ((n, words(t)) for n, t in op8.TEMPLATES.items())}
    count, best = 0, (0.0, None)
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            w = [x for line in lines[a : b + 1] for x in line]
            s = set(zip(w, w[1:], strict=False))
            found = [(2 * len(s & g) / (len(s) + len(g)), n) for n, g in sets.items()]
            if any(d >= op8.LIMIT for d, _ in found):
                count += 1
                best = min(best, *((d, n) for d, n in found), key=lambda x: (-x[0], x[1] or "~"))
    return count, best[1], round(best[0], 6)


def test_license_scan(spark):
    mit = op8.TEMPLATES["mit"]
    rows = [(1, "hello\nReleased under the MIT License.\nbye bye"), (2, mit[:100] + "\n" + mit[100:] + "\n\nmore of the same text"), (3, None), (4, ""), (5, "license"), (6, "LICENSED\nunder CC BY-NC 4.0\n\n\n!!"), (7, "the of " * 2000), (8, "Licensed under the Apache License, Version 2.0."), (8, "Licensed under the Apache License, Version 2.0.")]
    got = sorted((tuple(r) for r in op8.scan(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *brute_license(t)) for i, t in rows), key=str)
    assert op8.scan(frame(spark, [])).count() == 0


def brute_windows(text):
    w = words(text)
    sets = {n: set(zip(g, g[1:], strict=False)) for n, g in ((n, words(t)) for n, t in (op8.whole_texts() | op8.TEMPLATES).items())}
    best, ends = (0.0, None), []
    for a in range(len(w)):
        for b in range(a + 2, len(w) + 1):
            s = set(zip(w[a:b], w[a + 1 : b], strict=False))
            found = [(2 * len(s & g) / (len(s) + len(g)), n) for n, g in sets.items()]
            found = [f for f in found if f[0] >= op8.LIMIT]
            if found:
                ends.append((b, a))
                best = min(best, *found, best, key=lambda x: (-x[0], x[1] or "~"))
    count = free = 0
    for b, a in sorted(ends):
        if a >= free:
            count, free = count + 1, b
    return count, best[1], round(best[0], 6)


def test_licenses_inside_lines(spark):
    whole = op8.whole_texts()
    rows = [
        (1, "The code of this page is free. Released under the MIT License."), (2, "Text and pictures on this site are licensed under CC BY 4.0."),
        (3, "all of this is released under the mit\nlicense, and that also: licensed under CC BY-NC 4.0; under the MIT License so much more text"),
        (4, "released under the MIT " * 12), (5, "released under released under the MIT MIT license under the mit license of the very free sort that goes on here"), (6, "this is released under no license, of the mit"),
    ]
    texts = [(10 + i, "some words before " + " ".join(t.split()) + " and after") for i, t in enumerate(whole.values())]
    got = {r.doc_id: tuple(r)[1:] for r in op8.scan(frame(spark, rows + texts)).collect()}
    assert {i: got[i] for i, _ in rows} == {i: brute_windows(t) for i, t in rows}
    assert got[1][1] == "mit-notice" and got[2][1] == "cc-by-4.0-notice" and got[3][0] == 3 and got[6][1] is None
    assert all(got[10 + i][2] == 1 and got[10 + i][1].split("-")[0] == n.split("-")[0] for i, n in enumerate(whole))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute_spans(text):
    ok = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": luhn, "phone": lambda v: 8 <= sum(c.isdigit() for c in v) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok[k](m[0])]


PRIVATE = [
    (1, "é mail a.b+c@x-y.example.com, or a@b.c_d@e.f.g and a@b"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 000255.01.1.0 1.2.3"), (3, "4111 1111-1111 1111 and 4111111111111112 4111111111111111"),
    (4, "+1 (999) 555-0100. +12 +1234567890123456 ++1 2 3 4 5 6 7 8"), (5, None), (6, ""), (7, "9" * 20_000 + " " + "a" * 20_000 + "@"), (8, "1 " * 8000), (9, "x@y.z " * 500), (9, "x@y.z " * 500), (None, "😀 q@r.st"),
]


def test_base_spans(spark):
    got = [(r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.base]) for r in op9.find_pii(spark, frame(spark, PRIVATE)).collect()]
    assert sorted(got, key=str) == sorted(((i, brute_spans(t)) for i, t in PRIVATE), key=str)
    assert op9.find_pii(spark, frame(spark, [])).count() == 0


def test_disclosing_terms(spark):
    secret = [(i, f"Quorbix{'' if i else 'es'} Quorbix wrote to boss@corp.example from town{i * 'x'}, as people do") for i in range(4)]
    rows = secret + [(10 + i, f"people do write{i * 'y'} and as ever from town") for i in range(20)] + [(40, "A QUORBIX too, Quorbixes not"), (41, secret[0][1])]
    found = op9.find_pii(spark, frame(spark, rows), disclosed=0.8)
    got = {r.doc_id: [(s.start, s.end, s.value) for s in r.terms] for r in found.collect()}
    assert got[40] == [(2, 9, "QUORBIX")]
    assert got[1][0][2] == "Quorbix" and all(not got[10 + i] for i in range(20))
    clean = {r.doc_id: r.text for r in op9.sanitised(found, frame(spark, rows)).collect()}
    assert clean[40] == "A <term> too, Quorbixes not"
    assert "<email>" in clean[2] and "boss@" not in clean[2] and clean[12] == rows[6][1]


def brute_terms(rows, support, disclosed):
    """{row: folded terms that disclose an entity}, counted document by document."""
    fold = lambda t: t.replace("İ", "I").lower()
    texts = [t or "" for _, t in rows]
    entities = [{f"{s.split(':')[0]}:{fold(t[int(s.split(':')[1]):int(s.split(':')[2])])}" for s in brute_spans(t)} for t in texts]
    terms = [set(re.findall("[A-Za-z\x80-\U0010ffff]{3,}", fold(t))) for t in texts]
    n, bad = len(rows), set()
    for e in set().union(*entities):
        has = [i for i in range(n) if e in entities[i]]
        if len({texts[i] for i in has}) < support or len(has) == n:
            continue
        for term in set().union(*(terms[i] for i in has)):
            both = [i for i in has if term in terms[i]]
            if len({texts[i] for i in both}) >= support:
                of_term = sum(term in t for t in terms)
                if np.log2(len(both) * n / (of_term * len(has))) / np.log2(n / len(has)) >= disclosed:
                    bad.add(term)
    return [t & bad for t in terms]


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
def test_disclosing_terms_against_counts(spark, monkeypatch, broadcast):
    """Planted pairs of a name and an address, and common words: every disclosing term is found, no other."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(3)
    plain = [f"wort{c}" for c in "abcdefgh"] + ["İstanbul", "Straße", "ΣΟΦΟΣ"]
    rows = []
    for i in range(90):
        text = [rnd.choice(plain) for _ in range(6)]
        who = rnd.randint(0, 11)
        if who < 6:
            text += [f"name{'xyzuvw'[who]}{'İ' * (who % 2)}q", f"u{who}@ex.org"] if rnd.random() < 0.9 else [f"NAME{'xyzuvw'[who]}q"]
        rnd.shuffle(text)
        rows.append((i if i % 9 else None, " ".join(text)))
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, None), (202, "")]
    expected = sorted(((i, sorted(t)) for (i, _), t in zip(rows, brute_terms(rows, 3, 0.9), strict=True)), key=str)
    fold = lambda t: t.replace("İ", "I").lower()
    got = sorted(((r.doc_id, sorted({fold(s.value) for s in r.terms})) for r in op9.find_pii(spark, frame(spark, rows), disclosed=0.9).collect()), key=str)
    assert got == expected
    assert len({t for _, ts in got for t in ts}) >= 5 and not any(t.startswith(("wort", "stra")) for _, ts in got for t in ts)


def test_cuts_partition_every_length():
    for n in [1, 2, 255, 256, 257, 1000, 2047, 2048, 4095, 4096, 4097, 9999, 12288, 100_000]:
        pieces = op10.cuts(n)
        assert sum(p for p, _ in pieces) == n
        assert all(k == 0 or p * k <= op10.CAPACITY for p, k in pieces)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(op10.TOKENIZER))
    texts = ["", None, "Hello WORLD", "it's we'll 12 ½ ²", "Ünïcödé ſharp ŉ ª", "漢字 кириллица ﬁ", "a\xadb \x1f x\x85y\xa0z", "<|endoftext|> x <|startoftext|>", "İstanbul Σίσυφος", "word " * 9000, "!!!???...'s'S", "e\u0301 combining"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "x")]
    ids = {}
    for doc_id, t in rows:
        ids.setdefault(doc_id, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    got = op10.pack(frame(spark, rows)).collect()
    sequences = {}
    for r in got:
        assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= op10.CAPACITY
    assert op10.pack(frame(spark, [])).count() == 0


def test_packing_pads_little(spark):
    got = op10.op10_harmonic_packing(spark, "/root/testdata/sf0.01").collect()
    used = sum(r.length for r in got)
    assert used / (op10.CAPACITY * len({r.sequence_id for r in got})) > 0.95
