"""Line dedup, SimHash near-dedup, repeat removal and winnowing against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from metrolith.llm import common
from metrolith.llm import op01_line_dedup as op1
from metrolith.llm import op04_simhash as op4
from metrolith.llm import op05_repeats as op5
from metrolith.llm import op06_winnowing as op6

SCHEMA = "doc_id bigint, text string, `lines` int, th string, fp string, `hashes` int"


def frame(spark, rows):
    """Rows (doc_id, text), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", None, None) for i, t in rows], SCHEMA)


def corpus(seed=3, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(1, 12)))
    pool = [line() for _ in range(12)]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else line() for _ in range(rnd.randint(1, 12)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1]), (n + 3, "A"), (n + 4, "a"), (n + 5, "\n\n"), (None, rows[1][1]), (n + 6, "z" * 3000), (n + 7, rows[2][1] + " tail")]
    return rows


def brute_lines(rows, window=op1.WINDOW, words=op1.WORDS):
    """{(doc_id, text): (lines, removed, kept text)}; rows equal in both are one document."""

    def windows(lines):
        out = []
        for i in range(len(lines)):
            n = 0
            while i + n < len(lines) and n < window and (words is None or sum(len(x.encode().split()) for x in lines[i : i + n]) <= words):
                n += 1
            if n == window or (words is not None and sum(len(x.encode().split()) for x in lines[i : i + n]) > words):
                out.append((i, n))
        return out or ([(0, len(lines))] if lines else [])

    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = (text or "").split("\n") if text else [], set()
        for i, n in windows(lines):
            key = tuple(lines[i : i + n])
            if key in seen:
                gone |= set(range(i, i + n))
            seen.add(key)
        out[doc_id, text] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
@pytest.mark.parametrize(("window", "words"), [(1, None), (2, None), (3, 6), (4, 12), (4, 50)])
def test_line_dedup(spark, monkeypatch, window, words, broadcast):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rows = corpus()
    rows += [(60 + i, "\n".join([f"own {i}", *rows[3][1].split("\n"), f"end {i}"])) for i in range(3)] + [(70, "p q " * 30), (71, "x\n" + "p q " * 30 + "\ny"), (72, "\n" * 9)]
    expected = brute_lines(rows, window, words)
    got = {r.doc_id: (r.n_lines, max(0, r.n_removed), r.kept) for r in op1.dedup_lines(spark, frame(spark, rows), window=window, words=words).collect()}
    assert got == {d: v for (d, _), v in expected.items()}
    assert any(n for _, n, _ in got.values())


def test_line_windows_are_guaranteed_and_few(spark):
    rnd = random.Random(12)
    lines = [f"line {i} " + "w " * rnd.randint(0, 30) for i in range(400)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["other", *lines[100:140], "end"]))]
    prints = op1._fingerprints(frame(spark, rows).selectExpr("doc_id", "1L AS th", "split(text, '\n', -1) AS lines"), op1.WINDOW, op1.WORDS).collect()
    windows = {(r.doc_id, w.i) for r in prints for w in r.wins}
    assert len(windows) == sum(len(r.wins) for r in prints) and len(prints) < 0.7 * len(windows)
    own = {r.print for r in prints if r.doc_id == 1}
    assert all(r.print in own for r in prints if r.doc_id == 2 and all(1 <= w.i and w.i + w.n <= 41 for w in r.wins))


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
def test_line_dedup_repeated_rows_and_empty(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "a\nb")] + [(None, "a\nb\nc\nd\ne")] * 300 + [(9, "x\nb\nc\nd\ne"), (None, None)]
    got = Counter((r.doc_id, r.kept) for r in op1.dedup_lines(spark, frame(spark, rows)).collect())
    kept = brute_lines(rows)
    assert got == Counter((d, kept[d, t][2]) for d, t in rows)
    assert got[1, "a\nb"] == 2 and got[2, ""] == 1 and got[None, "a\nb\nc\nd\ne"] == 300 and got[9, "x"] == 1
    assert op1.dedup_lines(spark, frame(spark, [])).count() == 0


def test_long_single_lines(spark):
    rnd = random.Random(6)
    line = lambda n: " ".join(rnd.choice("abcdé") * rnd.randint(1, 4) for _ in range(n))
    pool = [line(n) for n in (5, 50, 51, 51, 80, 300)]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.4 else line(rnd.choice((3, 60))) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    rows += [(80, pool[4]), (81, line(4) + "\n" + pool[4]), (82, pool[1] + "\n" + line(4)), (None, pool[5] + "\n" + line(4)), (83, None), (84, "a " * 60 + "\n" + "a " * 60)]
    expected = {d: v[2] for (d, _), v in brute_lines(rows).items()}
    assert {r.doc_id: r.kept for r in op1.dedup_lines(spark, frame(spark, rows)).collect()} == expected
    assert expected[80] == "" and pool[4] not in expected[81] and pool[1] in expected[82] and pool[5] in expected[None]


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark):
    rows = corpus(5)
    base = " ".join(f"w{i}" for i in range(300))
    rows += [(200 + i, base + " x" * i) for i in range(12)]
    rows += [(300, "İ ı\tK\x0bk"), (301, "one two")]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = {}
    for d in fps:
        seen, todo = {d}, [d]
        while todo:
            x = todo.pop()
            new = {e for e in fps if e not in seen and (fps[x] ^ fps[e]).bit_count() <= 2}
            seen |= new
            todo += new
        root[d] = min((x for x in seen if x is not None), default=None)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4.near_duplicates(spark, frame(spark, rows)).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in fps}
    assert len({c for _, c in got.values()}) < len(rows)
    assert op4.near_duplicates(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [4, 8, 16])
def test_links_lose_nothing(spark, parts):
    """Random neighbourhoods: the forest has the components of the exhaustive comparison."""
    rng = np.random.default_rng(parts)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 1, 1, 2, 3, 4)} | {0, 1, 7, 2**64 - 1, 2**64 - 2}
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp bigint")
    pairs = [(r.a % 2**64, r.b % 2**64) for r in op4.links(nodes, 2, parts).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)

    def parts_of(edges):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        groups = {}
        for x in fps:
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    assert parts_of(pairs) == parts_of([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])


def test_components_of_a_long_chain(spark):
    from metrolith.llm.common import Staged

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 450)], "a bigint, b bigint")
    got = {r.node: r.root for r in op4.components(edges, Staged(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 450: 400, 500: 400}


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "anchor", "most"), [(20, 6, 2048), (20, 6, 1), (20, 6, 3), (50, 12, 2048)])
def test_repeat_removal(spark, length, anchor, most):
    rows = corpus(9)
    rows += [(500, "xy" * 400), (501, rows[3][1]), (501, rows[3][1]), (502, "é" * 30), (503, rows[4][1][:60] + "+" + rows[5][1][-60:])]
    got = sorted((tuple(r) for r in op5.remove_repeats(spark, frame(spark, rows), length=length, anchor=anchor, most=most).collect()), key=str)
    assert got == brute_repeats(rows, length)
    assert 0 < sum(g[2] for g in got) < sum(g[1] for g in got)


def test_repeat_removal_splits_hot_anchors(spark):
    rnd = random.Random(21)
    some = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    middle, sides = some(14), [some(30) for _ in range(6)]
    rows = [(i, some(20) + rnd.choice(sides)[rnd.randint(0, 25) :] + middle + rnd.choice(sides)[: rnd.randint(1, 30)] + some(20)) for i in range(120)]
    rows += [rows[5], (200, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]
    for most in (2, 5, 1000):
        got = sorted((tuple(r) for r in op5.remove_repeats(spark, frame(spark, rows), length=24, anchor=8, most=most).collect()), key=str)
        assert got == brute_repeats(rows, 24)


def test_repeat_removal_of_many_equal_rows(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcd ") for _ in range(4000))
    rows = [(None, text)] * 400 + [(3, text)] * 400 + [(4, text[:2000] + "!"), (5, "?" + text[1000:])]
    got = Counter(tuple(r)[:4] for r in op5.remove_repeats(spark, frame(spark, rows)).collect())
    assert got == {(None, 4000, 4000, 1): 400, (3, 4000, 4000, 1): 400, (4, 2001, 2000, 1): 1, (5, 3001, 3000, 1): 1}


def test_repeat_removal_of_nothing(spark):
    assert op5.remove_repeats(spark, frame(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in op5.remove_repeats(spark, frame(spark, [(1, None)])).collect()] == [(1, 0, 0, 0)]


def test_run_length_index():
    rnd = random.Random(1)
    for _ in range(40):
        strings = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 6))]
        where = [(i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)]

        def common(a, b):
            n, x, y = 0, strings[a[0]][a[1] :], strings[b[0]][b[1] :]
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return n

        index = op5.RunLengthIndex(strings)
        assert index.matching_statistics().tolist() == [max((common(a, b) for b in where if b != a), default=0) for a in where]
        assert index.run_length.sum() == index.size


def brute_winnow(text, k, window):
    points = [ord(c) for c in text]
    k = min(k, len(points))
    if not points:
        return []
    h = op6._HASH
    prefix = h.prefix(np.array(points, np.uint32))
    at = np.arange(len(points) - k + 1)
    grams = (h.ranges(prefix, at, at + k) >> np.uint64(20)).tolist()
    window = min(window, len(grams))
    kept = set()
    for i in range(len(grams) - window + 1):
        low = min(grams[i : i + window])
        kept.add(max(j for j in range(i, i + window) if grams[j] == low))
    return sorted((j, grams[j]) for j in kept)


def test_winnowing_selects_window_minima(monkeypatch):
    rnd = random.Random(2)
    texts = ["", "a", "aaaa" * 50, "é😀b" * 40] + ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 400))) for _ in range(20)]
    for step in (1 << 18, 7):
        monkeypatch.setattr(op6, "STEP", step)
        for t in texts:
            for k, w in ((3, 5), (20, 81), (1, 1)):
                hashes, places = op6.winnow(t, k, w)
                kept = brute_winnow(t, k, w)
                assert list(zip(places.tolist(), (hashes >> np.uint64(20)).tolist(), strict=True)) == kept
                assert op6.positions(op6.written(hashes, places)) == [(f"{h:011x}", at) for at, h in kept]


def test_short_edited_copies_share_fingerprints():
    rnd = random.Random(8)
    for n in [80, 81, 99, 100, 150, 199] * 20:
        text, other = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for _ in range(2))
        own, new = op6.Printed(text), op6.Printed(op6.edited(text, other))
        assert op6.likeness(own.set, new.set) > 0


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_winnowing_neighbours(spark, ranges):
    rows = [(i * 3, "".join(random.Random(i).choice("ab cé😀") for _ in range(i * 7 % 150))) for i in range(60)] + [(None, "first of all"), (7, "same"), (7, "same"), (10**12, None)]
    rows += [(None, f"no id {i}") for i in range(25)] + [(30, f"hot id {i}") for i in range(40)]
    digest = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1] or ""), r[1] or ""))
    expected = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        sets = [{h for _, h in brute_winnow(t, op6.K, op6.WINDOW)} for t in (text, new, following)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        expected.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), op6.written(*op6.winnow(text)), op6.written(*op6.winnow(new)), like(sets[0], sets[1]), like(sets[0], sets[2])))
    got = [tuple(r) for r in op6.compared(frame(spark, rows), ranges).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert op6.compared(frame(spark, []), ranges).count() == 0
    if ranges == 16:  # neither null nor the hot id stays in one part
        parts = op6.with_next(frame(spark, rows).select("doc_id", "text"), ranges).filter("ghost = 0").select("part", "doc_id").distinct().collect()
        assert len([1 for p in parts if p.doc_id is None]) > 2 and len([1 for p in parts if p.doc_id == 30]) > 2
    assert op6.fingerprint_texts(frame(spark, rows)).count() == len(rows)
