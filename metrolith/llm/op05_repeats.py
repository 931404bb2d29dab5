"""Removal of long repeated byte strings with a run-length compressed index.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus.

1. Winnowing: of the `ANCHOR`-byte hashes in each window of `length` bytes the smallest (rightmost on ties)
   is the window's anchor.  Equal windows have equal anchors, so the windows of one anchor occurrence, a
   *context* (its bytes are the union of the windows), need only meet the contexts of equal anchors.
2. Anchors that occur once are dropped.  Where all contexts of an anchor are identical, each window of them
   repeats; identical contexts are one context with a count from here on, so a group of any number of copies
   costs one entry.  A context that occurs twice repeats with all its windows.
3. The others of an anchor go to one bucket.  There the distinct contexts become a Burrows-Wheeler
   transform, kept as runs with the suffix positions and common prefixes sampled at both ends of each run.
   Streaming over the text, a position inside a run has its left neighbour's value less one, so the samples
   give every position's matching statistic against the rest of the bucket: its longest match elsewhere.
   A window whose statistic reaches `length` is repeated.
4. An anchor with more than `MOST` distinct contexts (a hot passage's edge) is split until no part has more:
   its windows by the number of bytes that they have behind the anchor, in halves, and each half by the bytes
   that all its windows must have before and behind the anchor.  Equal windows stay together, equal parts of
   contexts are again one with a count, and every part goes to the index like a whole anchor.
5. Marks meet their texts by document; a text whose marks are known from step 2 is finished on the way and
   only the others are kept for the marks of step 3.

Rows are told apart by two numbers: the id (for a null id a hash of the text) and a 64-bit hash of id and
text.  Contexts are taken as equal if two 64-bit hashes (anchor and whole) agree; windows within a bucket are
compared exactly.

Defined cases: a null text is empty; texts shorter than `length` keep everything; repeated rows, also with
equal or null ids, are texts of their own and repeat each other, and their marks are gathered once; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import Rolling, Staged, blocks, narrow, raw, read, tidied

LENGTH = 200
ANCHOR = 48
BLOCK_BYTES = 1 << 19
BUCKET_BYTES = 1 << 20
MOST = 512  # contexts of one anchor in one bucket: about 0.2 MB of text

RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
ANCHOR_SCHEMA = "anchor bigint, ctx bigint, k1 bigint, k2 bigint, s0 int, n int"
PASS_SCHEMA = RESULT_SCHEMA + ", k1 bigint, k2 bigint, text string, spans array<int>, anchor bigint, s0 int, n int, single boolean, bytes binary"
CONTEXT = ["anchor", "k1", "k2", "s0", "n", "single", "bytes"]
MARKS_SCHEMA = "k1 bigint, k2 bigint, spans array<int>"

_HASH = Rolling(977, 1 << 10)
_LOW = np.uint64((1 << 20) - 1)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor hash, context hash) of a block of texts."""
    out = []
    step = (1 << 19) - length
    for a in range(0, max(0, len(data) - length + 1), step):
        part = data[a : a + step + length - 1]
        prefix = _HASH.prefix(part)
        grams = np.arange(len(part) - k + 1)
        hashes = _HASH.ranges(prefix, grams, grams + k)
        low = sliding_minimum((hashes & ~_LOW) | (_LOW - grams.astype(np.uint64)), length - k + 1)
        at = (_LOW - (low & _LOW)).astype(np.int64)
        window = np.arange(len(at))
        text = np.searchsorted(offsets, window + a, "right") - 1
        fits = window + a + length <= offsets[text + 1]
        window, at, text = window[fits], at[fits], text[fits]
        if not len(window):
            continue
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
        s0, last = window[first], window[np.append(first[1:], len(window)) - 1]
        whole = _HASH.ranges(prefix, s0, last + length) ^ ((at[first] - s0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out.append((text[first], s0 + a - offsets[text[first]], last - s0 + 1, hashes[at[first]], whole))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several byte strings, sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        ends = np.cumsum([len(s) + 1 for s in strings])
        symbols = np.zeros(int(ends[-1]), np.int32)  # 0 ends a string; such ends differ and are ordered by place
        inside = np.ones(len(symbols), bool)
        inside[ends - 1] = False
        symbols[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int32) + 1
        self.size, self.starts = len(symbols), ends - np.array([len(s) + 1 for s in strings])
        order, levels = self._sorted(symbols)
        bwt = symbols[order - 1]
        change = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        heads, tails = np.flatnonzero(np.concatenate([[True], change])), np.flatnonzero(np.concatenate([change, [True]]))
        self.run_symbol, self.run_length = bwt[heads], tails - heads + 1
        self.head_at, self.tail_at = order[heads], order[tails]
        self.head_lcp = self._common(symbols, levels, self.head_at, np.concatenate([[-1], order])[heads])
        self.tail_lcp = self._common(symbols, levels, self.tail_at, np.concatenate([order, [-1]])[tails + 1])

    @staticmethod
    def _sorted(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by prefix doubling; the ranks by the first 6, 12, 24... symbols."""
        n, width = len(symbols), 6
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        padded = np.concatenate([symbols, np.zeros(width, np.int32)])
        for j in range(width):
            key = (key << 9) | np.where(alive, padded[j : j + n], 0)
            alive &= padded[j : j + n] != 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]]) | ~alive[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        levels = [(width, rank)]
        while True:
            alone = head & np.concatenate([head[1:], [True]])
            slots = np.flatnonzero(~alone)
            if not len(slots):
                return order, levels
            at = order[slots]
            key = rank[at].astype(np.int64) * n + rank[at + width]
            turn = np.argsort(key, kind="stable")
            at, key = at[turn], key[turn]
            order[slots] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            head[slots] = new
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            width *= 2
            levels.append((width, rank))

    @staticmethod
    def _common(symbols: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at a and b; none where b is -1."""
        some = b >= 0
        a, b = a.copy(), np.where(some, b, a)
        done = np.zeros(len(a), np.int64)
        last = len(symbols) - 1
        for width, rank in reversed(levels):
            same = some & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
            step = np.where(same, width, 0)
            a, b, done = a + step, b + step, done + step
        for _ in range(levels[0][0]):
            x, y = symbols[np.minimum(a, last)], symbols[np.minimum(b, last)]
            some = some & (x == y) & (x != 0)
            a, b, done = a + some, b + some, done + some
        return done

    def matching_statistics(self) -> np.ndarray:
        """For each position of the strings end to end, the length of its longest match at another position."""
        best = np.zeros(self.size, np.int64)
        place = np.arange(self.size)
        for at, lcp in ((self.head_at, self.head_lcp), (self.tail_at, self.tail_lcp)):
            sampled = np.zeros(self.size, np.int64)
            sampled[at] = place[at] + 1
            last = np.maximum.accumulate(sampled) - 1  # the nearest sample to the left; position 0 is one
            value = np.zeros(self.size, np.int64)
            value[at] = lcp
            best = np.maximum(best, value[last] - (place - last))
        return best


def repeated_windows(strings: list[bytes], windows: list[int], wanted: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """For each wanted string, the [first, last] runs of its leading windows that occur elsewhere in the list."""
    index = RunLengthIndex(strings)
    hit = index.matching_statistics() >= length
    out: list[list[tuple[int, int]]] = []
    for start, n, want in zip(index.starts.tolist(), windows, wanted, strict=True):
        at = np.flatnonzero(hit[start : start + n]) if want else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.diff(at) > 1)
        out.append(list(zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True)) if len(at) else [])
    return out


def _result(doc_id: int | None, text: bytes, spans: list[tuple[int, int]]) -> tuple:
    """The result row of a text of which the [start, end) spans go."""
    removed = runs = at = 0
    kept = hashlib.sha256()
    last = -1
    for a, b in sorted(spans):
        if a > last:
            kept.update(text[max(at, 0) : a])
            runs += 1
            removed += b - a
            last = at = b
        elif b > last:
            removed += b - last
            last = at = b
    kept.update(text[at:])
    return doc_id, len(text), removed, runs, kept.hexdigest()


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """ANCHOR_SCHEMA of docs (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            data, offsets = raw(block.column(2))
            text, s0, n, anchor, whole = contexts(data, offsets, length, k)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), block.column(0).take(at), block.column(1).take(at), pa.array(s0.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["anchor", "ctx", "k1", "k2", "s0", "n"],
            )

    return docs.select("k1", "k2", "text").mapInArrow(tidied(run), ANCHOR_SCHEMA)


def _passed(docs: DataFrame, length: int) -> DataFrame:
    """docs (doc_id, k1, k2, text, found): finished results; of the others text and spans, and the contexts to index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "k1", "k2", "text", "spans", "anchor", "s0", "n", "single", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in blocks(batches, 1 << 22):
            rows = []
            for doc_id, k1, k2, text, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                data = (text or "").encode()
                known = [(f["s0"], f["s0"] + f["n"] - 1 + length) for f in found or [] if f["settled"]]
                if any(not f["settled"] for f in found or []):
                    rows.append((doc_id, None, None, None, None, k1, k2, text, [x for s in known for x in s], None, None, None, None, None))
                else:
                    rows.append((*_result(doc_id, data, known), *[None] * 9))
                for f in found or []:
                    if f["index"]:
                        s0 = f["s0"]
                        rows.append((doc_id, None, None, None, None, k1, k2, None, None, f["anchor"], s0, f["n"], not f["settled"], data[s0 : s0 + f["n"] - 1 + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    return docs.mapInArrow(tidied(run), PASS_SCHEMA)


def _indexed(found: DataFrame, length: int) -> DataFrame:
    """MARKS_SCHEMA of contexts (CONTEXT) that have a bucket for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            runs = repeated_windows([r["bytes"] for r in held], [r["n"] for r in held], [r["single"] for r in held], length)
            marks = [(r["k1"], r["k2"], [x for a, b in s for x in (r["s0"] + a, r["s0"] + b + length)]) for r, s in zip(held, runs, strict=True) if s]
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([m[2] for m in marks], pa.list_(pa.int32()))], names=["k1", "k2", "spans"])

        for batch in batches:
            for row in batch.to_pylist():
                if size >= BUCKET_BYTES and row["anchor"] != held[-1]["anchor"]:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield out()

    return found.select(*CONTEXT).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidied(run), MARKS_SCHEMA)


def anchor_offset(data: np.ndarray, length: int, k: int) -> int:
    """Where a context's anchor stands: the smallest gram of its first window, as contexts() takes it."""
    at = np.arange(length - k + 1)
    hashes = _HASH.ranges(_HASH.prefix(data[:length]), at, at + k)
    return int(np.argmin((hashes & ~_LOW) | (_LOW - at.astype(np.uint64))))


def halves(data: bytes, key: int, n: int, offset: int, low: int, high: int, length: int, k: int) -> list[tuple]:
    """The two parts of a context, as (key, whole, offset, low, high, first, n, bytes).

    low <= r < high for the number r of bytes that a window of it has behind the anchor.  All windows of the
    part [a, b) have a bytes behind the anchor and length - k - b + 1 before it; these make its key.
    """
    out = []
    middle = (low + high) // 2
    base = length - k - offset  # r of the context's first window
    for a, b in ((low, middle), (middle, high)):
        first, last = max(0, a - base), min(n - 1, b - 1 - base)
        if a == b or last < first:
            continue
        before = length - k - b + 1
        shared = hashlib.blake2b(data[offset - before : offset + k + a], digest_size=8, key=b"%d:%d:%d" % (key, a, b)).digest()
        part = data[first : last + length]
        whole = hashlib.blake2b(part, digest_size=8, key=b"%d" % (offset - first)).digest()
        out.append((int.from_bytes(shared, "big", signed=True), int.from_bytes(whole, "big", signed=True), offset - first, a, b, first, last - first + 1, part))
    return out


def _halved(hot: DataFrame, length: int, k: int) -> DataFrame:
    """The halves of contexts (CONTEXT, and offset, low, high, null for a whole one) and their ctx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "ctx", "offset", "low", "high", "s0", "n", "bytes", "k1", "k2", "single"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                offset, low, high = r["offset"], r["low"], r["high"]
                if offset is None:
                    offset, low, high = anchor_offset(np.frombuffer(r["bytes"], np.uint8), length, k), 0, length - k + 1
                for key, whole, at, a, b, first, n, part in halves(r["bytes"], r["anchor"], r["n"], offset, low, high, length, k):
                    rows.append((key, whole, at, a, b, r["s0"] + first, n, part, r["k1"], r["k2"], r["single"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    return hot.select(*CONTEXT, "offset", "low", "high").mapInArrow(tidied(run), "anchor bigint, ctx bigint, offset int, low int, high int, s0 int, n int, bytes binary, k1 bigint, k2 bigint, single boolean")


def _split(staged: Staged, found: DataFrame, hot: DataFrame, length: int, k: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts for the index, and marks, of hot anchors; at most log2(length) rounds."""
    cold, marks = [], []
    now = found.join(hot, "anchor").select(*CONTEXT, *[F.lit(None).cast("int").alias(c) for c in ("offset", "low", "high")])
    while True:
        parts = staged.put(_halved(now, length, k))
        place = F.struct("k1", "k2", "s0")
        once = staged.put(parts.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), F.min(place).alias("rep"), F.bool_and("single").alias("alone")))
        of = parts.withColumnRenamed("single", "was").join(once, ["anchor", "ctx"])
        settled = of.filter("was and (c > 1 or not alone)")
        marks.append(settled.select("k1", "k2", F.array("s0", F.col("s0") + F.col("n") - 1 + length).alias("spans")))
        kept = of.filter(F.col("rep").eqNullSafe(place)).withColumn("single", F.expr("c = 1 and alone"))
        sizes = once.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > most).select("anchor")
        sizes = staged.put(sizes)
        hotter = kept.join(sizes, "anchor", "left_semi").filter("high - low > 1")
        cold.append(kept.join(sizes, "anchor", "left_anti").select(*CONTEXT).unionByName(kept.join(sizes, "anchor", "left_semi").filter("high - low <= 1").select(*CONTEXT)))
        if not sizes.take(1):
            return cold, marks
        now = staged.put(hotter.select(*CONTEXT, "offset", "low", "high"))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """A row per document row (RESULT_SCHEMA)."""
    staged = Staged(spark, "op5")
    k1 = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(7), "text")).otherwise(F.col("doc_id").cast("bigint"))
    docs = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", k1.alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "text")
    rows = staged.put(_anchors(docs, length, anchor))
    groups = rows.groupBy("anchor").agg(F.count("*").alias("g"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).filter("g > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    groups = staged.put(groups)  # a table, so that adaptive execution may split the join where an anchor is hot
    shared = staged.put(rows.join(groups, "anchor"))
    staged.drop(rows)

    mixed, place = shared.filter("mixed").drop("mixed"), F.struct("k1", "k2", "s0")
    distinct = staged.put(mixed.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), F.min(place).alias("rep")))
    settled = F.col("c") > 1
    known = mixed.join(distinct, ["anchor", "ctx"]).withColumn("index", F.col("rep") == place)
    known = known.select("k1", "k2", F.struct("s0", "n", "anchor", settled.alias("settled"), "index").alias("f"))
    plain = shared.filter("not mixed").select("k1", "k2", F.struct("s0", "n", "anchor", F.lit(True).alias("settled"), F.lit(False).alias("index")).alias("f"))
    # A set, so that rows with equal id and text, however many, gather one text's contexts.
    of = known.unionByName(plain).groupBy("k1", "k2").agg(F.collect_set("f").alias("found"))
    passed = staged.put(_passed(docs.join(of, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "found"), length))

    found = passed.filter("bytes is not null")
    if found.count() > distinct.count():  # rows with equal id and text hand on equal contexts
        found = staged.put(found.select(*CONTEXT).dropDuplicates(["anchor", "k1", "k2", "s0"]))
    hot = staged.put(distinct.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > most).select("anchor"))
    marks = []
    if hot.take(1):
        cold, marks = _split(staged, found, hot, length, anchor, most)
        found = reduce(DataFrame.unionByName, cold, found.join(hot, "anchor", "left_anti").select(*CONTEXT))
    marks = reduce(DataFrame.unionByName, marks, _indexed(found, length))
    marks = marks.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("more"))
    waiting = passed.filter("n_bytes is null and bytes is null").select("doc_id", "k1", "k2", "text", "spans")
    waiting = waiting.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "spans", "more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 22):
            out = []
            for doc_id, text, spans, more in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                flat = spans + (more or [])
                out.append(_result(doc_id, (text or "").encode(), list(zip(flat[::2], flat[1::2], strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ready = passed.filter("n_bytes is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return ready.unionByName(waiting.mapInArrow(tidied(finish), RESULT_SCHEMA))


def op5_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, read(spark, sf_dir, "documents"))
