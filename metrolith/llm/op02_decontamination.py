"""Benchmark decontamination with a positional inverted index.

The training texts become index segments: per segment the sorted term hashes,
and for each term the ascending positions at which it stands (positions of
different documents lie `GAP` apart, so that no phrase spans two documents).
The segments are written once to the shared folder.  A set of test items then
visits every segment: a phrase starts from the postings of its rarest term
there, each further list is shifted by the term's offset in the phrase, and
what survives all intersections is an occurrence.  Proximity matches take the
same rarest list and ask each other term for a posting within `slop` words.

Test items are sent to the executors in blocks of bounded size, one after
another; each block reads the index once.  Texts never shuffle, so a hot
document, source or phrase burdens no single task.

Defined cases: a null or empty text has no words; an item without words, or
with a null id, has no windows; an item id that occurs twice counts once;
repeated document rows each give a row; empty tables give no contamination.
Terms are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import Rolling, Staged, blocks, narrow, raw, read, tidied

WINDOW = 10
GAP = 128
SEGMENT_BYTES = 1 << 20
BLOCK_WORDS = 200_000

INDEX_SCHEMA = "segment bigint, doc_ids array<bigint>, text_hashes array<bigint>, n_words array<int>, terms binary, heads binary, gaps binary"
HIT_SCHEMA = "segment bigint, place bigint, doc_id bigint, text_hash bigint, n_words bigint, spans array<int>, items array<string>"
RESULT_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
MATCH_SCHEMA = "doc_id bigint, item_id string, kind string, first_word bigint, n_words bigint"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_HASH = Rolling(20240601, 1 << 12)


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a column, in order, and where each text's words start."""
    data, offsets = raw(text)
    lower = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[lower]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] |= inside[cut]  # a text may start within the last one's word
    ends = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] |= inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    prefix = _HASH.prefix(lower)
    return _HASH.ranges(prefix, start, end), np.searchsorted(start, offsets)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index segments of the texts, with each row's id and text hash; needs no shuffle."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("heads", pa.binary()), ("gaps", pa.binary())])
        for block in blocks(batches, SEGMENT_BYTES):
            hashes, first = words_of(block.column(1))
            counts = np.diff(first)
            place = np.arange(len(hashes), dtype=np.int64) + GAP * np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            postings = place[order].astype(np.uint32)
            gaps = np.diff(postings, prepend=np.uint32(0))  # wraps; cumsum undoes it
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([block.column(0).to_pylist()], schema[1].type), pa.array([block.column(2).to_pylist()], schema[2].type), pa.array([counts.astype(np.int32)], schema[3].type)]
                + [pa.array([x.tobytes()], pa.binary()) for x in (ordered[heads], heads.astype(np.uint32), gaps)],
                schema=schema,
            )
            number += 1

    docs = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return docs.mapInArrow(tidied(segments), INDEX_SCHEMA)


class Segment:
    """One index row, opened."""

    def __init__(self, segment: int, doc_ids: list, text_hashes: list, n_words: list, terms: bytes, heads: bytes, gaps: bytes):
        self.number, self.doc_ids, self.text_hashes, self.n_words = segment, doc_ids, text_hashes, np.array(n_words, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words + GAP)])
        self.terms = np.frombuffer(terms, np.uint64)
        self.postings = np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.uint32).astype(np.int64)
        self.heads = np.append(np.frombuffer(heads, np.uint32).astype(np.int64), len(self.postings))
        self.wide = int(self.first[-1]) + GAP
        rank = np.repeat(np.arange(len(self.terms)), np.diff(self.heads))
        self.keys = rank * self.wide + self.postings  # ascending: by term, then position

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Each term's number in this segment, -1 if it has no postings here."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def from_rarest(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows (a row of term numbers each) that have all their terms here: the terms by ascending
        number of postings, and (window, position) of each posting of its rarest term."""
        counts = self.heads[ranks + 1] - self.heads[ranks]
        order = np.argsort(counts, axis=1, kind="stable")
        rows = np.arange(len(ranks))
        rare = ranks[rows, order[:, 0]]
        n = counts[rows, order[:, 0]]
        window = np.repeat(rows, n)
        within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        return order, window, self.postings[self.heads[rare][window] + within]

    def phrases(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        order, window, place = self.from_rarest(ranks)
        start = place - order[window, 0]
        keep = start >= 0
        window, start = window[keep], start[keep]
        for j in range(1, ranks.shape[1]):
            offset = order[window, j]
            key = ranks[window, offset] * self.wide + start + offset
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            keep = self.keys[at] == key
            window, start = window[keep], start[keep]
        return window, start

    def near(self, ranks: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where every other term stands within `slop` words."""
        order, window, place = self.from_rarest(ranks)
        for j in range(1, ranks.shape[1]):
            base = ranks[window, order[window, j]] * self.wide
            at = np.minimum(np.searchsorted(self.keys, base + np.maximum(place - slop, 0)), len(self.keys) - 1)
            keep = (self.keys[at] >= base) & (self.keys[at] <= base + place + slop)
            window, place = window[keep], place[keep]
        return window, place

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, list[str]]]]:
    """Windows of the test items in blocks of bounded size, by window length: (hashes, item number, item ids)."""
    held: dict[int, tuple[list, list]] = {}
    names: list[str] = []
    size = 0

    def packed() -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
        return [(np.array(h, np.uint64), np.array(n), names) for h, n in held.values()]

    for row in narrow(items, item_id=id_col, text=text_col).filter("item_id is not null").toLocalIterator():
        hashes, _ = words_of(pa.array([row.text], pa.string()))
        if not len(hashes):
            continue
        length = min(window, len(hashes))
        views = np.lib.stride_tricks.sliding_window_view(hashes, length)
        of = held.setdefault(length, ([], []))
        of[0].extend(views)
        of[1].extend([len(names)] * len(views))
        names.append(str(row.item_id))
        size += views.size
        if size >= BLOCK_WORDS * window:
            yield packed()
            held, names, size = {}, [], 0
    if names:
        yield packed()


def _by_block(spark: SparkSession, index: DataFrame, blocks_of: Iterator[list], search: Callable[[DataFrame, Broadcast], DataFrame]) -> list[DataFrame]:
    """What search finds, by block of test items. Of several blocks one after another is sent, its result
    staged and its broadcast freed, so that no more than two blocks are held, whatever the number of items."""
    block, following = next(blocks_of, []), next(blocks_of, None)
    if following is None:
        return [search(index, spark.sparkContext.broadcast(block))]
    staged = Staged(spark, "op2")
    if not hasattr(index, "_staged_at"):
        index = staged.put(index)  # segment numbers must be the same for every block
    parts = []
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        parts.append(staged.put(search(index, sent)))
        sent.destroy()
        block, following = following, next(blocks_of, None)
    return parts


def matches(spark: SparkSession, index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Every phrase occurrence of an item's windows; with `slop`, also where all terms of a window stand close."""
    return reduce(DataFrame.unionByName, _by_block(spark, index, item_blocks(items, id_col, text_col, window), lambda i, sent: _matched(i, sent, slop)))


def _matched(index: DataFrame, sent: Broadcast, slop: int | None) -> DataFrame:
    """MATCH_SCHEMA of one block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(**batch.slice(i, 1).to_pylist()[0])
                for hashes, item, names in sent.value:
                    ranks = seg.ranks(hashes)
                    alive = np.flatnonzero((ranks >= 0).all(axis=1))
                    for kind in ("phrase", "near") if slop is not None else ("phrase",):
                        w, at = seg.phrases(ranks[alive]) if kind == "phrase" else seg.near(ranks[alive], min(slop, GAP - 1))
                        doc = seg.document(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([seg.doc_ids[d] for d in doc], pa.int64()), pa.array([names[item[alive[x]]] for x in w], pa.string()), pa.array([kind] * len(w), pa.string()), pa.array(at - seg.first[doc], pa.int64()), pa.array(np.full(len(w), hashes.shape[1]), pa.int64())],
                            names=["doc_id", "item_id", "kind", "first_word", "n_words"],
                        )

    return index.mapInArrow(tidied(search), MATCH_SCHEMA)


def _merged(start: np.ndarray, length: np.ndarray) -> list[int]:
    """Disjoint ascending [start, end) pairs, flat."""
    order = np.argsort(start, kind="stable")
    out: list[int] = []
    for a, b in zip(start[order].tolist(), (start + length)[order].tolist(), strict=True):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _found(index: DataFrame, sent: Broadcast) -> DataFrame:
    """Per document row: the hit word spans and the items of one block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(**batch.slice(i, 1).to_pylist()[0])
                doc, start, length, item = [], [], [], []
                names: list[str] = []
                for hashes, of, names in sent.value:
                    ranks = seg.ranks(hashes)
                    alive = np.flatnonzero((ranks >= 0).all(axis=1))
                    if len(alive):
                        w, at = seg.phrases(ranks[alive])
                        doc.append(d := seg.document(at))
                        start.append(at - seg.first[d])
                        length.append(np.full(len(w), hashes.shape[1]))
                        item.append(of[alive[w]])
                spans: list[list[int]] = [[] for _ in seg.doc_ids]
                items: list[list[str]] = [[] for _ in seg.doc_ids]
                if doc:
                    d, s, n, k = (np.concatenate(x) for x in (doc, start, length, item))
                    order = np.argsort(d, kind="stable")
                    d, s, n, k = d[order], s[order], n[order], k[order]
                    edges = [0, *(np.flatnonzero(d[1:] != d[:-1]) + 1).tolist(), len(d)]
                    for a, b in zip(edges, edges[1:], strict=False):
                        if a == b:
                            continue
                        spans[d[a]] = _merged(s[a:b], n[a:b])
                        items[d[a]] = sorted({names[x] for x in k[a:b]})
                places = np.arange(len(seg.doc_ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), seg.number)), pa.array(places), pa.array(seg.doc_ids, pa.int64()), pa.array(seg.text_hashes, pa.int64()), pa.array(seg.n_words), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    names=["segment", "place", "doc_id", "text_hash", "n_words", "spans", "items"],
                )

    return index.mapInArrow(tidied(search), HIT_SCHEMA)


def decontaminate(spark: SparkSession, index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, keyed: bool = False) -> DataFrame:
    """A row per document row: words, hit words and the items that hit it (RESULT_SCHEMA, and `spans`, the hit
    words); if `keyed`, also `text_hash`, which tells rows of one id apart."""
    key = ["text_hash"] if keyed else []
    parts = _by_block(spark, index, item_blocks(items, id_col, text_col, window), _found)
    hits = parts[0]
    if len(parts) > 1:  # an item's windows are all in one block; a document's hits may come from several
        for p in parts[1:]:
            hits = hits.unionByName(p.filter(F.size("items") > 0))
        hits = hits.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, count, sha, all_spans = [], [], [], []
            for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                pairs = np.array(spans, np.int64).reshape(-1, 2)
                spans = _merged(pairs[:, 0], pairs[:, 1] - pairs[:, 0])
                hit.append(sum(spans[1::2]) - sum(spans[::2]))
                items = sorted(set(items))
                count.append(len(items))
                sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
                all_spans.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(all_spans, pa.list_(pa.int32())), *batch.columns[4:]],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *key],
            )

    schema = RESULT_SCHEMA + ", spans array<int>" + ", text_hash bigint" * keyed
    return hits.select("doc_id", "n_words", "spans", "items", *key).mapInArrow(tidied(summed), schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Staged(spark, "op2").put(build_index(read(spark, sf_dir, "documents")))
    return decontaminate(spark, index, read(spark, sf_dir, "benchmark")).drop("spans")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, g)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
