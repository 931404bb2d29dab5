"""Document fingerprints by winnowing.

Every `K` consecutive code points have a rolling hash; of each `WINDOW` consecutive hashes the smallest is
kept, the rightmost on ties, with its position.  Texts that share K + WINDOW - 1 code points share a
fingerprint, wherever the passage stands: 40 of them, so also a text of 80 and a copy that keeps half of it.
Shorter passages may share none.  A fingerprint string is a list of records of 16 hexadecimal
digits: 11 of the hash (44 bits), 5 of the distance from the last kept position, which is below WINDOW + 1;
positions() reads it.  The likeness of two fingerprints is the Jaccard index of their hash sets.

To compare each document with the next one, documents are dealt into ranges of doc_id, sorted within each,
and each range also gets a copy of the next range's first document; so texts shuffle once and only
neighbouring rows are held.  An id that fills several ranges, or null, is dealt further by a hash of the text;
only rows equal in id and text stay together.

Defined cases: a null text is empty; an empty text has an empty fingerprint; two empty ones are alike (1),
an empty one and another are not (0); a text shorter than K is one gram.  Null ids come first; rows of one
doc_id are ordered by a hash of the text, then by text; a single row is its own next.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import Rolling, narrow, read, tidied

K = 20
WINDOW = 21
STEP = 1 << 18
RESULT_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_HASH = Rolling(7411, 1 << 12)
_LOW = np.uint64((1 << 20) - 1)
FLUSH_ROWS = 32


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the kept grams. A hash has 44 significant bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, n)
    grams = n - k + 1
    window = min(window, grams, 1 << 19)
    hashes, places = [], []
    for a in range(0, grams - window + 1, STEP):  # windows that start in [a, a + STEP)
        part = points[a : a + STEP + window + k - 2]
        prefix = _HASH.prefix(part)
        at = np.arange(len(part) - k + 1)
        key = (_HASH.ranges(prefix, at, at + k) & ~_LOW) | (_LOW - at.astype(np.uint64))
        low, span = key, 1
        while 2 * span <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
        place = (_LOW - (low & _LOW)).astype(np.int64) + a
        new = np.concatenate([[not places or places[-1][-1] != place[0]], place[1:] != place[:-1]])
        hashes.append((low & ~_LOW)[new])
        places.append(place[new]) if new.any() else None
    return np.concatenate(hashes), np.concatenate(places)


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    return (hashes | np.diff(places, prepend=0).astype(np.uint64)).astype(">u8").tobytes().hex()


def positions(fingerprint: str) -> list[tuple[str, int]]:
    """(hash, position) of each record of a fingerprint string."""
    at, out = 0, []
    for i in range(0, len(fingerprint), 16):
        at += int(fingerprint[i + 11 : i + 16], 16)
        out.append((fingerprint[i : i + 11], at))
    return out


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


class Printed:
    """A text with its fingerprint."""

    def __init__(self, text: str):
        hashes, places = winnow(text)
        self.text, self.string, self.set = text, written(hashes, places), set(hashes.tolist())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the plain operator, without neighbours; needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(*winnow(t.as_py() or "")) for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(tidied(run), "doc_id bigint, fingerprint string")


def dealt(docs: DataFrame, ranges: int) -> Column:
    """The part of each row of docs (doc_id, h), by ascending id (null first) and h: bounds are quantiles of the
    ids, and of h, which is a hash, where an id (or null) fills more than one of the ranges."""
    wide = lambda m: [round((j / m - 0.5) * (1 << 64)) for j in range(1, m)]
    quantiles = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    often = Counter(int(q) for q in quantiles)
    least = -(1 << 63)
    bounds = sorted((i, t) for i, m in often.items() for t in [least, *wide(m)])
    rows, empty = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    of_null = wide(max(1, round(ranges * empty / max(1, rows))))
    null_part = F.size(F.filter(F.lit(of_null), lambda t: t <= F.col("h"))) if of_null else F.lit(0)
    if not bounds:
        return F.when(F.col("doc_id").isNull(), null_part).otherwise(len(of_null) + 1)
    ids, hashes, k = F.lit([i for i, _ in bounds]), F.lit([t for _, t in bounds]), max(1, math.isqrt(len(bounds)))

    def reached(j: Column) -> Column:
        at = F.get(ids, j)
        return (at < F.col("doc_id")) | ((at == F.col("doc_id")) & (F.get(hashes, j) <= F.col("h")))

    # How many bounds are reached: first of every k-th bound, then of the k that follow.
    before = F.size(F.filter(F.lit(list(range(k - 1, len(bounds), k))), reached)) * k
    rest = F.filter(F.sequence(before, F.least(before + k, F.lit(len(bounds))) - 1), reached)
    part = F.when(before < len(bounds), before + F.size(rest)).otherwise(before)
    return F.when(F.col("doc_id").isNull(), null_part).otherwise(part + len(of_null) + 1)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, ghost, doc_id, text): rows by ascending id, then hash of the text, then text, within each part, and
    after each part's rows, as ghosts, copies of the first row of the next part (of the first part after the last)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    docs = docs.select(dealt(docs, ranges).alias("part"), F.lit(0).alias("ghost"), "doc_id", "h", "text")
    # At most some ranges rows: the first id and hash of each part.
    order = [F.col("doc_id").isNotNull().alias("some"), "doc_id", "h"]
    firsts = sorted((r.part, r.low.doc_id, r.low.h) for r in docs.groupBy("part").agg(F.min(F.struct(*order)).alias("low")).collect())
    if not firsts:
        return docs.drop("h")
    before = {p: firsts[i - 1][0] for i, (p, _, _) in enumerate(firsts)}
    chosen = F.col("doc_id").isNull()
    if ids := [d for _, d, _ in firsts if d is not None]:
        chosen = chosen | F.col("doc_id").isin(ids)
    chosen = chosen & F.col("h").isin([h for _, _, h in firsts])
    ghosts = docs.filter(chosen).groupBy("part").agg(F.min(F.struct(*order, "text")).alias("r"))
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ghosts = ghosts.select(to[F.col("part")].alias("part"), F.lit(1).alias("ghost"), "r.doc_id", "r.h", "r.text")
    sorted_rows = docs.unionByName(ghosts).repartition("part").sortWithinPartitions("part", "ghost", F.asc_nulls_first("doc_id"), "h", "text")
    return sorted_rows.drop("h")


def compared(docs: DataFrame, ranges: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT_SCHEMA, a row per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, Printed] | None = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for ghost, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                now = Printed(text.as_py())
                if held is not None:
                    own = held[1]
                    new = edited(own.text, now.text)
                    hashes, places = winnow(new)
                    out.append((held[0], len(own.text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.string, written(hashes, places), likeness(own.set, set(hashes.tolist())), likeness(own.set, now.set)))
                held = None if ghost else (doc_id, now)
                if len(out) >= FLUSH_ROWS:
                    yield flushed()
        if out:
            yield flushed()

    return with_next(narrow(docs, doc_id=id_col, text=text_col), ranges).mapInArrow(tidied(run), RESULT_SCHEMA)


def op6_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return compared(read(spark, sf_dir, "documents"), ranges)
