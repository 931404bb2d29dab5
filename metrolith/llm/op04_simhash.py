"""SimHash near-dedup by tiled exact comparison.

1. Every text gets a 64-bit fingerprint of its three-word shingles (one pass, no shuffle).
2. Distinct fingerprints are dealt into tiles.  A tile holds the fingerprints with the same population
   count in each of `parts` sub-words.  Two fingerprints differ in at least as many bits as the population
   counts of their sub-words differ in sum, so a tile pair whose counts differ by more than the radius is
   skipped; every other pair is compared exactly, by numpy exclusive-or and bit counts.  A fingerprint
   stays in its home tile and visits each admissible tile on one side, so each tile pair meets once.
3. A tile hands on only a spanning forest of its links, never all pairs of a group.
4. Components come from alternating large-star and small-star rounds over that forest, each round staged
   in the shared folder.

Copies meet as one fingerprint, so a hot group costs one row; documents are joined to their component by
fingerprint, which adaptive execution splits where a group is hot.

Defined cases: a text of fewer than three words is one shingle; none (null and empty texts too) is
fingerprint zero, linked like any other; repeated rows each give a row; a null doc_id is never a
component's id unless all of its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import Staged, narrow, read, tidied

RADIUS = 2
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z alone, splits at the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    ones, at = np.zeros(64, np.int64), 0
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in cuts), np.uint64, n)
    while at < n:
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += 4096
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(tidied(run), "doc_id bigint, text_hash bigint, fp bigint")


def _steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius whose first non-zero entry is positive."""
    out = []
    for n in range(1, radius + 1):
        for where in itertools.combinations(range(parts), n):
            for values in itertools.product(range(-radius, radius + 1), repeat=n):
                if 0 not in values and sum(map(abs, values)) <= radius and values[0] > 0:
                    step = [0] * parts
                    for i, v in zip(where, values, strict=True):
                        step[i] = v
                    out.append(tuple(step))
    return out


def _tiles(fps: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of the sub-words, a row for each fingerprint."""
    width = 64 // parts
    shifts = (np.arange(parts, dtype=np.uint64) * np.uint64(width))[None, :]
    mask = np.uint64((1 << width) - 1)
    return np.bitwise_count((fps[:, None] >> shifts) & mask).astype(np.int64)


def forest(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `home` and between `home` and `visitors`."""
    everyone = np.concatenate([home, visitors])
    root = list(range(len(everyone)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    rows = max(1, (1 << 20) // max(1, len(everyone)))
    for a in range(0, len(home), rows):
        i, j = np.nonzero(np.bitwise_count(home[a : a + rows, None] ^ everyone[None, a:]) <= radius)
        keep = j > i
        for x, y in zip((i[keep] + a).tolist(), (j[keep] + a).tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[q] = p
                left.append(x)
                right.append(y)
    return everyone[left], everyone[right]


def links(nodes: DataFrame, radius: int = RADIUS, parts: int = 4) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints of `nodes` (fp)."""
    width = 64 // parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.array([[0] * parts, *_steps(parts, radius)], np.int64)
        place = (width + 1) ** np.arange(parts, dtype=np.int64)
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fps), 1 << 14):
                fps = all_fps[at : at + (1 << 14)]
                counts = _tiles(fps.view(np.uint64), parts)
                for step, visits in zip(steps, [False] + [True] * (len(steps) - 1), strict=True):
                    to = counts + step
                    ok = ((to >= 0) & (to <= width)).all(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(to[ok] @ place), pa.array(np.full(ok.sum(), visits)), pa.array(fps[ok])], names=["tile", "visits", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tile = None

        def done() -> tuple[list, list]:
            fps, visits = (np.concatenate(x) for x in zip(*held, strict=True))
            home = fps[~visits]
            return forest(home, fps[visits], radius) if len(home) and len(fps) > 1 else ([], [])

        left, right, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])

        for batch in batches:
            tiles, visits, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps = fps.view(np.uint64)
            edges = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and tiles[a] != tile:
                    x, y = done()
                    held.clear()
                    if len(x):
                        left.append(x)
                        right.append(y)
                        size += len(x)
                held.append((fps[a:b], visits[a:b].astype(bool)))
                tile = tiles[a]
            if size > 10_000:
                yield out()
                left, right, size = [], [], 0
        if held:
            x, y = done()
            if len(x):
                left.append(x)
                right.append(y)
        if left:
            yield out()

    dealt = nodes.select("fp").mapInArrow(tidied(deal), "tile bigint, visits boolean, fp bigint")
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidied(compare), "a bigint, b bigint")


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches.

    Large-star and small-star rounds until nothing changes; a node's neighbours are never gathered in
    one place: minima are aggregated and joined back.
    """
    now = staged.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged.put(large.filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, now = now, staged.put(small.filter("a <> b").distinct())
        for old in (last, large):
            staged.drop(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash), a row per document row; text_hash tells rows of one id apart."""
    staged = Staged(spark, "op4")
    own = staged.put(fingerprints(docs, id_col, text_col, shingle))
    nodes = staged.put(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = nodes.count()
    # More sub-words make smaller tiles and more visits; either way every admissible pair is compared.
    parts = 4 if n < 1 << 22 else 8 if n < 1 << 30 else 16
    roots = components(links(nodes, radius, parts), staged)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged.put(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.filter("fp <> root").join(least, "root").select("fp", "component_id").unionByName(least.select(F.col("root").alias("fp"), "component_id"))
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents")).drop("text_hash")
