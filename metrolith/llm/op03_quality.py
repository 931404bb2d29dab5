"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as bytes in chunks of `CHUNK` filter positions that overlap by the filters' width less one,
so that the chunks together cover every position of the whole text.  `FILTERS` learned filters run over
each chunk; each filter's largest activation in the chunk is the chunk's value.  The chunk values of a text
are combined, by their mean and their maximum, and one logistic layer makes the probability.

A filter is the product of learned byte embeddings and weights, so its activation is a sum of table look-ups
by byte and tap.  Training is logistic loss with Adam, a rejected row counting REJECT_WEIGHT times, on a bounded sample of the labelled rows, chosen by a
hash of the id (`TRAIN_ROWS`), with a fixed seed.  Scoring needs no shuffle.

Defined cases: a null or empty text has no chunks and gets the score of all-zero features; repeated rows are
scored each; rows of the labels whose id or label is null are not learned from; with no label rows every
score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import narrow, read, tidied

CHUNK = 256
PAD = 256  # beside the 256 bytes
WIDTH = 5
DEPTH = 8
FILTERS = 16
STEPS = 500
BATCH = 24
RATE = 0.02
TRAIN_ROWS = 3000
TRAIN_BYTES = 1 << 25
THRESHOLD = 0.3
REJECT_WEIGHT = 4.0


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, a row of bytes each (PAD past a text's end), and each chunk's text."""
    counts = np.array([-(-len(t) // CHUNK) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    out = np.full((len(of), CHUNK + WIDTH - 1), PAD, np.uint16)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        if n:
            line = np.full(n * CHUNK + WIDTH - 1, PAD, np.uint16)
            line[: len(text)] = np.frombuffer(text, np.uint8)
            out[at : at + n] = np.lib.stride_tricks.as_strided(line, (n, CHUNK + WIDTH - 1), (2 * CHUNK, 2))
            at += n
    return out, of


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
            "taps": rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH, DEPTH, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def tables(self) -> np.ndarray:
        """Each byte's contribution to each filter, by tap."""
        t = np.einsum("bd,wdf->wbf", self.p["embed"], self.p["taps"])
        return np.concatenate([t, np.zeros((WIDTH, 1, FILTERS), t.dtype)], axis=1)  # padding adds nothing

    def pooled(self, rows: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest activation in each chunk; with `where`, also its position."""
        values = np.empty((len(rows), FILTERS), np.float32)
        at = np.empty((len(rows), FILTERS), np.int64) if where else None
        for a in range(0, len(rows), 64):
            part = rows[a : a + 64]
            sums = tables[0][part[:, :CHUNK]]
            for tap in range(1, WIDTH):
                sums += tables[tap][part[:, tap : tap + CHUNK]]
            if where:
                at[a : a + 64] = sums.argmax(axis=1)
            values[a : a + 64] = sums.max(axis=1)
        return np.maximum(values + self.p["shift"], 0), at

    @staticmethod
    def combined(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean and maximum over each text's chunks, chunk counts, and which chunk has the maximum."""
        counts = np.bincount(of, minlength=n)
        mean, top, best = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.int64)
        some = np.flatnonzero(counts)
        first = np.cumsum(counts) - counts
        if len(some):
            mean[some] = np.add.reduceat(values, first[some], axis=0) / counts[some, None]
            top[some] = np.maximum.reduceat(values, first[some], axis=0)
        for i in some:
            best[i] = first[i] + values[first[i] : first[i] + counts[i]].argmax(axis=0)
        return np.concatenate([mean, top], axis=1), counts, best

    def scores(self, texts: list[bytes], tables: np.ndarray) -> np.ndarray:
        rows, of = chunks(texts)
        values, _ = self.pooled(rows, tables)
        counts = np.bincount(of, minlength=len(texts))
        features = np.zeros((len(texts), 2 * FILTERS), np.float32)
        some, first = np.flatnonzero(counts), np.cumsum(counts) - counts
        if len(some):
            features[some, :FILTERS] = np.add.reduceat(values, first[some], axis=0) / counts[some, None]
            features[some, FILTERS:] = np.maximum.reduceat(values, first[some], axis=0)
        return 1 / (1 + np.exp(-(features.astype(np.float64) @ self.p["out"] + self.p["bias"][0])))

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int | None = None) -> Network:
        rng = np.random.default_rng(5)
        prior = np.clip(labels.mean(), 0.01, 0.99)
        self.p["bias"][0] = np.log(prior / (1 - prior))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        order = np.zeros(0, np.int64)
        steps = steps or STEPS
        for step in range(1, steps + 1):
            if len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(len(texts))])
            pick, order = order[:BATCH], order[BATCH:]
            grads = self.gradients([texts[i] for i in pick], labels[pick])
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(texts)
        rows, of = chunks(texts)
        values, at = self.pooled(rows, self.tables(), where=True)
        features, counts, best = self.combined(values, of, n)
        score = 1 / (1 + np.exp(-(features @ p["out"] + p["bias"][0])))
        error = ((score - labels) * np.where(labels > 0, 1.0, REJECT_WEIGHT) / n).astype(np.float32)
        to_features = error[:, None] * p["out"][None, :]
        back = np.zeros_like(values)
        if len(of):
            back += (to_features[:, :FILTERS] / np.maximum(counts, 1)[:, None])[of]
            some = np.flatnonzero(counts)
            np.add.at(back, (best[some], np.arange(FILTERS)[None, :]), to_features[some, FILTERS:])
            back[values <= 0] = 0
        row, filt = np.nonzero(back)
        g, place = back[row, filt], at[row, filt]
        d_embed, d_taps = np.zeros_like(p["embed"]), np.zeros_like(p["taps"])
        for tap in range(WIDTH):
            byte = rows[row, place + tap]
            real = byte != PAD
            np.add.at(d_embed, byte[real], g[real, None] * p["taps"][tap][:, filt[real]].T)
            sums = np.zeros((FILTERS, DEPTH), np.float32)
            np.add.at(sums, filt[real], g[real, None] * p["embed"][byte[real]])
            d_taps[tap] = sums.T
        out = {"embed": d_embed, "taps": d_taps, "shift": back.sum(axis=0), "out": features.T @ error, "bias": error.sum(keepdims=True)}
        out["out"] = out["out"] + 1e-4 * p["out"]
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Network | None:
    """A network fitted to at most `rows` different labelled rows that are not held out, and to the first of
    them that together hold TRAIN_BYTES, so that neither many nor long rows of one id reach the driver; None if
    there are none."""
    known = narrow(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    sample = F.broadcast(known)  # at most `rows` rows of two numbers
    texts_of = narrow(docs, doc_id=id_col, text=text_col).join(sample, "doc_id").select("doc_id", "label", "text", F.xxhash64("text").alias("th"))
    # First without texts: an id may have any number of rows, of which copies count once.
    order = [F.xxhash64("doc_id"), "doc_id", "th", "label"]
    found = texts_of.groupBy("doc_id", "th", "label").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count("*").alias("copies")).orderBy(*order).limit(rows)
    chosen, held, single = {}, 0, True
    for row in found.collect():  # at most `rows` rows of five numbers
        if held + row.n <= TRAIN_BYTES:
            held += row.n
            chosen[row.doc_id, row.th, float(row.label)] = len(chosen)
            single = single and row.copies == 1
    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame(list(chosen), "doc_id bigint, th bigint, label double")
    picked = texts_of.withColumn("label", F.col("label").cast("double")).join(F.broadcast(wanted), ["doc_id", "th", "label"])
    picked = picked if single else picked.dropDuplicates(["doc_id", "th", "label"])
    known_rows = sorted(picked.collect(), key=lambda r: chosen[r.doc_id, r.th, r.label])  # at most TRAIN_BYTES of text
    return Network().fit([(r.text or "").encode() for r in known_rows], np.array([r.label for r in known_rows], np.float32))


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), a row per document row."""
    tables = network.tables() if network else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 64):
                texts = [(t or "").encode() for t in batch.column(1).slice(a, 64).to_pylist()]
                out.append(network.scores(texts, tables) if network else np.full(len(texts), 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(tidied(run), "doc_id bigint, score double")


def accepted(docs: DataFrame, network: Network | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; needs no shuffle."""
    tables = network.tables() if network else None
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                keep = network.scores(texts, tables) >= threshold if network else np.ones(len(texts), bool)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
