"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Class k (1 <= k <= CLASSES) takes pieces of at most capacity/k tokens and fills each of its bins with
exactly k of them.  A document longer than the capacity gives full class-1 pieces; what is left, if k of it
would leave a bin more than `SLACK` empty, is cut to exactly the next class's size and the rest is placed in
the same way.  Rests below the last class go into one running bin that is cut where it is full, and so do
the unfinished bins of a worker at its end: each worker pads one sequence of its own, whatever the number
of classes.  Workers fill their bins independently; nothing shuffles and no state but the open bins'
pieces is held: at most CLASSES**2 / 2, and those of one running bin, each with its own ids alone.

Ids come from a public tokenizer file.  Equal words get equal ids, so each worker remembers the ids of the
words it has seen (a bounded table); texts with characters outside a range whose handling is plain go to the
tokenizer whole.

Defined cases: a null or empty text has the closing id alone; repeated rows are packed each; a null doc_id
is kept as null; an empty table gives no rows.  sequence_id is unique over workers: the worker's number and
a running number.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from metrolith.llm.common import narrow, read, tidied

CAPACITY = 4096
CLASSES = 16
SLACK = 0.01
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
WORDS_HELD = 200_000

RESULT_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

_LATIN = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]]
_KINDS = {kind: re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == kind)) for kind in "LN"}
# Characters that composing, lower-casing and splitting treat alike in Python and in the tokenizer.
PLAIN = re.compile("[\t\n\r " + re.escape("".join(c for c in _LATIN if c != "\xad")) + "]*")
# The tokenizer file's own splitting pattern, over the plain characters.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_KINDS['L']}]+|[{_KINDS['N']}]|[^\\s{_KINDS['L']}{_KINDS['N']}]+")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        model = tokenizer.model
        # The tokenizer's own spelling of each plain character; a word then goes to its model alone.
        spelled = str.maketrans({c: tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN})

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.array([t.id for t in model.tokenize(word.translate(spelled))], "<u4").tobytes()
                self[word] = ids
                return ids

        self.tokenizer, self.words = tokenizer, Words()

    def ids(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = b"".join(map(self.words.__getitem__, PIECES.findall(text.lower())))
        if len(self.words) > WORDS_HELD:
            self.words.clear()
        return out


def encoder(tokenizer: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    import public_tokenizers
    import tokenizers

    held = tokenizers.__dict__.setdefault("_held_encoders", {})
    if tokenizer not in held:
        held[tokenizer] = Encoder(public_tokenizers.path(tokenizer))
    return held[tokenizer]


def cuts(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order; class 0 is the running bin."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k > classes:
            out.append((rest, 0))
            break
        if k * rest >= capacity * (1 - SLACK):
            out.append((rest, k))
            break
        k += 1
        if k > classes:
            out.append((rest, 0))
            break
        out.append((capacity // k, k))
        rest -= capacity // k
    return out


class Bins:
    """The open bins of one worker. A piece: (document, start, ids), ids being its own alone, 4 bytes each;
    full bins go to `closed`."""

    def __init__(self, capacity: int, classes: int):
        self.capacity, self.open = capacity, [[] for _ in range(classes + 1)]
        self.used, self.closed = 0, []

    def put(self, piece: tuple, k: int) -> None:
        if k:
            self.open[k].append(piece)
            if len(self.open[k]) == k:
                self.closed.append(self.open[k])
                self.open[k] = []
            return
        document, start, ids = piece
        while ids:
            part = min(len(ids) // 4, self.capacity - self.used)
            self.open[0].append((document, start, ids[: 4 * part]))
            self.used += part
            start, ids = start + part, ids[4 * part :]
            if self.used == self.capacity:
                self.closed.append(self.open[0])
                self.open[0], self.used = [], 0

    def finish(self) -> None:
        left = [piece for bin_ in self.open[1:] for piece in bin_]
        self.open[1:] = [[] for _ in self.open[1:]]
        for piece in left:
            self.put(piece, 0)
        if self.open[0]:
            self.closed.append(self.open[0])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, classes: int = CLASSES, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """A row per piece (RESULT_SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, bins = encoder(tokenizer), Bins(capacity, classes)
        sequence = TaskContext.get().partitionId() << 36
        closing = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for bin_ in bins.closed:
                offset = 0
                for (doc_id, tokens), start, ids in bin_:
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            bins.closed = []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = of.ids(text.as_py() or "") + closing
                document, at = (doc_id, len(ids) // 4), 0
                for length, k in cuts(len(ids) // 4, capacity, classes):
                    bins.put((document, at, ids[4 * at : 4 * (at + length)]), k)
                    at += length
            if bins.closed:
                yield rows()
        bins.finish()
        if bins.closed:
            yield rows()

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(tidied(run), RESULT_SCHEMA)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
