"""Helpers that several operators share: the shared folder, staged tables, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

BROADCAST_BYTES = 32 << 20  # of a table's rows; what has more is joined by a shuffle

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir); where that is unset, as in tests, a temporary
    one of this machine, which only a local session may use."""
    global _own_dir
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="metrolith-")
        atexit.register(__import__("shutil").rmtree, _own_dir.removeprefix("file://"), True)
    return _own_dir


class Staged:
    """Tables written once to the shared folder and read back: they cut lineage and survive lost executors.

    An operator's result may read them until it is written, so they stay; release() then deletes them.
    """

    made: list[Staged] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        Staged.made.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a staged table that nothing reads any more."""
        self._delete(df._staged_at)

    def _delete(self, where: str) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def release(since: int = 0) -> None:
        """Deletes the tables of all but the first `since` that were made; their results must be written."""
        while len(Staged.made) > since:
            old = Staged.made.pop()
            old._delete(old.root)


def row_bytes(schema: StructType) -> Column:
    """About what a row takes in a broadcast relation: 8 bytes a field and for the row, and what strings,
    binaries and arrays hold."""

    def held(kind: DataType, c: Column) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c).cast("bigint"), F.lit(0)) + 8
        if isinstance(kind, StructType):
            return sum((held(f.dataType, c[f.name]) for f in kind.fields), F.lit(8))
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
                return F.coalesce(F.aggregate(c, F.lit(8).cast("bigint"), lambda n, x: n + held(kind.elementType, x).cast("bigint")), F.lit(8))
            return F.coalesce(F.size(c).cast("bigint") * 8, F.lit(0)) + 8
        return F.lit(8)

    return sum((held(f.dataType, F.col(f"`{f.name}`")) for f in schema.fields), F.lit(16)).cast("bigint")


def checked(df: DataFrame) -> DataFrame:
    """A broadcast of a staged table if its rows hold at most BROADCAST_BYTES; else the table itself, which
    adaptive execution may still split where a key is hot."""
    held = df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; others, whatever they are called, play no part."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of (.., text) cut so that the texts of one hold about `most` bytes; one text is never cut."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(sizes(text))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; at a task's end the worker, which Spark keeps, returns what it freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def sizes(text: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column end to end, and where each text starts (one more entry than texts); null is empty."""
    import pyarrow.compute as pc

    whole = pc.fill_null(text, "")
    offsets = np.concatenate([[0], np.cumsum(sizes(whole))])
    kind = np.int64 if pa.types.is_large_string(whole.type) else np.int32
    _, where, data = whole.buffers()
    first = int(np.frombuffer(where, kind, 1, whole.offset * kind().itemsize)[0]) if len(whole) and where else 0
    if data is None or not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8, int(offsets[-1]), first), offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any byte (or code point) range of a block from prefix sums, modulo 2**64."""

    def __init__(self, seed: int, most: int = 1 << 16):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(1, 1 << 60)) * 8 + 5) & (2**64 - 1)
        self.inverse = pow(self.base, -1, 2**64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.grow(most)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 2**64))])

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: bytes, or code points, which are spread by a finaliser."""
        n = len(symbols)
        self.grow(n + 1)
        values = self.table[symbols] if symbols.dtype == np.uint8 else mixed(symbols.astype(np.uint64) + self.table[0])
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])
