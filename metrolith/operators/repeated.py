"""Work on texts that repeat, done once for each different text.

What a text gives depends on nothing but the text.  Where the rows of a table share few texts, the texts
are told apart first, the work is done on those, and its results are joined back to every row.  Whether they
do is counted on all rows.  Rows whose texts mostly differ, and streams, go the plain way.  Where few plain columns
make a text, their values are told apart, which costs much less for each row than to make and compare texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.operators import rendering
from metrolith.operators.extract import extract

#: Rows for each different text from which on texts are told apart.
REPEATS = 4
#: Bytes of different texts up to which their results are sent to every task; beyond that the join shuffles.
BROADCAST_TEXT_BYTES = 1 << 20
#: Bytes of different texts for each task that works on them.
TASK_BYTES = 1 << 16


def once_per_text(df: DataFrame, text_col: str, id_cols: Sequence[str], work: Callable[[DataFrame, list[str]], DataFrame], how: str, parts: Sequence[str] = (), text: Column | None = None) -> DataFrame | None:
    """work() of the different texts, a table (_key.., _text) of what tells a text apart and the text, and the names of
    the former, which its result keeps; joined to the ids of all rows. None if texts do not repeat enough.

    parts: columns (no names with a leading _) of which alone text, then an expression over them, makes the text. Rows are told apart by these
    rather than by texts if that is not much more work; a row's text is then never made.
    """
    if df.isStreaming:
        return None
    keys, n_bytes = list(parts), _bytes_by_parts(df, parts, text) if parts else None
    told = [f"_key{i}" for i in range(len(keys))]
    back = [F.col(k).alias(c) for c, k in zip(keys, told, strict=True)]
    if n_bytes is None:
        df = df if text is None else df.withColumn(text_col, text)
        keys, told, back, text = [text_col], ["_key0"], [], F.col("_key0")
        n_bytes = _bytes_by_text(df, F.col(f"`{text_col}`"))
    if n_bytes is None:
        return None
    tasks = min(max(df.sparkSession.sparkContext.defaultParallelism, n_bytes // TASK_BYTES), 10_000)
    own = [f"_id{i}" for i in range(len(id_cols))]
    each = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, told, strict=True)]).distinct().repartition(tasks)
    made = each.select(*told, *back).select(*told, text.alias("_made"))
    # Conditions on the texts do not pass an explode: else the optimizer has them tested on each row of df.
    done = work(made.select(*told, F.explode(F.array("_made")).alias("_text")), told)
    results = [c for c in done.columns if c not in told]
    held = done.select(*told, *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(results)])
    left = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip([*id_cols, *keys], [*own, *told], strict=True)])
    out = left.join(F.broadcast(held) if n_bytes <= BROADCAST_TEXT_BYTES else held, told, how)
    return out.select(*[F.col(i).alias(c) for c, i in zip(id_cols, own, strict=True)], *[F.col(f"_r{i}").alias(c) for i, c in enumerate(results)])


def _bytes_by_text(df: DataFrame, text: Column) -> int | None:
    """Bytes of the different texts, at most; None if texts do not repeat enough."""
    rows, n_texts, longest = df.agg(F.count(text), F.approx_count_distinct(text, 0.02), F.max(F.octet_length(text))).first()
    return n_texts * (longest or 0) if rows >= REPEATS * max(n_texts, 1) else None


def _bytes_by_parts(df: DataFrame, parts: Sequence[str], text: Column) -> int | None:
    """Bytes of the texts of different parts, at most; None if parts do not repeat enough, are many for a text, or if
    a text is made of a missing part, which no join finds."""
    keys = [F.col(f"`{c}`") for c in parts]
    made = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select("_n", text.alias("_text"), reduce(Column.__or__, [k.isNull() for k in keys]).alias("_missing"))
    there = F.col("_text").isNotNull()
    counts = F.sum(F.when(there, F.col("_n"))), F.count("_text"), F.approx_count_distinct("_text", 0.02), F.max(F.octet_length("_text")), F.count_if(there & F.col("_missing"))
    rows, n_parts, n_texts, longest, n_missing = made.agg(*counts).first()
    return n_parts * longest if rows and rows >= REPEATS * n_parts and n_parts <= REPEATS * n_texts and not n_missing else None


def extract_repeated(
    df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = (), deal: Callable[[DataFrame], DataFrame] = lambda df: df, parts: Sequence[str] = (), text: Column | None = None, results: Sequence[Column | str] = ("*",)
) -> DataFrame:
    """extract()'s rows, each different text read once if texts repeat; else deal() spreads the rows first. parts and
    text: as for once_per_text(). results: what of the rows to keep beside the ids, made once for each text too."""

    def work(rows: DataFrame, ids: Sequence[str], col: str) -> DataFrame:
        found = extract(rows, col, ids)
        return found if list(results) == ["*"] else found.select(*[F.col(f"`{c}`") for c in ids], *results)

    out = once_per_text(df, text_col, id_cols, lambda texts, keys: work(texts, keys, "_text"), "inner", parts, text)
    return work(deal(df if text is None else df.withColumn(text_col, text)), id_cols, text_col) if out is None else out


def normalized_text_repeated(docs: DataFrame, key: str = "doc_id", text_col: str = "text", deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rendering.normalized_text() of extract()'s rows, each different text rendered once if texts repeat."""

    def work(texts: DataFrame, keys: list[str]) -> DataFrame:
        return rendering.normalized_text(texts, extract(texts, "_text", keys), keys[0], "_text")

    out = once_per_text(docs, text_col, [key], work, "left")
    if out is not None:
        return out
    docs = deal(docs)
    return rendering.normalized_text(docs, extract(docs, text_col, [key]), key, text_col)
