"""A training-data pipeline over `documents`: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
documents; the last returns the packed pieces.  run() writes each stage's result to the shared folder and
reads it again.  Decisions travel as keys (id and text hash); they are broadcast if a count shows that they
are few, and shuffled otherwise.

Rows with a null id take part in every stage; rows equal in id and text count as one document where copies
are dropped.  ORACLE_SQL is None: SQL cannot express the trained network or the tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import Staged, checked, read
from metrolith.llm.op01_line_dedup import dedup_lines
from metrolith.llm.op02_decontamination import build_index, decontaminate
from metrolith.llm.op03_quality import accepted, train
from metrolith.llm.op04_simhash import near_duplicates
from metrolith.llm.op10_packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

ORACLE_SQL = None


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose id and text hash are not among the keys (id2, th2), which are staged."""
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & F.xxhash64("text").eqNullSafe(F.col("th2"))
    return docs.join(checked(keys), same, "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    return accepted(docs, train(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; one that loses all its lines goes."""
    out = dedup_lines(spark, docs, carry=("text", "lang", "source", "n_chars"))
    out = out.filter((F.col("n_removed") <= 0) | (F.col("n_removed") < F.col("n_lines")))
    same = F.col("n_removed") <= 0
    text = F.when(same, F.col("carried.text")).otherwise(F.col("kept"))
    n_chars = F.when(same, F.col("carried.n_chars")).otherwise(F.length("kept").cast("bigint"))
    return out.select("doc_id", text.alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    staged = Staged(spark, "near")
    groups = staged.put(near_duplicates(spark, docs))
    keys = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("th2")).distinct()
    kept = without(docs, staged.put(keys))
    own = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    if own.count() != own.select("doc_id").distinct().count():  # rows that share an id, or groups without one
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    staged = Staged(spark, "leaks")
    index = staged.put(build_index(docs))
    hits = decontaminate(spark, index, read(spark, sf_dir, "benchmark"), keyed=True).filter("contaminated")
    return without(docs, staged.put(hits.select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("th2")).distinct()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens in sequences of a fixed length."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Staged(spark, "pipeline")
    made = len(Staged.made)
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = staged.put(stage(spark, docs, sf_dir))
        Staged.release(made)  # the stage's result is written: what it staged on its way, and its input, may go
        if last is not None:
            staged.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
