"""Sources and sinks: texts in any of Spark's formats, batch or stream; training examples; results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "text", "orc")


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text", schema: str | None = None, stream: bool = False, **options: str) -> DataFrame:
    """Texts of a path; the column named text_col becomes `text`. A stream needs a schema, except of text files."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is none of {', '.join(FORMATS)}")
    reader = spark.readStream if stream else spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    if schema:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    return df.withColumnRenamed("value" if fmt == "text" else text_col, "text")


def read_examples(spark: SparkSession, path: str, candidates: tuple[str, ...] = ()) -> DataFrame:
    """Training examples (text, unit) of JSON lists; with candidates, only theirs."""
    df = spark.read.option("multiLine", "true").schema("text string, unit string").json(path)
    return df.filter(F.col("unit").isin(*candidates)) if candidates else df


def one_hot(examples: DataFrame, labels: tuple[str, ...], col: str = "unit") -> DataFrame:
    """A 0/1 column for each label."""
    return examples.select("*", *[F.when(F.col(col) == x, 1).otherwise(0).alias(f"is_{x.replace(' ', '_').replace('-', '_')}") for x in labels])


def write_examples(examples: DataFrame, path: str, surface_col: str = "surface", mode: str = "errorifexists") -> None:
    """Training examples as Parquet, a folder for each ambiguous surface form."""
    examples.repartition(surface_col).write.mode(mode).partitionBy(surface_col).parquet(path)


def write_quantities(quantities: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet, by the given columns; each partition's rows are brought together first, so that it has few files."""
    out = quantities.repartition(*partition_by) if partition_by else quantities
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
