"""Corpus reports over extracted quantities: rollups, cubes, sketches, top units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def unit_rollup(q: DataFrame) -> DataFrame:
    """Counts and value sums by change and unit, with subtotals; a level tells them apart."""
    return q.rollup("change", "unit_norm").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.min("lower").alias("lowest"), F.max("upper").alias("highest"))


def quantity_cube(q: DataFrame) -> DataFrame:
    return q.cube("kind", "change", "unit_norm").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def distinct_values(q: DataFrame) -> DataFrame:
    """Exact and approximate numbers of different values of each unit."""
    return q.groupBy("unit_norm").agg(F.countDistinct("lower").alias("n_values"), F.approx_count_distinct("lower").alias("about_n_values"))


def top_units(q: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent units of each change. Units are counted before they are ranked."""
    counts = q.groupBy("change", "unit_norm").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("change").orderBy(F.desc("n"), "unit_norm"))
    return counts.withColumn("place", rank).filter(F.col("place") <= k)
