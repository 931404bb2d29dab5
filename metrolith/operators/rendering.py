"""Texts and places of quantities: the normalized text, places in the original text, printed tuples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.functions import numbers, textnorm
from metrolith.functions.catalog import catalog_frame


def replaced(text: Column, edits: Column) -> Column:
    """The text with [start, end) of each edit (start, end, put) replaced, by place. Edits do not overlap."""
    ordered = F.array_sort(edits)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(e["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], e["end"]).alias("at"), F.when(e["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, e["put"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def normalized_text(docs: DataFrame, quantities: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text): each text with its values and units in normalized form. quantities: extract()'s rows."""
    q = quantities.filter(F.size("value_spans") > 0)
    value = F.when(F.col("kind") == "value", F.struct(F.col("value_spans")[0]["start"].alias("start"), F.col("value_spans")[0]["end"].alias("end"), numbers.printed(F.col("value")).alias("put")))
    unit = F.when((F.size("unit_spans") > 0) & (F.col("unit_norm") != "-"), F.struct(F.col("unit_spans")[0]["start"].alias("start"), F.array_max(F.transform("unit_spans", lambda s: s["end"])).alias("end"), F.concat(F.lit(" "), F.col("unit_norm")).alias("put")))
    behind = unit["start"] >= value["end"]
    glued = F.struct(unit["start"].alias("start"), unit["end"].alias("end"), F.when(behind & (unit["start"] > value["end"]), F.ltrim(unit["put"])).otherwise(unit["put"]).alias("put"))
    # A unit before its number, such as $, moves behind it.
    ahead = F.struct(F.least(unit["start"], value["start"]).alias("start"), F.greatest(unit["end"], value["end"]).alias("end"), F.concat(value["put"], unit["put"]).alias("put"))
    edits = F.when(unit.isNull(), F.array(value)).when(value.isNull(), F.array(glued)).when(behind, F.array(value, glued)).otherwise(F.array(ahead))
    per_text = q.select(key, F.filter(edits, lambda e: e.isNotNull()).alias("e")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("edits"))
    texts = docs.select(key, textnorm.normalize(F.col(f"`{text_col}`")).alias("_norm")).join(per_text, key, "left")
    return texts.select(key, F.when(F.col("edits").isNull(), F.col("_norm")).otherwise(replaced(F.col("_norm"), F.col("edits"))).alias("text"))


def original_span(original: Column, surface: Column, occurrence: Column) -> Column:
    """Where the surface's occurrence-th copy (from 1) starts in the original text; 0-based, null if nowhere."""
    found = F.split(original, F.concat(F.lit(r"\Q"), surface, F.lit(r"\E")), -1)
    before = F.aggregate(F.slice(found, F.lit(1), occurrence), F.lit(0), lambda n, piece: n + F.length(piece))
    at = before + (occurrence - 1) * F.length(surface)
    return F.when((F.size(found) > occurrence) & (F.length(surface) > 0), at)


def closest_span(original: Column, surface: Column, slack: int = 2) -> Column:
    """The place of the window most like the surface, by edit distance, among windows of its length."""
    n = F.length(surface)
    starts = F.sequence(F.lit(0), F.greatest(F.length(original) - n, F.lit(0)))
    scored = F.transform(starts, lambda i: F.struct(F.levenshtein(F.substr(original, i + 1, n), surface).alias("d"), i.alias("i")))
    best = F.array_min(scored)
    return F.when(best["d"] <= slack, best["i"])


def as_tuple(value: Column, change: Column, unit: Column, concepts: Column) -> Column:
    """(=,2.5,percentage,[a, b])."""
    return F.concat(F.lit("("), change, F.lit(","), value, F.lit(","), unit, F.lit(",["), F.array_join(concepts, ", "), F.lit("])"))


def surface_forms(norms: DataFrame, col: str = "unit_norm") -> DataFrame:
    """(.., unit_key, forms): the names and symbols of each catalog unit in a normalized unit; `a per b` has two."""
    parts = norms.withColumn("_part", F.explode(F.split(F.col(col), " per ")))
    catalog = F.broadcast(catalog_frame(norms.sparkSession))
    forms = catalog.select(F.col("key").alias("unit_key"), F.concat("surfaces", "symbols").alias("forms"))
    return parts.join(forms, F.col("_part") == F.col("unit_key"), "left").drop("_part")


def bracket_inherit(quantities: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A bracketed quantity takes, of the last quantity before it in its sentence, the concept if it has none
    and the change if its own is `=`."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(*ids, "sent_no").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    outer = lambda c: F.last(F.when(~F.col("in_bracket"), F.col(c)), ignorenulls=True).over(w)
    bare = F.col("in_bracket") & (F.size("concepts") == 0)
    return quantities.select(
        "*",
        F.when(bare, F.coalesce(outer("concepts"), F.col("concepts"))).otherwise(F.col("concepts")).alias("_c"),
        F.when(F.col("in_bracket") & (F.col("change") == "="), F.coalesce(outer("change"), F.col("change"))).otherwise(F.col("change")).alias("_g"),
    ).withColumns({"concepts": F.col("_c"), "change": F.col("_g")}).drop("_c", "_g")
