"""The public surface: extraction, SQL registration and unit services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metrolith.functions import bounds, numbers, textnorm, tokens
from metrolith.functions.catalog import AMBIGUOUS, CATALOG, CUES, FORMS, catalog_frame, forms_frame
from metrolith.functions.held import held
from metrolith.operators.clauses import with_shared_units
from metrolith.operators.extract import extract, resolved
from metrolith.operators.parsed import parsed_quantities
from metrolith.operators.rendering import normalized_text, surface_forms
from metrolith.operators.rules import candidates, flags, match_all

__all__ = ["AMBIGUOUS", "CATALOG", "CUES", "FORMS", "bounds", "candidates", "catalog_frame", "disambiguate", "extract", "flags", "forms_frame", "learn_cues", "match_all", "normalize_units", "normalized_text", "numbers", "register", "parsed_quantities", "surface_forms", "textnorm", "tokens", "with_shared_units", "with_surface_forms"]


def normalize_units(df: DataFrame, form_col: str, text_col: str | None = None) -> DataFrame:
    """Adds unit_norm and unit_key of a column of unit forms: as it is, then lower-cased, then singular."""
    words = F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+") if text_col else F.array().cast("array<string>")
    form = F.col(f"`{form_col}`")
    out = df.withColumn("_words", words).withColumn("_unit", resolved([form, F.lower(form), tokens.singular(form)], F.col("_words")))
    return out.select(*df.columns, F.col("_unit.n").alias("unit_norm"), F.col("_unit.k").alias("unit_key"))


def learn_cues(examples: DataFrame, most: int = 25, text_col: str = "text", unit_col: str = "unit") -> DataFrame:
    """(reading, word, weight): of labelled examples (text, unit) the words that speak most for each unit, by
    smoothed log-odds of the texts that have them; at most `most` a unit. Counts are sums by unit and word."""
    rows = examples.select(F.col(f"`{unit_col}`").alias("reading"), F.array_distinct(F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+")).alias("words")).filter("reading is not null")
    texts = rows.groupBy("reading").agg(F.count("*").alias("n"))
    pairs = rows.select("reading", F.explode("words").alias("word")).filter((F.length("word") > 1) & ~tokens.is_stop(F.col("word"))).groupBy("reading", "word").agg(F.count("*").alias("k"))
    every, all_texts = W.partitionBy("word"), texts.agg(F.sum("n").alias("total"))
    scored = pairs.join(F.broadcast(texts), "reading").crossJoin(F.broadcast(all_texts)).withColumn("others", F.sum("k").over(every) - F.col("k"))
    odds = lambda k, n: F.log((k + 0.5) / (n - k + 0.5))
    scored = scored.withColumn("weight", odds(F.col("k"), F.col("n")) - odds(F.col("others"), F.col("total") - F.col("n")))
    rank = F.row_number().over(W.partitionBy("reading").orderBy(F.desc("weight"), "word"))
    return scored.filter("weight > 0").withColumn("_rank", rank).filter(F.col("_rank") <= most).select("reading", "word", "weight")


def disambiguate(df: DataFrame, form_col: str, text_col: str, cues: DataFrame | None = None) -> DataFrame:
    """(.., reading, score): for each mention of an ambiguous form the reading with the most cue words, the
    catalog's or learned ones (learn_cues)."""
    spark = df.sparkSession
    pairs = spark.createDataFrame([(f, i, u, list(CUES.get(u, ()))) for f, us in AMBIGUOUS.items() for i, u in enumerate(us)], "_form string, _place int, reading string, _cues array<string>")
    if cues is not None:  # a few words for each reading
        pairs = pairs.drop("_cues").join(cues.groupBy("reading").agg(F.collect_list("word").alias("_cues")), "reading", "left")
    out = df.withColumn("_words", F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+")).join(F.broadcast(pairs), F.col(f"`{form_col}`") == F.col("_form"))
    scored = out.withColumn("score", F.size(F.array_intersect("_words", F.coalesce("_cues", F.array().cast("array<string>")))))
    keys = [c for c in df.columns]
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("reading", "score"), F.struct("score", -F.col("_place"))).alias("b"))
    return best.select(*keys, "b.reading", "b.score")


def session(name: str = "metrolith", checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with what the engine is planned for: adaptive execution with skew joins, UTC, a shared folder."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def register(spark: SparkSession, texts: DataFrame | None = None, view: str = "quantities", text_col: str = "text", id_cols: tuple[str, ...] = ()) -> None:
    """SQL surface: a view of the quantities of the texts, by the engine's own plan; conditions and joins on it
    are planned with it. Without texts, a view of the unit catalog's forms alone (`unit_forms`)."""
    forms_frame(spark).createOrReplaceTempView("unit_forms")
    if texts is not None:
        extract(texts, text_col, id_cols).createOrReplaceTempView(view)


def with_surface_forms(quantities: DataFrame) -> DataFrame:
    """Adds unit_forms, the names and symbols of each of the quantity's catalog units."""
    forms = F.map_from_entries(F.array(*[F.struct(F.lit(u.key).alias("k"), F.array(*[F.lit(x) for x in dict.fromkeys([*u.surfaces, *u.symbols])]).alias("v")) for u in CATALOG]))
    return quantities.withColumn("unit_forms", F.transform("unit_keys", lambda k: F.try_element_at(held("catalog forms", lambda: forms), k)))
