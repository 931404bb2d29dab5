"""Registered queries of the engine, each with DuckDB SQL for the same result where SQL can say it.

Most build sentences from a table's columns, run the engine over all of them and return what it found; the
SQL computes what must be found from the columns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrolith import api, rule_examples
from metrolith.functions import bounds, ignore, numbers, textnorm, tokens
from metrolith.functions.lexicon import NUMBER_WORDS
from metrolith.functions.spans import BETWEEN_COMMAS, BRACKETS, located
from metrolith.operators import clauses as clause_ops
from metrolith.operators import parsed, rendering, rules
from metrolith.operators.extract import extract, tokenized
from metrolith.operators.repeated import extract_repeated, normalized_text_repeated
from metrolith.plans import reports
from metrolith.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small file's few splits dealt over all cores: extraction computes much for each row it reads."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def found(spark: SparkSession, sf_dir: str, name: str, ids: list[str], text: str, *more: str, parts: dict[str, str] | None = None, results: list | tuple = ("*",)) -> DataFrame:
    """extract() over sentences made from a table's rows, each different sentence once if they repeat. parts: by name,
    what a text is made of; text is then over these names. results: what to keep beside the ids."""
    if parts:
        rows = table(spark, sf_dir, name).selectExpr(*ids, *[f"{made} AS {part}" for part, made in parts.items()])
        return extract_repeated(rows, "text", ids, spread, list(parts), F.expr(text), results)
    return extract_repeated(table(spark, sf_dir, name).selectExpr(*ids, f"{text} AS text", *more), "text", [*ids, *[m.rsplit(" AS ", 1)[1] for m in more]], spread)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], columns: str) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns})"


_CENTS = "CAST(round(abs({0}) * 100) AS BIGINT)"
_MONEY_TEXT = "CAST({0} / 100 AS BIGINT)"


def cents_text(column: str) -> str:
    """Spark SQL: a two-decimal number as text, from whole cents."""
    c = _CENTS.format(column)
    return f"(CAST({c} div 100 AS STRING) || '.' || lpad(CAST({c} % 100 AS STRING), 2, '0'))"


# -- plain values and units


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, 'box' AS unit_norm, '=' AS change FROM lineitem")
def plain_number_extract(spark, sf_dir):
    q = found(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], "'They shipped ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' boxes in total.'")
    return q.select("l_orderkey", "l_linenumber", "value", "unit_norm", "change")


@query(f"SELECT o_orderkey, {_CENTS.format('o_totalprice')} / 100.0::DOUBLE AS value, 'dollar' AS unit_norm, true AS unit_scientific FROM orders")
def money_amounts(spark, sf_dir):
    q = found(spark, sf_dir, "orders", ["o_orderkey"], f"'The order costs $' || {cents_text('o_totalprice')} || ' today.'")
    return q.select("o_orderkey", "value", "unit_norm", "unit_scientific")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS DOUBLE) AS value, 'percentage' AS unit_norm, 'discount' AS concept FROM lineitem")
def percent_amounts(spark, sf_dir):
    text = "'The discount is ' || CAST(CAST(round(part * 100) AS INT) AS STRING) || '%.'"
    concept = F.array_join("concepts", " ").alias("concept")
    return found(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], text, parts={"part": "l_discount"}, results=["value", "unit_norm", concept])


@query(
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CASE p_partkey % 6 WHEN 0 THEN 'kilogram' WHEN 1 THEN 'mile' WHEN 2 THEN 'gigahertz' WHEN 3 THEN 'gallon' WHEN 4 THEN 'litre' ELSE 'celsius' END AS unit_norm,
    CASE p_partkey % 6 WHEN 0 THEN 'gram' WHEN 1 THEN 'mile' WHEN 2 THEN 'hertz' WHEN 3 THEN 'gallon' WHEN 4 THEN 'litre' ELSE 'celsius' END AS unit_key FROM part"""
)
def number_unit_pairs(spark, sf_dir):
    unit = "CASE p_partkey % 6 WHEN 0 THEN ' kg' WHEN 1 THEN ' miles' WHEN 2 THEN ' GHz' WHEN 3 THEN ' gallons' WHEN 4 THEN ' liters' ELSE ' degrees celsius' END"
    q = found(spark, sf_dir, "part", ["p_partkey"], f"'The gauge says ' || CAST(p_size AS STRING) || {unit} || '.'")
    return q.select("p_partkey", "value", "unit_norm", F.get("unit_keys", F.lit(0)).alias("unit_key"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, '-' AS unit_norm FROM part")
def lonely_numbers(spark, sf_dir):
    q = found(spark, sf_dir, "part", ["p_partkey"], "'It is ' || CAST(p_size AS STRING)")
    return q.select("p_partkey", "value", "unit_norm")


def _words_sql(n: str) -> str:
    """Spark SQL: 0..99 as words."""
    return "element_at(array(" + ", ".join(f"'{w}'" for w in sorted(NUMBER_WORDS, key=NUMBER_WORDS.get)) + f"), CAST({n} AS INT) + 1)"


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, 'hole' AS unit_norm FROM part")
def spelled_numbers(spark, sf_dir):
    q = found(spark, sf_dir, "part", ["p_partkey"], f"'The part has ' || {_words_sql('p_size')} || ' holes.'")
    return q.select("p_partkey", "value", "unit_norm")


@query("SELECT o_orderkey, CAST((o_orderkey % 9 + 1) * 1000000 + (o_orderkey % 7 + 1) * 100 * 1000 + o_orderkey % 89 + 10 AS DOUBLE) AS value, 'people' AS unit_norm FROM orders")
def compound_numbers(spark, sf_dir):
    text = f"'It serves ' || {_words_sql('o_orderkey % 9 + 1')} || ' million ' || {_words_sql('o_orderkey % 7 + 1')} || ' hundred thousand ' || {_words_sql('o_orderkey % 89 + 10')} || ' people.'"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).select("o_orderkey", "value", "unit_norm")


@query(
    """SELECT o_orderkey, ((o_orderkey % 900 + 100) / 10.0::DOUBLE) * CASE o_orderkey % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 ELSE 1e12 END AS value,
    CASE WHEN o_orderkey % 4 = 3 THEN 'euro' ELSE 'dollar' END AS unit_norm FROM orders"""
)
def scale_suffix(spark, sf_dir):
    n = "CAST((o_orderkey % 900 + 100) div 10 AS STRING) || '.' || CAST((o_orderkey % 900 + 100) % 10 AS STRING)"
    text = f"'It earned ' || CASE WHEN o_orderkey % 4 = 3 THEN '€' ELSE '$' END || {n} || CASE o_orderkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'bn' ELSE 'tn' END || ' last year.'"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).filter("unit_scientific").select("o_orderkey", "value", "unit_norm")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity * pow(10.0, l_linenumber + 2) AS value, 'metre' AS unit_norm, printf('%e', l_quantity * pow(10.0, l_linenumber + 2)) AS sci,
    regexp_replace(printf('%e', l_quantity * pow(10.0, l_linenumber + 2)), '\\.?0+e', 'e') AS sci_short FROM lineitem"""
)
def scientific_notation(spark, sf_dir):
    parts = {"whole": "CAST(l_quantity AS INT)", "mark": "CASE l_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END", "line": "l_linenumber"}
    text = "'The ring is ' || CAST(whole AS STRING) || CASE mark WHEN 0 THEN '×10^' WHEN 1 THEN '×e+' ELSE 'E' END || CAST(line + 2 AS STRING) || ' metres long.'"
    return found(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], text, parts=parts, results=["value", "unit_norm", "sci", "sci_short"])


@query("SELECT l_orderkey, l_linenumber, l_linenumber / l_quantity AS value, '% order' AS unit_norm, false AS unit_scientific FROM lineitem WHERE l_quantity > 0")
def fraction_values(spark, sf_dir):
    parts = {"line": "l_linenumber", "whole": "CAST(l_quantity AS INT)", "even": "l_orderkey % 2 <=> 0"}
    text = "'They lost ' || CAST(line AS STRING) || CASE WHEN even THEN ' out of ' ELSE ' of ' END || CAST(whole AS STRING) || ' orders.'"
    return found(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], text, parts=parts, results=["value", "unit_norm", "unit_scientific"])


@query("SELECT p_partkey, p_size + CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 ELSE 0.125 END::DOUBLE AS value, 'mile' AS unit_norm FROM part")
def mixed_numbers(spark, sf_dir):
    text = "'The road is ' || CAST(p_size AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' 1/2' WHEN 1 THEN ' 1/4' WHEN 2 THEN ' 3/4' ELSE ' 1/8' END || ' miles long.'"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "value", "unit_norm")


@query(f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END * ({_CENTS.format('c_acctbal')} / 100.0::DOUBLE) AS value, 'dollar' AS unit_norm FROM customer")
def sign_and_minus(spark, sf_dir):
    text = f"'The balance is ' || CASE WHEN c_acctbal < 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE 'minus ' END ELSE '' END || {cents_text('c_acctbal')} || ' dollars.'"
    return found(spark, sf_dir, "customer", ["c_custkey"], text).select("c_custkey", "value", "unit_norm")


_PHRASES = [("about ", "~"), ("more than ", ">"), ("fewer than ", "<"), ("at least ", ">"), ("up to ", "<"), ("exactly ", "="), ("roughly ", "~"), ("well over ", ">"), ("", "="), ("nearly ", "~")]
_TRENDS = [("fell by ", "down"), ("rose ", "up"), ("dropped ", "down"), ("climbed by ", "up"), ("was up ", "up"), ("slipped ", "down"), ("grew by about ", "~"), ("shrank ", "down")]


def _case(key: str, items: list[str]) -> str:
    return f"CASE {key} % {len(items)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


@query(f"SELECT o_orderkey, {_case('o_orderkey', [c for _, c in _PHRASES])} AS change, CAST(o_orderkey % 500 + 1 AS DOUBLE) AS value FROM orders")
def bounds_normalize(spark, sf_dir):
    text = f"'We saw ' || {_case('o_orderkey', [p for p, _ in _PHRASES])} || CAST(o_orderkey % 500 + 1 AS STRING) || ' boats.'"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).select("o_orderkey", "change", "value")


@query(f"SELECT event_id, {_case('event_id', [c for _, c in _TRENDS])} AS change, CAST(event_id % 90 + 1 AS DOUBLE) AS value, event_type || ' rate' AS concept FROM events")
def trend_changes(spark, sf_dir):
    text = f"'The ' || event_type || ' rate ' || {_case('event_id', [p for p, _ in _TRENDS])} || CAST(event_id % 90 + 1 AS STRING) || ' percent.'"
    q = found(spark, sf_dir, "events", ["event_id"], text)
    return q.select("event_id", "change", "value", F.array_join("concepts", " ").alias("concept"))


# -- ranges, fractions, lists


@query("SELECT p_partkey, 'range' AS kind, CAST(p_size AS DOUBLE) AS lower, CAST(p_size + p_partkey % 40 + 1 AS DOUBLE) AS upper, 'metre' AS unit_norm FROM part")
def ranges_to(spark, sf_dir):
    text = "'The wire is ' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ' to ' ELSE ' - ' END || CAST(p_size + p_partkey % 40 + 1 AS STRING) || ' metres long.'"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "kind", "lower", "upper", "unit_norm")


@query("SELECT o_orderkey, 'range' AS kind, CAST(o_orderkey % 300 AS DOUBLE) AS lower, CAST(o_orderkey % 300 + 5 AS DOUBLE) AS upper, CASE WHEN o_orderkey % 3 = 0 THEN 'dollar' ELSE 'box' END AS unit_norm FROM orders")
def ranges_between(spark, sf_dir):
    lo, hi = "CAST(o_orderkey % 300 AS STRING)", "CAST(o_orderkey % 300 + 5 AS STRING)"
    text = f"CASE o_orderkey % 3 WHEN 0 THEN 'It costs between $' || {lo} || ' and $' || {hi} || ' today.' WHEN 1 THEN 'They hold between ' || {lo} || ' and ' || {hi} || ' boxes.' ELSE 'They moved from ' || {lo} || ' to ' || {hi} || ' boxes.' END"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).select("o_orderkey", "kind", "lower", "upper", "unit_norm")


@query("SELECT o_orderkey, (o_orderkey % 90 + 1) * 1e9::DOUBLE AS lower, (o_orderkey % 90 + 4) * 1e9::DOUBLE AS upper, 'dollar' AS unit_norm FROM orders")
def ranges_with_shared_scale(spark, sf_dir):
    text = "'It costs $' || CAST(o_orderkey % 90 + 1 AS STRING) || ' to $' || CAST(o_orderkey % 90 + 4 AS STRING) || ' billion.'"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).select("o_orderkey", "lower", "upper", "unit_norm")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 100.0 WHEN 2 THEN 1000.0 ELSE 10000.0 END::DOUBLE AS lower,
    CASE p_partkey % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 1000.0 WHEN 2 THEN 10000.0 ELSE 100000.0 END::DOUBLE AS upper, 'part' AS unit_norm FROM part"""
)
def broad_ranges(spark, sf_dir):
    text = "CASE p_partkey % 4 WHEN 0 THEN 'Tens' WHEN 1 THEN 'Hundreds' WHEN 2 THEN 'Thousands' ELSE 'Tens of thousands' END || ' of parts were lost.'"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "lower", "upper", "unit_norm")


@query("SELECT p_partkey, CAST(unnest([p_size, p_size + 1, p_size + 2]) AS DOUBLE) AS value, 'centimetre' AS unit_norm FROM part")
def dimensions_split(spark, sf_dir):
    text = "'The case is ' || CAST(p_size AS STRING) || ' x ' || CAST(p_size + 1 AS STRING) || ' x ' || CAST(p_size + 2 AS STRING) || ' cm.'"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "value", "unit_norm")


@query("SELECT p_partkey, CAST(unnest([p_size, p_size + 10, p_size + 20]) AS DOUBLE) AS value, 'year' AS unit_norm FROM part")
def number_list_split(spark, sf_dir):
    text = "'We tested it for ' || CAST(p_size AS STRING) || ', ' || CAST(p_size + 10 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ', ' ELSE ' and ' END || CAST(p_size + 20 AS STRING) || ' years.'"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "value", "unit_norm")


@query("SELECT p_partkey, CAST(unnest([p_size, p_size + 1]) AS DOUBLE) AS value, 'dollar' AS unit_norm FROM part")
def shared_unit_forward(spark, sf_dir):
    text = "'It sells for ' || CAST(p_size AS STRING) || ' or $' || CAST(p_size + 1 AS STRING) || ' now.'"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "value", "unit_norm")


@query("SELECT o_orderkey, CAST(o_orderkey % 400 + 1 AS DOUBLE) * 1e6 AS value, 'user' AS unit_norm FROM orders")
def m_as_million(spark, sf_dir):
    text = "'It has ' || CAST(o_orderkey % 400 + 1 AS STRING) || 'm users.'"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).select("o_orderkey", "value", "unit_norm")


@query("SELECT p_partkey, 1.0::DOUBLE AS value, 'box' AS unit_norm, '' AS concept FROM part")
def one_of_quantities(spark, sf_dir):
    text = "'One of the boxes was lost by ' || p_brand"
    q = found(spark, sf_dir, "part", ["p_partkey"], text).filter("one_of")
    return q.select("p_partkey", "value", "unit_norm", F.array_join("concepts", " ").alias("concept"))


# -- units

_UNIT_FORMS = [
    ("%", "percentage"), ("kg", "kilogram"), ("GHz", "gigahertz"), ("gigawatts", "gigawatt"), ("km", "kilometre"), ("light years", "light-year"), ("Miles", "mile"), ("feet", "foot"),
    ("MiB", "mebibyte"), ("mph", "mile per hour"), ("€", "euro"), ("US$", "united states dollar"), ("usd", "united states dollar"), ("°C", "celsius"), ("m2", "square metre"), ("boxes", None), ("mg", "milligram"),
    ("kWh", "kilowatt hour"), ("hours", "hour"), ("µg", "microgram"), ("megapixels", "megapixel"), ("Mbit", "megabit"), ("bps", "basis point"), ("", None), (None, None),
]


@query(sql_values(_UNIT_FORMS, "form, unit_norm"))
def unit_cascade(spark, sf_dir):
    return api.normalize_units(values(spark, [(f,) for f, _ in _UNIT_FORMS], "form string"), "form").select("form", "unit_norm")


@query(
    """SELECT s.sym || u.sym AS form, s.name || u.key AS unit_norm, u.key AS unit_key
    FROM (VALUES ('k', 'kilo'), ('M', 'mega'), ('G', 'giga'), ('m', 'milli'), ('n', 'nano')) AS s(sym, name), (VALUES ('W', 'watt'), ('J', 'joule'), ('V', 'volt'), ('N', 'newton')) AS u(sym, key)"""
)
def prefixed_units(spark, sf_dir):
    forms = values(spark, [(p + u,) for p in "kMGmn" for u in "WJVN"], "form string")
    return api.normalize_units(forms, "form").select("form", "unit_norm", "unit_key")


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 80 + 1 AS DOUBLE) AS value, CASE o_orderkey % 5 WHEN 0 THEN 'dollar per barrel' WHEN 1 THEN 'barrel per day' WHEN 2 THEN 'kilometre per hour'
    WHEN 3 THEN 'dollar per square foot' ELSE 'mile per gallon' END AS unit_norm FROM orders"""
)
def compound_units(spark, sf_dir):
    n = "CAST(o_orderkey % 80 + 1 AS STRING)"
    text = f"CASE o_orderkey % 5 WHEN 0 THEN 'It costs $' || {n} || ' per barrel.' WHEN 1 THEN 'It gives ' || {n} || ' barrels a day.' WHEN 2 THEN 'It runs ' || {n} || ' km/h.' WHEN 3 THEN 'They pay $' || {n} || ' per square foot.' ELSE 'It makes ' || {n} || ' miles per gallon.' END"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).select("o_orderkey", "value", "unit_norm")


@query("SELECT c_custkey, CAST(c_custkey % 70 + 1 AS DOUBLE) AS value, CASE WHEN c_custkey % 2 = 0 THEN 'pound-mass' ELSE 'pound sterling' END AS unit_norm FROM customer")
def ambiguous_units_in_context(spark, sf_dir):
    text = "CASE WHEN c_custkey % 2 = 0 THEN 'The baby weighs ' ELSE 'The ticket costs ' END || CAST(c_custkey % 70 + 1 AS STRING) || ' pounds.'"
    return found(spark, sf_dir, "customer", ["c_custkey"], text).select("c_custkey", "value", "unit_norm")


@query("SELECT c_custkey, 'pound' AS form, CASE c_custkey % 3 WHEN 0 THEN 'pound-mass' ELSE 'pound sterling' END AS reading, CASE c_custkey % 3 WHEN 2 THEN 0 ELSE 2 END AS score FROM customer")
def ambiguous_unit_rank(spark, sf_dir):
    text = "CASE c_custkey % 3 WHEN 0 THEN 'a heavy fish of one pound' WHEN 1 THEN 'the price was one pound in cash' ELSE 'one pound' END"
    mentions = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'pound' AS form", f"{text} AS text")
    return api.disambiguate(mentions, "form", "text").select("c_custkey", "form", "reading", "score")


@query("SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'pound-mass' ELSE 'pound sterling' END AS reading FROM customer WHERE c_custkey % 3 = 0")
def ambiguity_learned(spark, sf_dir):
    """Cue words are learned from two thirds of the customers' sentences and decide the others."""
    said = "CASE c_custkey % 2 WHEN 0 THEN 'the sack tips the scale at ' ELSE 'the invoice was settled with ' END || c_mktsegment || ' ' || c_name"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'pound' AS form", f"{said} AS text", "CASE c_custkey % 2 WHEN 0 THEN 'pound-mass' ELSE 'pound sterling' END AS unit")
    cues = api.learn_cues(rows.filter("c_custkey % 3 <> 0"))
    return api.disambiguate(rows.filter("c_custkey % 3 = 0").drop("unit"), "form", "text", cues).select("c_custkey", "reading")


@query(sql_values([("dollar per barrel", "dollar", 5), ("dollar per barrel", "barrel", 3), ("litre", "litre", 6)], "unit_norm, unit_key, n"))
def unit_surface_forms(spark, sf_dir):
    q = rendering.surface_forms(values(spark, [("dollar per barrel",), ("litre",)], "unit_norm string"))
    return q.select("unit_norm", "unit_key", F.size(F.array_distinct("forms")).alias("n"))


# -- what is ignored


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey % 2 = 1")
def name_number_filter(spark, sf_dir):
    text = "CASE WHEN p_partkey % 4 = 0 THEN 'phone ' || CAST(p_size AS STRING) || ' is new' WHEN p_partkey % 2 = 0 THEN 'They sell the ' || CAST(p_size AS STRING) || ' Pro now' ELSE 'It holds ' || CAST(p_size AS STRING) || ' bolts' END"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "value")


@query("SELECT o_orderkey, 5.0::DOUBLE AS value, 'box' AS unit_norm FROM orders")
def ignored_times_dates(spark, sf_dir):
    stamp = "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'HH:mm:ss') WHEN 2 THEN 'March 17' WHEN 3 THEN '12:45' ELSE 'the 3rd' END"
    text = f"'They came at ' || {stamp} || ' with 5 boxes.'"
    return found(spark, sf_dir, "orders", ["o_orderkey"], text).select("o_orderkey", "value", "unit_norm")


@query("SELECT c_custkey, 2.0::DOUBLE AS value FROM customer")
def ignored_phones(spark, sf_dir):
    n = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
    text = f"'Call ' || CASE c_custkey % 3 WHEN 0 THEN '+49 (' || {n} || ') 567890' WHEN 1 THEN '(123) 555-' || {n} ELSE '5-4-10-12-' || {n} END || ' for 2 cups.'"
    return found(spark, sf_dir, "customer", ["c_custkey"], text).filter("unit_norm = 'cup'").select("c_custkey", "value")


def _counts(pattern: str) -> str:
    return f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{pattern}')) AS INT) AS n FROM documents WHERE regexp_matches(text, '{pattern}')"


def _shapes(spark, sf_dir, pattern):
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern))
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("n"))


def _masked(spark, sf_dir, text):
    """How many characters of texts made of the documents' columns are ignored."""
    made = table(spark, sf_dir, "documents").select("doc_id", ignore.mask(F.expr(text)).alias("t"))
    return made.select("doc_id", F.regexp_count("t", F.lit(ignore.MARK)).alias("n"))


@query("SELECT doc_id, CAST(length('5-4-10-' || CAST(doc_id AS VARCHAR)) AS INT) AS n FROM documents")
def documents_sequences(spark, sf_dir):
    return _masked(spark, sf_dir, "'The code is 5-4-10-' || CAST(doc_id AS STRING) || ' of ' || lang")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 8 ELSE length(CAST(doc_id % 24 AS VARCHAR)) + 3 END AS INT) AS n FROM documents")
def documents_times(spark, sf_dir):
    return _masked(spark, sf_dir, "'It came at ' || CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id % 24 AS STRING), 2, '0') || ':06:40' ELSE CAST(doc_id % 24 AS STRING) || ':30' END || ' from ' || lang")


@query("SELECT doc_id, CAST(length(CAST(doc_id AS VARCHAR)) + 3 AS INT) AS n FROM documents")
def documents_ordinals(spark, sf_dir):
    return _masked(spark, sf_dir, "'It is the ' || CAST(doc_id AS STRING) || '4th of ' || CAST(doc_id AS STRING) || ' texts'")


@query(_counts(ignore.PATTERNS["I12"].replace("'", "''")))
def documents_phones(spark, sf_dir):
    return _shapes(spark, sf_dir, ignore.PATTERNS["I12"])


@query(_counts(r"\([^()]*\)"))
def bracket_tokens(spark, sf_dir):
    return _shapes(spark, sf_dir, BRACKETS)


@query(
    r"""WITH d AS (SELECT page_id, regexp_extract_all(html, '\([^()]*\)') AS hits, html FROM pages)
    SELECT page_id, CAST(instr(html, hits[1]) - 1 AS INT) AS first_start, CAST(len(hits) AS INT) AS n FROM d WHERE len(hits) > 0"""
)
def bracket_places(spark, sf_dir):
    spans = table(spark, sf_dir, "pages").select("page_id", located(F.col("html"), BRACKETS).alias("s")).filter(F.size("s") > 0)
    return spans.select("page_id", F.col("s")[0]["start"].alias("first_start"), F.size("s").alias("n"))


@query(_counts(BETWEEN_COMMAS))
def comma_tokens(spark, sf_dir):
    return _shapes(spark, sf_dir, BETWEEN_COMMAS)


@query(
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), t AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
    c AS (SELECT doc_id, i, coalesce(sum(CASE WHEN right(word, 1) IN (',', '.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clause FROM t)
    SELECT doc_id, CAST(max(clause) AS BIGINT) AS last_clause, count(DISTINCT clause) AS n_clauses, CAST(sum(clause * i) AS BIGINT) AS weight FROM c GROUP BY doc_id"""
)
def clause_ids(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "word"))
    t = words.select("doc_id", (F.col("i") + 1).alias("i"), F.right("word", F.lit(1)).isin(",", ".").alias("is_break"))
    c = clause_ops.clause_table(t)
    return c.groupBy("doc_id").agg(F.max("clause").alias("last_clause"), F.countDistinct("clause").alias("n_clauses"), F.sum(F.col("clause") * F.col("i")).alias("weight"))


@query("SELECT l_orderkey, l_linenumber AS i, CASE WHEN l_linenumber % 3 = 0 THEN 'dollar' WHEN lead(l_linenumber) OVER w % 3 = 0 AND lead(l_linenumber) OVER w - l_linenumber = 1 THEN 'dollar' ELSE '-' END AS unit FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def shared_unit_window(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 2).alias("i"), F.lit(0).alias("clause"), F.when(F.col("l_linenumber") % 3 == 0, "dollar").alias("unit"))
    return clause_ops.shared_units(q, "l_orderkey").select("l_orderkey", (F.col("i") / 2).cast("int").alias("i"), "unit")


# -- concepts and texts


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 60 + 1 AS DOUBLE) AS value, CASE o_orderkey % 4 WHEN 0 THEN 'increase' WHEN 1 THEN 'shoes' WHEN 2 THEN 'profit' ELSE 'oil price' END AS concept FROM orders"""
)
def concept_of_for(spark, sf_dir):
    n = "CAST(o_orderkey % 60 + 1 AS STRING)"
    text = f"CASE o_orderkey % 4 WHEN 0 THEN 'They saw an increase of ' || {n} || ' percent.' WHEN 1 THEN 'They paid ' || {n} || ' dollars for shoes.' WHEN 2 THEN 'There was a profit of ' || {n} || ' dollars.' ELSE 'The oil price was ' || {n} || ' dollars.' END"
    q = found(spark, sf_dir, "orders", ["o_orderkey"], text)
    return q.select("o_orderkey", "value", F.array_join("concepts", " ").alias("concept"))


@query("SELECT o_orderkey, 'The tax is ' || CAST(o_orderkey % 9 AS VARCHAR) || ' percentage and the fee is ' || CAST(o_orderkey % 50 AS VARCHAR) || ' dollar .' AS text FROM orders")
def normalized_text(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'The tax is ' || CAST(o_orderkey % 9 AS STRING) || '% and the fee is $' || CAST(o_orderkey % 50 AS STRING) || '.' AS text")
    return normalized_text_repeated(docs, "o_orderkey", deal=spread)


@query("SELECT p_partkey, CAST(length(p_name) + 6 AS INT) AS first_at, CAST(length(p_name) + 6 + 2 * length(CAST(p_size AS VARCHAR)) + 10 - length(CAST(p_size AS VARCHAR)) AS INT) AS second_at FROM part")
def original_places(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size AS STRING) AS s", "p_name || ' uses ' || CAST(p_size AS STRING) || ' nuts and ' || CAST(p_size AS STRING) || ' bolts' AS text")
    return t.select("p_partkey", rendering.original_span(F.col("text"), F.col("s"), F.lit(1)).alias("first_at"), rendering.original_span(F.col("text"), F.col("s"), F.lit(2)).alias("second_at"))


@query("SELECT p_partkey, '(~,' || CAST(p_size AS VARCHAR) || ',kilogram,[load])' AS printed FROM part")
def printed_tuples(spark, sf_dir):
    q = found(spark, sf_dir, "part", ["p_partkey"], "'The load is about ' || CAST(p_size AS STRING) || ' kg.'")
    return q.select("p_partkey", rendering.as_tuple(numbers.printed(F.col("value")), F.col("change"), F.col("unit_norm"), F.col("concepts")).alias("printed"))


@query("SELECT p_partkey, unnest([false, true]) AS in_bracket, CAST(unnest([p_size, p_size + 1]) AS DOUBLE) AS value, 'load' AS concept, 'down' AS change FROM part")
def bracket_inherits(spark, sf_dir):
    q = found(spark, sf_dir, "part", ["p_partkey"], "'The load fell ' || CAST(p_size AS STRING) || ' kg (' || CAST(p_size + 1 AS STRING) || ' lbs) last year'")
    q = rendering.bracket_inherit(q, ["p_partkey"])
    return q.select("p_partkey", "in_bracket", "value", F.array_join("concepts", " ").alias("concept"), "change")


# -- single steps on given cases

_STEP_CASES = [
    ("P01", "x(abc", "x (abc"), ("P02", "Walmart — shares", "Walmart shares"), ("P03", "big oil — shares", "big oil  shares"), ("P04", "a   b", "a b"), ("P05", "a | b", "a ,  b"), ("P06", "the c $ 300", "the C$ 300"),
    ("P07", "C $6", "C$6"), ("P08", "S $ 3", "S$ 3"), ("P09", "for EUR 125", "for eur 125"), ("P10", "75 U.S. per", "75 US per"), ("P11", "9 per cent", "9 percent"), ("P12", "31 percent-owned", "31 percent owned"),
    ("P13", "10 [kg]", "10 kg"), ("P14", "10 <kg>", "10 kg"), ("P15", "10 (kg)", "10 kg"), ("P16", "41 yo", "41 years old"), ("P17", "18- to 34", "18to 34"), ("P18", "60 m.p.h", "60 mph"), ("P19", "at 1,234mm long", "at 1234 mm long"), ("P19", "2m.", "2 m ."),
    ("P20", "USD 10m.", "USD 10 M"), ("P21", "PS2.7", "£2.7"), ("P22", "$5.4m", "$5.4M"), ("P23", "RM3.16mil", "3.16 M RM"), ("P24", "RM31.20k", "31.20 k RM"), ("P25", "RM23.50", "23.50 RM"), ("P26", "90-km ride", "90 km ride"),
    ("P27", "8K users", "8 thousand users"), ("P27", "400 million-year", "400 million year"), ("P28", "200sq m", "200sqm"), ("P29", "200 sqm", "200 m2"), ("P30", "10 1/2 miles", "10.5miles"), ("P31", "1/2 turn", "0.5turn"), ("P32", "50 deg", "50 degree"),
    ("P33", "25 degrees F .", "25 degf ."), ("P34", "1.5 to-2 deg", "1.5 to 2 deg"), ("P35", "a $US 113", "a US$ 113"), ("P36", "hk$5", "HK$ 5"), ("P37", "15,000 us dollar", "15,000 US dollar"), ("P38", "us $ 150", "US $ 150"), ("P39", "aud$ 15", "AUD$ 15"),
    ("P40", "30$ fee", "$30 fee"), ("P41", "5 MUSD", "5 M USD"), ("P42", "75 USD million", "75 million USD"), ("P42", "usd 20", "20 usd"), ("P43", "7 bitcoins", "7 btc"), ("P44", "US71.37", "US 71.37"), ("P45", "71¢", "71 ¢"), ("P46", "$12-$15", "$12 - $15"),
    ("P47", "10 mB", "10 MB"), ("P48", "10 mb", "10 Mbit"), ("P49", "cent-a-share", "cent a share"), ("P50", "+0.4%", "up 0.4%"), ("P51", "minus-130", "-130"), ("P52", "is -5", "is minus 5"), ("P53", "-7 degrees", "minus 7 degrees"), ("P54", "sub-300 ms", "under 300 ms"),
    ("P55", "21days", "21 days"), ("P56", "300 Hz", "300 HZ"), ("P57", "Y=28,030", "28,030 Y"), ("P58", "it is 5", "it is 5 ."), ("P58", "is it 5?", "is it 5 ?"), ("P58", "it is.\n", "it is ."), ("P58", "", " ."),
]


@query(sql_values(_STEP_CASES, "step, input, output"))
def text_normalization(spark, sf_dir):
    cases = values(spark, [(s, i) for s, i, _ in _STEP_CASES], "step string, input string")
    out = F.col("input")
    for step in dict.fromkeys(s for s, _, _ in _STEP_CASES):
        out = F.when(F.col("step") == step, textnorm.group(step)(F.col("input"))).otherwise(out)
    return cases.select("step", "input", out.alias("output"))


_NUMBER_CASES = [
    ("n1", "1,234.5", 1234.5, 1234.5), ("n2", "seven", 7.0, 7.0), ("n3", "3/4", 0.75, 0.75), ("n4", "million", 1e6, 1e6), ("n5", "2.5 billion", 2.5e9, 2.5e9), ("n6", "12 m", 1.2e7, 1.2e7), ("n7", "66.5 107", 66.5, 107.0),
    ("n8", "two dozen", 24.0, 24.0), ("n9", "three million five hundred thousand", 3.5e6, 3.5e6), ("n10", "half million", 5e5, 5e5), ("n11", "six hundred forty-two", 642.0, 642.0), ("n13", "6.022E20", 6.022e20, 6.022e20),
    ("n14", "four 100 thousand", None, None), ("n15", "quarter", 0.25, 0.25), ("n16", "a half", 0.5, 0.5), ("n17", "inf", None, None), ("n18", "1/0", None, None), ("n19", "five 20", 5.0, 20.0), ("n20", "two-thirds", 2 / 3, 2 / 3), ("n21", "3×10", 30.0, 30.0),
    ("n22", "2×10³", 2000.0, 2000.0), ("n24", "five hundred", 500.0, 500.0), ("n25", "4.5e3", 4500.0, 4500.0), ("n23", "", None, None),
]


@query(sql_values(_NUMBER_CASES, "case_id, words, lower, upper"))
def number_cases(spark, sf_dir):
    cases = values(spark, [(i, w) for i, w, _, _ in _NUMBER_CASES], "case_id string, words string")
    out = cases.withColumn("n", numbers.number(F.filter(F.split("words", " "), lambda w: w != "")))
    return out.select("case_id", "words", "n.lower", "n.upper")


_BOUND_CASES = [("b1", "", "="), ("b2", "up to", "<"), ("b3", "more than", ">"), ("b4", "at least", ">"), ("b5", "about", "~"), ("b6", "fell by", "down"), ("b7", "rises", "up"), ("b8", "about fall", "down"), ("b9", ">=", ">="), ("b10", "Well over", ">"), ("b11", "blue", "="), ("b12", "rallied", "up"), ("b13", "> =", ">=")]


@query(sql_values(_BOUND_CASES, "case_id, words, change"))
def bound_cases(spark, sf_dir):
    cases = values(spark, [(i, w) for i, w, _ in _BOUND_CASES], "case_id string, words string")
    return cases.select("case_id", "words", bounds.change(F.filter(F.split("words", " "), lambda w: w != "")).alias("change"))


_TOKEN_CASES = [
    ("~5 km/h and twenty-six boxes .", "~|5|km/h|and|twenty-six|boxes|.", "bduAwn."), ("1.38×10^10 m2 , two-thirds !", "1.38×10^10|m2|,|two-thirds|!", "dukf."), ("1/16 of a pint", "1/16|of|a|pint", "doiu"),
    ("one thirty-second of an inch", "one thirty-second|of|an|inch", "foiu"), ("US$5 or ¥7 - 8 sq m", "US$|5|or|¥|7|-|8|sq m", "cdRcdhdu"), ("degrees celsius (°C)", "degrees celsius|(|°C|)", "u(u)"), (">= 3,000.50 x 2", ">=|3,000.50|x|2", "bdxd"),
]


@query(sql_values(_TOKEN_CASES, "text, tokens, code"))
def token_cases(spark, sf_dir):
    cases = values(spark, [(t,) for t, _, _ in _TOKEN_CASES], "text string").withColumn("t", tokens.tokens(F.col("text")))
    return cases.select("text", F.array_join(F.transform("t", lambda x: x["text"]), "|").alias("tokens"), tokens.classes(F.col("t")).alias("code"))


_SENTENCES = [
    ("e01", "The sp 500 was down 2.1% and nasdaq fell 2.5%.", "(down,2.1,percentage,[sp]) (down,2.5,percentage,[nasdaq])"), ("e02", "They hold between 40 and 60 boxes", "(=,40-60,box,[])"), ("e03", "It costs $89 to $93 billion", "(=,89000000000-93000000000,dollar,[])"),
    ("e04", "thousands of parts", "(=,1000-10000,part,[])"), ("e05", "one out of four orders", "(=,0.25,% order,[])"), ("e06", "40, 50, 60 years", "(=,40,year,[]) (=,50,year,[]) (=,60,year,[])"), ("e07", "2 x 3 x 4 cm", "(=,2,centimetre,[]) (=,3,centimetre,[]) (=,4,centimetre,[])"),
    ("e08", "8 or $9", "(=,8,dollar,[]) (=,9,dollar,[])"), ("e09", "$20 per square foot", "(=,20,dollar per square foot,[])"), ("e10", "300 barrels a day", "(=,300,barrel per day,[])"), ("e14", "an increase of 5 percent", "(up,5,percentage,[increase])"),
    ("e15a", "it weighs 20 pounds", "(=,20,pound-mass,[])"), ("e15b", "it costs 20 pounds", "(=,20,pound sterling,[])"), ("e16", "0 items", "(=,0,item,[])"),
    ("e18", "They need < 5 kg", "(<,5,kilogram,[])"), ("e19", "It holds ~3 litres", "(~,3,litre,[])"), ("e20", "The trip is >= 7 miles", "(>=,7,mile,[trip])"), ("e21", "He ran to the 40 yard line", "(=,40,yard,[])"),
    ("e23", "It is 5 am", "(=,5,-,[])"), ("e24", "The price (9 dollars) fell 3%", "(=,9,dollar,[price]) (down,3,percentage,[price])"), ("e25", "Sales grew by $5m a year", "(up,5000000,dollar per year,[Sales])"),
    ("e26", "It weighs two hundred and five pounds", "(=,205,pound-mass,[])"), ("e27", "half of the 30 men", "(=,0.5,-,[]) (=,30,man,[])"), ("e28", "It is 12-cent-a-share", "(=,12,cent,[])"), ("e29", "USD 10m in fees", "(=,10000000,united states dollar,[])"),
    ("e30", "sub-500 sqm flats", "(<,500,square metre,[])"), ("e31", "about three-quarters of a mile", "(~,0.75,-,[mile])"), ("e32", "6.022E20 units", "(=,6.022E20,unit,[])"),
    ("e17", "The September crude contract was up 19 cents at US $58.24 per barrel", "(up,19,cent,[September, crude, contract]) (=,58.24,united states dollar per barrel,[September, crude, contract])"),
]
_SILENT = [("e22", "The bag needs 9 AB8 now"), ("e11", "phone 11 is new"), ("e12", "call +49 (1234) 567890"), ("e13", "at 15:06:40 on 2019-09-05"), ("s1", ""), ("s2", None), ("s3", "no numbers here")]


@query(sql_values([(i, r) for i, _, r in _SENTENCES], "case_id, result"))
def sentence_cases(spark, sf_dir):
    cases = values(spark, [(i, t) for i, t, _ in _SENTENCES] + _SILENT, "case_id string, text string")
    q = extract(cases, "text", ["case_id"])
    printed = F.when(F.col("kind") == "value", numbers.printed(F.col("value"))).otherwise(F.concat_ws("-", numbers.printed(F.col("lower")), numbers.printed(F.col("upper"))))
    q = q.select("case_id", F.struct("ord", rendering.as_tuple(printed, F.col("change"), F.col("unit_norm"), F.col("concepts")).alias("t")).alias("s"))
    return q.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), " ").alias("result"))


# -- dependency rules over parses


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parse for each order: `<n> boxes cost about <n> dollars`, with the heads such a sentence has."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_id",
        "explode(array(struct(0 AS i, CAST(o_orderkey % 7 + 1 AS STRING) AS text, 'NUM' AS pos, 'nummod' AS dep, 1 AS head), struct(1 AS i, 'boxes' AS text, 'NOUN' AS pos, 'nsubj' AS dep, 2 AS head), struct(2 AS i, 'cost' AS text, 'VERB' AS pos, 'ROOT' AS dep, 2 AS head),"
        " struct(3 AS i, 'about' AS text, 'ADV' AS pos, 'advmod' AS dep, 4 AS head), struct(4 AS i, CAST(CAST(o_orderkey % 50 + 1 AS INT) AS STRING) AS text, 'NUM' AS pos, 'nummod' AS dep, 5 AS head), struct(5 AS i, 'dollars' AS text, 'NOUN' AS pos, 'dobj' AS dep, 2 AS head))) AS t",
    )
    return rows.select("doc_id", "t.i", "t.text", F.col("t.text").alias("lemma"), "t.pos", "t.dep", "t.head")


_EXAMPLES = rule_examples.examples()


def example_parses(spark: SparkSession, sf_dir: str, by: int = 1) -> DataFrame:
    """For every by-th order one of the example parses: a smallest one for each rule, or a whole sentence."""
    rows = [(k, i, t, t, p, d, h) for k, toks in enumerate(_EXAMPLES) for i, t, p, d, h in toks]
    known = spark.createDataFrame(rows, "parse int, i int, text string, lemma string, pos string, dep string, head int")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % len(_EXAMPLES)).cast("int").alias("parse"))
    return orders.join(F.broadcast(known), "parse").drop("parse")


@query(rule_examples.matches_sql(rules.REGISTERED, _EXAMPLES) + f" SELECT o_orderkey AS doc_id, rule, toks FROM orders JOIN hits ON parse = o_orderkey % {len(_EXAMPLES)}")
def dependency_rules(spark, sf_dir):
    return rules.match_all(example_parses(spark, sf_dir)).select("doc_id", "rule", F.concat_ws(",", F.col("toks").cast("array<string>")).alias("toks"))


@query("SELECT o_orderkey AS doc_id, anchor, toks FROM orders, (VALUES (0, '0,1'), (3, '3,4,5')) AS v(anchor, toks)")
def rule_candidates(spark, sf_dir):
    c = rules.candidates(rules.match_all(parses(spark, sf_dir)))
    return c.select("doc_id", "anchor", F.concat_ws(",", F.col("toks").cast("array<string>")).alias("toks"))


@query("SELECT o_orderkey AS doc_id, i, number, bound, unit FROM orders, (VALUES (0, true, false, false), (1, false, false, true), (3, false, true, false), (4, true, false, false), (5, false, false, true)) AS v(i, number, bound, unit)")
def rule_flags(spark, sf_dir):
    p = parses(spark, sf_dir)
    return rules.flags(p, rules.match_all(p)).select("doc_id", "i", "number", "bound", "unit")


_UNREGISTERED = tuple(r for r in rules.RULES if r.family == "-")


@query(rule_examples.matches_sql(rules.RULES, _EXAMPLES) + f" SELECT rule, count(*) AS n FROM orders JOIN hits ON parse = o_orderkey % {len(_EXAMPLES)} GROUP BY rule")
def rules_unregistered(spark, sf_dir):
    """All rules, with those that do not run by default."""
    return rules.match_all(example_parses(spark, sf_dir), rules.RULES).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id, k AS sent, 0 AS first_tok, count(*) AS n FROM orders, (VALUES (0), (1)) AS s(k) WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def rules_by_sentence(spark, sf_dir):
    """A governor of forty heads away, over two sentences of a document: `>>` holds over any depth."""
    n = 40
    rows = [(s, s * n + i, t, p, d, s * n + max(0, i - 1)) for s in (0, 1) for i, (t, p, d) in enumerate([("boxes", "NOUN", "ROOT"), ("5", "NUM", "nummod"), *[("so", "X", "dep")] * (n - 3), ("about", "ADV", "advmod")])]
    chain = spark.createDataFrame([(s, i, t, t, p, d, h) for s, i, t, p, d, h in rows], "sent int, i int, text string, lemma string, pos string, dep string, head int")
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    m = rules.match_all(orders.join(F.broadcast(chain)), tuple(r for r in rules.REGISTERED if r.name == "noun_num_quant"))
    return m.groupBy("doc_id", "sent").agg((F.min(F.col("toks")[0]) - F.col("sent") * n).alias("first_tok"), F.count("*").alias("n"))


_PARSED = [  # sentence, anchor, change, kind, lower, upper, unit, concepts; {a}, {b}, {c} are numbers of the order
    ("cost", 0, "=", "value", "a", "a", "box", ""), ("cost", 4, "~", "value", "b", "b", "dollar", "boxes"), ("range", 2, "=", "range", "a", "c", "box", ""),
    ("between", 3, "=", "range", "a", "c", "percentage", "Prices"), ("broad", 0, "=", "range", "100", "1000", "part", ""), ("fraction", 0, "=", "value", "0.25", "0.25", "% -", ""), ("one_of", 0, "=", "value", "1", "1", "box", ""),
    ("per", 2, "=", "value", "b", "b", "barrel per day", ""), ("money", 4, "=", "value", "b", "b", "dollar", "parking"), ("fell", 5, "down", "value", "a", "a", "percentage", "oil price"), ("minus", 3, "=", "value", "-a", "-a", "degree", ""),
    ("spelled", 2, "=", "value", "200", "200", "people", ""), ("phone", 8, "=", "value", "a", "a", "cup", ""), ("shared", 2, "=", "value", "a", "a", "euro", ""), ("shared", 4, "=", "value", "c", "c", "euro", ""),
    ("bracket", 3, "=", "value", "a", "a", "kilogram", "load"), ("bracket", 6, "=", "value", "b", "b", "pound-mass", "load"),
]
_PARSE_NAMES = list(rule_examples.SENTENCES)


def sentence_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a parsed sentence with numbers of its own."""
    rows = [(_PARSE_NAMES.index(n), i, t, p, d, h) for n in _PARSE_NAMES for i, t, p, d, h in rule_examples.sentence(n)]
    known = spark.createDataFrame(rows, "parse int, i int, text string, pos string, dep string, head int")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % len(_PARSE_NAMES)).cast("int").alias("parse"))
    t = orders.join(F.broadcast(known), "parse")
    number = F.when(F.col("text") == "{a}", F.col("doc_id") % 90 + 1).when(F.col("text") == "{b}", F.col("doc_id") % 400 + 10).when(F.col("text") == "{c}", F.col("doc_id") % 90 + 4)
    return t.withColumn("text", F.coalesce(number.cast("string"), F.col("text"))).select("doc_id", "i", "text", F.col("text").alias("lemma"), "pos", "dep", "head")


def _parsed_sql() -> str:
    n = lambda x: {"a": "o_orderkey % 90 + 1", "b": "o_orderkey % 400 + 10", "c": "o_orderkey % 90 + 4", "-a": "-(o_orderkey % 90 + 1)"}.get(x, x)
    return " UNION ALL ".join(
        f"SELECT o_orderkey AS doc_id, {anchor} AS anchor, '{change}' AS change, '{kind}' AS kind, CAST({n(lo)} AS DOUBLE) AS lower, CAST({n(hi)} AS DOUBLE) AS upper, '{unit}' AS unit_norm, '{concept}' AS concept FROM orders WHERE o_orderkey % {len(_PARSE_NAMES)} = {_PARSE_NAMES.index(name)}"
        for name, anchor, change, kind, lo, hi, unit, concept in _PARSED
    )


@query(_parsed_sql())
def quantities_of_parses(spark, sf_dir):
    q = parsed.parsed_quantities(sentence_parses(spark, sf_dir))
    return q.select("doc_id", "anchor", "change", "kind", "lower", "upper", "unit_norm", F.array_join("concepts", " ").alias("concept"))


# -- reports, training, streams


def event_quantities(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e = events if events is not None else spread(table(spark, sf_dir, "events"))
    text = f"'The rate ' || {_case('event_id', ['fell ', 'rose ', 'was about '])} || CAST(event_id % 50 AS STRING) || {_case('event_id', [' percent.', ' kg.', ' percent.', ' boxes.', ' miles.'])}"
    return extract(e.selectExpr("event_id", "ts", "user_id", f"{text} AS text"), "text", ["event_id", "ts", "user_id"])


_EVENTS_SQL = f"""e AS (SELECT event_id, ts, user_id, {_case('event_id', ['down', 'up', '~'])} AS change, CAST(event_id % 50 AS DOUBLE) AS lower,
{_case('event_id', ['percentage', 'kilogram', 'percentage', 'box', 'mile'])} AS unit_norm FROM events)"""


@query(f"WITH {_EVENTS_SQL} SELECT change, unit_norm, CAST(grouping(change, unit_norm) AS BIGINT) AS level, count(*) AS n, min(lower) AS lowest, max(lower) AS highest FROM e GROUP BY ROLLUP (change, unit_norm)")
def unit_rollup(spark, sf_dir):
    return reports.unit_rollup(event_quantities(spark, sf_dir))


@query(f"WITH {_EVENTS_SQL} SELECT kind, change, unit_norm, CAST(grouping(kind, change, unit_norm) AS BIGINT) AS level, count(*) AS n FROM (SELECT *, 'value' AS kind FROM e) GROUP BY CUBE (kind, change, unit_norm)")
def quantity_cube(spark, sf_dir):
    return reports.quantity_cube(event_quantities(spark, sf_dir))


@query(f"WITH {_EVENTS_SQL} SELECT unit_norm, count(DISTINCT lower) AS n_values FROM e GROUP BY unit_norm")
def distinct_values(spark, sf_dir):
    return reports.distinct_values(event_quantities(spark, sf_dir)).select("unit_norm", "n_values")


@query(f"WITH {_EVENTS_SQL}, c AS (SELECT change, unit_norm, count(*) AS n FROM e GROUP BY ALL) SELECT change, unit_norm, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY n DESC, unit_norm) AS place FROM c) WHERE place <= 3")
def top_units(spark, sf_dir):
    return reports.top_units(event_quantities(spark, sf_dir))


@query(f"WITH {_EVENTS_SQL} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, change, unit_norm, count(*) AS n, sum(lower) AS total FROM e GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return streams.windowed(event_quantities(spark, sf_dir), "ts", "1 hour")


@query(f"WITH {_EVENTS_SQL}, w AS (SELECT e.*, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM e) SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, change, unit_norm, count(*) AS n, sum(lower) AS total FROM w GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    return streams.windowed(event_quantities(spark, sf_dir), "ts", "1 hour", "30 minutes")


@query(
    f"""WITH {_EVENTS_SQL}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf_dir):
    return streams.sessions(event_quantities(spark, sf_dir), "ts", "6 hours", "user_id")


@query(f"WITH {_EVENTS_SQL} SELECT event_id, change, lower AS value, unit_norm FROM e")
def stream_event_quantities(spark, sf_dir):
    """The events read as a stream and written once; the result is what the batch gives."""
    import tempfile
    import uuid

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parq*")
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="metrolith-stream-")
    root = f"{root}/stream-{uuid.uuid4().hex}"
    q = event_quantities(spark, sf_dir, stream).select("event_id", "change", "value", "unit_norm")
    streams.run_once(q, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(q.schema).parquet(f"{root}/out")


@query("SELECT d.doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS is_good, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS is_bad FROM documents d JOIN labels USING (doc_id)")
def training_onehot(spark, sf_dir):
    from metrolith.sources.readers import one_hot

    named = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("unit"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(named, "doc_id")
    return one_hot(docs, ("good", "bad")).drop("unit")


@query("SELECT p_partkey, 5 AS ord, CAST(p_size AS DOUBLE) AS value, 'centimetre' AS unit_norm FROM part WHERE p_size > 10")
def sql_table_function(spark, sf_dir):
    """The view that register() makes, with conditions on what the engine computes."""
    api.register(spark, spread(table(spark, sf_dir, "part")).selectExpr("p_partkey", "'size ' || CAST(p_size AS STRING) || ' cm' AS text"), "part_quantities", "text", ("p_partkey",))
    return spark.sql("SELECT p_partkey, ord, value, unit_norm FROM part_quantities WHERE value > 10 AND unit_scientific")


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS value, 'box' AS unit_norm FROM events")
def json_properties(spark, sf_dir):
    k = "get_json_object(props, '$.k')"
    return found(spark, sf_dir, "events", ["event_id"], f"'They took ' || {k} || ' boxes.'").select("event_id", "value", "unit_norm")


@query(None)
def documents_quantities(spark, sf_dir):
    """Everything the engine finds in the documents themselves."""
    q = extract(spread(table(spark, sf_dir, "documents")), "text", ["doc_id"])
    return q.select("doc_id", "sent_no", "ord", "change", "kind", "lower", "upper", "unit_norm")


@query("SELECT doc_id, CAST(doc_id % 50 AS DOUBLE) AS value, 'up' AS change, 'petrel' AS concept FROM documents WHERE text IS NOT NULL")
def documents_planted_quantities(spark, sf_dir):
    """A sentence added to each whole document, found by conditions on what the engine computes."""
    docs = spread(table(spark, sf_dir, "documents")).selectExpr("doc_id", "text || '. The petrel grew ' || CAST(doc_id % 50 AS STRING) || ' kilolumens.' AS text")
    q = extract(docs.filter("text IS NOT NULL"), "text", ["doc_id"]).filter("unit_norm = 'kilolumen'")
    return q.select("doc_id", "value", "change", F.element_at("concepts", -1).alias("concept"))


@query("SELECT p_partkey, 5 AS n FROM part")
def token_brackets_joined(spark, sf_dir):
    """Tokens that stand in brackets: places of the brackets in a sentence's class string, within each row."""
    t = tokenized(table(spark, sf_dir, "part").selectExpr("p_partkey", "'The part (size ' || CAST(p_size AS STRING) || ' here) is new' AS text"), "text", ["p_partkey"])
    spans = located(F.col("code"), BRACKETS)
    return t.select("p_partkey", F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("n"))


# -- post-filters and shared units


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, 'bolt' AS unit_norm FROM part WHERE p_partkey % 4 = 0")
def post_filters(spark, sf_dir):
    """An echoed name, a year's noun and a street number are no quantities; bolts are."""
    n = "CAST(p_size AS STRING)"
    text = f"CASE p_partkey % 4 WHEN 0 THEN 'They use ' || {n} || ' bolts' WHEN 1 THEN 'The rover ' || {n} || ' is out and all ' || {n} || ' rover stock is sold' WHEN 2 THEN 'They won in 20' || lpad({n}, 2, '0') || ' season games' ELSE 'They live at ' || {n} || ' Old Oak Road' END"
    return found(spark, sf_dir, "part", ["p_partkey"], text).select("p_partkey", "value", "unit_norm")


@query(
    """SELECT p_partkey, 0 AS k, CAST(p_size AS DOUBLE) AS value, CASE p_partkey % 2 WHEN 0 THEN 'percentage' ELSE 'dollar' END AS unit_norm FROM part
    UNION ALL SELECT p_partkey, 1 AS k, CAST(p_size + 1 AS DOUBLE) AS value, CASE p_partkey % 2 WHEN 0 THEN 'percentage' ELSE 'dollar' END AS unit_norm FROM part"""
)
def shared_units_by_clause(spark, sf_dir):
    """A bare number takes the unit of the next value in its clause, or of its like in a clause built alike."""
    a, b = "CAST(p_size AS STRING)", "CAST(p_size + 1 AS STRING)"
    text = f"CASE p_partkey % 2 WHEN 0 THEN 'Big sales went over ' || {a} || ' percent and big taxes went over ' || {b} ELSE 'They sell it for ' || {a} || ' then $' || {b} || ' now' END"
    q = api.with_shared_units(found(spark, sf_dir, "part", ["p_partkey"], text), ["p_partkey"])
    return q.select("p_partkey", "value", "unit_norm", "ord").withColumn("k", (F.row_number().over(Window.partitionBy("p_partkey").orderBy("ord")) - 1)).drop("ord")


@query("SELECT 1 AS k, 'united states dollar' AS unit_norm UNION ALL SELECT 2 AS k, 'gram' AS unit_norm UNION ALL SELECT 3 AS k, 'metre' AS unit_norm UNION ALL SELECT 4 AS k, 'metre' AS unit_norm")
def unit_words(spark, sf_dir):
    """Units of several words: the first two as one, a word that the catalog knows, a repeated first word."""
    from metrolith.operators.extract import any_known, once, resolved

    rows = values(spark, [(1, ["US", "$", "notes"]), (2, ["old", "grams", "heaps"]), (3, ["metres", "metres"]), (4, ["small", "m"])], "k int, ws array<string>")
    unit = once(F.col("ws"))
    known = F.when(F.size(unit) > 1, any_known(unit)).otherwise(F.get(unit, F.lit(0)))
    return rows.select("k", resolved([known], F.col("ws"))["n"].alias("unit_norm"))


@query("SELECT p_partkey, 'kilometre per hour' AS unit_norm, true AS known FROM part")
def quantity_surface_forms(spark, sf_dir):
    q = api.with_surface_forms(found(spark, sf_dir, "part", ["p_partkey"], "'It runs ' || CAST(p_size AS STRING) || ' km/h'"))
    return q.select("p_partkey", "unit_norm", F.array_contains(F.flatten("unit_forms"), "hours").alias("known"))


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["plain_number_extract"](spark, "/root/testdata/sf0.001")
