"""Numbers from words: plain, spelled, scaled, fractional and scientific, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions.lexicon import FRACTIONS, NUMBER_WORDS, SCALES
from metrolith.functions.spans import constant_map, let

RANGE = "struct<lower:double,upper:double>"
_PLAIN = r"^[+-]?(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
_SUPER = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")


def is_number(word: Column) -> Column:
    """A decimal numeral, commas grouping. Neither inf nor nan is one."""
    return F.coalesce(word.rlike(_PLAIN), F.lit(False))


def plain(word: Column) -> Column:
    return F.when(is_number(word), F.replace(word, F.lit(","), F.lit("")).try_cast("double"))


def spelled(word: Column) -> Column:
    return F.try_element_at(constant_map(NUMBER_WORDS, "double"), word)


def scale(word: Column) -> Column:
    return F.try_element_at(constant_map(SCALES, "double"), word)


def fraction_word(word: Column) -> Column:
    return F.try_element_at(constant_map(FRACTIONS, "double"), word)


def slashed(word: Column) -> Column:
    """3/4 or 3⁄4; nothing over zero."""
    parts = F.split(word, "[/⁄]+")
    return F.when(word.rlike(r"^\d+[/⁄]+\d+$"), F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")))


def scientific(word: Column) -> Column:
    """6.02E20, 1.4×10³, 1.4×10^−3, 1.4×10−3; and a bare product 3×10."""
    e = r"^([\d,.]*\d)×?[eE]([+−-]?)(\d+)$"
    ten = r"^([\d,.]*\d)×10\^?([−-]?)(\d+)$"
    raised = r"^([\d,.]*\d)×10([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)$"
    product = r"^([\d,.]*\d)×(\d+)$"

    def powered(pattern: str) -> Column:
        minus = F.regexp_extract(word, pattern, 2).isin("−", "-")
        exponent = F.regexp_extract(word, pattern, 3).try_cast("double")
        return plain(F.regexp_extract(word, pattern, 1)) * F.pow(F.lit(10.0), F.when(minus, -exponent).otherwise(exponent))

    up = F.translate(F.regexp_extract(word, raised, 2), *_SUPER).try_cast("double")
    return (
        F.when(word.rlike(raised), plain(F.regexp_extract(word, raised, 1)) * F.pow(F.lit(10.0), up))
        .when(word.rlike(e), powered(e))
        .when(word.rlike(product) & ~word.rlike(r"×10\d"), plain(F.regexp_extract(word, product, 1)) * plain(F.regexp_extract(word, product, 2)))
        .when(word.rlike(ten), powered(ten))
    )


def single(word: Column) -> Column:
    """One word's value: numeral, scientific, number word, fraction, slash, scale."""
    return F.coalesce(plain(word), scientific(word), spelled(word), fraction_word(word), slashed(word), scale(word))


def _described(word: Column) -> Column:
    """What a word can be, each computed once."""
    return F.struct(
        plain(word).alias("plain"),
        scientific(word).alias("sci"),
        spelled(word).alias("spelled"),
        scale(word).alias("scale"),
        fraction_word(word).alias("fraction"),
        slashed(word).alias("slashed"),
        (word == "m").alias("is_m"),
        F.coalesce(word.rlike(r"^\d+$"), F.lit(False)).alias("digits"),
    )


def _range(lower: Column, upper: Column) -> Column:
    return F.when(lower.isNotNull() & upper.isNotNull(), F.struct(lower.alias("lower"), upper.alias("upper")).cast(RANGE))


def _composed(parts: Column) -> Column:
    """Spelled numbers by accumulation: `three million five hundred thousand`. Scales above a hundred close a
    group; a fraction word in front is its value; digits after the first word, or other words, are no number."""
    start = F.struct(F.lit(0.0).alias("cur"), F.lit(0.0).alias("sum"), F.lit(True).alias("ok"), F.lit(0).alias("i"))

    def step(acc: Column, w: Column) -> Column:
        leads = (acc["i"] == 0) & w["fraction"].isNotNull()
        value = F.coalesce(w["spelled"], w["plain"], F.when(leads, w["fraction"]))
        factor = F.when(~leads, F.coalesce(w["scale"], w["fraction"]))
        ok = acc["ok"] & (value.isNotNull() | factor.isNotNull()) & ~(w["digits"] & (acc["i"] > 0))
        now = F.when(factor.isNotNull(), acc["cur"] * factor).otherwise(F.coalesce(value, F.lit(0.0)) + acc["cur"])
        close = F.coalesce(factor > 100, F.lit(False))
        return F.struct(
            F.when(close, 0.0).otherwise(now).alias("cur"),
            F.when(close, acc["sum"] + now).otherwise(acc["sum"]).alias("sum"),
            ok.alias("ok"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], acc["sum"] + acc["cur"]))


def number(words: Column) -> Column:
    """struct(lower, upper) of lower-cased number words; null if they are no number.

    `a` and `and` are skipped; a leading fraction word before other words is its decimal value; two numbers side by
    side are a range; `m` after a number is million.
    """
    return let(F.transform(F.filter(words, lambda w: ~w.isin("a", "and")), _described), _number)


def composed(words: Column) -> Column:
    return _composed(F.transform(words, _described))


def _number(parts: Column) -> Column:
    n, first, second = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    one = F.coalesce(first["plain"], first["sci"], first["spelled"], first["fraction"], first["slashed"], first["scale"])
    lead = F.coalesce(first["plain"], first["fraction"], first["spelled"], first["sci"])
    scaled = lead * F.when(second["is_m"], 1e6).otherwise(second["scale"])
    both = (first["plain"].isNotNull() & F.coalesce(second["plain"], second["spelled"]).isNotNull()) | (first["spelled"].isNotNull() & second["plain"].isNotNull())
    total = _composed(parts)
    return (
        F.when(n == 0, None)
        .when(n == 1, _range(one, one))
        .when((n == 2) & scaled.isNotNull(), _range(scaled, scaled))
        .when((n == 2) & both, _range(lead, F.coalesce(second["plain"], second["spelled"])))
        .otherwise(let(total, lambda t: _range(t, t)))
    )


def notation(x: Column) -> Column:
    """1.234560e+03."""
    return F.format_string("%e", x)


def short_notation(x: Column) -> Column:
    """The same without trailing zeros in the mantissa."""
    return F.regexp_replace(notation(x), r"\.?0+e", "e")


def printed(x: Column) -> Column:
    """Integers without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))
