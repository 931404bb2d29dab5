"""Single functions: lexicons, normalization, numbers, bounds, tokens, places, ignored shapes."""

import re

import pytest
from pyspark.sql import functions as F

from metrolith.functions import bounds, ignore, lexicon, numbers, spans, textnorm, tokens
from metrolith.functions.catalog import CATALOG, FORMS, lookup
from metrolith.operators import clauses


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("r")).first().r


def test_lexicons():
    assert len(lexicon.NUMBER_WORDS) == 100 and lexicon.NUMBER_WORDS["ninety-nine"] == 99
    assert lexicon.FRACTIONS["seven-eighths"] == 7 / 8 and lexicon.FRACTIONS["three-quarter"] == 0.75
    assert len(lexicon.BOUNDS) == 89
    assert lexicon.BOUND_LEMMAS["fell"] == "fall" and lexicon.BOUND_LEMMAS["dropped"] == "drop" and lexicon.BOUND_LEMMAS["rallied"] == "rally"
    assert len({u.key for u in CATALOG}) == len(CATALOG)
    assert FORMS["kilometres"][0] == "kilometre" and FORMS["MB"][0] == "megabyte"


@pytest.mark.parametrize("words", [["a", "an", "and", "be"], ["", "x"], ["one"], [".", "(", "a+b"]])
def test_pattern_is_exactly_its_words(words):
    p = re.compile(lexicon.pattern(words))
    for w in words:
        assert p.match(w)
    for w in ["an ", "b", "bee", "xx", "ones", "aab"]:
        assert bool(p.match(w)) == (w in words)


def test_lookup(spark):
    rows = spark.createDataFrame([("GHz",), ("nothing",), (None,), ("",)], "f string").select(lookup(F.col("f"))["n"].alias("n")).collect()
    assert [r.n for r in rows] == ["gigahertz", None, None, None]


def test_normalizing_nulls_and_long_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("5kg " * 3000,)], "t string").select(textnorm.normalize(F.col("t")).alias("n")).collect()
    assert rows[0].n is None and rows[1].n == " ." and rows[2].n.count("5 kg") == 3000


def test_whitespace_steps_are_idempotent(spark):
    texts = ["a  b", "x(abc", "a | b", "10 [kg] (kg)", "it is 5 .", "is it ?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for step in ("P01", "P04", "P13", "P15", "P58"):
        f = textnorm.group(step)
        assert df.filter(f(F.col("t")) != f(f(F.col("t")))).count() == 0


def test_numbers_of_bad_words(spark):
    df = spark.createDataFrame([(["blue"],), ([],), (None,), (["nan"],), (["1,2,3"],), (["one", "blue"],)], "w array<string>")
    assert [r.n and r.n.lower for r in df.select(numbers.number(F.col("w")).alias("n")).collect()] == [None, None, None, None, 123.0, None]


def test_printing(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (1e7,), (-3.0,), (4e-3,)], "x double")
    rows = df.select(numbers.printed(F.col("x")).alias("p"), numbers.short_notation(F.col("x")).alias("s")).collect()
    assert [r.p for r in rows[:4]] == ["0", "2.5", "10000000", "-3"]
    assert rows[1].s == "2.5e+00" and rows[4].s == "4e-03"


def test_bounds_of_nothing(spark):
    df = spark.createDataFrame([([],), (["BY"],), (["Rose"],)], "w array<string>")
    assert [r.c for r in df.select(bounds.change(F.col("w")).alias("c")).collect()] == ["=", "=", "up"]


@pytest.mark.parametrize(
    ("step", "text"),
    [("I3", "(123)-456-7890"), ("I4", "18-11-9-5"), ("I5", "15:06:40"), ("I6", "2:00"), ("I7", "March 17"), ("I7", "Sept 3-5"), ("I8", "2019-09-05"), ("I9", "PS46.6m"), ("I10", "3 rd"), ("I12", "(12) 555 1234"), ("I12", "90210 ZIP"), ("I13", "+49 (1234) 567890")],
)
def test_ignored_shapes(spark, step, text):
    assert one(spark, ignore.ignored(F.col("t"), step), t=text)
    assert not one(spark, ignore.ignored(F.col("t"), step), t="5 boxes")
    assert "5" not in one(spark, ignore.mask(F.col("t")), t=f"in {text}").replace("⁣", "") or step in ("I3",)


def test_places_slice_back(spark):
    text = "tax 2.5% and €3.20/h for 7 über-boxes, Ω"
    for s in one(spark, tokens.tokens(F.col("t")), t=text):
        assert text[s.start : s.end] == s.text
    assert one(spark, spans.masked(F.col("t"), "[0-9]+", "#"), t="a12b3") == "a##b#"


def test_clauses(spark):
    got = one(spark, clauses.clauses(F.col("c")), c="nnnAnnnk.")
    assert [(x.lo, x.hi) for x in got] == [(0, 3), (4, 8)]
    assert one(spark, clauses.clauses(F.col("c")), c="") == []
    assert [(x.lo, x.hi) for x in one(spark, clauses.clauses(F.col("c")), c="n")] == [(0, 0)]
