"""Texts that repeat are read once, whatever the join, with the same rows as without."""

import pytest
from pyspark.sql import functions as F

from metrolith import queries
from metrolith.operators import rendering, repeated, rules
from metrolith.operators.extract import extract, tokenized


def plain(df):
    return sorted(map(repr, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_repeated_is_extract(spark, monkeypatch, most):
    monkeypatch.setattr(repeated, "BROADCAST_TEXT_BYTES", most)
    texts = ["It fell 5 kg", "We saw 2 to 3 boats. They cost $4 or $5.", "", None, "nothing", "it fell 5 kg"]
    df = spark.createDataFrame([(i % 7 or None, t, i % 2) for i in range(20) for t in texts], "_key int, text string, _r0 int")
    got, want = repeated.extract_repeated(df, "text", ["_key", "_r0"]), extract(df, "text", ["_key", "_r0"])
    assert "Aggregate [_key" in plan_of(got) and ("strategy=broadcast" in plan_of(got)) == (most > 0)
    assert got.columns == want.columns and plain(got) == plain(want) and got.count() == 100


def test_texts_that_differ_go_the_plain_way(spark):
    df = spark.range(50).select("id", F.format_string("It fell %d kg", "id").alias("text"))
    assert "Join" not in plan_of(repeated.extract_repeated(df, "text", ["id"]))
    assert repeated.extract_repeated(df.limit(0), "text", ["id"]).count() == 0


@pytest.mark.parametrize("name", ["plain_number_extract", "normalized_text", "percent_amounts", "fraction_values", "scientific_notation"])
def test_queries_read_each_text_once(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert "strategy=broadcast" in plan and "Aggregate [_key" in plan


@pytest.mark.parametrize("name", ["percent_amounts", "fraction_values", "scientific_notation"])
def test_queries_tell_rows_apart_by_plain_columns(spark, name):
    """No row's sentence is made or tested: neither for the count, nor to tell rows apart, nor for the join."""
    rows = plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.01")).splitlines()
    below = [line for i, line in enumerate(rows) if "Relation [" in line for line in rows[i - 3 : i]]
    assert any("Aggregate [_key0" in line for line in below) and not any("concat" in line or "RLIKE" in line for line in below)


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_parts_give_the_rows_of_extract(spark, monkeypatch, most):
    monkeypatch.setattr(repeated, "BROADCAST_TEXT_BYTES", most)
    made = F.expr("'We saw ' || CAST(CAST(n AS INT) AS STRING) || CASE WHEN few THEN ' or ' ELSE ' of ' END || '9 boats.'")

    def same(rows, told, results=("*",)):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 8)], "id int, n double, few boolean")
        got = repeated.extract_repeated(df, "text", ["id"], parts=["n", "few"], text=made, results=results)
        want = extract(df.withColumn("text", made), "text", ["id"])
        want = want if results == ("*",) else want.select("id", *results)
        assert got.columns == want.columns and plain(got) == plain(want)
        plan = plan_of(got)
        assert ("_key1" in plan, "_key0" in plan) == {"parts": (True, True), "text": (False, True), "rows": (False, False)}[told]
        return got.count()

    assert same([(2.0, True), (2.5, True), (3.0, False), (None, True), (None, None), (0.0, False), (-0.0, False), (-7.0, True)], "parts") > 0
    assert same([(2.0, True), (4.0, False)], "parts", ("value", F.array_join("unit_surface", " ").alias("unit"))) > 0
    assert same([(2.0, None), (2.0, True), (3.0, False)], "text") > 0  # a text made of a missing part
    assert same([(2 + i / 100, True) for i in range(60)], "text") > 0  # many parts for one text
    assert same([(float(i % 7), None) for i in range(20)], "text") > 0
    assert same([(None, True)], "rows") == 0


def test_repeated_texts_are_rendered_as_others(spark):
    df = spark.createDataFrame([(10 * i + j, t) for i in range(9) for j, t in enumerate(["The fee is $5 and 3%.", "nothing", "", None])], "id int, text string")
    got, want = repeated.normalized_text_repeated(df, "id"), rendering.normalized_text(df, extract(df, "text", ["id"]), "id")
    assert got.columns == want.columns and plain(got) == plain(want) and got.count() == 36


def test_governors_of_deep_parses_and_circles(spark):
    """All governors of each token, near and far, against a plain walk, in time that a deep parse does not square."""
    import random
    import time

    pick = random.Random(7)
    trees = [[max(0, i - 1) for i in range(600)], [pick.randrange(-2, 14) for _ in range(12)], [1, 2, 0, 0, 3], [1, 0], [0], [5, 9]]
    trees += [[pick.randrange(0, 9) for _ in range(9)] for _ in range(40)]
    rows = spark.createDataFrame([(k, h, list(range(len(h)))) for k, h in enumerate(trees)], "k int, heads array<int>, all array<int>")
    began = time.time()
    got = {r.k: r.above for r in rows.select("k", *rules._kin()).select("k", "above").collect()}
    assert time.time() - began < 30
    for k, heads in enumerate(trees):
        for i, above in enumerate(got[k]):
            want, at = set(), i
            while 0 <= heads[at] < len(heads) and heads[at] != at and heads[at] not in want:
                at = heads[at]
                want.add(at)
            assert sorted(above) == sorted(want - {i})


def test_rules_ask_of_tokens_only_what_they_test(spark):
    tokens = spark.createDataFrame([(1, 0, "x", "x", "NUM", "ROOT", 0)], "doc_id int, i int, text string, lemma string, pos string, dep string, head int")
    assert "RLIKE" not in plan_of(rules.match_all(tokens, tuple(r for r in rules.REGISTERED if r.name == "noun_num_quant"))).upper()
    assert rules.match_all(tokens).count() == 1


def test_sentences_without_numbers_are_not_cut(spark):
    texts = ["Cats sleep often. It fell 5 kg. Nothing else. Half of it. Dogs eat twenty-one cakes.", "None of the phones. They sold two-thirds of it. _million boats."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert sorted((r.id, r.sent_no) for r in tokenized(df, "text", ["id"]).collect()) == [(0, 1), (0, 3), (0, 4), (1, 1)]
