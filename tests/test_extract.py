"""Extraction end to end, rules over parses, renderings, sources and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from metrolith import api, queries
from metrolith.operators import rendering, rules
from metrolith.operators.extract import extract
from metrolith.plans import reports
from metrolith.sources import readers
from metrolith.streaming import streams


def quantities(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return extract(df, "text", ["id"]).orderBy("ord").collect()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("It grew 5 percent in 2011.", [("up", 5.0, 5.0, "percentage")]),
        ("They want at most 3 kg of flour", [("<", 3.0, 3.0, "kilogram")]),
        ("The tower is 1,250.5 feet tall", [("=", 1250.5, 1250.5, "foot")]),
        ("Profits fell by 2.5% to $1.2bn", [("down", 2.5, 2.5, "percentage"), ("=", 1.2e9, 1.2e9, "dollar")]),
        ("hundreds of cars", [("=", 100.0, 1000.0, "car")]),
        ("It is -5 degrees celsius", [("=", -5.0, -5.0, "celsius")]),
        ("The deal is worth €20m", [("=", 2e7, 2e7, "euro")]),
        ("between 1.5 and 2 kg", [("=", 1.5, 2.0, "kilogram")]),
        ("Nothing to see here", []),
        ("2 x 4 cm", [("=", 2.0, 2.0, "centimetre"), ("=", 4.0, 4.0, "centimetre")]),
        ("over 9000 users signed up", [(">", 9000.0, 9000.0, "user")]),
        ("(12) 345 6789", []),
    ],
)
def test_sentences(spark, text, expected):
    assert [(r.change, r.lower, r.upper, r.unit_norm) for r in quantities(spark, text)] == expected


def test_places_and_notation(spark):
    (r,) = quantities(spark, "The load is about 2.5 kg.")
    norm = "The load is about 2.5 kg ."
    assert [norm[s.start : s.end] for s in r.value_spans] == ["2.5"] and [norm[s.start : s.end] for s in r.unit_spans] == ["kg"]
    assert (r.sci, r.sci_short, r.kind, r.unit_keys, r.unit_scientific) == ("2.500000e+00", "2.5e+00", "value", ["gram"], True)


def test_hard_inputs(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "5 kg " * 400, 7), (4, "9" * 5000, 7), (5, "5 kg", 7), (5, "5 kg", 7), (None, "5 kg", 7)]
    df = spark.createDataFrame(rows, "id int, text string, toks int")  # toks: a name the plan uses itself
    got = extract(df, "text", ["id"]).groupBy("id").count().collect()
    counts = {r.id: r["count"] for r in got}
    assert counts[3] == 400 and counts[5] == 2 and counts[None] == 1 and 1 not in counts and 2 not in counts
    assert extract(df.limit(0), "text", ["id"]).count() == 0


def test_one_narrow_plan(spark):
    df = spark.createDataFrame([(1, "5 kg")], "id int, text string")
    plan = extract(df, "text", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_conditions_on_every_column_are_cheap_to_plan(spark):
    """A condition on a computed column is planned as fast as none and stays above the explode; one on an id goes to the scan."""
    df = spark.createDataFrame([(1, "It fell 5 kg")], "id int, text string")
    schema = extract(df, "text", ["id"]).schema
    for f in schema.fields:
        began = time.time()
        plan = extract(df, "text", ["id"]).filter(F.col(f.name).isNotNull() & (F.hash(f.name) != 7))._jdf.queryExecution().optimizedPlan().toString()
        assert time.time() - began < 15, f.name
        assert plan.count("Generate") == 4
    assert extract(df, "text", ["id"]).filter("unit_scientific AND change = 'down' AND value > 4 AND size(concepts) = 0 AND id = 1").count() == 1
    plan = extract(df, "text", ["id"]).filter("id = 7")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("id#") > plan.rindex("Generate") and "= 7" in plan[plan.rindex("Generate") :] or "LocalRelation <empty>" in plan


def test_names_that_the_plan_uses_itself(spark):
    df = spark.createDataFrame([(1, 2, 3, "5 kg")], "toks int, q int, _norm int, text string")
    r = extract(df, "text", ["toks", "q", "_norm"]).first()
    assert (r.toks, r.q, r["_norm"], r.unit_norm) == (1, 2, 3, "kilogram")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The rover 12 is out and all 12 rover stock is sold", []), ("They won in 2019 season games", []), ("They ate 2019 apples", [(2019.0, "apple")]), ("They ran in 2019 kilometres", [(2019.0, "kilometre")]),
        ("He lives at 12 Old Oak Road", []), ("He owns 12 old oak trees", [(12.0, "old")]),
    ],
)
def test_post_filters(spark, text, expected):
    assert [(r.lower, r.unit_norm) for r in quantities(spark, text)] == expected


def parse(spark, words):
    """words: (text, pos, dep, head)."""
    return spark.createDataFrame([(1, i, t, t, p, d, h) for i, (t, p, d, h) in enumerate(words)], "doc_id int, i int, text string, lemma string, pos string, dep string, head int")


def hits(spark, words, which=rules.RULES):
    return {(r.rule, tuple(r.toks)) for r in rules.match_all(parse(spark, words), which).collect()}


def test_rule_counts():
    assert (len(rules.RULES), len(rules.REGISTERED), len(rules.FAMILIES)) == (63, 58, 33)


def test_rules_on_parses(spark):
    got = hits(spark, [("between", "ADP", "prep", 0), ("40", "NUM", "pobj", 0), ("and", "CCONJ", "cc", 1), ("60", "NUM", "conj", 1), ("boxes", "NOUN", "dobj", 3)])
    assert ("adp_num_cconj_num", (0, 1, 2, 3)) in got
    got = hits(spark, [("$", "SYM", "nmod", 1), ("58.24", "NUM", "pobj", 1), ("per", "ADP", "prep", 1), ("barrel", "NOUN", "pobj", 2)])
    assert {("num_symbol", (1, 0)), ("unit_frac", (1, 2, 3)), ("lonely_num", (1,))} <= got
    got = hits(spark, [("higher", "ADJ", "amod", 0), ("by", "ADP", "prep", 0), ("about", "ADV", "advmod", 3), ("5", "NUM", "pobj", 1)])
    assert {("noun_num_quant_3", (3, 0)), ("num_quantmod", (3, 2))} <= got
    got = hits(spark, [("2", "NUM", "nummod", 5), ("x", "SYM", "punct", 5), ("3", "NUM", "nummod", 5), ("x", "SYM", "punct", 5), ("4", "NUM", "nummod", 5), ("boxes", "NOUN", "dobj", 5)])
    assert {("dimensions_2", (5, 0, 1, 2)), ("dimensions_3", (5, 0, 1, 2, 3, 4))} <= got
    assert hits(spark, []) == set()


def test_candidates_merge_transitively(spark):
    m = spark.createDataFrame([(1, 0, [0, 1]), (1, 1, [3, 4]), (1, 2, [1, 3]), (1, 3, [7])], "doc_id int, priority int, toks array<int>")
    assert sorted((r.anchor, r.toks) for r in rules.candidates(m).collect()) == [(0, [0, 1, 3, 4]), (7, [7])]


def test_renderings(spark):
    df = spark.createDataFrame([("a 5 b 5 c", "5")], "t string, s string")
    r = df.select(rendering.original_span(F.col("t"), F.col("s"), F.lit(1)).alias("a"), rendering.original_span(F.col("t"), F.col("s"), F.lit(2)).alias("b"), rendering.original_span(F.col("t"), F.col("s"), F.lit(3)).alias("c"), rendering.closest_span(F.col("t"), F.lit("5 d")).alias("d")).first()
    assert tuple(r) == (2, 6, None, 2)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"id": i, "body": f"{i} kg"}) for i in range(5)))
    df = readers.read_texts(spark, str(tmp_path / "a.jsonl"), "json", "body")
    assert extract(df, "text", ["id"]).count() == 5
    (tmp_path / "a.txt").write_text("5 kg\n7 miles\n")
    assert extract(readers.read_texts(spark, str(tmp_path / "a.txt"), "text")).count() == 2
    (tmp_path / "a.csv").write_text('id,body\n1,"5 kg, or so"\n')
    assert extract(readers.read_texts(spark, str(tmp_path / "a.csv"), "csv", "body"), "text", ["id"]).count() == 1
    with pytest.raises(ValueError):
        readers.read_texts(spark, "x", "xls")
    (tmp_path / "examples").mkdir()
    (tmp_path / "examples" / "p.json").write_text(json.dumps([{"text": "it costs a pound", "unit": "pound sterling"}, {"text": "x", "unit": "metre"}]))
    examples = readers.read_examples(spark, str(tmp_path / "examples"), ("pound sterling", "pound-mass"))
    assert readers.one_hot(examples, ("pound sterling", "pound-mass")).first().is_pound_sterling == 1 and examples.count() == 1


def test_sink_round_trip(spark, tmp_path):
    q = extract(spark.createDataFrame([(1, "5 kg"), (2, "7 miles")], "id int, text string"), "text", ["id"])
    readers.write_quantities(q, str(tmp_path / "q"), ("unit_norm",))
    assert {r.unit_norm for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {"kilogram", "mile"}


def test_stream_is_the_batch(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"It fell {i} percent") for i in range(20)], "id int, text string")
    texts.write.parquet(str(tmp_path / "in"))
    stream = readers.read_texts(spark, str(tmp_path / "in"), schema="id int, text string", stream=True)
    out = streams.extract_stream(stream, "text", ["id"]).select("id", "change", "value")
    streams.run_once(out, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, extract(texts, "text", ["id"]).select("id", "change", "value").collect()))


def test_reports(spark):
    q = extract(spark.createDataFrame([(i, f"{i % 3} kg") for i in range(9)], "id int, text string"), "text", ["id"])
    assert reports.unit_rollup(q).filter("level = 3").first().n == 9
    assert reports.distinct_values(q).first().n_values == 3
    assert reports.top_units(q).count() == 1


def test_disambiguation_and_units(spark):
    df = spark.createDataFrame([("pound", "a heavy fish"), ("pound", "the price"), ("B", "a loud noise"), ("metre", "x")], "f string, t string")
    got = {(r.f, r.t): r.reading for r in api.disambiguate(df, "f", "t").collect()}
    assert got == {("pound", "a heavy fish"): "pound-mass", ("pound", "the price"): "pound sterling", ("B", "a loud noise"): "bel"}


def test_learned_cues_and_their_sink(spark, tmp_path):
    rows = [(f"{'sugar heap' if i % 2 else 'cheque signed'} number {i}", ("pound-mass", "pound sterling")[i % 2 == 0], "pound") for i in range(40)] + [(None, "pound-mass", "pound"), ("x", None, "pound"), ("", "pound-mass", "B")]
    examples = spark.createDataFrame(rows, "text string, unit string, surface string")
    cues = {(r.reading, r.word) for r in api.learn_cues(examples, 2).collect()}
    assert cues == {("pound-mass", "sugar"), ("pound-mass", "heap"), ("pound sterling", "cheque"), ("pound sterling", "signed")}
    df = spark.createDataFrame([("pound", "a heap"), ("pound", "a cheque"), ("pound", None)], "f string, t string")
    got = {r.t: r.reading for r in api.disambiguate(df, "f", "t", api.learn_cues(examples, 2)).collect()}
    assert got["a heap"] == "pound-mass" and got["a cheque"] == "pound sterling"
    readers.write_examples(examples, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 43 and (tmp_path / "e" / "surface=pound").is_dir()
    assert api.learn_cues(examples.limit(0)).count() == 0
    assert api.session() is not None


def test_every_oracle_has_its_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


AGREE = (
    "sentence_cases", "number_cases", "bound_cases", "token_cases", "text_normalization", "unit_cascade", "unit_words", "ranges_between", "scale_suffix", "ignored_phones", "post_filters", "shared_units_by_clause",
    "quantity_surface_forms", "documents_sequences", "documents_times", "documents_ordinals", "documents_planted_quantities", "token_brackets_joined", "sql_table_function", "dependency_rules", "rules_unregistered", "rules_by_sentence",
    "rule_candidates", "rule_flags", "quantities_of_parses", "session_windows", "training_onehot", "ambiguity_learned",
)


@pytest.mark.parametrize("name", AGREE)
def test_queries_agree_with_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "customer", "documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    plain = lambda rows: sorted(repr(tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r)) for r in rows)
    expected = plain(cur.fetchall())
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == expected
    assert expected
