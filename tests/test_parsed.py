"""Rules as SQL, flags, candidates, shared units and concepts of supplied parses."""

import re

import pytest

from metrolith import rule_examples
from metrolith.operators import parsed, rules


def toks(line):
    out = []
    for i, word in enumerate(line.split("|")):
        text, pos, dep, head = word.rsplit(" ", 3)
        out.append({"i": i, "text": text, "lemma": text, "pos": pos, "dep": dep, "head": int(head)})
    return out


def found(line, *matches):
    """assembled() of matches (family, token indices); earlier families come first."""
    order = {f: k for k, f in enumerate(rules.FAMILIES)}
    return parsed.assembled(toks(line), [{"family": f, "rule": f.lower(), "priority": order[f], "toks": list(t)} for f, t in matches])


def values(qs):
    return [(q["shape"], q["a_words"], q["z_words"], q["own_words"] + ["per"] * bool(q["p_words"]) + q["p_words"]) for q in qs]


def test_every_rule_has_a_smallest_parse():
    for rule in rules.RULES:
        parse = rule_examples.smallest_parse(rule)
        assert [t[0] for t in parse] == list(range(len(rule.nodes)))


def test_rules_match_their_parses_and_no_depth_is_too_deep(spark):
    rows = [(k, *t[:2], t[1], *t[2:]) for k, rule in enumerate(rules.RULES) for t in rule_examples.smallest_parse(rule)]
    deep = [(500, 0, "boxes", "boxes", "NOUN", "ROOT", 0), (500, 1, "5", "5", "NUM", "nummod", 0), *[(500, i, "so", "so", "X", "dep", i - 1) for i in range(2, 60)], (500, 60, "about", "about", "ADV", "advmod", 59)]
    circle = [(501, 0, "5", "5", "NUM", "nummod", 1), (501, 1, "boxes", "boxes", "NOUN", "x", 0), (502, 0, "5", None, None, None, 99), (503, 0, None, None, "NUM", None, None)]
    df = spark.createDataFrame(rows + deep + circle, "doc_id int, i int, text string, lemma string, pos string, dep string, head int")
    got = {(r.doc_id, r.rule, tuple(r.toks)) for r in rules.match_all(df, rules.RULES).collect()}
    assert all(any(d == k and n == rule.name for d, n, _ in got) for k, rule in enumerate(rules.RULES))
    assert (500, "noun_num_quant", (0, 1, 60)) in got and {n for d, n, _ in got if d == 503} >= {"lonely_num"}
    assert rules.match_all(df.limit(0)).count() == 0


def test_quantities_of_sentences_of_a_document(spark):
    rows = []
    for s, name in enumerate(("fell", "money", "phone")):
        rows += [(7, s, 20 * s + i, t.format(a="5", b="120", c="9"), t, p, d, 20 * s + h) for i, t, p, d, h in rule_examples.sentence(name)]
    df = spark.createDataFrame(rows, "doc_id int, sent int, i int, text string, lemma string, pos string, dep string, head int")
    got = sorted((r.sent, r.anchor, r.change, r.lower, r.unit_norm, " ".join(r.concepts)) for r in parsed.parsed_quantities(df).collect())
    assert got == [(0, 5, "down", 5.0, "percentage", "oil price"), (1, 24, "=", 120.0, "dollar", "parking"), (2, 48, "=", 5.0, "cup", "")]
    assert parsed.parsed_quantities(df.limit(0)).count() == 0
    assert parsed.parsed_quantities(df).filter("unit_norm = 'cup' AND change = '='").count() == 1


@pytest.mark.parametrize(
    ("texts", "rule"),
    [
        (["(", "1", ")", "23", "-", "456", "7890"], "phone_number_pattern_1"), (["(", "1)23", "456", "-", "7890"], "phone_number_pattern_2"), (["(", "123", ")", "4567", "8901"], "phone_number_pattern_3"),
        (["(", "123", ")", "456", "-", "789"], "phone_number_pattern_4"), (["+", "49", "(", "1234", ")", "567890"], "phone_number_pattern_5"), (["12345", "ZIP"], "zip_number_pattern"),
    ],
)
def test_phone_and_zip_shapes(texts, rule):
    assert [n for n, p in parsed.SHAPES.items() if re.fullmatch(p, parsed.shape_code(texts))] == [rule]
    line = "|".join(["Call VERB ROOT 0", *[f"{t} NUM dep 0" for t in texts], "now ADV dep 0"])
    s = parsed.Sentence(toks(line))
    assert s.ignored == set(range(1, len(texts) + 1))
    assert found(line, ("LONELY_NUM", [2 if len(texts) > 2 else 1])) == []


def test_dropped_matches():
    wide = "5 NUM nummod 7|" + "|".join(["so X dep 7"] * 6) + "|boxes NOUN ROOT 7"
    assert found(wide, ("NOUN_NUM", [7, 0])) == []
    assert values(found("between" + wide[wide.index(" ") :], ("NOUN_NUM", [7, 0]))) != []
    bracket = "boxes NOUN ROOT 0|( PUNCT punct 2|5 NUM nummod 0|) PUNCT punct 2"
    assert found(bracket, ("NOUN_NUM", [0, 2])) == [] and values(found(bracket, ("LONELY_NUM", [2]))) == [("single", ["5"], [], [])]
    named = "Acme PROPN nsubj 2|500 NUM nummod 0|fell VERB ROOT 2"
    assert found(named, ("LONELY_NUM", [1])) == []
    assert found("on ADP prep 0|2019-09-05 NUM pobj 0", ("LONELY_NUM", [1])) == []


def test_commas_and_brackets():
    s = parsed.Sentence(toks("a X d 0|, PUNCT d 0|b X d 0|, PUNCT d 0|c X d 0|, PUNCT d 0|( PUNCT d 0|d X d 0|( PUNCT d 0|e X d 0|) PUNCT d 0"))
    assert s.commas == {2} and s.bracket == {7, 8, 9}


def test_splits():
    years = "40 NUM nummod 4|, PUNCT d 4|50 NUM nummod 4|60 NUM nummod 4|years NOUN ROOT 4"
    assert values(found(years, ("NOUN_NUM", [4, 0]), ("NOUN_NUM", [4, 2]), ("NOUN_NUM", [4, 3]))) == [("single", [n], [], ["years"]) for n in ("40", "50", "60")]
    case = "2 NUM nummod 5|x SYM punct 5|3 NUM nummod 5|x SYM punct 5|4 NUM nummod 5|cm NOUN ROOT 5"
    assert values(found(case, ("DIM2", [5, 0, 1, 2]), ("NOUN_NUM", [5, 4]))) == [("single", [n], [], ["cm"]) for n in "234"]
    three = "5 NUM nummod 5|to PART d 0|7 NUM nummod 5|to PART d 2|9 NUM nummod 5|kg NOUN ROOT 5"
    got = found(three, ("NUM_TO_NUM", [0, 1, 2]), ("NUM_TO_NUM", [2, 3, 4]), ("NOUN_NUM", [5, 4]))
    assert values(got) == [("range", ["5"], ["7"], ["kg"]), ("range", ["7"], ["9"], ["kg"])]
    four = "5 NUM nummod 7|to PART d 0|7 NUM nummod 7|and CCONJ cc 2|8 NUM nummod 7|to PART d 4|9 NUM nummod 7|kg NOUN ROOT 7"
    got = found(four, ("NUM_TO_NUM", [0, 1, 2]), ("NUM_TO_NUM", [4, 5, 6]), ("NOUN_NUM", [7, 2]), ("NOUN_NUM", [7, 6]))
    assert values(got) == [("range", ["5"], ["7"], ["kg"]), ("range", ["8"], ["9"], ["kg"])]
    spelled = "three NUM compound 1|million NUM nummod 4|five NUM compound 3|hundred NUM nummod 4|people NOUN ROOT 4"
    assert values(found(spelled, ("COMPOUND_NUM", [1, 0]), ("COMPOUND_NUM", [3, 2]), ("NOUN_NUM", [4, 1]), ("NOUN_NUM", [4, 3]))) == [("single", ["three", "million", "five", "hundred"], [], ["people"])]
    before = "2 NUM nummod 3|over ADP quantmod 2|500 NUM nummod 3|men NOUN ROOT 3"
    assert values(found(before, ("NUM_QUANTMOD", [2, 1]), ("NOUN_NUM", [3, 0]), ("NOUN_NUM", [3, 2]))) == [("single", ["500"], [], ["men"])]


def test_fractions_units_and_broad_ranges():
    assert values(found("one NUM nsubj 3|of ADP prep 0|four NUM pobj 1|failed VERB ROOT 3", ("FRAC", [0, 1, 2]))) == [("fraction", ["one"], ["four"], [])]
    dozen = "64 NUM nummod 1|cents NOUN ROOT 1|a DET det 3|dozen NUM npadvmod 1"
    assert values(found(dozen, ("NOUN_NUM", [1, 0]), ("UNIT_FRAC", [1, 2, 3]))) == [("single", ["64"], [], ["cents", "per", "dozen"])]
    tens = "tens NOUN ROOT 0|of ADP quantmod 2|thousands NOUN pobj 0|of ADP prep 2|men NOUN pobj 3"
    assert values(found(tens, ("RANGE_DOUBLE", [0, 1, 2]), ("RANGE_SINGLE", [2, 3, 4]))) == [("broad", ["tens", "thousands"], [], ["men"])]
    assert values(found("one NUM ROOT 0|of ADP prep 0|boxes NOUN pobj 1", ("ONE_OF", [0, 1, 2]))) == [("one_of", ["one"], [], ["boxes"])]
    assert found("one NUM ROOT 0|of ADP prep 0|boxes NOUN pobj 1|5 NUM nummod 2", ("ONE_OF", [0, 1, 2])) == []


def test_shared_units_of_parallel_clauses():
    line = "Sales NOUN nsubj 1|rose VERB ROOT 1|5 NUM nummod 3|percent NOUN dobj 1|while SCONJ mark 6|profits NOUN nsubj 6|fell VERB advcl 1|3 NUM dobj 6"
    assert values(found(line, ("NOUN_NUM", [3, 2]), ("LONELY_NUM", [7]))) == [("single", ["5"], [], ["percent"]), ("single", ["3"], [], ["percent"])]
    other = "Sales NOUN nsubj 1|rose VERB ROOT 1|5 NUM nummod 3|percent NOUN dobj 1|while SCONJ mark 7|in ADP prep 7|all DET det 7|3 NUM ROOT 7|came VERB x 7|by ADV x 7|again ADV x 7|here ADV x 7"
    assert values(found(other, ("NOUN_NUM", [3, 2]), ("LONELY_NUM", [7])))[1] == ("single", ["3"], [], [])


@pytest.mark.parametrize(
    ("line", "matches", "concept"),
    [
        ("an DET det 1|increase NOUN nsubj 5|of ADP prep 1|5 NUM nummod 4|percent NOUN pobj 2|came VERB ROOT 5", [("NOUN_NUM", [4, 3])], ["increase"]),
        ("5 NUM nummod 1|boxes NOUN nsubj 4|of ADP prep 1|tea NOUN pobj 2|came VERB ROOT 4", [("NOUN_NUM", [1, 0])], ["tea"]),
        ("Rain NOUN nsubj 1|fell VERB ROOT 1|with ADP prep 1|5 NUM nummod 4|mm NOUN pobj 2", [("NOUN_NUM", [4, 3])], ["Rain"]),
        ("A DET det 1|river NOUN ROOT 1|that PRON nsubj 3|measures VERB relcl 1|5 NUM nummod 5|miles NOUN dobj 3", [("NOUN_NUM", [5, 4])], ["river"]),
        ("It PRON nsubj 1|gave VERB ROOT 1|old ADJ amod 3|people NOUN dobj 1|5 NUM nummod 5|hours NOUN npadvmod 1", [("NOUN_NUM", [5, 4])], ["old", "people"]),
        ("The DET det 2|big ADJ amod 2|tower NOUN nsubj 3|is AUX ROOT 3|5 NUM nummod 5|feet NOUN attr 3", [("NOUN_NUM", [5, 4])], ["big", "tower"]),
        ("It PRON nsubj 1|is AUX ROOT 1|5 NUM nummod 3|feet NOUN attr 1", [("NOUN_NUM", [3, 2])], []),
    ],
)
def test_concepts(line, matches, concept):
    assert [q["concepts"] for q in found(line, *matches)] == [concept]
