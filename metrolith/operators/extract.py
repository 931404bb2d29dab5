"""Quantities out of text, as one narrow plan: no shuffle, no Python, the same for batches and streams.

A text is normalized, cut into sentences and tokens, and each token gets a class letter (functions.tokens).
The shapes of quantities are regular expressions over a sentence's letters; each match is exploded into
rows, and value, bound, unit and concept are column expressions over the matched token ranges.  Units are
looked up in the catalog's table of forms, a constant of the package and one literal of the plan.

What a row needs for its public columns goes through one explode as a struct; rows that are no quantities
are dropped there.  A condition on a public column can then be pushed down to that explode and no further, so
the expressions before it stand in the plan once; a condition on the ids reaches the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.functions import bounds, ignore, numbers, textnorm, tokens
from metrolith.functions.catalog import AMBIGUOUS, CUES, FORMS, lookup
from metrolith.functions.held import held
from metrolith.functions.lexicon import BROAD, DATE_WORDS, FRACTIONS, MODEL_MARKS, NAME_EXEMPT, NAME_MARKS, NUMBER_WORDS, SCALES, UNIT_BLACKLIST
from metrolith.functions.spans import SPANS, constant_map, let, located, placed
from metrolith.operators.clauses import clauses

_BOUND = "(?:q?b[tqo]?(?:q?b[tqo]?)?q?)?"
_VALUE = "(?:ds*|fis+|f|i?s+|w[ws]*sAw(?![wsd])|w[wsd]*)"
_UNIT = "(?:h?nu|h?Nu|h?u|c|h?[nN])"
_PER = "(?:P(?:nu|u|n|N)|iu)"

#: Every shape is ten consecutive groups, in this order: bound, between/from, currency and sign, first value
#: (or the values that share a unit), its unit, link, second side's currency and sign, second value, unit, per-unit.
ROLES = ("b", "v", "c", "1", "u", "x", "d", "2", "w", "p")
_SIGNED = "c?m?c?"
_MANY = f"(?:(?:k{_VALUE}){{2,}}(?:k?[AR]{_VALUE})?|(?:k{_VALUE})+k?[AR]{_VALUE})"
SHAPES: dict[str, dict[str, str]] = {
    "between": {"b": _BOUND, "v": "v", "c": _SIGNED, "1": _VALUE, "u": _UNIT + "?", "x": "[thA]", "d": _SIGNED, "2": _VALUE, "w": _UNIT + "?", "p": _PER + "?"},
    "fraction": {"b": _BOUND, "1": _VALUE, "x": "O?o", "2": _VALUE, "w": _UNIT + "?"},
    "one_of": {"1": "w", "x": "o[lv]{0,2}", "w": "[nNu]"},
    "broad": {"1": "S(?:oS)*", "x": "o", "w": _UNIT},
    "dimension": {"b": _BOUND, "1": f"{_VALUE}(?:x{_VALUE})+", "u": _UNIT + "?", "p": _PER + "?"},
    "list": {"c": "c?", "1": _VALUE + _MANY, "u": _UNIT, "p": _PER + "?"},
    "shared": {"c": "c?", "1": f"{_VALUE}[RA]c?{_VALUE}", "u": _UNIT + "?", "p": _PER + "?"},
    "range": {"b": _BOUND, "c": _SIGNED, "1": _VALUE, "x": "[th]", "d": _SIGNED, "2": _VALUE, "w": _UNIT + "?", "p": _PER + "?"},
    "single": {"b": _BOUND, "c": _SIGNED, "1": _VALUE, "u": _UNIT + "?", "p": _PER + "?"},
}
_PATTERN = {name: "^" + "".join(f"({groups.get(r, '')})" for r in ROLES) + "$" for name, groups in SHAPES.items()}
_MULTIPLE = ("dimension", "list", "shared")
CHUNK = "(?=[bqvcmdfiwsS])(?:" + "|".join("(?:" + "".join(f"(?:{groups[r]})" for r in ROLES if r in groups) + ")" for groups in SHAPES.values()) + ")"


def _tree(words: Sequence[str]) -> str:
    """A pattern for any of the words that reads a common beginning once."""
    rest: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    out = "|".join(re.escape(c) + _tree(ends) for c, ends in rest.items())
    return f"(?:{out})" + ("?" if "" in words else "") if out else ""


_PLAIN_WORDS = [w for w in [*NUMBER_WORDS, *SCALES, *BROAD, *FRACTIONS] if "-" not in w]


def may_hold_numbers(text: Column) -> Column:
    """A cheap test on the scan: a digit, or a number or scale word."""
    return text.rlike("[0-9]") | text.rlike(r"(?i:\b" + _tree(_PLAIN_WORDS) + r"\b)")


def _may_hold_values(sentence: Column) -> Column:
    """The same of a sentence, as tokens are cut: every value has a digit or a listed word."""
    return sentence.rlike("[0-9]") | sentence.rlike(r"(?iu:(?<!\p{L})" + _tree([*NUMBER_WORDS, *SCALES, *BROAD, *FRACTIONS]) + r"(?!\p{L}))")


def _shape(code: Column) -> Column:
    """The first shape that fits a chunk."""
    out = F.lit("single")
    for name in reversed(SHAPES):
        out = F.when(code.rlike(_PATTERN[name]), name).otherwise(out)
    return out


def _lengths(shape: Column, code: Column) -> Column:
    """Tokens in each role's group: one replacement lists the groups, with a sign that no code has between."""
    out = F.lit("")
    for name in SHAPES:
        out = F.when(shape == name, F.regexp_replace(code, _PATTERN[name], ",".join(f"${i}" for i in range(1, len(ROLES) + 1)))).otherwise(out)
    return F.transform(F.split(out, ",", -1), F.length)


def _texts(toks: Column, at: Column, n: Column) -> Column:
    return F.when((n > 0) & (at >= 0), F.transform(F.slice(toks, F.greatest(at, F.lit(0)) + 1, F.greatest(n, F.lit(0))), lambda t: t["text"])).otherwise(F.array().cast("array<string>"))


def _text(toks: Column, at: Column) -> Column:
    return F.when(at >= 0, F.get(toks, at)["text"])


def _sentences(text: Column) -> Column:
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"))).cast(SPANS)
    return F.when(text.rlike(r"[.!?] +\p{Lu}"), located(text, r"(?s).+?(?:[.!?](?= +\p{Lu})|$)")).otherwise(whole)


def tokenized(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ()) -> DataFrame:
    """(ids.., sent_no, base, toks, code): a row per sentence that may hold numbers; toks are
    (start, end, text) in the sentence, base is the sentence's place in the normalized text."""
    ids = [F.col(f"`{c}`") for c in id_cols]
    out = df.select(*ids, F.col(f"`{text_col}`").alias("_text")).filter(held("may", lambda: may_hold_numbers(F.col("_text"))))
    out = out.select(*ids, held("norm", lambda: textnorm.normalize(F.col("_text")).alias("_norm")))
    out = out.select(*ids, held("sentences", lambda: F.posexplode_outer(_sentences(F.col("_norm"))).alias("sent_no", "_sent")))
    out = out.filter(held("sentence may", lambda: _may_hold_values(F.col("_sent.text"))))
    out = out.select(*ids, "sent_no", *held("toks", lambda: [F.col("_sent.start").alias("base"), tokens.tokens(ignore.mask(F.col("_sent.text"))).alias("toks")]))
    return out.select(*ids, "sent_no", "base", "toks", held("code", lambda: tokens.classes(F.col("toks")).alias("code")))


def chunked(sentences: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """A row for each value of each chunk: its shape, the chunk's token range [from, to), where each role's
    tokens stand (at_<role>, n_<role>) and where the value's own do (a_at, a_n); `plain` is the sentence's code
    without any chunk's tokens."""
    kept = [*[f"`{c}`" for c in id_cols], "sent_no", "base", "toks", "code", "plain"]
    out = sentences.select(*kept[:-1], *held("hits", lambda: [F.regexp_extract_all("code", F.lit(CHUNK), F.lit(0)).alias("hits"), F.split("code", CHUNK, -1).alias("gaps")]))

    def spans() -> list[Column]:
        plain = F.array_join(F.zip_with("gaps", "hits", lambda gap, hit: F.concat(gap, F.repeat(F.lit("z"), F.coalesce(F.length(hit), F.lit(0))))), "")
        return [placed(F.col("hits"), F.col("gaps")).alias("spans"), plain.alias("plain")]

    def roles() -> list[Column]:
        sums = F.transform("n", lambda _, i: F.col("from") + F.aggregate(F.slice("n", F.lit(1), i), F.lit(0), lambda a, b: a + b))
        return [F.col("n"), sums.alias("at")]

    def places() -> list[Column]:
        return [F.get("n", F.lit(i)).alias(f"n_{r}") for i, r in enumerate(ROLES)] + [F.get("at", F.lit(i)).alias(f"at_{r}") for i, r in enumerate(ROLES)]

    def values() -> Column:
        group = F.substr("code", F.col("at_1") + 1, F.col("n_1"))
        alone = F.array(F.struct(F.lit(0).alias("start"), F.col("n_1").alias("end"), F.lit("").alias("text"))).cast(SPANS)
        return F.explode_outer(F.when(F.col("shape").isin(*_MULTIPLE), located(group, _VALUE)).otherwise(alone)).alias("value")

    out = out.select(*kept[:-1], *held("spans", spans))
    out = out.select(*kept, held("chunks", lambda: F.explode_outer("spans").alias("c")))
    out = out.select(*kept, *held("shape", lambda: [F.col("c.start").alias("from"), F.col("c.end").alias("to"), F.col("c.text").alias("chunk"), _shape(F.col("c.text")).alias("shape")]))
    out = out.select(*kept, "from", "to", "chunk", "shape", held("lengths", lambda: _lengths(F.col("shape"), F.col("chunk")).alias("n")))
    out = out.select(*kept, "from", "to", "chunk", "shape", *held("roles", roles))
    out = out.select(*kept, "from", "to", "chunk", "shape", *held("places", places))
    out = out.select("*", held("values", values))
    return out.select("*", *held("own", lambda: [(F.col("at_1") + F.col("value.start")).alias("a_at"), (F.col("value.end") - F.col("value.start")).alias("a_n")])).drop("value")


def _sides(shape: Column) -> tuple[Column, Column]:
    """(lower, upper) of a part before signs and `m`, from the columns one, two, a_words and z_words."""
    a, z = F.col("one.lower"), F.col("two.lower")
    # A scale after the second side belongs to the first too if the sides are then close.
    factor, own = F.col("z_scale"), F.col("a_scale").isNotNull()
    low = F.when(factor.isNotNull() & ~own & (F.size("z_words") > 1) & (F.abs(z / factor - a) <= 1000), a * factor).otherwise(a)
    two_sided = shape.isin("between", "range")
    ratio = F.coalesce(F.try_divide(a, z), F.when(z.isNull(), a), F.when(a.isNull(), z))
    lower = F.when(two_sided, F.coalesce(low, z)).when(shape == "fraction", ratio).when(shape == "broad", F.col("broad")).otherwise(a)
    upper = F.when(two_sided, F.coalesce(z, low)).when(shape == "broad", F.col("broad") * 10).when(shape == "fraction", ratio).otherwise(F.col("one.upper"))
    return lower, upper


#: Ambiguous form to its readings, the norms it may arrive with, and the readings' cue words.
_READINGS = {f: {"a": us[0], "b": us[1], "norms": sorted({*us, *([FORMS[f][0]] if f in FORMS else [])}), "ca": list(CUES.get(us[0], ())), "cb": list(CUES.get(us[1], ()))} for f, us in AMBIGUOUS.items()}


def _reading(form: Column, norm: Column, words: Column) -> Column:
    """Of an ambiguous form the reading with more cue words in the sentence; the first on a tie."""
    known = constant_map(_READINGS, "struct<a:string,b:string,norms:array<string>,ca:array<string>,cb:array<string>>")

    def chosen(r: Column) -> Column:
        second = F.size(F.array_intersect(words, r["cb"])) > F.size(F.array_intersect(words, r["ca"]))
        return F.when(r.isNotNull() & F.array_contains(r["norms"], norm), F.when(second, r["b"]).otherwise(r["a"])).otherwise(norm)

    return let(F.try_element_at(known, form), chosen)


def resolved(forms: Sequence[Column], words: Column) -> Column:
    """struct(n norm, k key) of the first of the forms that the catalog knows, read in the words' context."""

    def one(form: Column) -> Column:
        return let(form, lambda f: let(lookup(f), lambda hit: F.when(hit.isNotNull(), F.struct(_reading(f, hit["n"], words).alias("n"), hit["k"].alias("k")))))

    return F.coalesce(*[one(f) for f in forms])


def _concepts(toks: Column, code: Column, plain: Column, start: Column, end: Column, b_at: Column, b_n: Column) -> Column:
    """What the number refers to: `increase of 5`; nouns after for/of/off; else the last nouns before it, or
    before its bracket."""
    before, after = F.substr(plain, F.lit(1), start), F.substr(code, end + 1, F.length(code))
    nouns = lambda at, n: F.filter(_texts(toks, at, n), lambda w: ~tokens.is_stop(w))
    bound = F.substr(code, b_at + 1, b_n)
    of_bound = F.when((b_n > 0) & bound.endswith("o"), F.filter(_texts(toks, b_at, b_n), lambda w: tokens.klass(w) == "b"))
    of_noun = F.regexp_extract(before, r"([nNu]+)o$", 1)
    lead, later = F.regexp_extract(after, r"^[^nNuk.]{0,1}[go][il]*", 0), F.regexp_extract(after, r"^[^nNuk.]{0,1}[go][il]*([nNu]+)", 1)
    left = F.regexp_replace(before, r"\([^)]*$", "")
    run, tail = F.regexp_extract(left, r"([nNu]+)[^nNu.;]*$", 1), F.regexp_extract(left, r"[nNu]+([^nNu.;]*)$", 1)
    return F.coalesce(
        of_bound,
        F.when(of_noun != "", nouns(start - 1 - F.length(of_noun), F.length(of_noun))),
        F.when(later != "", nouns(end + F.length(lead), F.length(later))),
        F.when(run != "", nouns(F.length(left) - F.length(tail) - F.length(run), F.length(run))),
        F.array().cast("array<string>"),
    )


def _roles() -> list[Column]:
    """The words of each role of a value, and what stands before and behind its chunk."""
    toks, code, shape = F.col("toks"), F.col("code"), F.col("shape")
    low = lambda a: F.transform(a, F.lower)
    unit_at, unit_n = F.when(F.col("n_w") > 0, F.col("at_w")).otherwise(F.col("at_u")), F.when(F.col("n_w") > 0, F.col("n_w")).otherwise(F.col("n_u"))
    signs = F.substr(code, F.col("at_c") + 1, F.col("n_c"))
    other = F.substr(code, F.col("at_d") + 1, F.col("n_d"))
    inner = F.when(shape == "shared", F.instr(F.substr(code, F.col("at_1") + 1, F.col("n_1")), "c")).otherwise(0)
    c_at = F.when(F.instr(signs, "c") > 0, F.col("at_c") + F.instr(signs, "c") - 1).when(F.instr(other, "c") > 0, F.col("at_d") + F.instr(other, "c") - 1).when(inner > 0, F.col("at_1") + inner - 1).otherwise(-1)
    return [
        *[F.col(c) for c in _CARRIED],
        unit_at.alias("at_u"),
        unit_n.alias("n_u"),
        c_at.alias("at_c"),
        signs.contains("m").alias("minus"),
        F.transform(toks, lambda t: F.lower(t["text"])).alias("words"),
        low(_texts(toks, F.col("a_at"), F.col("a_n"))).alias("a_words"),
        low(_texts(toks, F.col("at_2"), F.col("n_2"))).alias("z_words"),
        bounds.change(_texts(toks, F.col("at_b"), F.col("n_b"))).alias("change"),
        F.filter(_texts(toks, unit_at, unit_n), lambda w: ~w.isin("-", "–")).alias("own_words"),
        F.filter(_texts(toks, F.col("at_p") + 1, F.col("n_p") - 1), lambda w: w != "-").alias("p_words"),
        _text(toks, c_at).alias("c_word"),
        _text(toks, F.col("from") - 1).alias("previous"),
        F.when(F.col("from") > 0, F.substr(code, F.col("from"), F.lit(1))).alias("previous_class"),
        _text(toks, F.col("to")).alias("next"),
        F.substr(code, F.col("to") + 1, F.lit(1)).alias("next_class"),
    ]


def _numbers() -> list[Column]:
    scales = constant_map(BROAD, "double")
    broad = F.aggregate(F.filter("a_words", lambda w: w != "of"), F.lit(1.0), lambda acc, w: acc * F.coalesce(F.try_element_at(scales, w), F.lit(1.0)))
    tail = lambda c: F.get(c, F.size(c) - 1)
    return [numbers.number(F.col("a_words")).alias("one"), numbers.number(F.col("z_words")).alias("two"), numbers.scale(tail(F.col("a_words"))).alias("a_scale"), numbers.scale(tail(F.col("z_words"))).alias("z_scale"), broad.alias("broad")]


def _ends() -> list[Column]:
    lower, upper = _sides(F.col("shape"))
    # `12 m users`: m is million and the next noun the unit.
    is_m = (F.get("own_words", F.lit(0)) == "m") & (F.size("own_words") == 1) & F.col("next_class").isin("n", "N") & F.col("c_word").isNull()
    return [lower.alias("low"), upper.alias("high"), F.coalesce(is_m, F.lit(False)).alias("may_m")]


def _signed() -> list[Column]:
    million = F.when(F.col("is_m"), 1e6).otherwise(1.0)
    return [
        (F.col("low") * million * F.when(F.col("minus"), -1.0).otherwise(1.0)).alias("lower"),
        (F.col("high") * million * F.when(F.col("minus") & ~F.col("shape").isin("between", "range"), -1.0).otherwise(1.0)).alias("upper"),
        F.when(F.col("is_m"), F.array("next")).otherwise(once(F.col("own_words"))).alias("u_words"),
    ]


def _unit_texts() -> list[Column]:
    """The two sides of a unit as texts: the currency before the number, else the words after it; `a/b` and
    `a per b` have a right side."""
    last, slash = F.col("u_last"), F.col("slash")
    whole = F.when(F.size("u_words") > 0, F.array_join("u_words", " "))
    return [
        F.when(F.col("c_word").isNotNull(), F.replace("c_word", F.lit(" "), F.lit(""))).when(slash, F.split_part(last, F.lit("/"), F.lit(1))).otherwise(whole).alias("left_text"),
        F.when(F.col("c_word").isNull() & ~slash, last).alias("left_last"),
        F.when(slash, F.split_part(last, F.lit("/"), F.lit(2))).when(F.size("p_words") > 0, F.array_join("p_words", " ")).alias("right_text"),
        F.get("p_words", F.size("p_words") - 1).alias("right_last"),
    ]


def any_known(unit: Column) -> Column:
    """Of a unit's words the first two as one (`US $`), else the first that the catalog knows, as it is or
    singular; null if there is none."""
    first_two = F.when(F.size(unit) > 2, F.concat(F.get(unit, F.lit(0)), F.get(unit, F.lit(1))))
    tried = F.filter(F.concat(F.array(first_two), unit, F.transform(unit, tokens.singular)), lambda w: w.isNotNull())
    return F.get(F.filter(tried, lambda w: lookup(w).isNotNull()), F.lit(0))


def once(unit: Column) -> Column:
    """A unit's words without the last if that is the first again (`dollars 5 dollars` around a number)."""
    return F.when((F.size(unit) > 1) & (F.get(unit, F.lit(0)) == F.get(unit, F.size(unit) - 1)), F.slice(unit, F.lit(1), F.size(unit) - 1)).otherwise(unit)


def _units() -> list[Column]:
    wide = F.when((F.size("u_words") > 1) & F.col("c_word").isNull() & ~F.col("slash"), any_known(F.col("u_words")))
    return [
        resolved([F.col("left_text"), F.lower("left_text"), F.col("left_last"), tokens.singular(F.col("left_last")), wide], F.col("words")).alias("left"),
        resolved([F.col("right_text"), tokens.singular(F.col("right_text")), tokens.singular(F.col("right_last"))], F.col("words")).alias("right"),
    ]


def _norms() -> list[Column]:
    noun = F.when(F.col("left_text").isNotNull(), F.array_join(F.transform(F.split("left_text", " "), tokens.singular), " "))
    right_norm = F.coalesce("right_norm", tokens.singular(F.col("right_text")))
    scientific = F.col("left_norm").isNotNull() | (F.col("slash") & F.col("left_text").isNotNull())
    base_norm = F.coalesce("left_norm", noun)
    norm = F.when(base_norm.isNotNull() & right_norm.isNotNull(), F.concat_ws(" per ", base_norm, right_norm)).otherwise(base_norm)
    black = F.coalesce(F.exists("u_words", lambda w: w.isin(*UNIT_BLACKLIST)), F.lit(False)) & F.col("left_norm").isNull()
    unit = F.when(black, F.lit("-")).otherwise(F.coalesce(norm, F.lit("-")))
    unit = F.when((F.col("shape") == "fraction") & ~F.coalesce(F.col("left_norm").isNotNull(), F.lit(False)), F.concat(F.lit("% "), unit)).otherwise(unit)
    return [unit.alias("unit_norm"), (F.coalesce(scientific, F.lit(False)) & ~black).alias("unit_scientific")]


def _kept() -> Column:
    """The rest of the row, in one struct of an array, for those rows that are quantities."""
    # Names with numbers (`phone 11 is`), models (`11 Pro`), codes for units.
    bare = (F.col("unit_norm") == "-") & (F.col("change") == "=") & (F.col("shape") == "single")
    named = bare & F.coalesce(F.col("previous_class").isin("n", "N"), F.lit(False)) & ~F.lower("previous").isin(*NAME_EXEMPT) & ~F.col("previous").rlike("ed$") & ~F.col("minus")
    marked = F.coalesce(F.col("previous").isin(*NAME_MARKS), F.lit(False)) | F.coalesce(F.col("next").isin(*MODEL_MARKS), F.lit(False)) | F.exists("u_words", lambda w: w.isin(*MODEL_MARKS))
    coded = ~F.col("unit_scientific") & F.col("unit_norm").rlike("[0-9]") & (F.col("shape") != "one_of")
    # `the battery 2024 ..  2024 battery`: the unit stands before the same number elsewhere, as a name does.
    own = F.concat_ws(" ", F.lit(""), "u_words", "a_words", F.lit(""))
    echoed = ~F.col("unit_scientific") & (F.col("shape") == "single") & (F.size("u_words") > 0) & F.contains(F.concat_ws(" ", F.lit(""), "words", F.lit("")), F.lower(own))
    # Parts of dates (`the 2019 season`) and street numbers (`5 Old Oak Road`) count only with a unit of the catalog.
    year = (F.size("a_words") == 1) & F.get("a_words", F.lit(0)).rlike("^(?:19|20)[0-9]{2}$") & F.lower("previous").isin(*DATE_WORDS)
    road = F.substr("code", F.col("at_u") + 1, F.lit(3)).rlike("^(?:NN[nN]|N[nN]N|[nN]NN)") & F.col("c_word").isNull()
    street = road & F.forall(F.slice("toks", F.greatest(F.col("at_u"), F.lit(0)) + 1, F.lit(3)), lambda t: F.length(t["text"]) > 2)
    considered = ~F.col("unit_scientific") & (F.col("shape") == "single") & (F.col("n_u") > 0) & (F.coalesce(year, F.lit(False)) | F.coalesce(street, F.lit(False)))
    kept = F.col("lower").isNotNull() & ~(F.coalesce(named, F.lit(False)) | marked | coded | F.coalesce(echoed, F.lit(False)) | considered)
    return F.explode_outer(F.when(kept, F.array(F.struct(*_LAST)))).alias("_q")


def _clause() -> tuple[Column, Column, Column]:
    """Number of the clause in which a value ends, its class letters, and the tokens behind the value in it."""
    at = F.col("_q.a_at") + F.col("_q.a_n") - 1
    parts = clauses(F.col("_q.code"))
    number = let(parts, lambda ps: F.size(F.filter(ps, lambda p: p["hi"] < at)))
    own = let(parts, lambda ps: F.get(F.filter(ps, lambda p: p["hi"] >= at), F.lit(0)))
    return number, let(own, lambda p: F.substr(F.col("_q.code"), p["lo"] + 1, p["hi"] - p["lo"] + 1)), own["hi"] - at


def _public() -> list[Column]:
    q = {c: F.col("_q")[c] for c in _LAST}
    toks, code, shape, base = q["toks"], q["code"], q["shape"], q["base"]
    none = F.array().cast("array<string>")
    span = lambda at, n: F.when((at >= 0) & (n > 0), F.struct((base + F.get(toks, at)["start"]).alias("start"), (base + F.get(toks, at + n - 1)["end"]).alias("end")))
    spans = lambda *s: F.filter(F.array(*s), lambda x: x.isNotNull())
    before = F.substr(code, F.lit(1), q["from"])
    opened = F.length(F.regexp_replace(before, r"[^(]", "")) > F.length(F.regexp_replace(before, r"[^)]", ""))
    ranged = q["lower"] != q["upper"]
    keys = F.filter(F.array(q["left_key"], q["right_key"]), lambda k: k.isNotNull())
    own = F.when(q["c_word"].isNotNull(), F.array(q["c_word"])).otherwise(q["u_words"])
    per = F.when(F.size(q["p_words"]) > 0, F.concat(F.array(_text(toks, q["at_p"])), q["p_words"])).otherwise(none)
    concepts = F.when(shape == "one_of", none).otherwise(_concepts(toks, code, q["plain"], q["from"], q["to"], q["at_b"], q["n_b"]))
    return [
        F.col("sent_no"),
        (base + F.get(toks, q["a_at"])["start"]).alias("ord"),
        q["change"].alias("change"),
        F.when(ranged | shape.isin("between", "range", "broad"), "range").otherwise("value").alias("kind"),
        F.when(~ranged, q["lower"]).alias("value"),
        q["lower"].alias("lower"),
        q["upper"].alias("upper"),
        F.filter(F.flatten(F.array(own, per)), lambda w: w.isNotNull()).alias("unit_surface"),
        q["unit_norm"].alias("unit_norm"),
        q["unit_scientific"].alias("unit_scientific"),
        keys.alias("unit_keys"),
        concepts.alias("concepts"),
        opened.alias("in_bracket"),
        spans(span(q["a_at"], q["a_n"]), span(q["at_2"], q["n_2"])).alias("value_spans"),
        spans(span(q["at_c"], F.lit(1)), F.when(q["c_word"].isNull() & ~q["is_m"], span(q["at_u"], q["n_u"])), span(q["at_p"], q["n_p"])).alias("unit_spans"),
        F.when(~ranged, numbers.notation(q["lower"])).otherwise(F.concat_ws("-", numbers.notation(q["lower"]), numbers.notation(q["upper"]))).alias("sci"),
        F.when(~ranged, numbers.short_notation(q["lower"])).otherwise(F.concat_ws("-", numbers.short_notation(q["lower"]), numbers.short_notation(q["upper"]))).alias("sci_short"),
        (shape == "one_of").alias("one_of"),
        *[c.alias(name) for c, name in zip(_clause(), ("clause", "clause_code", "clause_rest"), strict=True)],
    ]


_CARRIED = ("sent_no", "base", "toks", "code", "plain", "from", "to", "shape", "a_at", "a_n", "at_2", "n_2", "at_b", "n_b", "at_p", "n_p")
#: What the public columns are made of.
_LAST = (*_CARRIED[1:], "at_u", "n_u", "at_c", "c_word", "u_words", "p_words", "is_m", "change", "lower", "upper", "unit_norm", "unit_scientific", "left_key", "right_key")


def normalized(rows: DataFrame) -> DataFrame:
    """Adds the unit of rows with u_words, p_words, c_word, words and shape."""
    rows = rows.select("*", held("x last", lambda: F.get("u_words", F.size("u_words") - 1).alias("u_last")))
    rows = rows.select("*", held("x slash", lambda: F.coalesce(F.col("u_last").contains("/") & F.col("c_word").isNull(), F.lit(False)).alias("slash")))
    rows = rows.select("*", *held("x texts", _unit_texts))
    rows = rows.select("*", *held("x units", _units))
    rows = rows.select("*", *held("x sides", lambda: [F.col(f"{side}.{f}").alias(f"{side}_{name}") for side in ("left", "right") for f, name in (("n", "norm"), ("k", "key"))]))
    return rows.select("*", *held("x norms", _norms))


def extract(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ()) -> DataFrame:
    """A row for each quantity of each text.

    ids.., sent_no, ord (place of the number in the normalized text), change, kind (value or range), value,
    lower, upper, unit_surface, unit_norm (`-` for none), unit_scientific, unit_keys, concepts, in_bracket,
    value_spans, unit_spans (places in the normalized text), sci, sci_short, one_of, clause, clause_code and
    clause_rest (the clause the value stands in: its number, its tokens' classes, how many are behind the value).
    Texts that are null, empty or without numbers give no rows.
    """
    own = [f"_id{i}" for i in range(len(id_cols))]
    texts = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(id_cols, own, strict=True)], F.col(f"`{text_col}`").alias("_text"))
    rows = chunked(tokenized(texts, "_text", own), own).select(*own, *held("x roles", _roles))
    rows = rows.select("*", *held("x numbers", _numbers))
    rows = rows.select("*", *held("x ends", _ends))
    rows = rows.select("*", held("x is_m", lambda: F.coalesce(F.col("may_m") & (F.col("high") - F.col("low") <= 100), F.lit(False)).alias("is_m")))
    rows = rows.select("*", *held("x signed", _signed))
    rows = normalized(rows)
    rows = rows.select(*own, "sent_no", held("x kept", _kept)).filter("_q is not null")
    rows = rows.select(*own, *held("x public", _public))
    return rows.select(*[F.col(i).alias(c) for c, i in zip(id_cols, own, strict=True)], *rows.columns[len(own) :])
