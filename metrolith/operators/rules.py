"""Dependency rules over supplied parses: each rule is a small tree pattern over the tokens of a text.

Input is a token table (doc_id, i, text, lemma, pos, dep, head); i counts a document's tokens from 0 and head
is the index of a token's governor (its own for a root).  A table with a column `sent` is matched sentence by
sentence; heads then stay within their sentence.  A rule names its tokens, constrains their attributes, and
relates each to an earlier one.  Relations: `>` the new token is governed by the earlier, `<` it governs it,
`>>` and `<<` the same over any number of heads, `.` it stands directly behind, `;` directly before, `$+` it is
the next sibling to the right.

Tokens are gathered once into a row for each sentence (or document), one exchange; all rules are then
self-joins of that array within the row, so the number of rules adds no shuffle.  The expressions are built
once for each JVM.

Matches are rows (doc_id, sent, family, rule, priority, toks); earlier families take precedence.  A document
without tokens, or with none that fit, gives no rows; heads outside the sentence govern nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.functions.held import held
from metrolith.functions.lexicon import BROAD, FRACTIONS, NUMBER_WORDS, SCALES, pattern
from metrolith.functions.spans import let

# The rules. Family, then: token, relation to an earlier token, that token, [attributes].
# Attributes: p= part of speech, d= dependency, t= text (!= negates), digit, notdigit, scale, notscale, number.
_NOUN, _MOD, _ADV = "p=PROPN,NOUN", "d=quantmod,amod,compound,nummod,nmod,advmod,npadvmod", "p=ADJ,SCONJ,ADV,PART,ADP,DET"
RULE_TEXT = f"""
NUM_TO_NUM num_to_num: a[p=NUM] | b . a[d=quantmod,prep;p=PART,ADP;t=to] | c . b[p=NUM]
NUM_TO_NUM num_to_num_2: a[p=NUM;digit] | b . a[d=quantmod,prep;p=PART,ADP;t=to] | c > b[p=NUM]
NUM_TO_NUM num_to_num_3: a[p=NUM;digit] | s < a[p=NUM;scale] | b . s[d=quantmod,prep;p=PART;t=to] | z < b[p=NUM;scale] | c > z[p=NUM;digit]
NUM_TO_NUM num_to_num_4: a[p=NUM;scale] | b > a[p=NUM;digit] | c > a[p=NUM;digit] | s > a[p=NUM;scale] | t . s[d=quantmod,prep;p=PART;t=to]
NUM_TO_NUM num_to_num_5: a[p=NUM] | b > a[d=quantmod,prep;p=PART,ADP;t=to] | c > a[p=NUM]
NUM_TO_NUM num_to_num_dig: a[p=NUM;digit] | b . a[t=-] | c . b[p=NUM;digit]
ADP_NUM_CCONJ_NUM adp_num_cconj_num: a[t=between,from] | b > a[p=NUM] | c > b[t=and,to] | d > b[p=NUM]
ADP_NUM_CCONJ_NUM adp_num_cconj_num_2: a[t=from] | n > a[p=NOUN,SYM] | b > n[p=NUM] | q > a[t=to] | m > q[d=pobj] | c > m[p=NUM]
ADP_NUM_CCONJ_NUM adp_num_cconj_num_3: m[p=NOUN] | b > m[p=NUM] | n < m[p=NOUN] | q > n[t=and] | a < n[p=NUM] | v > a[t=between]
ADP_NUM_CCONJ_NUM_WITH_UNIT adp_num_cconj_num_with_unit: a[p=NUM;t!=thousand,million,billion,trillion] | b > a[p=NUM] | v > a[t=between] | q > a[t=and]
ADP_NUM_CCONJ_NUM_WITH_UNIT adp_num_cconj_num_with_unit_2: a[p=NUM] | v > a[t=between] | n < a[p=PROPN,NOUN,SYM] | q > n[t=and] | m > n[p=PROPN,NOUN,SYM]
ADP_NUM_CCONJ_NUM_WITH_UNIT adp_num_cconj_num_with_unit_3: b[p=NUM;number] | a < b[p=NUM;number] | v < a[t=from] | q > a[t=to]
ADP_NUM_CCONJ_NUM_WITH_UNIT adp_num_cconj_num_with_unit_4: v[t=between] | a > v[p=NUM;number] | n > v[p=PROPN,NOUN,SYM] | q > n[t=and] | b . q[p=NUM;number]
ADP_NUM_CCONJ_NUM_WITH_UNIT adp_num_cconj_num_with_unit_5: a[p=NUM;scale] | b > a[p=NUM;digit] | v > a[t=between] | q > a[t=and] | s > a[p=NUM;scale] | c > s[p=NUM;digit]
ADP_NUM_CCONJ_NUM_WITH_UNIT adp_num_cconj_num_with_unit_6: v[t=between] | a < v[p=NUM] | q > a[t=and] | n > a[p=SYM,NOUN] | b > n[p=NUM]
RANGE_SINGLE range_single: a[p=NOUN;number] | o > a[d=prep;t=of] | n > o[d=pobj;p=NOUN,PROPN]
RANGE_DOUBLE range_double: a[p=NOUN;number] | o > a[d=prep;t=of] | n > o[d=pobj;p=NOUN;number] | q > a[d=quantmod;t=of] | b > a[d=quantmod;p=NOUN]
FRAC frac: a[p=NUM] | o . a[d=quantmod,prep;t=of] | b . o[d=pobj,appos,nummod;p=NUM]
FRAC frac_2: a[p=NUM] | x . a[t=out] | o . x[t=of] | b . o[p=NUM]
COMPOUND_NUM compound_num: a[p=NUM;notdigit] | b > a[p=NUM;d=nummod,compound,quantmod;notdigit]
COMPOUND_NUM compound_num_2: a[p=NUM;notdigit] | b > a[p=NUM;d=nummod,compound,quantmod;notdigit] | c > b[p=NUM;d=nummod,compound,quantmod;notdigit]
NUM_NUM num_num: a[p=NUM;scale] | b > a[d=compound,nummod;p=NUM]
NUM_SYMBOL num_symbol: a[p=NUM] | s > a[d=quantmod,nmod;p=SYM;t!=#]
SYMBOL_NUM symbol_num: s[p=SYM] | a ; s[p=NUM]
NOUN_NUM noun_num: n[p=PROPN,NOUN,INTJ,ADJ;t!=#,ers] | a > n[d=quantmod,nmod,nummod,compound,amod,nsubj;p=NUM]
NUM_QUANTMOD num_quantmod: a[p=NUM] | q > a[{_MOD};{_ADV}]
NUM_QUANTMOD num_quantmod_chain: a[p=NUM] | q > a[{_MOD};{_ADV}] | r > q[{_MOD};{_ADV}]
NUM_DIRECT_PROPN num_direct_propn: a[d=quantmod,nmod,nummod;p=NUM] | n . a[p=PROPN]
MINUS_NUM minus_num: a[p=NUM] | m < a[t=minus]
MINUS_NUM minus_num_2: n[p=NOUN] | m > n[t=minus] | a > n[p=NUM]
QUANTMOD_DIRECT_NUM quantmod_direct_num: a[p=NUM] | q ; a[d=advcl,advmod,amod,conj,acl,prep,prt,ROOT,pcomp,ccomp,xcomp;p=VERB,ADV,ADP]
VERB_QUANTMOD_NUM verb_quantmod_num: a[p=NUM] | q ; a[t=by] | v < q[p=VERB]
VERB_QUANTMOD2_NUM verb_quantmod2_num: a[p=NUM] | q ; a[t=by] | v < q[p=VERB] | w > v[d=advmod;p=ADV]
NUM_DIRECT_NOUN num_direct_noun: a[d=quantmod,nmod,nummod;p=NUM] | n . a[d=compound;p=NOUN]
NOUN_NUM_ADP_RIGHT_NOUN noun_num_adp_right_noun: n[{_NOUN}] | a > n[d=nummod;p=NUM] | o > n[d=prep,appos;p=ADP;t=of,per] | r > o[d=pobj,appos;p=PROPN,NOUN,ADJ]
NOUN_NUM_QUANT noun_num_quant: n[{_NOUN}] | a > n[d=quantmod,amod,compound,nummod,nmod,advmod,npadvmod,dobj;p=NUM] | v >> a[{_MOD};p!=NUM]
NOUN_NUM_QUANT noun_num_quant_2: n[{_NOUN}] | a > n[{_MOD};p=NUM] | j << n[d=acomp,amod,punct;p=ADJ]
NOUN_NUM_QUANT noun_num_quant_3: a[{_MOD},pobj;p=NUM] | j << a[d=acomp,amod;p=ADJ;t=higher,lower]
NOUN_NUM_QUANT noun_num_quant_4: a[{_MOD},pobj;p=NUM] | s ; a[d=punct,attr;p=PUNCT,X,SYM;t=~,=,<,>,≈]
NOUN_COMPOUND_NUM noun_compound_num: n[{_NOUN}] | c > n[d=compound;p=ADJ] | a > c[d=quantmod,amod,nummod,nmod;p=NUM]
NOUN_ADJ_NUM noun_adj_num: n[{_NOUN}] | a > n[{_MOD};p=NUM] | v > n[{_MOD};{_ADV},SYM]
ADJ_NUM adj_num: v[d=quantmod,amod,nummod,nmod;p=ADJ] | a > v[{_MOD};p=NUM]
ADJ_NOUN_NUM adj_noun_num: j[d=acomp,amod;p=ADJ;t=old] | n > j[d=npadvmod;p=NOUN] | a > n[d=quantmod,nmod,nummod,compound;p=NUM]
NOUN_NOUN noun_noun: n[{_NOUN}] | a > n[d=quantmod,nummod,nmod,compound;{_NOUN}] | q > a[d=quantmod,amod,nummod,nmod,advmod,npadvmod]
NOUN_NOUN noun_noun_2: n[{_NOUN}] | a > n[d=quantmod,nummod,nmod,compound,npadvmod;{_NOUN}] | q > n[d=quantmod,nummod,nmod,advmod,npadvmod]
UNIT_FRAC unit_frac: a[p=NUM,NOUN] | r > a[t=per,a,an] | n > r[{_NOUN}]
UNIT_FRAC unit_frac_2: a[p=NUM] | n > a[{_NOUN}] | r > n[t=per,a,an]
UNIT_FRAC unit_frac_3: a[p=NUM] | r > a[t=per] | n > r[{_NOUN}] | j > n[p=ADJ]
UNIT_FRAC unit_frac_4: n[p=NOUN,PROPN,SYM] | r > n[d=prep;t=per,a,an] | b > r[p=NUM,NOUN,PROPN]
UNIT_FRAC unit_frac_5: n[{_NOUN}] | y > n[t=year,month,day,hour,minute,second] | r > y[p=DET;t=per,a,an]
UNIT_FRAC unit_frac_6: n[{_NOUN}] | m > n[{_NOUN}] | r . n[t=per,a,an] | a ; n[p=NUM]
NUM_NOUN num_noun: a[d=quantmod,nmod,nummod,attr;p=NUM] | n > a[{_NOUN}]
DIM2 dimensions_2: n[{_NOUN}] | a > n[d=quantmod,nmod,nummod;p=NUM] | x $+ a[p=SYM] | b $+ x[d=quantmod,nmod,nummod;p=NUM]
NOUN_QUANT_NOUN_NOUN noun_quant_noun_noun: n[{_NOUN}] | a > n[d=nummod;p=NUM] | m > n[d=compound;p=NOUN] | k > m[d=compound;p=NOUN]
ONE_OF one_of: a[p=NUM] | o > a[p=ADP;t=of] | n > o[p=NOUN]
NOUN_NUM_RIGHT_NOUN noun_num_right_noun: n[{_NOUN}] | a > n[d=nummod;p=NUM] | r > n[d=pobj;{_NOUN}]
NUM_NUM_ADP_RIGHT_NOUN num_num_adp_right_noun: a[p=NUM] | b > a[d=nummod;p=NUM] | o > a[d=prep,appos;p=ADP;t=of,per] | r > o[d=pobj,appos;{_NOUN}]
LONELY_NUM lonely_num: a[p=NUM]
- num_right_noun: a[p=NUM] | n >> a[d=prep,pobj;{_NOUN}]
- num_to_num_num: a[p=NUM;notscale] | b > a[t=to] | c > a[d=quantmod;p=NUM] | d > a[d=compound;p=NUM]
- num_to_num_num_dig: a[p=NUM;digit] | b > a[t=-] | c > a[d=quantmod;p=NUM;digit] | d > a[d=compound;p=NUM]
- dimensions_3: n[{_NOUN}] | a > n[d=quantmod,nmod,nummod;p=NUM] | x $+ a[p=SYM] | b $+ x[d=quantmod,nmod,nummod;p=NUM] | y $+ b[p=SYM] | c $+ y[d=quantmod,nmod,nummod;p=NUM]
- adp_num_cconj_num_with_scale: a[p=NUM] | b > a[p=NUM] | q > a[t=and] | s > a[d=quantmod;p=NOUN] | n < a[p=PROPN,NOUN,SYM] | v < n[t=between]
"""


@dataclass(frozen=True)
class Node:
    name: str
    relation: str | None
    to: str | None
    tests: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    family: str  # `-`: defined, but not among the rules that run by default
    name: str
    nodes: tuple[Node, ...]


def _parse(line: str) -> Rule:
    head, body = line.split(": ", 1)
    family, name = head.split()
    nodes = []
    for part in body.split(" | "):
        m = re.fullmatch(r"(\w+)(?: (\S+) (\w+))?\[(.*)\]", part.strip())
        nodes.append(Node(m[1], m[2], m[3], tuple(x for x in m[4].split(";") if x)))
    return Rule(family, name, tuple(nodes))


RULES: tuple[Rule, ...] = tuple(_parse(line) for line in RULE_TEXT.strip().split("\n"))
REGISTERED = tuple(r for r in RULES if r.family != "-")
FAMILIES = tuple(dict.fromkeys(r.family for r in REGISTERED))
_NUMBERS = tuple({*NUMBER_WORDS, *SCALES, *FRACTIONS, *BROAD})


def _test(test: str, t: Column) -> Column:
    if test in ("digit", "notdigit"):
        return t["digit"] if test == "digit" else ~t["digit"]
    if test in ("scale", "notscale"):
        return t["scale"] if test == "scale" else ~t["scale"]
    if test == "number":
        return t["like_number"]
    key, negated, values = re.fullmatch(r"([pdt])(!?)=(.*)", test).groups()
    found = t[{"p": "pos", "d": "dep", "t": "text"}[key]].isin(*values.split(","))
    return ~found if negated else found


def _name(tests: tuple[str, ...]) -> str:
    return "fits " + ";".join(tests)


def keys(tokens: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "sent") if c in tokens.columns]


def in_rows(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent if there, base, toks): a row per sentence or document; base is its first token's index, and
    in toks both i and head count from there."""
    token = F.struct("i", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lemma", "pos", "dep")], "head")
    rows = tokens.groupBy(*keys(tokens)).agg(F.array_sort(F.collect_list(token)).alias("toks"))
    rows = rows.select(*keys(tokens), F.get("toks", F.lit(0))["i"].alias("base"), "toks")
    return rows.withColumn("toks", F.transform("toks", lambda t: t.withField("i", t["i"] - F.col("base")).withField("head", t["head"] - F.col("base"))))


def _facts(rules: tuple[Rule, ...]) -> list[Column]:
    """Of each token what the rules' tests ask for."""
    asked = {test for rule in rules for node in rule.nodes for test in node.tests}

    def fact(t: Column) -> Column:
        low, out = F.lower(t["text"]), [t[c].alias(c) for c in ("text", "pos", "dep")]
        if asked & {"digit", "notdigit"}:
            out.append(t["text"].rlike("^[0-9]+$").alias("digit"))
        if asked & {"scale", "notscale"}:
            out.append(low.rlike(pattern([*SCALES, *BROAD])).alias("scale"))
        if "number" in asked:
            out.append((low.rlike(pattern(_NUMBERS)) | t["text"].rlike("^[0-9][0-9.,]*$")).alias("like_number"))
        return F.struct(*out)

    heads = F.transform("toks", lambda t: t["head"])
    return [F.transform("toks", fact).alias("facts"), heads.alias("heads"), F.sequence(F.lit(0), F.size("toks") - 1).alias("all")]


def _kin() -> list[Column]:
    """Of each token its next sibling to the left, and all its governors, near and far."""

    def left_of(i: Column) -> Column:
        head = F.get("heads", i)
        return F.array_max(F.filter("all", lambda j: (j < i) & (F.get("heads", j) == head) & (j != head) & (i != head)))

    # Nearest first; each round doubles the reach by what the farthest has. A circle of heads ends where it closes.
    near = F.transform("all", lambda i: F.filter(F.array(F.get("heads", i)), lambda h: (h != i) & h.between(0, F.size("all") - 1)))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("all") + 1)).cast("int"))

    def longer(own: Column, more: Column) -> Column:
        return F.when((F.size(more) < 1) | F.array_contains(own, F.get(more, F.lit(0))), own).otherwise(F.array_distinct(F.concat(own, more)))

    def reach(above: Column) -> Column:
        return F.transform(above, lambda own: F.when(F.size(own) == 0, own).otherwise(let(F.get(above, F.get(own, F.size(own) - 1)), lambda more: longer(own, more))))

    above = F.aggregate(rounds, near, lambda above, _: reach(above))
    return [F.col("heads"), F.transform("all", left_of).alias("left"), F.transform(above, lambda own, i: F.array_remove(own, i)).alias("above")]


def _passing(rules: tuple[Rule, ...]) -> list[Column]:
    """For each set of tests the tokens that pass it."""

    def passing(tests: tuple[str, ...]) -> Column:
        def all_of(i: Column) -> Column:
            t, ok = F.get("facts", i), F.lit(True)
            for test in tests:
                ok = ok & _test(test, t)
            return ok

        return F.filter("all", all_of)

    return [passing(t).alias(_name(t)) for t in dict.fromkeys(node.tests for rule in rules for node in rule.nodes)]


def gathered(tokens: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per sentence: heads, left siblings, governors, and for each set of tests the tokens that pass it."""
    rows = in_rows(tokens)
    kept = [*keys(tokens), "base", *keep]
    rows = rows.select(*kept, *held(("facts", rules), lambda: _facts(rules)))
    return rows.select(*kept, *held("kin", _kin), *held(("passing", rules), lambda: _passing(rules)))


def _matched(rule: Rule) -> Column:
    """The matches of a rule in a gathered row: arrays of token indices in the rule's order."""
    places = {node.name: k for k, node in enumerate(rule.nodes)}

    def column(node: Node) -> Column:
        return F.col(f"`{_name(node.tests)}`")

    def grown(partial: Column, node: Node) -> Column:
        def related(t: Column, m: Column) -> Column:
            return {
                ">": lambda: F.get("heads", t) == m,
                "<": lambda: F.get("heads", m) == t,
                ">>": lambda: F.array_contains(F.get("above", t), m),
                "<<": lambda: F.array_contains(F.get("above", m), t),
                ".": lambda: t == m + 1,
                ";": lambda: t == m - 1,
                "$+": lambda: F.coalesce(F.get("left", t) == m, F.lit(False)),
            }[node.relation]()

        def extended(match: Column) -> Column:
            m = F.get(match, F.lit(places[node.to]))
            fits = F.filter(column(node), lambda t: related(t, m) & ~F.array_contains(match, t))
            return F.transform(fits, lambda t: F.array_append(match, t))

        return F.flatten(F.transform(partial, extended))

    out = F.transform(column(rule.nodes[0]), lambda t: F.array(t))
    for node in rule.nodes[1:]:
        out = grown(out, node)
    return out


def _found(rules: tuple[Rule, ...]) -> Column:
    def named(rule: Rule) -> Column:
        priority = FAMILIES.index(rule.family) if rule.family in FAMILIES else len(FAMILIES)
        return F.transform(_matched(rule), lambda toks: F.struct(F.lit(rule.family).alias("family"), F.lit(rule.name).alias("rule"), F.lit(priority).alias("priority"), toks.alias("toks")))

    return F.flatten(F.array(*map(named, rules))).alias("found")


def in_row_matches(tokens: DataFrame, rules: tuple[Rule, ...] = REGISTERED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sent if there, base, the kept columns of in_rows(), found): a row per sentence with its matches,
    whose toks count from base."""
    return gathered(tokens, rules, keep).select(*keys(tokens), "base", *keep, held(("found", rules), lambda: _found(rules)))


def match_all(tokens: DataFrame, rules: tuple[Rule, ...] = REGISTERED) -> DataFrame:
    """(doc_id, sent if there, family, rule, priority, toks) of every rule."""
    out = in_row_matches(tokens, rules).select(*keys(tokens), "base", F.explode_outer("found").alias("m")).filter("m is not null")
    return out.select(*keys(tokens), "m.family", "m.rule", "m.priority", F.transform("m.toks", lambda t: t + F.col("base")).alias("toks"))


def flags(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, i, number, bound, scale, unit, range_l, range_r): what the matches say of each token."""
    at = matches.select("doc_id", "family", F.posexplode("toks").alias("place", "i"), F.array_min("toks").alias("low"), F.array_max("toks").alias("high"))
    words = tokens.select("doc_id", "i", F.lower("text").alias("text"), "pos", "dep")
    known = at.join(words, ["doc_id", "i"])
    numeric = (F.col("pos") == "NUM") | F.col("text").isin(*_NUMBERS)
    ranged = F.col("family").isin("NUM_TO_NUM", "ADP_NUM_CCONJ_NUM", "ADP_NUM_CCONJ_NUM_WITH_UNIT")
    modifying = F.col("family").isin("NUM_QUANTMOD", "MINUS_NUM", "QUANTMOD_DIRECT_NUM", "VERB_QUANTMOD_NUM", "VERB_QUANTMOD2_NUM", "NOUN_NUM_QUANT")
    scale = F.col("text").isin(*SCALES)
    return known.groupBy("doc_id", "i").agg(
        F.bool_or(numeric).alias("number"),
        F.bool_or(modifying & ~numeric & F.col("pos").isin("ADJ", "SCONJ", "ADV", "PART", "ADP", "DET", "VERB", "SYM", "PUNCT")).alias("bound"),
        F.bool_or(scale).alias("scale"),
        F.bool_or(~numeric & F.col("pos").isin("NOUN", "PROPN", "SYM")).alias("unit"),
        F.bool_or(ranged & numeric & ~scale & (F.col("i") == F.col("low"))).alias("range_l"),
        F.bool_or(ranged & numeric & ~scale & (F.col("i") == F.col("high"))).alias("range_r"),
    )


def candidates(matches: DataFrame) -> DataFrame:
    """(doc_id, anchor, toks): matches that share tokens, merged; the anchor is the smallest index.

    Groups are merged transitively, within each document's row.
    """
    per_doc = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("priority", F.array_sort("toks").alias("toks")))).alias("ms"))
    start = F.array().cast("array<array<int>>")

    def merge(groups: Column, m: Column) -> Column:
        touching = F.filter(groups, lambda g: F.arrays_overlap(g, m["toks"]))
        others = F.filter(groups, lambda g: ~F.arrays_overlap(g, m["toks"]))
        joined = F.array_sort(F.array_distinct(F.concat(F.flatten(touching), m["toks"])))
        return F.concat(others, F.array(joined))

    out = per_doc.select("doc_id", F.explode(F.aggregate("ms", start, merge)).alias("toks"))
    return out.select("doc_id", F.array_min("toks").alias("anchor"), "toks")
