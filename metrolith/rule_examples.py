"""For each dependency rule a smallest parse that it matches, and the rule as a SQL query over token rows.

The SQL joins the token table with itself, once for each further node of the rule, so it says what a rule means
without the array matcher of operators.rules.
"""

from __future__ import annotations

import itertools
import re

from metrolith.functions.lexicon import BROAD, FRACTIONS, NUMBER_WORDS, SCALES
from metrolith.operators.rules import RULES, Node, Rule

Token = tuple[int, str, str, str, int]  # i, text, pos, dep, head
_DEFAULT = {"NUM": "12", "NOUN": "boxes", "PROPN": "Acme", "ADJ": "old", "SYM": "$", "VERB": "cost", "ADV": "about", "ADP": "of", "PUNCT": ",", "": "so"}


def _values(node: Node) -> dict[str, str]:
    found = {t.split("=")[0]: t.split("=")[1].split(",")[0] for t in node.tests if "=" in t and "!=" not in t}
    pos = found.get("p", "")
    text = found.get("t") or ("million" if "scale" in node.tests else "seven" if {"notdigit", "number"} & set(node.tests) else _DEFAULT.get(pos, "so"))
    return {"text": text, "pos": pos or "X", "dep": found.get("d", "dep")}


def smallest_parse(rule: Rule) -> list[Token]:
    """One token for each node, in an order in which neighbours and siblings stand as the rule has them."""
    at = {n.name: k for k, n in enumerate(rule.nodes)}
    head: dict[int, int] = {}
    for k, n in enumerate(rule.nodes):
        other = at.get(n.to)
        if n.relation in (">", ">>"):
            head[k] = other
        elif n.relation in ("<", "<<"):
            head[other] = k
        elif n.relation == "$+":
            head[k] = head[other]
    for order in itertools.permutations(range(len(rule.nodes))):  # order[k]: the place of node k
        fits = True
        for k, n in enumerate(rule.nodes):
            step = order[k] - order[at[n.to]] if n.to else 0
            fits &= {".": step == 1, ";": step == -1, "$+": step > 0}.get(n.relation, True)
            if n.relation == "$+":
                between = [j for j in range(len(order)) if head.get(j) == head[k] and order[at[n.to]] < order[j] < order[k]]
                fits &= not between
        if fits:
            break
    else:
        raise ValueError(f"no order fits {rule.name}")
    rows = []
    for k, n in enumerate(rule.nodes):
        v = _values(n)
        rows.append((order[k], v["text"], v["pos"], v["dep"], order[head.get(k, k)]))
    return sorted(rows)


#: Parses of whole sentences: (text, pos, dep, head) each.
SENTENCES: dict[str, str] = {
    "cost": "{a} NUM nummod 1|boxes NOUN nsubj 2|cost VERB ROOT 2|about ADV advmod 4|{b} NUM nummod 5|dollars NOUN dobj 2",
    "range": "They PRON nsubj 1|hold VERB ROOT 1|{a} NUM quantmod 4|to PART quantmod 4|{c} NUM nummod 5|boxes NOUN dobj 1",
    "between": "Prices NOUN nsubj 1|rose VERB ROOT 1|between ADP quantmod 5|{a} NUM quantmod 5|and CCONJ cc 5|{c} NUM nummod 6|percent NOUN dobj 1",
    "broad": "hundreds NOUN nsubj 3|of ADP prep 0|parts NOUN pobj 1|broke VERB ROOT 3",
    "fraction": "one NUM nsubj 4|out SCONJ quantmod 3|of ADP quantmod 3|four NUM nummod 0|failed VERB ROOT 4",
    "one_of": "one NUM nsubj 3|of ADP prep 0|boxes NOUN pobj 1|broke VERB ROOT 3",
    "per": "It PRON nsubj 1|pumps VERB ROOT 1|{b} NUM nummod 3|barrels NOUN dobj 1|per ADP prep 3|day NOUN pobj 4",
    "money": "The DET det 1|fee NOUN nsubj 2|is AUX ROOT 2|$ SYM nmod 4|{b} NUM attr 2|for ADP prep 2|parking NOUN pobj 5",
    "fell": "The DET det 2|oil NOUN compound 2|price NOUN nsubj 3|fell VERB ROOT 3|by ADP prep 3|{a} NUM nummod 6|percent NOUN pobj 4",
    "minus": "It PRON nsubj 1|is AUX ROOT 1|minus NOUN nmod 4|{a} NUM nummod 4|degrees NOUN attr 1",
    "spelled": "It PRON nsubj 1|serves VERB ROOT 1|two NUM compound 3|hundred NUM nummod 4|people NOUN dobj 1",
    "phone": "Call VERB ROOT 0|( PUNCT punct 2|123 NUM dobj 0|) PUNCT punct 2|555 NUM nummod 2|- PUNCT punct 2|555 NUM nummod 2|for ADP prep 0|{a} NUM nummod 9|cups NOUN pobj 7",
    "shared": "It PRON nsubj 1|costs VERB ROOT 1|{a} NUM dobj 1|or CCONJ cc 2|{c} NUM nummod 5|euros NOUN conj 2",
    "bracket": "The DET det 1|load NOUN nsubj 2|was AUX ROOT 2|{a} NUM nummod 4|kg NOUN attr 2|( PUNCT punct 7|{b} NUM nummod 7|lbs NOUN appos 4|) PUNCT punct 7",
}


def sentence(name: str) -> list[Token]:
    out = []
    for i, word in enumerate(SENTENCES[name].split("|")):
        text, pos, dep, head = word.rsplit(" ", 3)
        out.append((i, text, pos, dep, int(head)))
    return out


def examples(rules: tuple[Rule, ...] = RULES) -> list[list[Token]]:
    """A smallest parse for each rule, then the sentences with small numbers."""
    numbered = lambda toks: [(i, t.format(a="5", b="120", c="9") if t in ("{a}", "{b}", "{c}") else t, p, d, h) for i, t, p, d, h in toks]
    return [smallest_parse(r) for r in rules] + [numbered(sentence(n)) for n in SENTENCES]


_NUMBERS = {*NUMBER_WORDS, *SCALES, *FRACTIONS, *BROAD}


def token_values(parses: list[list[Token]]) -> str:
    """A SQL common table `tok` (parse, i, text, pos, dep, head, digit, scale, number) and `up`, all governors."""
    rows = []
    for k, toks in enumerate(parses):
        for i, text, pos, dep, head in toks:
            digit, scale = text.isascii() and text.isdigit(), text.lower() in {*SCALES, *BROAD}
            number = text.lower() in _NUMBERS or bool(re.fullmatch("[0-9][0-9.,]*", text))
            rows.append(f"({k}, {i}, '{text}', '{pos}', '{dep}', {head}, {digit}, {scale}, {number})")
    return (
        f"tok AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(parse, i, text, pos, dep, head, digit, scale, number)),\n"
        "up AS (SELECT parse, i, head AS m FROM tok WHERE head <> i UNION SELECT up.parse, up.i, tok.head FROM up JOIN tok ON tok.parse = up.parse AND tok.i = up.m WHERE tok.head <> tok.i)"
    )


def as_sql(rule: Rule) -> str:
    """SELECT parse, rule, toks (indices in the rule's order, joined by commas)."""
    alias = {n.name: f"t{k}" for k, n in enumerate(rule.nodes)}
    tests, joins = [], []
    for k, n in enumerate(rule.nodes):
        t = alias[n.name]
        for test in n.tests:
            if test in ("digit", "scale", "number"):
                tests.append(f"{t}.{test}")
            elif test in ("notdigit", "notscale"):
                tests.append(f"NOT {t}.{test[3:]}")
            else:
                key, negated, listed = re.fullmatch("([pdt])(!?)=(.*)", test).groups()
                quoted = ", ".join(f"'{v}'" for v in listed.split(","))
                tests.append(f"{t}.{ {'p': 'pos', 'd': 'dep', 't': 'text'}[key]} {'NOT ' if negated else ''}IN ({quoted})")
        if n.to:
            m = alias[n.to]
            on = {
                ">": f"{t}.head = {m}.i",
                "<": f"{m}.head = {t}.i",
                ">>": f"EXISTS (SELECT 1 FROM up WHERE up.parse = {t}.parse AND up.i = {t}.i AND up.m = {m}.i)",
                "<<": f"EXISTS (SELECT 1 FROM up WHERE up.parse = {t}.parse AND up.i = {m}.i AND up.m = {t}.i)",
                ".": f"{t}.i = {m}.i + 1",
                ";": f"{t}.i = {m}.i - 1",
                "$+": f"{m}.i = (SELECT max(s.i) FROM tok s WHERE s.parse = {t}.parse AND s.head = {t}.head AND s.i < {t}.i AND s.head <> s.i) AND {t}.head <> {t}.i",
            }[n.relation]
            joins.append(f"JOIN tok {t} ON {t}.parse = t0.parse AND {on}")
        tests += [f"{t}.i <> {alias[o.name]}.i" for o in rule.nodes[:k]]
    toks = " || ',' || ".join(f"CAST({alias[n.name]}.i AS VARCHAR)" for n in rule.nodes)
    return f"SELECT t0.parse, '{rule.name}' AS rule, {toks} AS toks FROM tok t0 {' '.join(joins)} WHERE {' AND '.join(tests) or 'true'}"


def matches_sql(rules: tuple[Rule, ...], parses: list[list[Token]]) -> str:
    """A common table `hits` (parse, rule, toks) of all rules over the parses."""
    return f"WITH RECURSIVE {token_values(parses)},\nhits AS (" + "\nUNION ALL ".join(map(as_sql, rules)) + ")"
