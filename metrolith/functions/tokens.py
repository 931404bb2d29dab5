"""Tokens of a normalized sentence and their classes, one letter each.

A sentence's classes make a string, so that the shapes of quantities are regular expressions over it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions.bounds import WORDS as BOUND_WORDS
from metrolith.functions.catalog import CATALOG, FORMS
from metrolith.functions.ignore import MARK
from metrolith.functions.lexicon import BROAD, FRACTIONS, NUMBER_WORDS, SCALES, STOP_WORDS, VERBS, pattern
from metrolith.functions.spans import constant_lookup, let, located

_HYPHENED = sorted((w for w in [*NUMBER_WORDS, *FRACTIONS] if "-" in w), key=len, reverse=True)

#: One pattern; longer shapes first.
TOKEN = "|".join(
    [
        MARK + "+",
        r"[0-9][0-9,.]*×10\^?[−-]?[0-9]+|[0-9][0-9,.]*×10[⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+|[0-9][0-9,.]*×?[eE][+−-]?[0-9]+\b",
        r"\b[0-9]+[/⁄]+[0-9]+\b",
        r"[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?|\.[0-9]+",
        r"(?i:\b" + pattern(_HYPHENED)[1:-1] + r"\b)",
        r"\bsq (?:m|ft)\b",
        r"(?i:\bdegrees? (?:c[a-z]*els?c?ius|fah?renheit)\b)|°[CcFf](?:elsius|elcius|entigrade)?\b",
        r"(?U)[\w%$€£]+/\w+",
        r"\b(?:USD|AUD|US|CA|HK|AU|GB|C|A|S)\$|\bUS \$|[$€£¥₡₫₵₥₿¢₾₹円圓₭₩]",
        r"[<>]\s?=|~\s?=|[<>~≈=]",
        r"[A-Za-zμµ]{1,3}[23²³]\b",
        r"\p{L}+[0-9]+[\p{L}0-9]*",
        r"\p{L}+(?:['’]\p{L}+)*",
        r"\S",
    ]
)

_CURRENCY = tuple(s for u in CATALOG if u.entity == "currency" for s in u.symbols)
_NOT_UNITS = set(STOP_WORDS) | set(VERBS) | {"may", "top", "am", "a", "A", "in", "as", "at", "no", "us", "US", "so", "I", "K", "pa", "second", "seconds"}
_UNITS = tuple(f for f in FORMS if f not in _NOT_UNITS and f not in _CURRENCY) + ("second", "seconds")
_STOPS = tuple(dict.fromkeys(w for w in [*STOP_WORDS, *VERBS] if w != "minus"))

# Letters: d numeral, w number word, s scale, S plural scale, f fraction, c currency, u unit, b bound,
# m minus, q than/by/at, t to, h dash, A and, R or, v between/from, o of, O out, P per, i a/an, x times,
# k comma, ( ), . end, g for/off, l other function word, N capitalised, n other word, z the rest.
CLASSES = "dwsSfcubmqthARvoOPixk().glNnz"


def _letters() -> tuple[dict[str, str], dict[str, str]]:
    """Class letters by the token as it is (currencies, units) and by its lower case (everything else)."""
    low: dict[str, str] = {}
    for letter, words in (
        ("w", NUMBER_WORDS), ("s", SCALES), ("S", BROAD), ("f", FRACTIONS), ("m", ("minus",)), ("q", ("than", "by", "at")), ("t", ("to",)), ("h", ("-", "–")), ("A", ("and",)), ("R", ("or",)), ("v", ("between", "from")),
        ("o", ("of",)), ("O", ("out",)), ("P", ("per",)), ("i", ("a", "an")), ("x", ("x", "×")), ("k", (",",)), ("(", ("(",)), (")", (")",)), (".", (".", "?", "!")), ("g", ("for", "off")),
        ("b", (*BOUND_WORDS, "<", ">", "<=", ">=", "< =", "> =", "~", "~=", "~ =", "≈", "=")), ("l", _STOPS), ("u", (u for u in _UNITS if u == u.lower())),
    ):
        for w in words:
            low.setdefault(w, letter)
    exact = {c: "c" for c in _CURRENCY} | {u: "u" for u in _UNITS if u != u.lower()}
    return exact, low


_EXACT, _LOW = _letters()


def klass(token: Column) -> Column:
    def of(t: Column) -> Column:
        known = F.coalesce(constant_lookup(_EXACT, "string", t), constant_lookup(_LOW, "string", F.lower(t)))
        shape = F.when(t.rlike(r"^[\p{L}%$€£]+/[\p{L}0-9]+$"), "u").when(t.rlike(r"^\p{Lu}"), "N").when(t.rlike(r"^\p{L}"), "n").otherwise("z")
        return F.when(t.rlike(r"^[0-9.]*[0-9]"), "d").otherwise(F.coalesce(known, shape))

    return let(token, of)


def is_stop(word: Column) -> Column:
    return F.lower(word).rlike(pattern(_STOPS))


def tokens(text: Column) -> Column:
    """(start, end, text) of each token."""
    return located(text, TOKEN)


def classes(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: klass(t["text"])), "")


def sentences(text: Column) -> Column:
    """Sentences: cut after a full stop, question or exclamation mark before a capital."""
    return F.split(text, r"(?<=[.!?]) +(?=\p{Lu})", -1)


_IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "pence": "penny", "lives": "life", "wives": "wife", "knives": "knife", "halves": "half", "leaves": "leaf"}


def singular(word: Column) -> Column:
    """A plain lemma of a noun; words in capitals stay."""
    low = F.lower(word)
    stem = (
        F.when(low.rlike(pattern(_IRREGULAR)), constant_lookup(_IRREGULAR, "string", low))
        .when(low.rlike("(?:ss|us|is)$") | (F.length(low) < 4), low)
        .when(low.rlike("[^aeiou]ies$"), F.regexp_replace(low, "ies$", "y"))
        .when(low.rlike("(?:ch|sh|x|ss)es$"), F.regexp_replace(low, "es$", ""))
        .when(low.rlike("s$"), F.regexp_replace(low, "s$", ""))
        .otherwise(low)
    )
    return F.when(word.rlike(r"^\p{Lu}+$|\p{Ll}\p{Lu}"), word).otherwise(stem)
