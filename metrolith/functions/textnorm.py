"""Text normalization: an ordered list of string-to-string steps, each a column expression.

Every step sees what the one before has made, so the order matters.  normalize() folds them all; a step can
be applied alone by its id.  No step needs a shuffle or leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions.lexicon import SUFFIXES
from metrolith.functions.spans import let

Step = tuple[str, Callable[[Column], Column]]

# Currency codes and symbols that the steps move, and symbols that stand after a number.
CODES = "inr|jpy|cad|sen|usd|aud|eur|rmb|gbp"
CODES_OR_SIGNS = CODES + "|₡|₫|₵|¥|₥"
TRAILING = "₿|¢|₡|₫|₾|₵|₹|円|圓|₭|₥|ரூ|₩|′|″|”|Å|Ω|Ω"
MONEY = "₡₫₵¥₥$₿¢₾₹円圓₭₩"
NUM = r"[0-9,.]*[0-9]"


def sub(pattern: str, put: str) -> Callable[[Column], Column]:
    """Every match replaced; words and digits are Unicode's."""
    return lambda c: F.regexp_replace(c, pattern, put)


def literal(old: str, new: str) -> Callable[[Column], Column]:
    return lambda c: F.replace(c, F.lit(old), F.lit(new))


def upper_groups(pattern: str, build: Callable[[Callable[[int], Column]], Column]) -> Callable[[Column], Column]:
    """Every match replaced by an expression over its groups."""

    def step(c: Column) -> Column:
        hits, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
        put = F.transform(hits, lambda h: build(lambda i: F.regexp_extract(h, pattern, i)))
        pairs = F.zip_with(gaps, put, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
        return F.when(c.rlike(pattern), F.array_join(pairs, "")).otherwise(c)

    return lambda c: let(c, step)


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def _shortest(x: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _scale_steps() -> list[Step]:
    out: list[Step] = []
    for letter, word in SUFFIXES.items():
        out.append((f"P27{letter}", sub(rf"(?<![A-Z\d,.])([\d,.]+)\s?{letter}([\s.,()]+|$)", rf"$1 {word}$2")))
        out.append((f"P27{letter}-", sub(rf"([\d,.]+)\s?{word}-", rf"$1 {word} ")))
    return out


def _currency_steps() -> list[Step]:
    out: list[Step] = []
    for letter, word in SUFFIXES.items():
        out.append((f"P42{letter}", sub(rf"(?i)({NUM})\s*({CODES_OR_SIGNS})(\s*{word})", "$1$3 $2")))
    every = "|".join(dict.fromkeys(SUFFIXES.values()))
    out.append(("P42-", sub(rf"(?i)(?<![a-zA-Z])(M)?({CODES_OR_SIGNS})\s*({NUM})(\s*(?:{every}))?", "$3$4 $1$2")))
    return out


def _ended(c: Column) -> Column:
    """A detached full stop or question mark at the end; a final line feed goes."""
    return let(F.regexp_replace(c, r"\n$", ""), _stopped)


def _stopped(c: Column) -> Column:
    return (
        F.when(c.endswith(" .") | c.endswith(" ?"), c)
        .when(c.endswith("?") | c.endswith("."), F.concat(F.substr(c, F.lit(1), F.length(c) - 1), F.lit(" "), F.right(c, F.lit(1))))
        .when(c.endswith(" "), F.concat(c, F.lit(".")))
        .otherwise(F.concat(c, F.lit(" .")))
    )


# The patterns of the steps, in the order in which they apply.
STEPS: list[Step] = [
    ("P01", sub(r"(?<=[\p{L}\p{N}_])(\([a-zA-Z]+)", " $1")),
    ("P02", sub(r"(?U)^(\w+)\s?—\s?", "$1 ")),
    ("P03", sub(r"(?<=\S)\s?—", " ")),
    ("P04", sub(r"\s{2,}", " ")),
    ("P05", literal(" | ", " ,  ")),
    ("P06", literal(" c $", " C$")),
    ("P07", sub(r"\bC\s+\$", r"C\$")),
    ("P08", sub(r"\bS\s\$\s*", r"S\$ ")),
    ("P09", literal(" EUR ", " eur ")),
    ("P10", literal(" U.S. ", " US ")),
    ("P11", sub(r"\bper cent\b", "percent")),
    ("P12", sub(r"(\bpercent|(?<=\w)%)-([a-z]+)", "$1 $2")),
    ("P13", sub(r"\[([a-z]+|%+)\]", "$1")),
    ("P14", sub(r"<([a-z]+)>", "$1")),
    ("P15", sub(r"\(([a-z]{2,3})\)", "$1")),
    ("P16", sub(r"\b(\d+)\s*yo\b", "$1 years old")),
    ("P17", sub(r"(\d+)-[\s.]", "$1")),
    ("P18", sub(r"\b([a-z])\.(?!$)", "$1")),
    ("P19a", sub(r"(?<=\d),(?=[\d,]*(?:\.\d+)?(?!E[+−\d]|e[+−\d])[a-zA-Z]{1,3}[.,]?(?![\d]))", "")),
    ("P19b", sub(rf"(?<![A-Z\d,.])({NUM})(?!E[+−\d]|e[+−\d])([a-zA-Z]{{1,3}})\.", "$1 $2 .")),
    ("P19c", sub(rf"(?<![A-Z\d,.])({NUM})(?!E[+−\d]|e[+−\d])([a-zA-Z]{{1,3}})", "$1 $2")),
    ("P20", sub(rf"(?i)({CODES})\s?({NUM})\s?m(?![a-z\d])(?:[.,](?=\s|$))?", "$1 $2 M")),
    ("P21", sub(rf"\bPS({NUM})", "£$1")),
    ("P22", sub(rf"([$€£]\s?{NUM}\s?)m(?![a-z\d])([., \n]?)", "$1M$2")),
    ("P23", sub(rf"\b(RM)\s?({NUM})(?:million|mil|m|M)+\b", "$2 M $1")),
    ("P24", sub(rf"\b(RM)\s?({NUM})(k|K|bn|b|B|tn)+\b", "$2 $3 $1")),
    ("P25", sub(rf"\b(RM)({NUM})\b", "$2 $1")),
    ("P26", sub(r"([0-9.]+)-([a-zA-Z]+)", "$1 $2")),
    *_scale_steps(),
    ("P28", sub(r"([\d,.]+)\s*sq\sm\b", "$1sqm")),
    ("P29", sub(r"([\d,.]+)\s*sqm\b", "$1 m2")),
    ("P30", upper_groups(r"(\d+)\s+(\d)/(\d)[\s.]", lambda g: _shortest(_number(g(1)) + F.coalesce(F.try_divide(_number(g(2)), _number(g(3))), F.lit(0.0))))),
    ("P31", upper_groups(r"\b(\d)/([1-9])[\s.]", lambda g: _shortest(_number(g(1)) / _number(g(2))))),
    ("P32", sub(r"([\d,.]+)\s+deg\b", "$1 degree")),
    ("P33", sub(r"degrees?\s+[fF](?=[\s.]|$)", "degf")),
    ("P34", sub(r"\s+to-([\d,.]+)", " to $1")),
    ("P35", sub(r"(\s)\$US", r"$1US\$")),
    ("P36", upper_groups(r"\b(u\.s|US|hk|HK)\s*\$\s*", lambda g: F.concat(F.upper(g(1)), F.lit("$ ")))),
    ("P37", sub(r"((?:[0-9,.]+|million)\s+)us\s", "$1US ")),
    ("P38", sub(r"us\s*\$", r"US \$")),
    ("P39", upper_groups(r"(aud|usd)\$", lambda g: F.concat(F.upper(g(1)), F.lit("$")))),
    ("P40", sub(rf"({NUM})\s*([$€])", "$2$1")),
    ("P41", sub(rf"(?i)(?<![a-zA-Z])(M)({CODES})\b", "$1 $2")),
    *_currency_steps(),
    ("P43", sub(rf"({NUM}\s*)bitcoins?", "$1btc")),
    ("P44", sub(r"(?i)\b(us)(?=[\d,.]+)", "$1 ")),
    ("P45", sub(rf"(?<![A-Z\d,.])([0-9,.]+)({TRAILING})", "$1 $2")),
    ("P46", sub(rf"([{MONEY}]+{NUM})-([{MONEY}]+{NUM})", "$1 - $2")),
    ("P47", upper_groups(rf"({NUM}\s*)(mB|gB|kB|tB)\b", lambda g: F.concat(g(1), F.upper(g(2))))),
    ("P48", upper_groups(rf"({NUM}\s*)([mMgGkKtT])b\b", lambda g: F.concat(g(1), F.upper(g(2)), F.lit("bit")))),
    ("P49", sub(r"([a-z]+)-a-([a-z]+)", "$1 a $2")),
    ("P50", sub(r"(?<![\da-zA-Z])\+(?!\s?\d{2}\s?\(?\d{4}\)?\s?\d{4,7}\b)", "up ")),
    ("P51", sub(r"minus-([\d,.]+)", "-$1")),
    ("P52", sub(r"\s-([\d,.]+)", " minus $1")),
    ("P53", sub(r"^-([\d,.]+)", "minus $1")),
    ("P54", sub(r"sub-([\d,.]+)", "under $1")),
    ("P55", sub(rf"(?<![A-Z\d,.])({NUM})([a-zA-Z,/]{{2,}})", "$1 $2")),
    ("P56", sub(r"\s[Hh]z\b", " HZ")),
    ("P57", sub(rf"([a-zA-Z,])=({NUM})", "$2 $1")),
    ("P58", _ended),
]

STEP: dict[str, Callable[[Column], Column]] = dict(STEPS)


def group(step: str) -> Callable[[Column], Column]:
    """All parts of a step, such as P27's."""

    def run(c: Column) -> Column:
        for name, f in STEPS:
            if name == step or (name.startswith(step) and not name[len(step) : len(step) + 1].isdigit()):
                c = f(c)
        return c

    return run


def normalize(text: Column) -> Column:
    for _, step in STEPS:
        text = step(text)
    return text
