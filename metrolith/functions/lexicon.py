"""Word lists: number words, scales, fractions, bounds, months, and the word forms of bound verbs.

Number words and fractions are composed; the lists marked as fixed values must be as they are for the
results to be right.
"""

from __future__ import annotations

from math import gcd

_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

NUMBER_WORDS: dict[str, float] = {w: float(i) for i, w in enumerate(_SMALL)}
for _i, _t in enumerate(_TENS, start=2):
    NUMBER_WORDS[_t] = 10.0 * _i
    for _j in range(1, 10):
        NUMBER_WORDS[f"{_t}-{_SMALL[_j]}"] = 10.0 * _i + _j

# Scale words.
SCALES: dict[str, float] = {
    "dozen": 12.0,
    "doz": 12.0,
    "dozs": 12.0,
    "dzs": 12.0,
    "dz": 12.0,
    "hundred": 100.0,
    "thousand": 1e3,
    "lakh": 1e5,
    "million": 1e6,
    "mil": 1e6,
    "mln": 1e6,
    "crore": 1e7,
    "billion": 1e9,
    "bln": 1e9,
    "trillion": 1e12,
    "tln": 1e12,
}
PLURAL_SCALES = {w + "s": SCALES[w] for w in ("dozen", "hundred", "thousand", "lakh", "million", "crore", "billion", "trillion")}
BROAD = {**PLURAL_SCALES, "tens": 10.0}

_NTH = {3: "third", 4: "fourth", 5: "fifth", 6: "sixth", 7: "seventh", 8: "eighth", 9: "ninth", 10: "tenth", 12: "twelfth", 16: "sixteenth", 100: "hundredth"}
FRACTIONS: dict[str, float] = {"half": 0.5, "halve": 0.5, "quarter": 0.25, "one thirty-second": 1 / 32, "a hundred twenty-eighth": 1 / 128, **{w: 1.0 / d for d, w in _NTH.items()}}
for _d, _w in {**{d: _NTH[d] for d in (3, 5, 6, 8, 9)}, 4: "quarter"}.items():
    for _n in range(2, _d):
        if gcd(_n, _d) == 1:
            for _end in ("", "s"):
                FRACTIONS[f"{_SMALL[_n]}-{_w}{_end}"] = _n / _d

# Letters after a number that stand for a scale word.
SUFFIXES: dict[str, str] = {"B": "billion", "b": "billion", "M": "million", "K": "thousand", "k": "thousand", "bn": "billion", "tn": "trillion"}

# What a word says about the number after it.
BOUNDS: dict[str, str] = {
    **dict.fromkeys(("exactly", "just", "equals", "equal", "totalling", "="), "="),
    **dict.fromkeys(("barely", "about", "approximately", "average", "averaging", "roughly", "around", "nearly", "close", "circa", "estimate", "some", "~", "~ =", "~=", "≈"), "~"),
    **dict.fromkeys(("more", "least", "above", "over", "well over", "greater", "great", "larger", "large", "exceeding", "exceed", "higher", "high", ">"), ">"),
    **dict.fromkeys(("less", "fewer", "few", "under", "most", "below", "up to", "smaller", "small", "beneath", "lower", "low", "<"), "<"),
    **dict.fromkeys((">=", "> ="), ">="),
    **dict.fromkeys(("<=", "< ="), "<="),
    **dict.fromkeys(("collapse", "decline", "decrease", "descend", "dip", "down", "downward", "drop", "fall", "flop", "lose", "plummet", "plunge", "sag", "shrink", "skid", "slide", "slip", "slump", "spil", "stumble", "tumble"), "down"),
    **dict.fromkeys(("add", "advance", "ascend", "climb", "gain", "grow", "increase", "jump", "rally", "rise", "rise under", "surge", "up", "upward"), "up"),
}

_IRREGULAR = {
    "fall": ("fell", "fallen"), "rise": ("rose", "risen"), "grow": ("grew", "grown"), "shrink": ("shrank", "shrunk"), "lose": ("lost", "losing"), "slide": ("slid", "sliding"),
}
_DOUBLED = ("dip", "drop", "flop", "sag", "skid", "slip")
_FIXED = ("down", "downward", "up", "upward", "spil")


def _forms(verb: str) -> set[str]:
    if verb in _FIXED or " " in verb:
        return {verb}
    stem = verb + verb[-1] if verb in _DOUBLED else verb.removesuffix("e")
    out = {verb, verb[:-1] + "ies" if verb.endswith("ly") else verb + "s", stem + "ing", *_IRREGULAR.get(verb, ())}
    return out | ({verb[:-1] + "ied"} if verb.endswith("ly") else {stem + "ed"} if verb not in _IRREGULAR else set())


#: Inflected form to the listed word, for the verbs among the bounds.
BOUND_LEMMAS: dict[str, str] = {form: word for word, change in BOUNDS.items() for form in (_forms(word) if change in ("up", "down") else {word})}
BOUND_LEMMAS |= {"exceeds": "exceed", "exceeded": "exceed", "estimated": "estimate", "averaged": "average", "averages": "average"}

# Words that matter to ignoring numbers.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DURATIONS = ("year", "month", "week", "day", "second", "minute", "hour", "daily")
NAME_MARKS = ("GMT", "index", "Max")
MODEL_MARKS = ("Max", "Pro", "Mini")
NAME_EXEMPT = ("age", "between", "than", "from")
DATE_WORDS = ("in", "since", "until", "during", "the", "early", "late", "mid", *(m.lower() for m in MONTHS))
UNIT_BLACKLIST = ("low", "high", "am")

# SI and IEC prefixes.
PREFIXES: dict[str, str] = {
    "q": "quecto", "r": "ronto", "y": "yocto", "z": "zepto", "a": "atto", "f": "femto", "p": "pico", "n": "nano", "μ": "micro", "µ": "micro", "m": "milli", "c": "centi", "d": "deci",
    "h": "hecto", "k": "kilo", "M": "mega", "G": "giga", "T": "tera", "P": "peta", "E": "exa", "Z": "zetta", "Y": "yotta", "R": "ronna", "Q": "quetta",
    "Ki": "kibi", "Mi": "mebi", "Gi": "gibi", "Ti": "tebi", "Pi": "pebi", "Ei": "exbi", "Zi": "zebi", "Yi": "yobi",
}

#: Common verbs: neither units nor what a number refers to.
VERBS = tuple(
    "cost costs hold holds held pay pays paid sell sells sold buy buys bought give gives gave weigh weighs weighed use uses used test tested make makes made take takes took get gets got "
    "need needs needed see sees saw run runs ran reach reaches reached show shows showed report reports reported expect expects expected earn earns earned spend spends spent contain contains "
    "contained include includes included measure measures measured keep keeps kept ship ships shipped carry carries carried cover covers covered last lasts lasted say says said want wants "
    "wanted stand stands stood move moves moved trade trades traded live lives lived join joins joined call calls called".split()
)

#: A plain list of English function words, with the additions and removals that extraction needs.
STOP_WORDS = tuple(
    sorted(
        (
            set(
                "i me my we our you your he him his she her it its they them their this that these those am is are was were be been being have has had do does did a an the and but if or because as until while of at by for with about against between into through during before after above below to from in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very can will just should now also would could may might must us amount up top never".split()
            )
            - {"top", "us", "up", "amount", "never"}
        )
        | {"total", "instead", "maybe", "≈", "minus"}
    )
)


def pattern(words) -> str:
    """A regular expression for exactly these words: a tree of their common beginnings, so that a test reads a
    token once and a plan holds one literal instead of hundreds."""
    import re

    def of(items: list[str]) -> str:
        branches: dict[str, list[str]] = {}
        for w in items:
            if w:
                branches.setdefault(w[0], []).append(w[1:])
        parts = []
        for first in sorted(branches):
            rest = of(sorted(set(branches[first])))
            parts.append(re.escape(first) + rest)
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
        if "" in items and body:
            return f"(?:{body})?"
        return body

    return "^" + of(sorted(set(words))) + "$"
