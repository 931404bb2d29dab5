"""What is not a quantity: phone numbers, sequences, times, dates, names with numbers, ordinals, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions.lexicon import MONTHS
from metrolith.functions.spans import masked

#: Stands for an ignored character; no text has it.
MARK = "\u2063"

_MONTH = "(?:" + "|".join([*(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS if len(m) > 3 and m != "September"), "Sept(?:ember)?|Sep", "May"]) + ")"

# The shapes that are ignored.
PATTERNS: dict[str, str] = {
    "I3": r"^\+?\(?[0-9]{3}\)?[-\s.]?[0-9]{3}[-\s.]?[0-9]{4,6}$",
    "I4": r"-?(?:[0-9]+-){2,}[0-9]+",
    "I5": r"[0-9]{1,2}\s?:\s?[0-9]{0,2}[:.]\s?[0-9]{0,2}",
    "I6": r"[0-9]{1,2}\s?:\s?[0-9]{1,2}",
    "I7": rf"{_MONTH}.?\s?[0-9]{{1,2}}-?\s?[0-9]{{0,2}}",
    "I8": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "I9": r"(?<![0-9.,a-zA-Z])[a-zA-Z]+[0-9]+[.|,]*[0-9]+[a-zA-Z]*",
    "I10": r"[0-9]+\s*(?:st|nd|rd|th)\b",
    "I12": r"\(\s?[0-9]{1,3}\s?\)\s?[0-9]{2,4}[\s-]*[0-9]{3,4}(?:[\s-]*[0-9]{4})?|[0-9]{5}\s+ZIP\b",
    "I13": r"\+\s?[0-9]{2}\s?\(?[0-9]{4}\)?\s?[0-9]{4,7}\b",
}
#: The order in which a text is searched: longer shapes first.
ORDER = ("I3", "I13", "I12", "I8", "I4", "I5", "I6", "I7", "I9", "I10")
YEAR = r"\b(?:[Ii]n|[Ss]ince|[Uu]ntil|[Bb]y|[Dd]uring|[Oo]f|[Yy]ear) (?:1[5-9]|20)[0-9]{2}(?= [^0-9a-z]|$)"


def ignored(text: Column, step: str) -> Column:
    return F.coalesce(text.rlike(PATTERNS[step]), F.lit(False))


def mask(text: Column) -> Column:
    for step in ORDER:
        text = masked(text, PATTERNS[step], MARK)
    return masked(text, YEAR, MARK)
