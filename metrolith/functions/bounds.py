"""Bounds and trends: what the words before a number say about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions.lexicon import BOUND_LEMMAS, BOUNDS
from metrolith.functions.spans import constant_map, let

_LEMMA = {f: w for f, w in BOUND_LEMMAS.items() if " " not in f}
WORDS = tuple(_LEMMA)


def lemma(word: Column) -> Column:
    """The listed word of which this is a form, or the word itself."""
    return F.coalesce(F.try_element_at(constant_map(_LEMMA, "string"), word), word)


def change(words: Column) -> Column:
    """= ~ < > <= >= up or down, of the words between which and the number nothing else stands.

    The whole phrase counts first, then the last word that says something; `=` if none does.
    """
    known = constant_map(BOUNDS, "string")
    lemmas = F.transform(words, lambda w: lemma(F.lower(w)))

    def chosen(ws: Column) -> Column:
        phrase = F.when(F.size(ws) > 1, F.array_join(ws, " ")).otherwise(F.lit(""))
        # The words in order, then the phrase: of those that say something the last is taken.
        said = F.filter(F.transform(F.concat(ws, F.array(phrase)), lambda w: F.try_element_at(known, w)), lambda x: x.isNotNull())
        return F.coalesce(F.get(said, F.size(said) - 1), F.lit("="))

    return let(lemmas, chosen)
