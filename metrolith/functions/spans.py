"""Where a pattern's matches stand in a text, as column expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions.held import held


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def constant_map(values: dict, of: str) -> Column:
    """A map as one literal of the plan; `of` is the type of its values."""
    text = json.dumps(values)
    return held((of, text), lambda: F.from_json(F.lit(text), f"map<string,{of}>"))


def constant_lookup(values: dict, of: str, key: Column) -> Column:
    """A large constant map's value of a key, null if it has none.

    The map is one literal of the plan, an array of small maps by the key's checksum, because Spark searches a
    map from its first entry to its last.
    """
    n = max(1, len(values) // 8)

    def dealt() -> Column:
        buckets: list[dict] = [{} for _ in range(n)]
        for k, v in values.items():
            buckets[zlib.crc32(k.encode()) % n][k] = v
        return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{of}>>")

    table = held(("lookup", of, json.dumps(values)), dealt)
    return let(key, lambda x: F.try_element_at(F.get(table, F.pmod(F.crc32(x.cast("binary")), F.lit(n)).cast("int")), x))


SPANS = "array<struct<start:int,end:int,text:string>>"


def located(text: Column, pattern: str) -> Column:
    """(start, end, text) of every match; what lies between two matches gives their places."""
    return let(text, lambda t: _located(t, pattern))


def _located(text: Column, pattern: str) -> Column:
    return placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def placed(hits: Column, gaps: Column) -> Column:
    """(start, end, text) of matches, given the texts between them."""
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["gap"])
        b = a + F.length(p["hit"])
        return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end"), p["hit"].alias("text"))).cast(SPANS).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def masked(text: Column, pattern: str, mark: str) -> Column:
    """The text with every match replaced by as many marks; places stay."""
    return let(text, lambda t: _masked(t, pattern, mark))


def _masked(text: Column, pattern: str, mark: str) -> Column:
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.repeat(F.lit(mark), F.coalesce(F.length(hit), F.lit(0)))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


BRACKETS = r"\([^()]*\)"
BETWEEN_COMMAS = r",[^,]*,"
