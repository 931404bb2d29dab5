"""Licence scan: runs of lines compared with licence templates by the Dice coefficient of word bigrams.

A text's segments are all runs of consecutive lines that have words.  A segment matches a template if
twice the number of bigrams they share, over the sum of their numbers of distinct bigrams, reaches `LIMIT`.
Sizes prune candidates, and never a match: of a template with b bigrams a matching segment has at least
LIMIT / (2 - LIMIT) * b of them, so a text that has fewer is done with one look-up of its bigrams; and a
segment has at most (2 - LIMIT) / LIMIT * b bigrams, so runs stop growing there.

A text of which no run of lines matches is searched for windows of words, inside lines and over their ends,
and against whole licence texts (folder `licenses`) beside the notices.  A window that begins or ends with a
bigram that it holds twice, or that the template has not, is no better than without it, so only windows
between other bigrams are tried.  n_segments is then the largest number of matching windows that share no word.

Texts do not shuffle.  Words are compared by 64-bit hash.

Defined cases: a null or empty text, and one of fewer than two words, matches nothing; repeated rows are
scanned each; ties go to the template whose name comes first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from metrolith.llm.common import blocks, mixed, narrow, raw, read, tidied
from metrolith.llm.op02_decontamination import _LOWER, _WORD, words_of

LIMIT = 0.8
RESULT_SCHEMA = "doc_id bigint, n_segments bigint, license string, dice double"

# Notices and opening passages of public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def whole_texts() -> dict[str, str]:
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def bigrams_of(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class Templates:
    def __init__(self, texts: dict[str, str], limit: float):
        self.names, self.limit = sorted(texts), limit
        sets = [np.unique(bigrams_of(words_of(pa.array([texts[n]]))[0])) for n in self.names]
        self.sizes = np.array([len(s) for s in sets])
        self.known = np.unique(np.concatenate(sets))
        self.has = np.array([np.isin(self.known, s) for s in sets]).T  # a row for each known bigram
        self.least = np.ceil(limit / (2 - limit) * self.sizes - 1e-9)
        self.most = int((2 - limit) / limit * self.sizes.max() + 1e-9)

    def best(self, words: np.ndarray, line: np.ndarray) -> tuple[int, str | None, float]:
        """Matching runs, and the best template with its coefficient. line: each word's line number."""
        if len(words) < 2:
            return 0, None, 0.0
        grams = bigrams_of(words)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        number = np.where(self.known[at] == grams, at, -1)
        inside = np.unique(number[number >= 0])
        if not (self.has[inside].sum(axis=0) >= self.least).any():
            return 0, None, 0.0
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])).tolist()
        ends = [*starts[1:], len(words)]
        count, top, name = 0, 0.0, None
        for a, start in enumerate(starts):
            seen: set[int] = set()
            shared = np.zeros(len(self.names), np.int64)
            done = start
            for end in ends[a:]:
                for g, k in zip(grams[done : end - 1].tolist(), number[done : end - 1].tolist(), strict=True):
                    if g not in seen:
                        seen.add(g)
                        if k >= 0:
                            shared += self.has[k]
                done = max(done, end - 1)
                if len(seen) > self.most:
                    break
                dice = 2 * shared / (self.sizes + len(seen))
                i = int(dice.argmax())
                if dice[i] >= self.limit:
                    count += 1
                    if (-dice[i], self.names[i]) < (-top, name or ""):
                        top, name = float(dice[i]), self.names[i]
        return count, name, top

    def within(self, words: np.ndarray) -> tuple[int, str | None, float]:
        """The largest number of disjoint matching word windows, and the best template with its coefficient."""
        if len(words) < 2:
            return 0, None, 0.0
        grams = bigrams_of(words)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        number = np.where(self.known[at] == grams, at, -1)
        fits = np.flatnonzero(self.has[np.unique(number[number >= 0])].sum(axis=0) >= self.least)
        if not len(fits):
            return 0, None, 0.0
        order = np.argsort(grams, kind="stable")
        same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
        before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))  # where each bigram stands next
        before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
        found, top, name = [], 0.0, None
        for t in fits.tolist():
            hit = (number >= 0) & self.has[number, t]
            most = (2 - self.limit) / self.limit * self.sizes[t] + 1e-9
            for a in np.flatnonzero(hit).tolist():
                n = int(most) + 1
                while True:
                    part = slice(a, min(a + n, int(after[a])))
                    new = before[part] < a
                    distinct = np.cumsum(new)
                    if part.stop < a + n or distinct[-1] > most:
                        break
                    n *= 2
                dice = 2 * np.cumsum(new & hit[part]) / (self.sizes[t] + distinct)
                high = float(dice.max())
                if high >= self.limit:
                    found.append((a + int((dice >= self.limit).argmax()) + 2, a))
                    if (-high, self.names[t]) < (-top, name or ""):
                        top, name = high, self.names[t]
        count = free = 0
        for end, start in sorted(found):
            if start >= free:
                count, free = count + 1, end
        return count, name, top


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """RESULT_SCHEMA, a row per document row."""
    known, wide = Templates(templates, limit), Templates(whole_texts() | templates, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1 << 20):
            words, first, line = lined(block.column(1))
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                lines = known.best(words[a:b], line[a:b])
                out.append(lines if lines[0] else wide.within(words[a:b]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([round(o[2], 6) for o in out], pa.float64())], names=["doc_id", "n_segments", "license", "dice"])

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(tidied(run), RESULT_SCHEMA)


def lined(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words_of, and each word's line number over the whole block."""
    words, first = words_of(text)
    data, offsets = raw(text)
    inside = _WORD[_LOWER[data]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] |= inside[cut]
    return words, first, np.cumsum(data == 10)[np.flatnonzero(begins)]


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
ORACLE = f"""
WITH t AS (
  SELECT name, {_PAIRS.format('w')} AS g FROM (SELECT name, {_WORDS.format('body')} AS w FROM (VALUES {', '.join(f"('{n}', '{b}')" for n, b in TEMPLATES.items())}) AS v(name, body))
), d AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {_WORDS.format('l')}), lambda w: len(w) > 0) AS lines FROM documents
), wide AS (
  SELECT doc_id, lines, {_PAIRS.format('w')} AS g FROM (SELECT doc_id, lines, flatten(lines) AS w FROM d)
), may AS (
  SELECT DISTINCT doc_id, lines FROM wide, t WHERE len(list_intersect(wide.g, t.g)) >= {LIMIT} / (2 - {LIMIT}) * len(t.g) - 1e-9
), runs AS (
  SELECT doc_id, a, b, flatten(lines[a:b]) AS w FROM (SELECT doc_id, lines, a, unnest(range(a, len(lines) + 1)) AS b FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS a FROM may))
), sets AS (
  SELECT doc_id, a, b, {_PAIRS.format('w')} AS g FROM runs
), scored AS (
  SELECT doc_id, a, b, name, 2 * len(list_intersect(sets.g, t.g)) / (len(sets.g) + len(t.g)) AS dice FROM sets, t
), hits AS (
  SELECT doc_id, count(DISTINCT (a, b)) AS n_segments, arg_min(name, (-dice, name)) AS license, max(dice) AS dice FROM scored WHERE dice >= {LIMIT} GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_segments, 0) AS n_segments, license, round(coalesce(dice, 0.0), 6) AS dice FROM d LEFT JOIN hits USING (doc_id)
"""
