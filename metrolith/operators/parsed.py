"""Quantities out of supplied parses: matches of the dependency rules become flags, candidates and rows.

A sentence's tokens and matches are one row (rules.in_row_matches, the only exchange).  What its tokens are to
each other depends on the order of matches and on walks over the tree, so a Python function over Arrow batches
takes each sentence by itself and hands on words: of the value, the bound, the unit and the concept.  Numbers,
bounds and units are then normalized by the column expressions that extract() uses.

1. Tokens of phone numbers, ZIP codes, times and dates are ignored.  Matches that hold one, that mix tokens
   in and out of brackets, or that are wider than five tokens without `between` or brackets, are dropped.
2. Each family of rules marks its tokens (FLAGS), earlier families first.
3. Matches that share a token are one candidate, transitively; in it, marked tokens are numbers, bounds and
   unit words.  Numbers that stand side by side are one value.  Dimensions, lists, and several values without
   a common range are a row each, and share the other tokens; three values of overlapping ranges are two ranges.
4. A value without a unit takes that of the next value two or three tokens on in its clause, with no verb or
   punctuation between, or of a value at the same place of a neighbouring clause that is built alike.
5. The concept is looked for around the quantity, then over the verb, then at the root (Sentence.concept).

Defined cases: a sentence without matches, and a match without a number, give no rows; heads outside the
sentence govern nothing; null words and tags are empty; an empty table gives no rows. A sentence's indices
follow one another, each once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.functions import bounds
from metrolith.functions.catalog import FORMS
from metrolith.functions.held import held
from metrolith.functions.ignore import PATTERNS
from metrolith.functions.lexicon import BOUND_LEMMAS, BROAD, FRACTIONS, NUMBER_WORDS, SCALES, STOP_WORDS
from metrolith.operators import extract as rows_of
from metrolith.operators import rules

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOUNS, PER, SPLIT = ("NOUN", "PROPN"), ("per", "a", "an"), ("x", "×")
_NUMERIC = frozenset({*NUMBER_WORDS, *SCALES, *FRACTIONS, *BROAD})
_BOUND_WORDS = frozenset(f for f in BOUND_LEMMAS if " " not in f)
_CURRENCY = frozenset(f for f, (_, _, entity, kind) in FORMS.items() if entity == "currency" and kind == "symbol")
_DATES = [re.compile(PATTERNS[p]) for p in ("I4", "I5", "I6", "I7", "I8", "I10")]

# Phone numbers and ZIP codes as token shapes: 1, 2, 3 a token of so many digits, f of four, g of
# more, p a digit with a closing bracket and digits behind, Z the word ZIP.
SHAPES = {"phone_number_pattern_1": r"\(1\)2-?3-?[fg]", "phone_number_pattern_2": r"\(p-?3-?[fg]", "phone_number_pattern_3": r"\(3\)[fg]-?[fg]", "phone_number_pattern_4": r"\(3\)3-?3", "phone_number_pattern_5": r"\+2\(?[fg]\)?[fg]", "zip_number_pattern": r"gZ"}

FLAGS = ("number", "bound", "unit", "broad", "left", "right", "numerator", "denominator", "one_of")
MODIFIERS = frozenset({"NUM_QUANTMOD", "MINUS_NUM", "QUANTMOD_DIRECT_NUM", "VERB_QUANTMOD_NUM", "VERB_QUANTMOD2_NUM"})
BETWEEN = frozenset({"ADP_NUM_CCONJ_NUM", "ADP_NUM_CCONJ_NUM_WITH_UNIT"})
_WORDS = pa.list_(pa.string())
OUT = {"anchor": pa.int32(), "toks": pa.list_(pa.int32()), "shape": pa.string(), "a_words": _WORDS, "z_words": _WORDS, "b_words": _WORDS, "own_words": _WORDS, "p_words": _WORDS, "c_word": pa.string(), "minus": pa.bool_(), "words": _WORDS, "concepts": _WORDS, "in_bracket": pa.bool_(), "value_toks": pa.list_(pa.int32()), "unit_toks": pa.list_(pa.int32())}
SQL = "anchor int, toks array<int>, shape string, a_words array<string>, z_words array<string>, b_words array<string>, own_words array<string>, p_words array<string>, c_word string, minus boolean, words array<string>, concepts array<string>, in_bracket boolean, value_toks array<int>, unit_toks array<int>"


def shape_code(texts: list[str]) -> str:
    """One letter a token, for SHAPES."""

    def letter(t: str) -> str:
        if t in ("(", ")", "-", "+"):
            return t
        if t.isascii() and t.isdigit():
            return "0123fg"[min(len(t), 5)]
        return "Z" if t == "ZIP" else "p" if re.fullmatch(r"[0-9]\)[0-9]*", t) else "x"

    return "".join(map(letter, texts))


@dataclass
class Candidate:
    """Tokens of one quantity: its numbers by value, and the others by role."""

    values: list[list[int]]
    bound: list[int]
    unit: list[int]
    shape: str = "single"


@dataclass
class Sentence:
    toks: list[dict]
    flags: dict[str, set[int]] = field(default_factory=lambda: {f: set() for f in FLAGS})

    def __post_init__(self) -> None:
        n = len(self.toks)
        self.text = [t["text"] for t in self.toks]
        self.low = [t.lower() for t in self.text]
        self.pos = [t["pos"] for t in self.toks]
        self.dep = [t["dep"] for t in self.toks]
        self.head = [t["head"] if t["head"] is not None and 0 <= t["head"] < n else i for i, t in enumerate(self.toks)]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i, h in enumerate(self.head):
            if h != i:
                self.children[h].append(i)
        self.bracket = self._between("(", ")")
        self.ignored = self._ignored()

    def _between(self, opens: str, closes: str) -> set[int]:
        out, start = set(), None
        for i, t in enumerate(self.text):
            if start is not None and t == closes:
                out |= set(range(start + 1, i))
                start = None
            elif start is None and t == opens:
                start = i
        return out

    @property
    def commas(self) -> set[int]:
        """Tokens between two commas, taken in pairs from the left."""
        return self._between(",", ",")

    def _ignored(self) -> set[int]:
        code, out = shape_code(self.text), set()
        for shape in SHAPES.values():
            for m in re.finditer(shape, code):
                out |= set(range(m.start(), m.end()))
        at, starts = 0, []
        for t in self.text:
            starts.append(at)
            at += len(t) + 1
        line = " ".join(self.text)
        for p in _DATES:
            for m in p.finditer(line):
                out |= {i for i, s in enumerate(starts) if s < m.end() and s + len(self.text[i]) > m.start() and any(c.isdigit() for c in self.text[i])}
        return out

    def numeric(self, i: int) -> bool:
        return self.pos[i] == "NUM" or self.low[i] in _NUMERIC

    # -- matches

    def fits(self, toks: list[int]) -> bool:
        inside = [t in self.bracket for t in toks]
        if any(t in self.ignored for t in toks) or (any(inside) and not all(inside)):
            return False
        return max(toks) - min(toks) <= 5 or any(inside) or any(self.low[t] in ("between", "from") for t in toks)

    def mark(self, family: str, toks: list[int]) -> None:
        """What a match of the family says of its tokens."""
        f, order = self.flags, sorted(set(toks))
        nums = [t for t in order if self.numeric(t)]
        if family in MODIFIERS:
            units = {t for t in order if self.pos[t] in NOUNS and t > nums[0] and self.low[t] not in _BOUND_WORDS} if nums else set()
            f["number"] |= set(nums)
            f["unit"] |= units
            f["bound"] |= set(order) - set(nums) - units
        elif family == "LONELY_NUM":
            f["number"] |= set(order) - f["unit"]
        elif family == "COMPOUND_NUM":
            f["number"] |= set(order)
        elif family in ("RANGE_SINGLE", "RANGE_DOUBLE"):
            broad = {t for t in order if self.low[t] in BROAD}
            f["number"] |= broad
            f["broad"] |= broad
            f["unit"] |= {t for t in order if self.pos[t] in NOUNS} - broad
        elif family == "FRAC" and nums:
            f["number"] |= set(nums)
            f["numerator"].add(nums[0])
            f["denominator"].add(nums[-1])
        elif family == "ONE_OF":
            nouns = [t for t in order if t not in nums and self.pos[t] in NOUNS]
            if any(self.text[c].isdigit() for t in nouns for c in self.children[t]):
                return
            f["number"] |= set(nums)
            f["one_of"] |= {*nums, *nouns}
        elif family == "UNIT_FRAC":
            pivot = next((t for t in order if self.low[t] in PER), len(self.text))
            self._default([t for t in order if t < pivot])
            right = {t for t in order if t >= pivot}
            f["unit"] |= right
            f["number"] -= right
            f["bound"] -= right
        elif family == "NUM_TO_NUM":
            self._range(nums, order)
        elif family in BETWEEN:
            words = [t for t in order if self.low[t] in ("between", "from", "and", "to")]
            if order[-1] - order[0] <= 10 and (len(words) < 2 or words[-1] - words[0] < 6):
                f["unit"] |= {t for t in order if not self.numeric(t)} - set(words)
                self._range(nums, words)
        else:
            self._default(order)

    def _range(self, nums: list[int], others: list[int]) -> None:
        f = self.flags
        f["number"] |= set(nums)
        ends = [t for t in nums if self.low[t] not in SCALES] or nums
        if len(ends) > 1:
            f["left"].add(ends[0])
            f["right"].add(ends[-1])
        f["bound"] |= set(others) - set(nums)

    def _default(self, order: list[int]) -> None:
        f = self.flags
        nums = [t for t in order if self.numeric(t) and t not in f["unit"]]
        f["number"] |= set(nums)
        for t in order:
            if t not in nums and not self.numeric(t):
                before = bool(nums) and t < nums[-1] and (self.low[t] in _BOUND_WORDS or self.pos[t] not in (*NOUNS, "ADJ", "SYM"))
                f["bound" if before else "unit"].add(t)

    # -- candidates

    def candidates(self, matches: list[dict]) -> list[Candidate]:
        groups: list[set[int]] = []
        for m in sorted((m for m in matches if self.fits(m["toks"])), key=lambda m: m["priority"]):
            self.mark(m["family"], m["toks"])
            touching = [g for g in groups if g & set(m["toks"])]
            groups = [g for g in groups if not g & set(m["toks"])] + [set(m["toks"]).union(*touching)]
        return [c for g in sorted(groups, key=min) for c in self.split(sorted(g))]

    def split(self, group: list[int]) -> list[Candidate]:
        f = self.flags
        bound = [t for t in group if t in f["bound"] and t not in f["number"]]
        nums = [t for t in group if t in f["number"]]
        if bound and not any(self.low[t] in ("to", "out", "of", "-", "and", "by") for t in bound):
            nums = [t for t in nums if not (t + 1 == bound[0] and len(nums) > 1)]
        unit = [t for t in group if t not in bound and t not in f["number"] and self.low[t] not in (*SPLIT, "-", "of", "and", "to")]
        runs: list[list[int]] = []
        for t in nums:
            joined = runs and t == runs[-1][-1] + 1 and not (self.text[t][0].isdigit() and self.text[t - 1][0].isdigit())
            runs[-1].append(t) if joined else runs.append([t])
        if not runs:
            return []
        has = lambda run, flag: any(t in f[flag] for t in run)
        if any(t in f["one_of"] for t in nums) and any(t in f["one_of"] for t in unit):
            return [Candidate(runs[:1], [], [t for t in unit if t in f["one_of"]], "one_of")]
        if any(has(r, "broad") for r in runs):
            return [Candidate([sum(runs, [])], bound, unit, "broad")]
        if any(self.low[t] in SPLIT for t in group) or not any(has(r, "left") or has(r, "numerator") for r in runs):
            return [Candidate([r], bound, unit) for r in runs]
        pairs, alone, k = [], [], 0
        while k < len(runs):
            two = runs[k : k + 2]
            if len(two) == 2 and ((has(two[0], "left") and has(two[1], "right")) or (has(two[0], "numerator") and has(two[1], "denominator"))):
                pairs.append(Candidate(two, bound, unit, "fraction" if has(two[0], "numerator") and not has(two[0], "left") else "range"))
                k += 1 if has(two[1], "left") else 2
            else:
                if not (pairs and runs[k] in pairs[-1].values):
                    alone.append(Candidate([runs[k]], bound, unit))
                k += 1
        return pairs + alone

    # -- clauses and shared units

    def clauses(self) -> list[int]:
        """Each token's clause; clauses of fewer than three tokens join the one before."""
        out, now, size = [], 0, 0
        for i, (p, low) in enumerate(zip(self.pos, self.low, strict=True)):
            joint = (p == "CCONJ" or self.dep[i] == "mark") and i not in self.flags["bound"] and self.dep[i] != "quantmod" and self.head[i] != i - 1 and not (i + 1 < len(self.pos) and self.pos[i + 1] == "VERB")
            if (joint or (p == "PUNCT" and low not in ("(", ")", "=", "-"))) and size >= 3:
                now, size = now + 1, 0
            out.append(now)
            size += 1
        if out and size < 3 and now:
            out = [min(c, now - 1) for c in out]
        return out

    def share_units(self, found: list[Candidate]) -> None:
        clause = self.clauses()
        end = {c: i for i, c in enumerate(clause)}
        for c in found:
            if c.unit or c.shape == "one_of":
                continue
            last = c.values[-1][-1]
            for other in found:
                first = other.values[0][0]
                here, there = clause[last], clause[first]
                if not other.unit or other is c:
                    continue
                lead = min([first, *[u for u in other.unit if u > last]])
                near = here == there and 2 <= first - last <= 3 and not any(self.pos[i] in ("VERB", "PUNCT") for i in range(last + 1, lead))
                alike = abs(here - there) == 1 and self.parallel(clause, here, there) and abs((end[here] - last) - (end[there] - max([other.values[-1][-1], *other.unit]))) < 3
                if near or alike:
                    c.unit = list(other.unit)
                    break

    def parallel(self, clause: list[int], a: int, b: int) -> bool:
        """Whether two clauses have like parts of speech in like order: the longest common part, over the shorter."""
        one, two = ([p for p, k in zip(self.pos, clause, strict=True) if k == c and p not in ("CCONJ", "SCONJ", "PUNCT")] for c in (a, b))
        if not one or not two:
            return False
        row = [0] * (len(two) + 1)
        for p in one:
            last = 0
            for j, q in enumerate(two, 1):
                last, row[j] = row[j], last + 1 if p == q else max(row[j], row[j - 1])
        linked = any(w in ("while", "whilst", "whereas", "but", "and") for w, k in zip(self.low, clause, strict=True) if k in (a, b))
        return row[-1] / min(len(one), len(two)) >= (0.6 if linked else 1.0)

    # -- concepts

    def noun(self, i: int, taken: set[int], depth: int = 4) -> list[int]:
        """A noun with its describing children, of them the nearest levels."""
        out, level = {i}, [i]
        for _ in range(depth):
            level = [c for t in level for c in self.children[t] if c not in taken and self.dep[c] in ("compound", "amod", "nmod", "poss", "flat", "name") and (self.pos[c] not in ("NUM", "PUNCT", "SYM", "VERB") or (self.dep[c] == "amod" and self.pos[c] == "VERB"))]
            out |= set(level)
        return sorted(out - taken)

    def concept(self, c: Candidate) -> list[int]:
        own = {t for v in c.values for t in v} | set(c.unit) | set(c.bound)
        first, last = min(own), max(own)
        nouns = lambda ts: [t for t in ts if 0 <= t < len(self.pos) and self.pos[t] in NOUNS and t not in own]
        below = lambda t: nouns(sorted(self.children[t]))
        for look in (self._behind, self._before_of, self._before_adposition, self._out_of_bracket, self._subject, self._relative, self._root, self._object):
            for t in look(first, last, own, nouns, below):
                if words := self.cleaned(self.noun(t, own), own):
                    return words
        alone = [t for t in nouns(range(len(self.pos))) if t not in self.flags["unit"]]
        return self.cleaned(self.noun(alone[0], own), own) if len(alone) == 1 else []

    def cleaned(self, words: list[int], own: set[int]) -> list[int]:
        return [t for t in words if t not in own and self.low[t] not in STOP_WORDS and self.pos[t] not in ("PUNCT", "DET", "PRON") and t not in self.ignored and not self.numeric(t)]

    def _behind(self, first, last, own, nouns, below):
        """`for`, `of` or `off` within two tokens behind: what it governs."""
        at = [t for t in range(last + 1, min(last + 3, len(self.low))) if self.low[t] in ("for", "of", "off")]
        return below(at[0]) or nouns(range(at[0] + 1, at[0] + 4)) if at else []

    def _before_of(self, first, last, own, nouns, below):
        """The noun before an `of` that stands within three tokens before; bounds such as `an increase of` are such nouns."""
        at = [t for t in range(max(0, first - 3), first + 1) if self.low[t] == "of"]
        return nouns(range(at[-1] - 1, at[-1] - 3, -1)) if at else []

    def _before_adposition(self, first, last, own, nouns, below):
        """Of a quantity that by, at, to or with governs, the noun just before that word, or the one it hangs on."""
        for t in sorted(own):
            h = self.head[t]
            if h not in own and self.low[h] in ("by", "at", "to", "with"):
                return nouns([h - 1]) or nouns([self.head[h]])
        return []

    def _out_of_bracket(self, first, last, own, nouns, below):
        if first not in self.bracket:
            return []
        free = lambda t: t not in self.bracket and t not in self.flags["unit"] and t in nouns([t])
        return [t for t in self.above(first) if free(t)] or [t for t in range(first - 1, -1, -1) if free(t)][:1]

    def above(self, t: int) -> list[int]:
        out = []
        while self.head[t] != t and self.head[t] not in out:
            t = self.head[t]
            out.append(t)
        return out

    def verbs(self, own: set[int]) -> list[int]:
        return [t for t in dict.fromkeys(a for o in sorted(own) for a in self.above(o)) if self.pos[t] in ("VERB", "AUX")]

    def _subject(self, first, last, own, nouns, below):
        """The subject of the nearest verb above, if it stands before; a determiner gives way to its head."""
        for v in self.verbs(own):
            for s in self.children[v]:
                if self.dep[s] in ("nsubj", "nsubjpass") and s < first:
                    t = self.head[s] if self.pos[s] == "DET" else s
                    if t in nouns([t]):
                        return [t]
        return []

    def _relative(self, first, last, own, nouns, below):
        """The noun that a relative clause describes; of an apposition, what it stands beside."""
        for v in self.verbs(own):
            if self.dep[v] == "relcl":
                t = self.head[v]
                return nouns([self.head[t] if self.dep[t] == "appos" else t])
        return []

    def _root(self, first, last, own, nouns, below):
        roots = [i for i, h in enumerate(self.head) if h == i]
        return [s for r in roots for s in self.children[r] if self.dep[s] in ("nsubj", "nsubjpass") and s in nouns([s])] or nouns([r for r in roots if self.pos[r] in NOUNS])

    def _object(self, first, last, own, nouns, below):
        """The object of a verb above, unless it is another quantity's unit."""
        return [s for v in self.verbs(own) for s in self.children[v] if self.dep[s] in ("dobj", "obj") and s in nouns([s]) and s not in self.flags["unit"]]


def assembled(toks: list[dict], matches: list[dict]) -> list[dict]:
    """The quantities (OUT) of a sentence."""
    s = Sentence(toks)
    found = s.candidates(matches)
    s.share_units(found)
    out = []
    for c in found:
        currency = [t for t in c.unit if s.text[t] in _CURRENCY]
        per = next((t for t in sorted(c.unit) if s.low[t] in PER and t > c.values[0][0]), None)
        words = [t for t in sorted(c.unit) if t not in currency and (per is None or t < per)]
        minus = [t for t in [*c.bound, *c.unit] if s.low[t] in ("minus", "-") and t < c.values[0][0]]
        words = [t for t in words if t not in minus]
        if c.shape == "single" and not words and not currency and not c.bound:
            i = c.values[0][0]
            behind = s.pos[c.values[0][-1] + 1] if c.values[0][-1] + 1 < len(s.pos) else ""
            if i and (s.pos[i - 1] == "PROPN" or (s.pos[i - 1] == "NOUN" and behind in ("VERB", "AUX"))):
                continue  # a name with its number
        value = [t for v in c.values for t in v]
        text = lambda ts: [s.text[t] for t in ts]
        out.append(
            {
                "anchor": value[0], "toks": sorted({*value, *c.bound, *c.unit}), "shape": c.shape,
                "a_words": [w.lower() for w in text(c.values[0])], "z_words": [w.lower() for w in text(c.values[1])] if len(c.values) > 1 else [],
                "b_words": text([t for t in c.bound if t not in minus and s.low[t] not in ("between", "from", "to", "and", "-")]),
                "own_words": text(words), "p_words": text([t for t in sorted(c.unit) if per is not None and t > per]),
                "c_word": s.text[currency[0]] if currency else None, "minus": bool(minus), "words": s.low,
                "concepts": [] if c.shape == "one_of" else text(s.concept(c)), "in_bracket": value[0] in s.bracket, "value_toks": value, "unit_toks": sorted(c.unit),
            }
        )
    return out


def parsed_quantities(tokens: DataFrame, default: tuple[rules.Rule, ...] = rules.REGISTERED) -> DataFrame:
    """A row for each quantity of each sentence of a token table (rules).

    doc_id, sent (if the table has it), anchor (index of the first number), toks, change, kind, lower, upper,
    unit_norm, unit_scientific, unit_keys, concepts, in_bracket, value_toks, unit_toks (token indices), one_of.
    """
    ids = rules.keys(tokens)
    found = rules.in_row_matches(tokens, default, ("toks",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(ids)
            kept, out = [], []
            for at, (toks, matches) in enumerate(zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)):
                for q in assembled(toks, matches or []):
                    kept.append(at)
                    out.append(q)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(n + 1)], *[pa.array([q[c] for q in out], t) for c, t in OUT.items()]], names=[*ids, "base", *OUT])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in (*ids, "base"))
    q = found.mapInArrow(run, f"{schema}, {SQL}")
    # The names that the shared expressions know.
    q = q.select("*", *held("p roles", lambda: [bounds.change(F.col("b_words")).alias("change"), F.lit(None).cast("string").alias("next"), F.lit("").alias("next_class")]))
    q = q.select("*", *held("p numbers", rows_of._numbers))
    q = q.select("*", *held("p ends", rows_of._ends))
    q = q.select("*", held("p is_m", lambda: F.lit(False).alias("is_m")))
    q = rows_of.normalized(q.select("*", *held("x signed", rows_of._signed)))
    moved = lambda c: F.transform(c, lambda t: t + F.col("base"))
    ranged = F.col("lower") != F.col("upper")
    q = q.filter("lower is not null").select(
        *ids, (F.col("anchor") + F.col("base")).alias("anchor"), moved("toks").alias("toks"), "change", F.when(ranged | F.col("shape").isin("range", "broad"), "range").otherwise("value").alias("kind"), "lower", "upper",
        "unit_norm", "unit_scientific", F.filter(F.array("left_key", "right_key"), lambda k: k.isNotNull()).alias("unit_keys"), "concepts", "in_bracket", moved("value_toks").alias("value_toks"), moved("unit_toks").alias("unit_toks"), (F.col("shape") == "one_of").alias("one_of"),
    )
    return q
