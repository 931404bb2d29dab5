"""Clauses: intervals of tokens between conjunctions and punctuation.

clauses() works within a row, so it also runs on streams; clause_table() gives the same as a running sum
over exploded tokens, for joins and corpus statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metrolith.functions.spans import let

SHORTEST = 3
#: Token classes that end a clause: and, or, comma, full stop, other punctuation.
BREAKS = "ARk.z"


def clauses(code: Column) -> Column:
    """array<struct<lo,hi>>: inclusive token intervals of a sentence's class string; a part of fewer than
    SHORTEST tokens joins the one before it."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def cut(c: Column) -> Column:
        pieces = F.filter(F.transform(F.split(c, "", -1), lambda x, i: F.when(F.lit(BREAKS).contains(x) & (x != ""), i)), lambda i: i.isNotNull())
        ends = F.array_distinct(F.concat(pieces, F.array(F.length(c) - 1)))

        def step(acc: Column, end: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            lo = F.coalesce(last["hi"] + 1, F.lit(0))
            fresh = F.array(F.struct(lo.alias("lo"), end.alias("hi")))
            fused = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), end.alias("hi"))))
            return F.when(end < lo, acc).when((end - lo + 1 < SHORTEST) & (F.size(acc) > 0), fused).otherwise(F.concat(acc, fresh)).cast("array<struct<lo:int,hi:int>>")

        return F.when(F.length(c) > 0, F.aggregate(ends, empty, step)).otherwise(empty)

    return let(code, cut)


def clause_table(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """tokens (key, i, is_break) with clause, the number of breaks before each token."""
    before = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn("clause", F.coalesce(F.sum(F.col("is_break").cast("int")).over(before), F.lit(0)))


LINKS = "AR"


def with_shared_units(quantities: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """extract()'s rows; a value without a unit takes that of another one of its sentence.

    Of the next value, if that ends two or three tokens on in the same clause (`8 then $9`), else of a value of
    the clause before or behind that is built alike: the clauses' class letters, without what joins them, agree but for a fifth of the
    longer one (two fifths if one begins or ends with `and` or `or`), and equally many tokens, give or take two,
    stand behind the values.  One exchange by sentence, which holds few rows.
    """
    w = W.partitionBy(*ids, "sent_no").orderBy("ord")
    bare = (F.col("unit_norm") == "-") & ~F.col("one_of")
    fields = ["unit_norm", "unit_scientific", "unit_keys", "unit_surface", "clause", "clause_code", "clause_rest", "ord"]
    out = quantities.select("*", F.lead(F.struct(*fields)).over(w).alias("_next"), F.lag(F.struct(*fields)).over(w).alias("_last"))

    def parallel(o: Column) -> Column:
        plain = lambda c: F.translate(c, "N" + BREAKS, "n")
        one, two = plain(F.col("clause_code")), plain(o["clause_code"])
        size = F.greatest(F.length(one), F.length(two))
        linked = F.exists(F.array(F.col("clause_code"), o["clause_code"]), lambda c: c.rlike(f"^[{LINKS}]|[{LINKS}]$"))
        slack = F.when(linked, 0.4).otherwise(0.2)
        return (F.abs(o["clause"] - F.col("clause")) == 1) & (F.levenshtein(one, two) <= size * slack) & (F.abs(o["clause_rest"] - F.col("clause_rest")) < 3)

    has = lambda o: o.isNotNull() & (o["unit_norm"] != "-")
    near = (F.col("_next.clause") == F.col("clause")) & (F.col("clause_rest") - F.col("_next.clause_rest")).between(2, 3)
    other = F.when(has(F.col("_next")) & near, F.col("_next")).when(has(F.col("_last")) & parallel(F.col("_last")), F.col("_last")).when(has(F.col("_next")) & parallel(F.col("_next")), F.col("_next"))
    out = out.withColumn("_unit", F.when(bare, other))
    taken = {c: F.when(F.col("_unit").isNotNull(), F.col("_unit")[c]).otherwise(F.col(c)) for c in fields[:4]}
    return out.withColumns(taken).drop("_next", "_last", "_unit")


def shared_units(quantities: DataFrame, key: str = "doc_id") -> DataFrame:
    """A bare number takes the next number's unit if that starts two or three tokens later in its clause.

    quantities: (key, i, clause, unit), i being the number's token; an as-of look-up of the next row.
    """
    w = W.partitionBy(key).orderBy("i")
    near = (F.lead("i").over(w) - F.col("i")).between(2, 3) & (F.lead("clause").over(w) == F.col("clause"))
    return quantities.withColumn("unit", F.coalesce("unit", F.when(near, F.lead("unit").over(w)), F.lit("-")))
