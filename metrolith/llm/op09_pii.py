"""Personal data: pattern spans and information-theoretic sanitisation, in DataFrame operations only.

Patterns find mail addresses, IP addresses, card and phone numbers; these are the protected entities.
A term discloses an entity as far as seeing the term tells of the entity: with N texts, P(e) the share of
texts that hold entity e, and P(e|t) the share of those with term t that hold it, the term's pointwise
mutual information log2(P(e|t) / P(e)) is set against the entity's own information -log2 P(e).  A term that
stands with an entity in at least `SUPPORT` different texts and gives away at least `DISCLOSED` of the
entity's information is itself protected: every occurrence becomes a span of kind `term`, which
sanitised() generalises like the others.  Equal texts are one text to SUPPORT, so plain copies prove nothing.

Only terms of texts with an entity that stands in SUPPORT texts are candidates; their frequencies are
counted over all texts.  All counts are distinct sums with map-side combination; texts meet their terms by
document, and rows of hot entities are split by adaptive execution.

Terms are compared without regard to case (folded()).
Spans are kind:start:end in code points, end exclusive, by kind (email, ip, card, phone, term), then start.
Base spans of one kind do not overlap; term spans that overlap a base span are left out.

Defined cases: a null text is empty; an empty text has no spans; repeated rows give a row each, equal rows
equal ones; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import Staged, checked, narrow, read

SUPPORT = 3
DISCLOSED = 0.95
WORD = r"[A-Za-z\x{80}-\x{10FFFF}]{3,}"

# The query's patterns. A match can only begin at the start of a run of its leading
# characters or where the last match ended, which a look-behind states so that long runs are read once.
_LOCAL, _HOST = r"A-Za-z0-9._%+-", r"[A-Za-z0-9-]"
KINDS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def folded(text: Column) -> Column:
    """Lower case, one code point for each: İ, whose lower case has two, counts as I."""
    return F.lower(F.translate(text, "İ", "I"))


def located(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of the pattern's matches: what lies between them gives their places."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["hit"].alias("value"))).cast(SPAN).alias("out"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def weighed(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


def _octet(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) > 3, False).otherwise(F.concat(F.lit("0"), plain).cast("int") <= 255)


CHECKS = {
    "email": None,
    "ip": lambda v: F.forall(F.split(v, r"\.", -1), _octet),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _kept(spans: Column, check) -> Column:
    return F.filter(spans, lambda s: check(s["value"]))


def base_spans(text: Column) -> Column:
    """The valid spans of all base kinds of a text, by kind and start."""
    lists = []
    for kind, pattern in KINDS.items():
        may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        if kind in ("ip", "card"):
            may = may & text.rlike("[0-9]{1}" if kind == "ip" else "[0-9](?:[ -]?[0-9]){15}")
        spans = located(text, F.lit(pattern), kind)
        if check := CHECKS[kind]:
            spans = _kept(spans, check)
        lists.append(F.when(may, spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*lists)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosing_terms(staged: Staged, docs: DataFrame, base: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(doc_id, th, terms): for each document the terms in it that disclose a protected entity; staged.

    docs: (doc_id, th, text); base: (doc_id, th, spans). th is a hash of the text.
    """

    def words(df: DataFrame) -> DataFrame:
        return df.withColumn("term", F.explode(F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0)))))

    n = docs.count()
    named = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], folded(s["value"]))))
    entities = base.filter(F.size("spans") > 0).select("th", F.explode(named).alias("entity")).groupBy("th", "entity").agg(F.count("*").alias("copies"))
    common = entities.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).filter(F.col("texts") >= support).drop("texts")
    pairs = staged.put(entities.join(common, "entity"))
    held = staged.put(pairs.select("th").distinct())
    near = docs.join(checked(held), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    both = words(near).select("th", "term").join(pairs, "th").groupBy("entity", "n_e", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts"))
    both = staged.put(both.filter(F.col("texts") >= support))
    terms = staged.put(both.select("term").distinct())
    few = checked(terms)
    if few is not terms:
        counts = words(docs).select("term").join(few, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    else:  # then every term is summed, on the map side first
        counts = words(docs).groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term")
    told = F.try_divide(F.log2(F.col("n_both") * n / (F.col("n_t") * F.col("n_e"))), F.log2(n / F.col("n_e")))
    bad = staged.put(both.join(counts, "term").filter((F.col("n_e") < n) & (told >= disclosed)).select("term").distinct())
    seen = words(docs).select("doc_id", "th", "term").join(checked(bad), "term")
    return staged.put(seen.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("term")).alias("terms")))


def find_pii(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(doc_id, text, base, terms): a row per document row, with arrays of spans."""
    staged = Staged(spark, "op9")
    docs = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    base = staged.put(docs.select("doc_id", "th", base_spans(F.col("text")).alias("spans")))
    listed = disclosing_terms(staged, docs, base, support, disclosed)
    return _located_terms(staged, docs, base, listed)


def _located_terms(staged: Staged, docs: DataFrame, base: DataFrame, listed: DataFrame) -> DataFrame:
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    edge = r"[A-Za-z\x{80}-\x{10FFFF}]"
    # A term is a whole word; its letters need no quoting. Folding keeps places.
    pattern = F.concat(F.lit(rf"(?<!{edge})(?:"), F.array_join("terms", "|"), F.lit(rf")(?!{edge})"))
    found = docs.alias("d").join(checked(listed).alias("l"), same("d", "l"))
    own = F.transform(located(folded(F.col("d.text")), pattern, "term"), lambda s: s.withField("value", F.substr(F.col("d.text"), s["start"] + 1, s["end"] - s["start"])))
    found = found.select("d.doc_id", "d.th", own.alias("terms")).dropDuplicates(["doc_id", "th"])
    out = base.alias("b").join(found.alias("f"), same("b", "f"), "left")
    free = F.filter(F.coalesce("f.terms", F.array().cast(SPAN)), lambda t: ~F.exists(F.col("b.spans"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return out.select("b.doc_id", "b.th", F.col("b.spans").alias("base"), free.alias("terms"))


def sanitised(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every found span generalised to its kind, such as <email>; of overlapping spans the
    first in text order is generalised and the others' remainders go."""
    texts = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = found.select(F.col("doc_id").alias("id2"), F.col("th").alias("th2"), F.concat("base", "terms").alias("spans")).dropDuplicates(["id2", "th2"])
    rows = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", done.alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark, read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "terms")).alias("spans"),
    )
