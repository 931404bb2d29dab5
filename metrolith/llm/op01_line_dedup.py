"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A window is the shortest run of lines from a line on that has `window` lines or more than `words` words (runs
of characters that are no ASCII blank).  Of each window's line hashes the smallest, the rightmost on ties, is
selected; a selected position with all windows that select it is one fingerprint, about one for each two or
three lines.  What is guaranteed: runs of lines that repeat and hold a whole window, so all of `window` lines
or of more than `words` words, a single long line too, share that window's fingerprint.  Shorter repeats stay.

Fingerprints whose hash stands at one position only are dropped by a count.  The others' positions are joined,
and matches are extended to both sides through the windows around each position: a window's lines, by two
hashes of 64 bits for each line, meet the first place in the corpus that has them.  Consecutive windows add up
to the longest run that repeats.  A line goes if a window over it also stands earlier: in a smaller doc_id, or
earlier in its own document.

Every exchange before the texts' own carries hashes and positions only.  Counts and first places are sums
and minima with map-side combination, and the joins back are on one row for each key, which adaptive
execution can split, so a line that a third of all documents hold burdens no single task.  Sides of at most
BROADCAST_BYTES (common) are broadcast; beyond that the same joins shuffle.

Defined cases: null and empty texts have no lines; lines are cut at line feeds and compared as they are,
blank ones too; a document without a whole window is one window and meets others of its kind; null ids come
first; rows with equal id and text are one document to this operator and all keep what the first keeps; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm.common import Staged, checked, read

WINDOW = 4
WORDS = 50
NO_BLANK = r"[^\x20\x09-\x0D]+"


def _sized(counts: Column, i: Column, window: int, words: int | None) -> Column:
    """The number of lines of the window that starts at line i, null if the text ends before it does."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
    full = lambda a: (a["w"] > words) if words is not None else F.lit(False)
    grown = lambda a, c: F.when(full(a), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["w"] + c).alias("w")))
    return F.aggregate(F.slice(counts, i + 1, F.lit(window)), start, grown, lambda a: F.when((a["n"] == window) | full(a), a["n"]))


def _fingerprints(docs: DataFrame, window: int, words: int | None) -> DataFrame:
    """A row per fingerprint: its document, its hash, and the windows that select it (first line i, lines n, and
    two hashes of all their lines). Windows are made within the row, so that exploding copies no lines."""
    hashes = lambda seed: F.transform("lines", lambda x: F.xxhash64(*seed, x))
    counts = F.transform("lines", lambda x: F.regexp_count(x, F.lit(NO_BLANK)) if words is not None else F.lit(0))
    docs = docs.filter(F.size("lines") > 0).withColumns({"h1": hashes([]), "h2": hashes([F.lit(7)]), "counts": counts})
    starts = F.sequence(F.lit(0), F.size("counts") - 1)
    whole = F.filter(F.transform(starts, lambda i: F.struct(i.alias("i"), _sized(F.col("counts"), i, window, words).alias("n"))), lambda w: w["n"].isNotNull())
    docs = docs.select("doc_id", "th", "h1", "h2", whole.alias("wins"))
    docs = docs.withColumn("wins", F.when(F.size("wins") > 0, F.col("wins")).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.size("h1").alias("n")))))

    def selected(w: Column) -> Column:
        """Hash and negated place of the window's smallest line hash; of equal ones the rightmost."""
        return F.array_min(F.transform(F.slice("h1", w["i"] + 1, w["n"]), lambda h, j: F.struct(h.alias("h"), (-(w["i"] + j)).alias("back"))))

    docs = docs.withColumn("picks", F.transform("wins", selected))
    new = lambda k: (k == 0) | (F.get("picks", k)["back"] != F.get("picks", k - 1)["back"])
    docs = docs.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.size("picks") - 1), new))

    def keyed(w: Column) -> Column:
        key = lambda seed, hs: F.xxhash64(F.lit(seed), w["n"], F.slice(hs, w["i"] + 1, w["n"]))
        return F.struct(w["i"].alias("i"), w["n"].alias("n"), key(1, "h1").alias("k1"), key(2, "h2").alias("k2"))

    def fingerprint(first: Column, k: Column) -> Column:
        own = F.slice("wins", first + 1, F.coalesce(F.get("firsts", k + 1), F.size("wins")) - first)
        return F.struct(F.get("picks", first)["h"].alias("print"), F.transform(own, keyed).alias("wins"))

    docs = docs.select("doc_id", "th", F.explode(F.transform("firsts", fingerprint)).alias("f"))
    return docs.select("doc_id", "th", "f.print", "f.wins")


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), words: int | None = WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept), a row per document row; `kept` is the text that stays. The columns
    named in `carry` follow, in a struct `carried`. With `words` None all windows have `window` lines."""
    staged = Staged(spark, "op1")
    text = F.coalesce("text", F.lit(""))
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).alias("none"))
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), carried.alias("carried"))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), "carried")
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    docs = docs.withColumn("lines", lines)
    prints = staged.put(_fingerprints(docs, window, words))

    shared = staged.put(prints.groupBy("print").agg(F.count("*").alias("c")).filter("c > 1").select("print"))
    near = prints.join(checked(shared), "print", "left_semi")
    near = staged.put(near.select("doc_id", "th", F.explode("wins").alias("w")).select("doc_id", "th", "w.*"))
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "th", "i")
    first = near.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").select("k1", "k2", "first")
    first = staged.put(first)
    later = near.join(checked(first), ["k1", "k2"]).filter(~F.col("first").eqNullSafe(place)).select("doc_id", "th", "i", "n").distinct()
    gone = later.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("i") + 1, F.col("i") + F.col("n"))))).alias("gone"))
    gone = staged.put(gone.select(F.col("doc_id").alias("id2"), F.col("th").alias("th2"), "gone"))
    for old in (prints, shared, near, first):
        staged.drop(old)

    # If the removed lines are few, the texts need not move to meet them.
    out = docs.select("doc_id", "th", "text", "carried").join(checked(gone), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    out = out.withColumn("lines", lines).withColumn("n_lines", F.size("lines").cast("bigint"))
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda j: F.element_at("lines", j)), "\n"))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone").cast("bigint"), F.lit(0)).alias("n_removed"), kept.alias("kept"), "carried")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS lines FROM documents
), counted AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS cs FROM d WHERE len(lines) > 0
), starts AS (
  SELECT doc_id, lines, cs, unnest(range(1, len(lines) + 1)) AS i FROM counted
), sized AS (
  SELECT doc_id, lines, i, list_min(list_filter([1, 2, 3, 4], lambda n: i + n - 1 <= len(lines) AND (n = 4 OR list_sum(cs[i:i + n - 1]) > 50))) AS n FROM starts
), wins AS (
  SELECT doc_id, lines, i, n FROM sized WHERE n IS NOT NULL
  UNION ALL SELECT doc_id, lines, 1 AS i, len(lines) AS n FROM counted WHERE doc_id NOT IN (SELECT doc_id FROM sized WHERE n IS NOT NULL)
), later AS (
  SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, array_to_string(lines[i:i + n - 1], chr(10)) ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM later
), per_doc AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda j: NOT list_contains(coalesce(js, []), j)), lambda j: lines[j]), chr(10))) AS kept_sha256
FROM d LEFT JOIN per_doc USING (doc_id)
"""
