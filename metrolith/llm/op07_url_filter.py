"""URL filter: logistic regression on hashed character n-grams of host and path, in DataFrame operations only.

The regression is trained from a small labelled table (LABELLED, or the caller's).  Its weights are a sum
of the training urls' features, one coefficient for each url, so gradient descent needs only the urls'
inner products: they come from a join on feature buckets, and one fold over arrays does the steps.  The
resulting weights, `BUCKETS` numbers whatever the input, are a literal in the scoring expression; pages do
not shuffle.

Rules (host, path prefix, verdict) come before the regression; a rule fits its host and all subdomains, and
of several that fit the longest wins.

Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule, and gets the
regression's verdict on no n-grams; repeated rows are judged each; an empty table gives no rows; an empty
labelled table gives `allow`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metrolith.llm.common import narrow, read

BUCKETS = 1024
SIZES = (3, 4)
ITERATIONS = 300
RATE = 2.0
DECAY = 0.002
SCALE = 40.0
MOST_LABELLED = 2000

# The rules of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

# A small labelled table: 1 marks a url to block.
LABELLED = (
    (1, "http://spam-farm.example.com/en/1"), (1, "https://spam-farm.example.net/fr/20?ref=x"), (1, "http://link-farm.example.org/de/333"),
    (1, "https://www.spam-offers.example.com/es/4.html"), (1, "http://casino-bonus.example.net/win/free-spins"), (1, "https://best-casino.example.org/en/jackpot"),
    (1, "http://cheap-pills.example.com/buy/viagra"), (1, "https://pharmacy-cheap.example.net/pills/order-now"), (1, "http://adult-cams.example.org/live/xxx"),
    (1, "https://xxx-videos.example.com/porn/12"), (1, "http://ads.tracker.example.net/click/track?id=3"), (1, "https://adserver.example.org/banner/ads/9"),
    (1, "http://free-download-crack.example.com/warez/keygen"), (1, "https://torrent-warez.example.net/crack/serial"), (1, "http://login-verify-account.example.org/phish/secure"),
    (1, "https://malware-drop.example.com/payload/setup.exe"), (1, "http://get-rich-quick.example.net/loan/payday"), (1, "https://payday-loans.example.org/apply/now"),
    (1, "http://spam-blog.example.com/tag/seo/backlinks"), (1, "https://seo-backlinks.example.net/buy/links"), (1, "http://clickbait-farm.example.org/en/728?utm_source=feed"),
    (0, "http://blog.example.com/en/100"), (0, "https://www.example.net/fr/52.html"), (0, "http://m.example.org/de/7?page=2&ref=x"),
    (0, "https://news.example.com/en/2021/science"), (0, "http://library.example.net/catalog/books/12"), (0, "https://docs.example.org/guide/install"),
    (0, "http://wiki.example.com/es/articulo/3"), (0, "https://museum.example.net/de/sammlung/44"), (0, "http://university.example.org/courses/math"),
    (0, "https://www.garden.example.com/en/5#top"), (0, "http://recipes.example.net/fr/tarte/8"), (0, "https://weather.example.org/es/madrid"),
    (0, "http://blog.then.example.com/en/61.html"), (0, "https://m.there.example.net/en/99#top"), (0, "http://www.other.example.org/de/345?utm_source=feed"),
    (0, "https://thing.example.com/en/12?page=2&ref=x"), (0, "http://nation.example.net/fr/77/"), (0, "https://blog.station.example.org/es/870"),
    (0, "http://m.father.example.com/de/241.html"), (0, "https://www.honest.example.net/en/533/"), (0, "http://history.example.org/archive/1900"),
)


_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it has none."""
    host = F.translate(F.regexp_extract(url, _SPLIT, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, with marks at their ends; of each side, the grams' share is equal."""

    def of(side: str, text: Column) -> Column:
        text = F.concat(F.lit("<"), text, F.lit(">"))
        def sized(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(side), F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

        return F.concat(*[sized(n) for n in SIZES])

    return F.when(host == "", F.array().cast("array<int>")).otherwise(F.concat(of("host", host), of("path", path)))


def train(spark: SparkSession, labelled: DataFrame) -> tuple[float, list[float]]:
    """The bias and a weight for each bucket. labelled: (label, url), at most MOST_LABELLED rows."""
    host, path = parts(F.col("url"))
    rows = labelled.filter("label is not null").select((F.row_number().over(W.orderBy("url", "label")) - 1).alias("u"), "label", grams(host, path).alias("g"))
    rows = rows.cache()
    n = rows.count()
    if n > MOST_LABELLED:
        raise ValueError(f"the labelled table has {n} rows; at most {MOST_LABELLED} are a small one")
    if not n:
        return -1.0, [0.0] * BUCKETS
    cells = rows.select("u", F.explode("g").alias("b"), (F.lit(1.0) / F.size("g")).alias("x")).groupBy("u", "b").agg(F.sum("x").alias("x"))
    inner = cells.join(cells.select(F.col("u").alias("v"), "b", F.col("x").alias("y")), "b").groupBy("u", "v").agg((SCALE * F.sum(F.col("x") * F.col("y"))).alias("k"))
    lines = rows.join(inner.groupBy("u").agg(F.collect_list(F.struct("v", "k")).alias("near")), "u", "left")
    lines = lines.select("u", "label", F.coalesce("near", F.array().cast("array<struct<v:int,k:double>>")).alias("near"))
    table = lines.agg(F.array_sort(F.collect_list(F.struct("u", "label", "near"))).alias("t"))

    def step(alpha: Column, _: Column) -> Column:
        bias = F.aggregate(alpha, F.lit(0.0), lambda s, a: s + a)

        def moved(row: Column) -> Column:
            own = F.element_at(alpha, row["u"] + 1)
            z = F.aggregate(row["near"], bias, lambda s, e: s + e["k"] * F.element_at(alpha, e["v"] + 1))
            return own * (1 - RATE * DECAY) - RATE / n * (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - row["label"])

        return F.transform("t", moved)

    alpha = table.select(F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), F.transform("t", lambda _: F.lit(0.0)), step)).alias("a"))
    alpha = alpha.select((F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1).alias("u"), "a").cache()
    weights = [0.0] * BUCKETS
    for r in cells.join(alpha, "u").groupBy("b").agg(F.sum(F.col("a") * F.col("x")).alias("w")).collect():  # at most BUCKETS rows
        weights[r.b] = SCALE * r.w
    bias = alpha.agg(F.sum("a")).first()[0]
    rows.unpersist()
    alpha.unpersist()
    return bias, weights


def judge(pages: DataFrame, bias: float, weights: list[float], rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row per page row; score is the regression's, of a block."""
    host, path = parts(F.col("url"))
    out = narrow(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    known = F.lit(weights)
    g = grams(F.col("host"), F.col("path"))
    z = F.aggregate(g, F.lit(0.0), lambda s, b: s + F.element_at(known, b + 1)) / F.greatest(F.size(g), F.lit(1)) + F.lit(float(bias))
    out = out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("of_rule"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("of_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(LABELLED, "label int, url string")
    return judge(read(spark, sf_dir, "pages"), *train(spark, labelled))
