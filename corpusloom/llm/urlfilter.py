"""URL filters in DataFrame expressions only: host and path rules, else a logistic regression on hashed n-grams.

The regression sees character n-grams of host and path, hashed into ``BUCKETS`` columns. It learns from a small
labelled URL table (a file by default), folded into one row and trained by gradient descent inside one SQL expression. Scoring is a sum of
weights over an array literal, so the page table is scanned once and never shuffled.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import let, staged

BUCKETS = 4096
GRAMS = (3, 4)
EPOCHS, RATE, SHRINK = 80, 8.0, 0.0005
#: Labelled URLs that training accepts; more raise an error.
MAX_LABELLED = 1_000

HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: (allow or block, host and path prefix). Fixed values.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

#: The small labelled table (url, blocked: 1 or 0) that training reads where none is given.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null: equal or parent host, and prefix of the path."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest one ends up outermost
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + rest))
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every character n-gram of the framed host and path."""

    def grams(name: str, text: Column) -> list[Column]:
        framed = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0))

        def of_size(chars: Column, n: int) -> Column:
            return F.when(F.size(chars) < n, F.array().cast("array<int>")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(chars) - n),
                    lambda i: F.pmod(F.xxhash64(F.lit(name), *[F.get(chars, i + k) for k in range(n)]), F.lit(buckets)).cast("int"),
                )
            )

        return [let(framed, lambda chars: F.concat(*[of_size(chars, n) for n in GRAMS]))]

    return F.concat(*grams("host", host), *grams("path", path))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Weights (the bias last) of a regression on ``labelled`` (url, blocked); all zero where nothing is labelled.

    Rows with a null url or a label other than 0 and 1 teach nothing. Full-batch gradient descent runs as one
    ``aggregate`` expression over one row that holds the whole small table.
    """
    known = labelled.filter("url IS NOT NULL AND blocked IN (0, 1)").select("url", "blocked")
    if known.count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    grams = known.select(
        "url", F.col("blocked").cast("double").alias("y"), F.array_distinct(gram_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets)).alias("b")
    ).select("y", "url", F.when(F.size("b") > 0, F.col("b")).otherwise(F.lit([]).cast("array<int>")).alias("b"))
    one = grams.agg(F.sort_array(F.collect_list(F.struct("url", "y", "b"))).alias("rows"))

    def scale(b: Column) -> Column:
        return F.lit(1.0) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double"))

    # the weights are a sum over rows of coefficient times features, so descent only needs the rows' products
    products = F.transform("rows", lambda r: F.transform("rows", lambda q: (
        F.size(F.array_intersect(r["b"], q["b"])) * scale(r["b"]) * scale(q["b"]) + 1.0
    )))

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def descent(kernel: Column) -> Column:
        def epoch(coef: Column, _: Column) -> Column:
            rate = F.lit(RATE) / F.greatest(F.size(coef), F.lit(1)).cast("double")
            return F.transform(coef, lambda c, j: c * F.lit(1 - SHRINK) + rate * (
                F.get(F.col("rows"), j)["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(F.get(kernel, j), coef)))
            ))

        return F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), F.transform("rows", lambda r: F.lit(0.0)), epoch)

    fitted = one.select(let(products, lambda kernel: F.arrays_zip(F.col("rows").alias("rows"), descent(kernel).alias("coef"))).alias("z"))
    per_row = staged(fitted.select(F.inline("z")), "coefficients")  # one row for each labelled url
    shares = per_row.select((F.col("coef") * scale(F.col("rows.b"))).alias("share"), F.explode("rows.b").alias("bucket"))
    weights = [0.0] * (buckets + 1)
    for r in shares.groupBy("bucket").agg(F.sum("share").alias("w")).collect():  # a row for each bucket at most
        weights[r["bucket"]] = r["w"]
    weights[buckets] = per_row.agg(F.sum("coef").alias("w")).first()["w"] or 0.0
    return weights


def score(host: Column, path: Column, weights: list[float], buckets: int = BUCKETS) -> Column:
    """Probability that a URL is to be blocked."""
    table = F.lit(weights).cast("array<double>")

    def logit(b: Column) -> Column:
        total = F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(table, i))
        return total / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")) + F.lit(float(weights[buckets]))

    return F.lit(1.0) / (F.lit(1.0) + F.exp(-let(F.array_distinct(gram_buckets(host, path, buckets)), logit)))


def labelled_urls(spark: SparkSession, path: str | Path = LABELLED) -> DataFrame:
    """A small labelled table from a CSV file that the driver reads."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = [(r["url"], int(r["blocked"])) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "url string, blocked int")


def filter_urls(
    pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, threshold: float = 0.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row of ``pages`` (page_id, url).

    A fitting rule decides; elsewhere the regression blocks from ``threshold`` on. A null url or one without ``://``
    has an empty host and path, fits no rule and is scored as such. Repeated rows stay; other columns are not read;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    weights = train(labelled_urls(spark) if labelled is None else labelled)
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = split.select(
        "page_id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("hit"),
        score(F.col("host"), F.col("path"), weights).alias("block_score"),
    )
    return judged.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
