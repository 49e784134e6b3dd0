"""Where quoted evidence really stands: winnowed fingerprints of source files and of quotes.

Texts become tokens, so line breaks, indentation and spacing do not matter. Of the hashes of ``GRAM`` neighbouring tokens
the least of every ``WINDOW`` stays; a quote and a file that share ``GRAM + WINDOW - 1`` tokens in a row share one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of a gram, grams of a window, least share of a quote's fingerprints at its place, and lines that may lie
#: between a stated and a found line without a difference.
GRAM, WINDOW, SHARE, NEAR_LINES = 4, 3, 0.6, 2
#: What may be said of a quote's place.
AT_PLACE, MOVED, MISSING, TOO_SHORT = "at place", "moved", "missing", "too short"
TOKEN = re.compile(r"[A-Za-z_0-9]+|[^\sA-Za-z_0-9]")


def winnowed(text: str | None) -> list[tuple[int, int]]:
    """(hash, line from 1) of the fingerprints of a text; a text of fewer than ``GRAM + WINDOW - 1`` tokens has none."""
    tokens, at = [], []
    for n, line in enumerate((text or "").split("\n"), 1):
        found = TOKEN.findall(line)
        tokens += found
        at += [n] * len(found)
    if len(tokens) < GRAM + WINDOW - 1:
        return []
    hashes = [xxhash.xxh64_intdigest("\0".join(tokens[i : i + GRAM])) >> 1 for i in range(len(tokens) - GRAM + 1)]
    kept: dict[int, int] = {}
    for i in range(len(hashes) - WINDOW + 1):
        # of equal hashes the last one, so that a repeated gram is not taken again and again
        best = min(range(i, i + WINDOW), key=lambda j: (hashes[j], -j))
        kept[best] = hashes[best]
    return [(h, at[i]) for i, h in kept.items()]


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hash, line) of every fingerprint of a text column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [winnowed(t) for t in pdf[text]]
            rows = pdf[keys].loc[pdf.index.repeat([len(f) for f in found])]
            flat = [x for f in found for x in f]
            yield rows.assign(hash=pd.Series([h for h, _ in flat], index=rows.index, dtype="int64"), line=pd.Series([n for _, n in flat], index=rows.index, dtype="int64"))

    types = dict(texts.dtypes)
    return texts.select(*keys, text).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", hash long, line long")


def located(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, id, place, found_file, found_line, share) of every finding (module_id, id, file, line, evidence).

    ``files`` has (module_id, file, text). The place of a quote is the stretch of a file, as many lines long as the
    quote and half of it more, that holds most of its fingerprints; it counts from ``SHARE`` of them on. Between equally
    good places the stated file, then the line next to the stated one wins. ``place`` says whether that is where the
    finding says it is, elsewhere, or nowhere; a quote that is too short to tell has no place.
    """
    key = ["module_id", "id"]
    prints = fingerprints(findings, key, "evidence").groupBy(*key, "hash").agg(F.min("line").alias("at"))
    sizes = prints.groupBy(*key).agg(F.count("*").alias("of"), (F.max("at") - F.min("at") + 1).alias("height"))
    wanted = prints.join(sizes, key).join(findings.select(*key, F.col("file").alias("_file"), F.col("line").cast("long").alias("_line")), key)
    index = fingerprints(files, ["module_id", "file"], "text")
    met = wanted.join(index, ["module_id", "hash"])
    # every match opens a stretch; what it holds is counted by a range of lines behind it
    reach = F.ceil(F.col("height") * 1.5).cast("long") + NEAR_LINES
    lists = met.groupBy(*key, "file", "of", "height", "_file", "_line").agg(F.sort_array(F.collect_list(F.struct("line", "hash"))).alias("m"))
    opened = lists.select("*", reach.alias("reach"), F.explode("m").alias("o"))
    inside = F.size(F.array_distinct(F.transform(F.filter("m", lambda x: x["line"].between(F.col("o.line"), F.col("o.line") + F.col("reach"))), lambda x: x["hash"])))
    scored = opened.select(*key, "file", "_file", "_line", F.col("o.line").alias("line"), (inside / F.col("of")).alias("share"))
    best = scored.groupBy(*key).agg(F.max(F.struct(
        "share", (F.col("file") == F.col("_file")).alias("same"), (-F.abs(F.col("line") - F.col("_line"))).alias("near"), F.col("file").alias("found_file"), F.col("line").alias("found_line"),
    )).alias("b")).filter(F.col("b.share") >= SHARE)
    every = findings.select(*key, "file", F.col("line").cast("long").alias("line")).join(sizes.select(*key, "of", "height"), key, "left").join(best, key, "left")
    close = (F.col("b.found_file") == F.col("file")) & F.col("line").between(F.col("b.found_line") - NEAR_LINES, F.col("b.found_line") + F.col("height") + NEAR_LINES)
    place = F.when(F.col("of").isNull(), TOO_SHORT).when(F.col("b").isNull(), MISSING).when(F.coalesce(close, F.lit(False)), AT_PLACE).otherwise(MOVED)
    return every.select(*key, place.alias("place"), "b.found_file", "b.found_line", "b.share")


def near_equal(findings: DataFrame, places: DataFrame) -> DataFrame:
    """(module_id, id, same_as): findings whose quote stands where an earlier one's (by ``no``) stands, within
    ``NEAR_LINES`` lines of it one after the other; ``same_as`` is the first of them, null for the first itself."""
    at = findings.select("module_id", "id", "no").join(places.filter("found_file IS NOT NULL"), ["module_id", "id"])
    line = W.partitionBy("module_id", "found_file").orderBy("found_line", "no")
    starts = F.coalesce(F.col("found_line") - F.lag("found_line").over(line) > NEAR_LINES, F.lit(True)).cast("int")
    grouped = at.withColumn("_start", starts).withColumn("_group", F.sum("_start").over(line))
    first = F.min_by("id", "no").over(W.partitionBy("module_id", "found_file", "_group"))
    return grouped.withColumn("_first", first).select("module_id", "id", F.when(F.col("_first") != F.col("id"), F.col("_first")).alias("same_as"))
