"""Search of lines by an inverted index, and searches that stop early.

``postings`` lists, for every module, the lines of each word and of each three-character gram; it is built once and
answers any number of rounds. A query names the grams that every match must hold; only lines with all of them are looked
at. ``first_hits`` tests rows of a group in order and stops at a number of hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants, _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

#: Lines of one list of postings.
BLOCK = 4096
#: Words stand in the index as ``w:word``, other grams as they are; a gram has this many characters.
WORD, GRAM = "w:", 3
_NAME = re.compile(r"[A-Za-z0-9_]+")


def grams(text: Column) -> Column:
    """Distinct words (runs of ASCII letters, digits and ``_``) and three-character grams of a text."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.concat(F.lit(WORD), w))
    n = F.length(text) - GRAM + 1
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, parts))


def postings(lines: DataFrame) -> DataFrame:
    """(module_id, gram, file, block, numbers) of ``lines`` (module_id, file, line_no, line): the sorted numbers of the
    lines that hold a gram, ``BLOCK`` lines of a file at a time, so no list outgrows a block."""
    each = lines.filter("line IS NOT NULL").select("module_id", "file", "line_no", F.explode(grams(F.col("line"))).alias("gram"))
    block = F.floor(F.col("line_no") / BLOCK).alias("block")
    return each.groupBy("module_id", "gram", "file", block).agg(F.array_sort(F.collect_list(F.col("line_no").cast("long"))).alias("numbers"))


def _runs(parsed: _parser.SubPattern) -> list[str] | None:
    """Texts that every match of a parsed pattern holds, in pieces; None where case may be ignored."""
    runs, now = [], ""
    for op, value in parsed:
        if op is _constants.LITERAL:
            now += chr(value)
            continue
        if op is _constants.AT:
            continue  # takes no characters
        inner: list[str] | None = []
        if op is _constants.SUBPATTERN:
            _, add, _, body = value
            inner = None if add & re.IGNORECASE else _runs(body)
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _runs(value[2])
        elif op is _constants.ATOMIC_GROUP:
            inner = _runs(value)
        if inner is None:
            return None
        runs += [now, *inner]
        now = ""
    return [*runs, now]


def pattern_grams(pattern: str) -> list[str]:
    """Grams that every line with a match holds; none for patterns that fix no three characters in a row, or that are
    no patterns."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    runs = None if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) else _runs(parsed)
    return sorted({r[i : i + GRAM] for r in runs or [] for i in range(len(r) - GRAM + 1)})


def name_grams(name: str) -> list[str]:
    """Grams of lines that hold ``name`` as a whole word; for a name that is no single word, those of its text."""
    return [WORD + name] if _NAME.fullmatch(name) else sorted({name[i : i + GRAM] for i in range(len(name) - GRAM + 1)})


@F.pandas_udf(ArrayType(StringType()))
def needed_grams(kind: pd.Series, target: pd.Series) -> pd.Series:
    """Grams of a query by its kind: a pattern for ``search``, else a name."""
    return pd.Series([(pattern_grams if k == "search" else name_grams)(t or "") for k, t in zip(kind, target, strict=True)], dtype=object)


def candidates(asked: DataFrame, keys: list[str], index: DataFrame, lines: DataFrame) -> DataFrame:
    """``asked`` (keys, grams, ...; module_id among the keys) with the lines that hold all grams of a query: adds file,
    line_no, line.

    Lists of postings meet by (module, gram) and intersect block by block, so work follows the rarest lists of a query
    and not lines times queries. Queries without grams meet all lines of their module.
    """
    wanted = F.size("grams").alias("_wanted")
    each = asked.filter(F.size("grams") > 0).select(*keys, wanted, F.explode("grams").alias("gram"))
    met = each.join(index, ["module_id", "gram"]).groupBy(*keys, "_wanted", "file", "block").agg(F.collect_list("numbers").alias("_lists")).filter(F.size("_lists") == F.col("_wanted"))
    common = F.aggregate(F.slice("_lists", 2, F.greatest(F.size("_lists") - 1, F.lit(1))), F.element_at("_lists", 1), lambda a, b: F.array_intersect(a, b))
    found = met.select(*keys, "file", F.explode(common).alias("line_no")).join(lines.select("module_id", "file", F.col("line_no").cast("long").alias("line_no"), "line"), ["module_id", "file", "line_no"])
    named = found.join(asked.drop("grams"), keys)
    rest = asked.filter(F.size("grams") == 0).drop("grams").join(lines.select("module_id", "file", F.col("line_no").cast("long").alias("line_no"), "line"), "module_id")
    return named.unionByName(rest)


def first_hits(rows: DataFrame, keys: list[str], order: list[str], test: Callable[[pd.Series], bool], columns: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, in order, that pass ``test`` (given the row's ``columns``), plus ``gave_up``.

    A group's rows after its last hit are not tested. Where ``test`` raises TimeoutError the row comes back with
    ``gave_up`` true and the group ends. Rows are sorted by Spark and read as a stream; nothing is held but the last
    key and its hits.
    """
    rows = rows.drop("gave_up")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hits = None, 0
        for pdf in batches:
            kept, gave_up = [], []
            names = list(zip(*(pdf[k] for k in keys), strict=True))
            for i, (name, values) in enumerate(zip(names, zip(*(pdf[c] for c in columns), strict=True), strict=True)):
                if name != key:
                    key, hits = name, 0
                if hits >= limit:
                    continue
                try:
                    if test(*values):
                        hits += 1
                        kept.append(i)
                        gave_up.append(False)
                except TimeoutError:
                    hits = limit
                    kept.append(i)
                    gave_up.append(True)
            yield pdf.iloc[kept].assign(gave_up=pd.Series(gave_up, index=pdf.index[kept], dtype=bool))

    schema = type(rows.schema)([*rows.schema.fields]).add("gave_up", BooleanType())
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
