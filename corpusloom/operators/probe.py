"""Evidence queries: a table of (module_id, n, kind, target) answered from module tables without any model.

Kinds: callers, callees, accessors, definition, source, search, macro. A module's first ``MAX_QUERIES`` queries count.
Unknown kinds, patterns that are no regular expression and queries without a hit get one readable row each.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusloom.operators import intervals, relational, search

#: Texts of the report language and limits (fixed values).
NO_HIT, UNSUPPORTED, BAD_PATTERN, TOO_SLOW = "（没有命中）", "不支持的取证类型：", "检索模式不合法：", "检索超时："
CALLS, IN_FUNCTION, END = " 调用 ", "（函数 ", "）  "
MAX_QUERIES, MAX_HITS, MAX_CHARS = 12, 20, 8000
#: Characters kept of one line by kind, and lines that show a definition.
SEARCH_CHARS, MACRO_CHARS, DEFINITION_CHARS, DEFINITION_LINES = 160, 200, 240, 10
#: Seconds that a pattern may take on one line; patterns come from a model and may backtrack without end.
PATTERN_SECONDS = 1.0

#: Which table each kind reads.
NEEDS = {"callers": "edges", "callees": "edges", "source": "functions", "accessors": "lines", "definition": "lines", "search": "lines", "macro": "lines"}
KEY = ["module_id", "n", "kind", "target"]

Tables = dict[str, DataFrame]


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except re.error:
        return None


@F.pandas_udf(BooleanType())
def is_pattern(pattern: pd.Series) -> pd.Series:
    """Whether a text is a regular expression."""
    return pattern.map(lambda p: p is not None and _compiled(p) is not None)


@lru_cache(maxsize=256)
def _stoppable(pattern: str) -> regex.Pattern | None:
    try:
        return regex.compile(pattern, regex.V0)
    except regex.error:
        return None


def has_match(line: str | None, pattern: str) -> bool:
    """Whether a line holds a match; no pattern matches nothing, one that takes too long raises TimeoutError."""
    if _compiled(pattern) is None:
        return False
    stoppable = _stoppable(pattern)
    if stoppable is None:  # known to the standard library only
        return _compiled(pattern).search(line or "") is not None
    return stoppable.search(line or "", timeout=PATTERN_SECONDS) is not None


def limited(asked: DataFrame, queries: int = MAX_QUERIES) -> DataFrame:
    """The first ``queries`` queries of each module."""
    turn = F.row_number().over(W.partitionBy("module_id").orderBy("n"))
    return asked.select(*KEY).withColumn("_turn", turn).filter(F.col("_turn") <= queries).drop("_turn")


def _place() -> Column:
    return F.struct("file", "line")


def _edge_hits(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers and callees: the edges are read once, each edge answers in both roles."""
    text = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit("  "), "src", F.lit(CALLS), "dst")
    roles = F.array(F.struct(F.lit("callers").alias("kind"), F.col("dst").alias("target")), F.struct(F.lit("callees").alias("kind"), F.col("src").alias("target")))
    rows = edges.select("module_id", "src", "dst", F.col("file").cast("string").alias("file"), F.col("line").cast("long").alias("line")).distinct()
    told = rows.select("module_id", _place().alias("at"), text.alias("hit"), F.inline(roles))
    return told.join(asked, ["module_id", "kind", "target"]).select(*KEY, "at", "hit")


def _quoted(name: str) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(F.col(name), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _line_hits(asked: DataFrame, lines: DataFrame, functions: DataFrame | None, index: DataFrame | None, most: int) -> DataFrame:
    """Search, macro, accessors and definition: queries meet the lines that the index names, in the JVM but for search
    patterns, which stop at ``most`` hits."""
    name = _quoted("target")
    word = F.concat(F.lit(r"\b"), name, F.lit(r"\b"))
    macro = F.concat(F.lit(r"^\s*#\s*define\s+"), name, F.lit(r"\b"))
    definition = F.concat(F.lit(r"\b(?:typedef|struct|union|enum)\b.*"), word, F.lit(r"|^\s*\}?\s*"), name, F.lit(r"\s*;"))
    pattern = F.when(F.col("kind") == "macro", macro).when(F.col("kind") == "definition", definition).when(F.col("kind") == "accessors", word)
    body = lines.select("module_id", "file", F.col("line_no").cast("long").alias("line"), F.col("line").alias("text"))
    wanted = asked.withColumn("pattern", pattern).withColumn("grams", search.needed_grams("kind", "target"))
    met = search.candidates(wanted, KEY, search.postings(lines) if index is None else index, lines).withColumnsRenamed({"line": "text", "line_no": "line"})
    plain = met.filter("kind <> 'search'").filter(F.regexp("text", F.col("pattern"))).withColumn("gave_up", F.lit(False))
    searched = search.first_hits(met.filter("kind = 'search'"), KEY, ["file", "line"], has_match, ["text", "target"], most)
    found = plain.unionByName(searched).drop("pattern")
    at = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    chars = F.when(F.col("kind") == "macro", MACRO_CHARS).otherwise(SEARCH_CHARS)
    shown = F.when(F.col("gave_up"), F.concat(F.lit(TOO_SLOW), "target")).otherwise(F.concat(at, F.lit("  "), F.left(F.trim("text"), chars)))
    simple = found.filter("kind IN ('search', 'macro')").select(*KEY, _place().alias("at"), shown.alias("hit"))
    # a definition is the first line of a file that has one, shown with the lines after it
    first = found.filter("kind = 'definition'").groupBy(*KEY, "file").agg(F.min("line").alias("line"))
    after = first.join(body.withColumnRenamed("line", "_no"), ["module_id", "file"]).filter(F.col("_no").between(F.col("line"), F.col("line") + DEFINITION_LINES - 1))
    shown = F.left(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_no", "text"))), lambda x: x["text"]), " "), F.lit(DEFINITION_CHARS))
    definitions = after.groupBy(*KEY, "file", "line").agg(shown.alias("shown")).select(*KEY, _place().alias("at"), F.concat(at, F.lit("  "), "shown").alias("hit"))
    hits = simple.unionByName(definitions)
    if functions is None:
        return hits
    spans = functions.select("module_id", "file", F.col("name").alias("function"), F.col("line").alias("_from"), F.col("end_line").alias("_to"))
    used = intervals.covering(found.filter("kind = 'accessors'"), spans, ["module_id", "file"], "line", "_from", "_to")
    return hits.unionByName(used.select(*KEY, _place().alias("at"), F.concat(at, F.lit(IN_FUNCTION), "function", F.lit(END), F.trim("text")).alias("hit")))


def _sources(asked: DataFrame, functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Body of the first function of that name in the module."""
    named = functions.select("module_id", F.col("name").alias("target"), "file", "line", "end_line").join(asked.filter("kind = 'source'"), ["module_id", "target"])
    first = named.groupBy(*KEY).agg(F.min(F.struct("file", "line", "end_line")).alias("f")).select(*KEY, "f.*")
    body = first.select(*KEY, "file", F.col("line").alias("start"), F.explode(F.sequence("line", "end_line")).alias("line_no")).join(
        lines.select("module_id", "file", "line_no", "line"), ["module_id", "file", "line_no"]
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return body.groupBy(*KEY, "file", "start").agg(text.alias("hit")).select(*KEY, F.struct("file", F.col("start").cast("long").alias("line")).alias("at"), "hit")


def dispatch(asked: DataFrame, tables: Tables, most: int = MAX_HITS + 1) -> DataFrame:
    """(module_id, n, kind, target, at, hit) of every query; ``at`` (file, line) orders hits, null for plain messages.

    ``tables`` holds what the kinds in use need: edges (module_id, src, dst, file, line), lines (module_id, file,
    line_no, line), functions (module_id, file, name, line, end_line), and, where several rounds ask, the postings of
    the lines (``search.postings``). A search pattern has ``most`` hits at most, one that takes too long a line that says
    so. All joins are by module.
    """
    asked = limited(asked)
    able = [k for k, t in NEEDS.items() if t in tables and (k not in ("accessors", "source") or {"functions", "lines"} <= set(tables))]
    parts = []
    if "edges" in tables:
        parts.append(_edge_hits(asked, tables["edges"]))
    if "lines" in tables:
        parts.append(_line_hits(asked.filter(F.col("kind").isin("search", "macro", "definition", "accessors")), tables["lines"], tables.get("functions"), tables.get("postings"), most))
    if "source" in able:
        parts.append(_sources(asked, tables["functions"], tables["lines"]))
    hits = reduce(DataFrame.unionByName, parts)
    # one message row where nothing was found: the anti-join becomes a left join with a count of hits per query
    counted = asked.join(hits.groupBy(*KEY).agg(F.count("*").alias("hits")), KEY, "left")
    legal = F.col("kind") != "search"
    message = F.when(~F.col("kind").isin(*able), F.concat(F.lit(UNSUPPORTED), "kind")).when(~(legal | F.col("legal")), F.concat(F.lit(BAD_PATTERN), "target")).otherwise(F.lit(NO_HIT))
    silent = counted.filter("hits IS NULL").withColumn("legal", is_pattern("target"))
    at = F.lit(None).cast("struct<file:string,line:bigint>").alias("at")
    return hits.unionByName(silent.select(*KEY, at, message.alias("hit")))


def evidence(hits: DataFrame, max_hits: int = MAX_HITS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(module_id, n, kind, target, result, truncated): hits of each query joined, at most ``max_hits`` of them and
    ``max_chars`` of a module; the query that crosses the budget keeps the remainder and later ones are left out."""
    line = W.partitionBy(*KEY).orderBy("at", "hit")
    ranked = hits.withColumn("rn", F.row_number().over(line)).filter(F.col("rn") <= max_hits + 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= max_hits, F.struct("rn", "hit")))), lambda x: x["hit"]), "\n")
    made = ranked.groupBy(*KEY).agg(text.alias("text"), (F.max("rn") > max_hits).alias("more"))
    kept = relational.within_budget(made, "module_id", ["n"], F.length("text"), max_chars)
    return kept.select(*KEY, F.left("text", F.col("keep").cast("int")).alias("result"), (F.col("more") | F.col("truncated")).alias("truncated"))
