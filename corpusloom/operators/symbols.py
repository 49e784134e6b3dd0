"""Symbol tables, call graphs and cross-module dependencies from lexed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import lexer, relational

MACRO, FUNCTION, TYPE, GLOBAL = "宏", "函数", "类型", "全局变量"


def functions(lexed: DataFrame) -> DataFrame:
    """(module_id, file, name, line, end_line, signature, kind) of functions in .c files."""
    found = lexer.relation(lexed, "functions").filter(F.col("file").endswith(".c")).withColumnRenamed("text", "signature")
    declared = declared_names(lexed).withColumn("declared", F.lit(True))
    return found.join(declared, ["module_id", "name"], "left").withColumn("kind", lexer.exported(F.coalesce("declared", F.lit(False)))).drop("declared")


def declared_names(lexed: DataFrame) -> DataFrame:
    """Distinct (module_id, name) that a module's headers declare."""
    return lexer.relation(lexed, "declarations").filter(F.col("file").endswith(".h")).select("module_id", "name").distinct()


def call_edges(lexed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, ambiguous, unresolved): calls of functions the module defines once, several times, or not at all."""
    calls = lexer.relation(lexed, "calls").filter(F.col("file").endswith(".c"))
    defined = lexer.relation(lexed, "functions").filter(F.col("file").endswith(".c")).select("module_id", F.col("name").alias("callee"))
    once, several, never = relational.resolved(calls, defined, ["module_id", "callee"])
    return once.select("module_id", F.col("caller").alias("src"), F.col("callee").alias("dst"), "file", "line"), several, never


def symbol_table(lexed: DataFrame) -> DataFrame:
    """(module_id, file, name, kind, line, end_line, lines, text) of functions and globals in .c files, by their tag."""
    found = functions(lexed).withColumnRenamed("signature", "text")
    variables = lexer.relation(lexed, "globals").filter(F.col("file").endswith(".c")).withColumn("kind", F.lit(GLOBAL))
    rows = found.unionByName(variables.select(*found.columns)).withColumn("lines", F.col("end_line") - F.col("line") + 1)
    return rows.select("module_id", "file", "name", "kind", "line", "end_line", "lines", "text")


def graph_nodes(lexed: DataFrame) -> DataFrame:
    """(module_id, name, file, line, lines) of functions that their module defines once: the nodes of its call graph."""
    sole = functions(lexed).groupBy("module_id", "name").agg(F.count("*").alias("n"), F.first("file").alias("file"), F.first("line").alias("line"), F.first("end_line").alias("end"))
    return sole.filter("n = 1").select("module_id", "name", "file", "line", (F.col("end") - F.col("line") + 1).alias("lines"))


def macro_names(lexed: DataFrame) -> DataFrame:
    """(module_id, macros): the sorted set of macros that a module's files define."""
    return lexer.relation(lexed, "macros").groupBy("module_id").agg(F.array_sort(F.collect_set("name")).alias("macros"))


def digests(modules: DataFrame, lexed: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(module_id, overview, cycles) of every module of ``modules``: symbols and calls, and cyclic groups, as text."""
    table = symbol_table(lexed).join(modules, "module_id", "left_semi")
    rank = F.when(F.col("kind") == lexer.EXPORTED, 0).when(F.col("kind") == GLOBAL, 2).otherwise(1)
    row = F.concat(F.lit("  ["), "kind", F.lit("] "), "text", F.format_string("   （%s:%d，%d 行）", "file", "line", "lines"))
    listed = table.groupBy("module_id").agg(_joined(F.struct(rank.alias("a"), F.col("file").alias("b"), F.col("line").alias("c")), row).alias("symbols"))
    called = relational.adjacency(edges, "module_id").groupBy("module_id").agg(_joined(F.col("src"), F.concat(F.lit("  "), "src", F.lit(" -> "), "callees")).alias("calls"))
    ring = F.concat(F.format_string("  第 %d 组：", "group_no"), F.array_join("members", "、"))
    rings = cycles.groupBy("module_id").agg(_joined(F.col("group_no"), ring).alias("cycles"))
    every = modules.join(listed, "module_id", "left").join(called, "module_id", "left").join(rings, "module_id", "left")
    overview = F.concat(F.lit("符号：\n"), F.coalesce("symbols", F.lit("  （无）")), F.lit("\n调用：\n"), F.coalesce("calls", F.lit("  （无）")))
    return every.select("module_id", overview.alias("overview"), F.coalesce("cycles", F.lit("  （无）")).alias("cycles"))


def _joined(order: Column, text: Column) -> Column:
    """Aggregate: one line for each row, in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n")


def dependency_index(lexed: DataFrame) -> DataFrame:
    """(name, kind, text, file, line, owner): what headers define, names of several modules left out."""
    parts = [("macros", MACRO), ("declarations", FUNCTION), ("types", TYPE)]
    entries = None
    for table, kind in parts:
        rows = lexer.relation(lexed, table).filter(F.col("file").endswith(".h")).withColumn("kind", F.lit(kind))
        entries = rows if entries is None else entries.unionByName(rows)
    first = relational.first_by(entries, ["module_id", "name"], [F.col("file"), F.col("line")], ["kind", "text", "file", "line"])
    sole = relational.sole_owner(first, "name", "module_id")
    return first.join(sole, "name").filter("module_id = owner").select("name", "kind", "text", "file", "line", "owner")


def dependencies(lexed: DataFrame) -> DataFrame:
    """Entries of other modules' headers that each module uses."""
    used = lexed.select("module_id", F.explode("lex.names").alias("name")).distinct()
    return relational.foreign_uses(used, dependency_index(lexed), "name", "module_id")


def backgrounds(lexed: DataFrame) -> DataFrame:
    """(module_id, background): the used entries of each module as text, by kind and name."""
    rank = F.when(F.col("kind") == MACRO, 0).when(F.col("kind") == FUNCTION, 1).otherwise(2)
    row = F.concat(F.lit("- ["), "kind", F.lit("] "), "text", F.lit("  ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")"))
    rows = dependencies(lexed).select("module_id", F.struct(rank.alias("r"), "name", row.alias("row")).alias("e"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["row"]), "\n")
    return rows.groupBy("module_id").agg(text.alias("background"))
