"""Readers of source trees and tolerant readers of small artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S

UNREADABLE = "（文件不可读）"


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of every .c and .h file below ``root``: bad UTF-8 is replaced, line ends become line feeds."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    qualified = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[ch]").text(root, wholetext=True)
    # what follows the qualified root; schemes print one or three slashes before an absolute path
    path, prefix = (F.regexp_replace(c, r"^file:/+", "file:/") for c in (F.col("_metadata.file_path"), F.lit(qualified)))
    tail = F.substr(path, F.length(prefix) + 2)
    return raw.select(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))).alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def modules(files: DataFrame) -> DataFrame:
    """``files`` plus module (path without suffix) and module_id, numbered by module name.

    The numbering window sees one row per module.
    """
    named = files.withColumn("module", F.regexp_replace("file", r"\.[ch]$", ""))
    ids = named.select("module").distinct().withColumn("module_id", F.format_string("M%02d", F.row_number().over(W.orderBy("module"))))
    return named.join(ids, "module")


def module_inventory(files: DataFrame) -> DataFrame:
    """One row per module: module_id, module, files, lines, chars, estimated_tokens."""
    return files.groupBy("module_id", "module").agg(
        F.sort_array(F.collect_list("file")).alias("files"), F.sum(S.line_count(F.col("text"))).alias("lines"), F.sum(F.length("text")).alias("chars"),
        F.sum(S.ascii_chars(F.col("text"))).alias("_ascii"),
    ).withColumn("estimated_tokens", S.token_estimate(F.col("_ascii"), F.col("chars"))).drop("_ascii")


def missing_files(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, file) that the inventory lists and the tree no longer has."""
    return inventory.select("module_id", F.explode("files").alias("file")).join(files.select("file"), "file", "left_anti")


def joined_sources(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, source): each module's files under a heading, unreadable ones named."""
    wanted = inventory.select("module_id", F.posexplode("files").alias("pos", "file")).join(files.select("file", "text"), "file", "left")
    part = F.concat(F.lit("=== "), "file", F.lit(" ===\n"), F.coalesce("text", F.lit(UNREADABLE)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"])
    return wanted.groupBy("module_id").agg(F.array_join(ordered, "\n").alias("source"))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines table; corrupt rows drop out and a missing table is an empty one."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _label_rows(spark: SparkSession, path: str, cells: int) -> DataFrame:
    """Cells ``c`` and place of the table rows of a Markdown file that begin with a letter and a number and have so many
    cells; a place is ``file:line``, ``file:first-last`` or ``file:line,line``."""
    parts = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(F.replace(c, F.lit("`"), F.lit(""))))
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\|\s*[A-Z]\d+\s*\|")).select(parts.alias("c")).filter(F.size("c") == cells)
    place = F.get("c", 1)
    return rows.select(
        "c", F.get("c", 0).alias("no"), F.regexp_extract(place, r"^(.*?):(\d+)", 1).alias("file"), F.regexp_extract(place, r":(\d+)", 1).try_cast("int").alias("first_line"),
        F.regexp_extract(place, r"(\d+)\D*$", 1).try_cast("int").alias("last_line"),
    )


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """(no, file, first_line, last_line, category, severity, text) of labelled defects in Markdown tables.

    A row is ``| no | place | category | severity | text |``; everything else drops out.
    """
    rows = _label_rows(spark, path, 5)
    return rows.select("no", "file", "first_line", "last_line", F.get("c", 2).alias("category"), F.get("c", 3).alias("severity"), F.get("c", 4).alias("text"))


def decoy_table(spark: SparkSession, path: str) -> DataFrame:
    """(no, file, first_line, last_line, text) of places that look like defects and are none: ``| no | place | text |``."""
    return _label_rows(spark, path, 3).select("no", "file", "first_line", "last_line", F.get("c", 2).alias("text"))
