"""A deterministic C corpus of any size, with known facts, for tests and load runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, modules: int, functions: int) -> DataFrame:
    """(module_id, file, text): every module has a header of prototypes and a source whose functions call the next one
    and, in every third module, close the ring."""
    k = F.sequence(F.lit(0), F.lit(functions - 1))
    name = lambda i: F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("_f"), i.cast("string"))
    ring = (F.col("id") % 3 == 0) & F.lit(functions > 1)

    def body(i):
        following = F.pmod(i + 1, F.lit(functions))
        call = F.when((following != 0) | ring, F.concat(F.lit("    return "), name(following), F.lit("(n - 1);\n"))).otherwise(F.lit("    return n; /* end */\n"))
        return F.concat(F.lit("int "), name(i), F.lit("(int n)\n{\n"), call, F.lit("}\n"))

    source = F.array_join(F.transform(k, body), "\n")
    header = F.concat(F.lit("#define M"), F.col("id").cast("string"), F.lit("_SIZE 4\n"), F.array_join(F.transform(k, lambda i: F.concat(F.lit("int "), name(i), F.lit("(int n);\n"))), ""))
    stem = F.concat(F.lit("m"), F.col("id").cast("string"))
    files = F.array(F.struct(F.concat(stem, F.lit(".c")).alias("file"), source.alias("text")), F.struct(F.concat(stem, F.lit(".h")).alias("file"), header.alias("text")))
    return spark.range(modules).select(F.format_string("M%02d", F.col("id") + 1).alias("module_id"), F.inline(files))
