"""Where a review's tables go: one folder per table, partitioned by module, each run replacing what it rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by module; only the modules in ``df`` are replaced, so a later success clears an earlier failure row."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module_id").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines by module, text unescaped."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("module_id").json(path)


def write_texts(df: DataFrame, column: str, path: str) -> None:
    """One text per module, as text files in the module's folder."""
    df.select("module_id", F.col(column).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module_id").text(path)


def write_review(run, root: str) -> None:
    """All tables of a review below ``root``; ``raw`` and ``judged`` hold every reply and every judged item."""
    write_json(run.inventory, f"{root}/inventory")
    for name in ("findings", "conclusions", "chunks", "plans", "incomplete", "raw", "judged", "places"):
        write_table(getattr(run, name), f"{root}/{name}")
    write_json(run.failed, f"{root}/errors")
    append_table(run.evidence, f"{root}/evidence")
    write_texts(run.report, "report", f"{root}/reports")


def append_table(df: DataFrame, path: str) -> None:
    """Parquet by module, added to what is there: a log of rounds."""
    df.write.mode("append").partitionBy("module_id").parquet(path)
