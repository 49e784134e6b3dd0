"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Scopes that are open, the innermost last.
_scopes: list[str] = []


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, but only in a session that runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local[name]


def _own(spark: SparkSession) -> str:
    return f"{_root(spark)}/corpusloom-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the application's part of the shared folder, or in that of the innermost open scope."""
    return "/".join([_own(spark), *_scopes, uuid.uuid4().hex])


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end, so results must be written elsewhere before."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    path = "/".join([_own(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        _remove(spark, path)


def staged(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application staged; results not yet written are gone with it."""
    _remove(spark, _own(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
