"""The folder that driver and executors share, and things made there once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only a local session without that setting gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (master := conf.get("spark.master", "")) != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="lanternrank-")
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _where(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _where(spark, path)
    return files.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    where, files = _where(spark, path)
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, files = _where(spark, path)
    files.delete(where, True)


def made(spark: SparkSession, name: str, signature: str, make: Callable[[str], None], force: bool = False) -> str:
    """Path of a thing made once from inputs and settings that the signature tells.

    It is made under a path of its own, and listed once it is whole: what a
    failed or a second maker leaves behind is never used.
    """
    base = f"{shared_dir(spark)}/{name}-{signature[:24]}"
    if not force:
        if (found := _made.get((spark.sparkContext.applicationId, base))) and exists(spark, found):
            return found
        if exists(spark, f"{base}/list"):
            if whole := [r.value for r in spark.read.text(f"{base}/list").collect() if exists(spark, r.value)]:
                return _made.setdefault((spark.sparkContext.applicationId, base), min(whole))
    path = f"{base}/{uuid.uuid4().hex}"
    make(path)
    spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("append").text(f"{base}/list")
    _made[spark.sparkContext.applicationId, base] = path
    return path
