"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java, DuckDB and Python regular expressions read it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Only a local session without
    that setting gets a folder of its own; a cluster without it is an error,
    because a machine-local folder would lose files there.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (master := conf.get("spark.master", "")) != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="lanternrank-")
    return _own


_own: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, tasks_a_file: int = 0) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts the lineage, and survives lost executors.

    tasks_a_file: for tables of a few short rows a task, so many tasks' rows go to one file.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if _open:
        _open[-1].append(path)
    if tasks_a_file:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) // tasks_a_file + 1)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables written within it, but for those that `kept` took out.

    What is left must not read them any more: a caller leaves the block only
    once all that it needs from them is itself a written table.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """`written` for a result that outlives the innermost `scratch`; an outer one takes it over."""
    out = written(df, name)
    if _open:
        path = _open[-1].pop()
        if len(_open) > 1:
            _open[-2].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from the given ones; Spark takes names without regard to case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def doc_hash_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(m))


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tokens(data: bytes) -> list[bytes]:
    """Words of WORD after lower-casing A-Z: bytes methods know ASCII letters and ASCII white space only."""
    return data.lower().split()


def pieces(batches, most: int = 4 << 20, column: str = "text"):
    """Slices of Arrow batches whose texts hold about `most` bytes or one row, so that no step works on an unbounded batch."""
    for batch in batches:
        at, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def ids(batch, name: str = "doc_id") -> pa.Array:
    return batch.column(name)
