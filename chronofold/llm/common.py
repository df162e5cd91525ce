"""What several of the operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words and is stripped from lines.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where none is set, a local session gets a folder of its own; a cluster has no folder that could stand in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        app = spark.conf.get("spark.app.id", "")
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='chronofold-')}"
        found = _own[app]
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) on the side of the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: its lineage ends there and lost executors cost nothing.

    The table goes when the application ends, or earlier by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `written` that nothing reads any more."""
    for t in tables:
        files, where = _hadoop(t.sparkSession, t._written_to)
        files.delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and broadcasts that no table needs any more.

    It does so when their plans are collected as garbage on the driver, which with a large heap would be after the job.
    """
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hashes(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows with the least hashes of the columns `by`, all of them where there are no more.

    A threshold, set a little above the n-th hash to be expected, leaves about n rows before they are sorted; so the
    tasks together send about n rows, however many there are.
    """
    total = rows.count()
    h = F.xxhash64(*by)
    if total > n:
        share = min(1.0, (n + 8 * n**0.5 + 64) / total)
        rows = rows.where(h <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1))
    return rows.orderBy(h, *by).limit(n)


#: Rows of the table that `join_on_hot` broadcasts, at most.
HOT_KEYS = 1 << 16


def join_on_hot(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """The inner join of `rows` with `table`, which has one row for each key; keys of many rows need not meet in one task.

    Column `n` of `table` is a count of rows by key that adds up to `total` at most. So at most HOT_KEYS keys have
    total / HOT_KEYS or more: these are broadcast, and their rows stay where they are. `rows` is read twice.
    """
    least = total // HOT_KEYS + 1
    big = F.broadcast(table.where(F.col(n) >= least))
    rest = rows.join(F.broadcast(table.where(F.col(n) >= least).select(*on)), on, "left_anti")
    return rows.join(big, on).unionByName(rest.join(table.where(F.col(n) < least), on))


def ascii_lower(text: Column) -> Column:
    """A stand-in for `text` that is equal for two texts just where these are equal with A-Z lower-cased.

    The UTF-8 bytes are read as Latin-1 and lower-cased there, which is far faster than mapping
    single characters. Beyond A-Z this maps the bytes C0-DE to E0-FE only. Those are lead bytes of
    two-byte characters on the one side and of three- or four-byte ones on the other, and the number
    of continuation bytes after them still tells which they were; so no two different texts meet.
    """
    return F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
