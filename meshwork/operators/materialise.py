"""Cutting lineage where several plans read one table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = "meshwork-tables"
#: Shuffle files go at the end of the query that wrote them, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local session (tests on one machine)
    takes a temporary folder; a cluster raises, as executors do not share such a folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshwork-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{_FOLDER}-{sc.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it again, by columns and with statistics. A lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_lean(*parts: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """`keep` for tables that nearly fill the disk: packed harder, one part (all of one schema) after the other, and the shuffle files of a part go as soon as it is
    written. `discard` deletes the table."""
    first = parts[0]() if callable(parts[0]) else parts[0]
    spark = first.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for k, part in enumerate(parts):
            df = first if k == 0 else part() if callable(part) else part
            df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    kept = spark.read.schema(first.schema).parquet(path)
    kept._kept_at = path
    return kept


def in_slice(hashed: Column, k: int, n: int) -> Column:
    return F.pmod(hashed, F.lit(n)) == k if n > 1 else F.lit(True)


def sliced(n: int, plan: Callable[..., DataFrame], *tables: tuple[DataFrame, tuple[str, ...] | Column]) -> list[Callable[[], DataFrame]]:
    """`plan` of n slices of the tables, each given with the columns whose values, or the hash that, decide a row's slice: parts for `keep_lean`. For plans in which rows of other
    values do not meet; their shuffles are n times smaller, one at a time."""

    def part(k: int) -> DataFrame:
        return plan(*[t.where(in_slice(by if isinstance(by, Column) else F.xxhash64(*by), k, n)) for t, by in tables])

    return [partial(part, k) for k in range(n)]


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_bytes(df: DataFrame) -> int:
    """The size of the files that `df` reads; 0 where it reads none."""
    return sum(fs.getFileStatus(p).getLen() for fs, p in (_at(df.sparkSession, f) for f in df.inputFiles()))


def kept_bytes(kept: DataFrame) -> int:
    """The size of a table of `keep_lean` on disk."""
    fs, p = _at(kept.sparkSession, kept._kept_at)
    return fs.getContentSummary(p).getLength()


def discard(*kept: DataFrame) -> None:
    """Delete tables that `keep_lean` wrote. Nothing may read them afterwards."""
    for t in kept:
        fs, p = _at(t.sparkSession, t._kept_at)
        fs.delete(p, True)


def forget(spark: SparkSession) -> None:
    """Delete all tables that `keep` wrote in this session. DataFrames that read them are of no use afterwards."""
    fs, path = _at(spark, shared_dir(spark))
    fs.delete(path, True)


@contextmanager
def kept_tables(spark: SparkSession):
    """A scope at whose end the tables written in this session are deleted."""
    try:
        yield
    finally:
        forget(spark)
