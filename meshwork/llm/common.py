"""What the operators share: reading tables, the shared folder, Arrow text buffers."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialise import shared_dir as session_dir

#: Rows in one Arrow batch; with maxBytesPerBatch it bounds what a Python worker holds.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below this session's in spark.checkpoint.dir, which all executors share; `materialise.forget` deletes the session's."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage is cut and a lost executor
    costs nothing that was written. The files stay until `materialise.forget` or the end of a `kept_tables` scope."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_workers(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that Spark hands to Python at once, and let workers on the driver's machine find this
    package wherever they are started (on a cluster it is installed or sent with --py-files)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of `df` (case does not count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys with more rows than this are split; and at most MAX_HOT of them are broadcast, whatever the number of rows.
HOT_ROWS, MAX_HOT = 256, 100_000


def hot_limit(rows: int) -> int:
    """Keys with more rows than this are hot: of `rows` rows at most MAX_HOT keys can be."""
    return max(HOT_ROWS, rows // MAX_HOT)


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str, limit: int) -> DataFrame:
    """Inner join of `rows` with `per_key` (one row for each key, `count` its rows). The values of keys with more than `limit` rows, at most MAX_HOT
    by hot_limit, are broadcast, and the rows of such a key are spread by their hash, so that no task gets them all."""
    values = [c for c in per_key.columns if c not in (key, count)]
    hot = per_key.where(F.col(count) > limit).select(key, F.struct(*values).alias("_hot"))
    spread = 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(65_536))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(spread))
    own = per_key.select(key, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_own"))
    both = marked.join(own, [key, "_salt"], "left").withColumn("_v", F.coalesce("_hot", "_own")).where("_v IS NOT NULL")
    return both.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


def text_col(name: str) -> Column:
    """The text with null taken as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string column without making Python strings; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces_of(off: np.ndarray, most: int = 1 << 20):
    """Ranges [a, b) of rows with at most `most` bytes, or one longer row: bounds numpy's memory."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        x = np.full(max(n, 256), np.uint64(_BASE))
        x[0] = 1
        _powers = np.cumprod(x, dtype=np.uint64)
    return _powers


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of the words [^\\x20\\x09-\\x0D]+ of each row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    first = step[:-1] == 1
    cut = off[1:-1]  # words end where a row ends
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    if len(cut):
        both = (inside[cut] == 1) & (inside[cut + 1] == 1)
        first[cut[both]] = True
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(step[1:] == -1) + 1
    if len(cut) and both.any():
        ends = np.sort(np.concatenate([ends, cut[both]]))
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends - starts, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased: a polynomial mod 2**64, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lens) - lens
    rel = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    at = rel + np.repeat(starts, lens)
    terms = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * _power_table(int(lens.max()))[rel]
    return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64))
