"""Dense numbers in a global order, without one task that sorts all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .materialise import keep_lean


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, 1 for the first row by `order`, which must be total for numbers that repeat.

    Rows are range-partitioned and numbered inside partitions; the offsets, one row for each
    partition, are broadcast."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep_lean(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_at") + 1).select(*df.columns, name)
