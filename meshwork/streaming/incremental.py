"""Coverage validation over a stream of vertices.

Ownership of an edge depends on its own uses only, ordered by use_key. So a micro-batch touches the edges it has uses of
and no others: their earlier uses are fetched by a semi join from the buckets of the state that the batch touches, the window runs on them,
and the state is one more Parquet part per batch. Each batch lists the edges that it judged anew; an edge's verdicts are those of its newest batch,
whichever order uses arrive in. A batch that is replayed overwrites its own parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import edges
from ..operators.rings import edge_uses


#: The state is dealt to this many folders by edge; a batch reads those that hold its edges.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("edge_key"), F.lit(BUCKETS)).cast("int")


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, state: str, out: str) -> None:
    """Whole rings come in one batch. Writes the overlaps of the touched edges, and these edges themselves, under batch_id."""
    uses = edge_uses(batch).withColumn("bucket", _bucket())
    if uses.isEmpty():
        return
    uses.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={batch_id}")
    new = spark.read.parquet(f"{state}/batch={batch_id}")
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    uses = spark.read.parquet(state).where((F.col("batch") <= batch_id) & F.col("bucket").isin(touched)).drop("batch", "bucket")
    again = new.select("edge_key").distinct()
    again.write.mode("overwrite").parquet(f"{out}/judged/batch={batch_id}")
    owned = edges.owned_uses(uses.join(again, "edge_key", "left_semi"))
    edges.overlapping_edges(owned, with_edge=True).write.mode("overwrite").parquet(f"{out}/overlaps/batch={batch_id}")


def validate_stream(vertices: DataFrame, state: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query; `trigger` as for DataStreamWriter.trigger (all that is there by default)."""
    spark = vertices.sparkSession
    return vertices.writeStream.foreachBatch(lambda b, i: process_batch(spark, b, i, state, out)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_overlaps(spark: SparkSession, out: str) -> DataFrame:
    """The overlaps as a run over all batches at once would give them: each edge's, by the newest batch that judged it."""
    newest = spark.read.parquet(f"{out}/judged").groupBy("edge_key").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/overlaps").join(newest, ["edge_key", "batch"], "left_semi").drop("edge_key", "batch")
