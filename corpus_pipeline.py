"""A corpus pipeline of four stages: quality classifier, line dedup, MinHash near-dedup, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.

Defined cases: those of the operators. The classifier is fitted on the labelled documents that reach it; without labels
every document gets one score and, at the smoothed share of good labels, stays or goes alike. Line dedup leaves a document
whose lines are all held by others with an empty text. Near-dedup keeps the smallest doc_id of each component;
rows that repeat an id are one document, of which the least row stays; rows with a null id link with nothing and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import line_dedup, minhash, packing, quality
from meshwork.llm.common import free_name, materialise, table

#: The near-dedup stage's own threshold on the Jaccard similarity; 85 is that of the query op6 only.
NEAR_PERCENT = 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least quality.ACCEPT."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    [score] = free_name(docs, "score")
    return quality.score_documents(docs, model).where(F.col(score) >= quality.ACCEPT).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds."""
    _, _, kept = free_name(docs, "n_lines", "n_dropped", "kept_text")
    out = line_dedup.dedup_lines(docs).withColumn("text", F.col(kept))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    gone = minhash.near_duplicates(docs, NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    [once] = free_name(docs, "once")  # tells rows with a null id apart, so that only repeated ids are one
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rest = [c for c in docs.columns if c != "doc_id"]
    kept = left.withColumn(once, key).groupBy("doc_id", once).agg(F.min(F.struct(*rest)).alias(once + "_row"))
    return kept.select("doc_id", f"{once}_row.*").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", classify), ("line_dedup", dedup_lines), ("minhash_dedup", dedup_near), ("packing", pack)]

#: A fitted model and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
