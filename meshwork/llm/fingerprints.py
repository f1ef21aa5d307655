"""Context-triggered piecewise hashing.

A rolling hash over seven bytes cuts the text where it equals -1 modulo the block size; each chunk
gives one of 64 characters. The block size is the smallest 3 * 2**k that lets about 64
chunks cover the text, halved while fewer than 32 are found. A fingerprint is
`block:signature:signature at twice the block`. Likeness compares signatures of the same block size
by edit distance: 1 - distance / longer length, the best of those that are compatible, else 0.

The edited text needs the next document in descending id. Ids are split at exact ids of the table
(into ranges of about RANGE_BYTES of text, or as many as shuffle partitions); each range is a partition, ordered, and the head of a range is
sent to the range before as well, so one shuffle of the texts is all and nothing is ordered in one
task. A worker holds two texts at a time.

Defined cases: null text is empty (fingerprint `3::`, likeness of two empty fingerprints 1); null ids
come last; rows that share an id are ordered by text; a single document is its own next; if no
row has an id the last row's next is an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, python_workers, table

WINDOW = 7
MIN_BLOCK = 3
LENGTH = 64
RANGE_BYTES = 64 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, mod 2**32, from an empty window."""
    n = len(data)
    pad = np.zeros(n + WINDOW, np.uint32)
    pad[WINDOW:] = data
    plain, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for k in range(WINDOW):
        back = pad[WINDOW - k : WINDOW - k + n]
        plain += back
        weighted += back * np.uint32(WINDOW - k)
        shifted ^= back << np.uint32(5 * k) if 5 * k < 32 else np.uint32(0)
    return plain + weighted + shifted


def _signature(text: bytes, ends: np.ndarray, length: int) -> str:
    """One character for each chunk; what follows the last trigger is a chunk too, and the last
    character covers all that is left."""
    cut = ends[: length - 1].tolist()
    out, at = [], 0
    for e in cut:
        out.append(_ALPHABET[zlib.crc32(text[at : e + 1]) & 63])
        at = e + 1
    if at < len(text):
        out.append(_ALPHABET[zlib.crc32(text[at:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    raw = memoryview(text.encode("utf-8", "surrogatepass"))
    n = len(raw)
    level = 0
    while (MIN_BLOCK << level) * LENGTH < n:
        level += 1
    r = _rolling(np.frombuffer(raw, np.uint8)) + np.uint32(1) if n else np.zeros(0, np.uint32)
    at = np.flatnonzero(r % np.uint32(MIN_BLOCK) == 0)
    q = r[at] // np.uint32(MIN_BLOCK)
    while True:
        ends = at[q & np.uint32((1 << level) - 1) == 0]
        if level == 0 or len(ends) >= LENGTH // 2:
            break
        level -= 1
    twice = at[q & np.uint32((2 << level) - 1) == 0]
    return f"{MIN_BLOCK << level}:{_signature(raw, ends, LENGTH)}:{_signature(raw, twice, LENGTH // 2)}"


def likeness(a: Column, b: Column) -> Column:
    """Between 0 and 1, of two fingerprints; 1 for equal ones."""
    block = lambda c: F.split_part(c, F.lit(":"), F.lit(1)).cast("long")
    sig = lambda c, i: F.split_part(c, F.lit(":"), F.lit(i))

    def score(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)

    return (
        F.when(a == b, F.lit(1.0))
        .when(block(a) == block(b), F.greatest(score(sig(a, 2), sig(b, 2)), score(sig(a, 3), sig(b, 3))))
        .when(block(a) == 2 * block(b), score(sig(a, 2), sig(b, 3)))
        .when(2 * block(a) == block(b), score(sig(a, 3), sig(b, 2)))
        .otherwise(F.lit(0.0))
    )


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, part, echo) ordered by part, echo and descending id; echo rows are copies of the next part's head."""
    spark = docs.sparkSession
    row = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(shuffle_partitions(spark), (row.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    q = row.agg(F.max("id"), F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(n - 1, 0, -1)]), F.lit(10_000)) if n > 1 else F.lit(None)).first()
    splits = sorted({q[0], *(q[1] or ())} - {None}, reverse=True)
    if not splits:
        return row.withColumn("part", F.lit(0)).withColumn("echo", F.lit(False)).repartition(1).sortWithinPartitions("text")
    array = F.array(*[F.lit(int(s)).cast("long") for s in splits])
    own = F.coalesce(F.size(F.filter(array, lambda s: s >= F.col("id"))) - 1, F.lit(len(splits) - 1))
    own = F.when(F.col("id").isNull(), F.lit(len(splits) - 1)).otherwise(own)
    before = F.when(F.array_contains(array, F.col("id")), F.pmod(own - 1, F.lit(len(splits))))
    places = F.filter(F.array(F.struct(own.cast("int").alias("part"), F.lit(False).alias("echo")), F.struct(before.cast("int").alias("part"), F.lit(True).alias("echo"))), lambda s: s["part"].isNotNull())
    dealt = row.withColumn("p", F.explode(places)).select("id", "text", "p.part", "p.echo")
    return dealt.repartitionById(len(splits), "part").sortWithinPartitions("part", "echo", F.col("id").desc_nulls_last(), "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint."""
    python_workers(docs.sparkSession)
    names = (id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")

    def run(batches):
        held, out = None, []  # held: (part, id, text, fingerprint) that waits for its next

        def done(following: str, mark: str) -> None:
            _, doc, text, own = held
            changed = edited(text, following)
            out.append((doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, own if changed == text else fingerprint(changed), mark))

        def emit() -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.string()] * 4), strict=True)], names=names)
            out.clear()
            return batch

        for b in batches:
            for doc, text, part, echo in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                doc, text, part, echo = doc.as_py(), text.as_py(), part.as_py(), echo.as_py()
                if echo and held is None:
                    continue  # further rows of a head's id
                mark = fingerprint(text)
                if held is not None:
                    done(text, mark)
                held = None if echo else (part, doc, text, mark)
            if out:
                yield emit()
        if held is not None:
            done("", fingerprint(""))
            yield emit()

    return _in_ranges(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")


def op9_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint_documents(table(spark, sf_dir, "documents"))
    own = F.col("fingerprint")
    return f.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(own, F.col("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"))
