"""Line dedup through a sharded minimal perfect hash.

A line's key is stripped of [\\x20\\x09-\\x0D] and has A-Z lower-cased. Keys of `min_chars` code points
that at least two documents hold lose all their lines but those of the smallest doc_id.

1. Every document row gives its distinct keys as 128-bit hashes; a grouped aggregate (combined before
   the shuffle, so a line that a third of all documents hold is a row per task) gives each distinct
   hash its smallest document and its count.
2. The distinct hashes are dealt to shards of about SHARD_KEYS. Each shard gets a minimal perfect hash
   (levels of bit arrays with ranks) that indexes three arrays: fingerprints, counts and
   first documents. The shards are a table in the shared folder.
3. Documents are dealt to parts of about PART_BYTES of text; rows that repeat one id and text more often are spread over several. A part asks for each distinct hash once,
   however many of its documents hold it; requests meet their shard, probe its arrays, and what is
   repeated goes back to the part, where the lines are dropped.

Hashes of the corpus itself are all members, so its probes are exact up to a 128-bit collision;
foreign lines pass a 32-bit fingerprint by chance once in 2**32.

Defined cases: null or empty text is one empty line; null ids count as one document that comes last;
rows that share an id are one document; an empty table gives an empty result; a part holds one long
document at least; all columns of the input stay, and helper columns take free names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_HOT, free_name, materialise, mix, python_workers, table

MIN_CHARS = 10
SHARD_KEYS = 100_000
PART_BYTES = 12 << 20
_STRIP = b" \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1


def line_hashes(text: bytes, min_chars: int) -> list[bytes]:
    """Per line its key's 16-byte hash, or b'' for keys that are too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP).lower()  # bytes.lower touches A-Z only
        n = len(key)
        long = n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else b"")
    return out


class PerfectHash:
    """A minimal perfect hash over distinct pairs of uint64: at each level the keys that fall alone
    on a bit keep it, the rest go on. A key's index is the rank of its bit."""

    GAMMA = 2.0

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _at(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(h1 ^ mix(h2 + np.uint64(level + 1))) % np.uint64(size)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(h1):
            size = int(max(64, -(-len(h1) * cls.GAMMA // 64) * 64))
            at = cls._at(h1, h2, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at.astype(np.int64)]
            h1, h2, level = h1[left], h2[left], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's index; -1 or any index for keys that are not members."""
        out, todo, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self._at(h1[todo], h2[todo], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            value = self.words[word]
            hit = (value >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = self.ranks[word[hit]] + below[hit]
            todo, base = todo[~hit], base + size // 64
        return out


INDEX_SCHEMA = "shard bigint, keys bigint, level_sizes binary, bits binary, fingerprints binary, counts binary, firsts binary"


def _u8(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False).view(np.uint64)


def _build_shard(t: pa.Table) -> pa.Table:
    h1, h2 = _u8(t["h1"]), _u8(t["h2"])
    mph = PerfectHash.build(h1, h2)
    at = mph.index(h1, h2)
    prints, counts, firsts = np.zeros(len(h1), "<u4"), np.zeros(len(h1), np.uint8), np.zeros(len(h1), "<i8")
    prints[at] = (h2 & np.uint64(0xFFFFFFFF)).astype("<u4")
    counts[at] = t["n"].to_numpy()
    firsts[at] = t["first_doc"].to_numpy()
    row = (t["shard"][0].as_py(), len(h1), mph.sizes.astype("<i8").tobytes(), mph.words.tobytes(), prints.tobytes(), counts.tobytes(), firsts.tobytes())
    names = ("shard", "keys", "level_sizes", "bits", "fingerprints", "counts", "firsts")
    return pa.table({k: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for k, v in zip(names, row, strict=True)})


def _probe(requests: pa.Table, shard: pa.Table) -> pa.Table:
    """What is in two documents or more, with its first document."""
    if not requests.num_rows or not shard.num_rows:
        return requests.select(["part", "h1", "h2"]).slice(0, 0).append_column("first_doc", pa.array([], pa.int64()))
    s = {k: v[0] for k, v in shard.slice(0, 1).to_pydict().items()}
    mph = PerfectHash(np.frombuffer(s["level_sizes"], "<i8"), np.frombuffer(s["bits"], "<u8"))
    h1, h2 = _u8(requests["h1"]), _u8(requests["h2"])
    at = mph.index(h1, h2)
    member = (at >= 0) & (np.frombuffer(s["fingerprints"], "<u4")[at] == (h2 & np.uint64(0xFFFFFFFF)).astype("<u4"))
    found = member & (np.frombuffer(s["counts"], np.uint8)[at] >= 2)
    rows = np.flatnonzero(found)
    return requests.select(["part", "h1", "h2"]).take(pa.array(rows)).append_column("first_doc", pa.array(np.frombuffer(s["firsts"], "<i8")[at[rows]]))


def build_index(lines: DataFrame, n_lines: int) -> tuple[DataFrame, int]:
    """(index table, shards) of lines (doc, h1, h2)."""
    shards = max(1, -(-n_lines // SHARD_KEYS))
    docs = F.when(F.min("doc") == F.max("doc"), F.lit(1)).otherwise(F.least(F.count("*"), F.lit(255)))
    keys = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), docs.cast("int").alias("n"))
    keys = keys.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return materialise(keys.groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA), "line-index"), shards


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then n_lines, n_dropped and kept_text."""
    spark = docs.sparkSession
    python_workers(spark)
    part, doc, own, spread = free_name(docs, "part", "doc", "own", "spread")
    outs = free_name(docs, "n_lines", "n_dropped", "kept_text")
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    sizes = materialise(docs.groupBy(key.alias(own)).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).alias("bytes")), "line-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts, most = max(1, -(-total // PART_BYTES)), max(PART_BYTES, total // MAX_HOT)
    # At most MAX_HOT keys can have more than `most` bytes.
    hot = F.broadcast(sizes.where(F.col("bytes") > most).select(own, F.least(F.ceil(F.col("bytes") / most), F.lit(parts)).cast("long").alias(spread)))
    keyed = docs.withColumn(own, key).join(hot, own, "left").withColumn(spread, F.coalesce(spread, F.lit(1).cast("long")))
    base = F.pmod(F.col(own), F.lit(parts))
    keyed = keyed.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    # Any of its parts will do for a row, as each of them asks for the row's lines.
    dealt = keyed.withColumn(part, F.pmod(base + F.pmod(F.monotonically_increasing_id(), F.col(spread)), F.lit(parts))).drop(own, spread)

    def keys(batches):
        for b in batches:
            counts, found = [], []
            for text in b.column(3):
                own = set(line_hashes(text.as_py() or b"", min_chars))
                own.discard(b"")
                counts.append(len(own))
                found += own
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["base", "spread", "doc", "h1", "h2"])

    raw = keyed.select(base.alias("base"), spread, doc, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    lines = materialise(raw.mapInArrow(keys, "base bigint, spread bigint, doc bigint, h1 bigint, h2 bigint"), "line-hashes")
    index, shards = build_index(lines, lines.count())
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1))
    asked = lines.select("base", "spread", "h1", "h2").distinct().withColumn("k", every).select(F.pmod(F.col("base") + F.col("k"), F.lit(parts)).alias("part"), "h1", "h2").distinct().withColumn("shard", F.pmod("h1", F.lit(shards)))
    answers = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "part bigint, h1 bigint, h2 bigint, first_doc bigint")

    names = docs.columns

    def drop(group: pa.Table, found: pa.Table) -> pa.Table:
        h = np.stack([found["h1"].to_numpy(), found["h2"].to_numpy()], 1).astype("<i8").tobytes() if found.num_rows else b""
        first = {h[16 * i : 16 * i + 16]: d for i, d in enumerate(found["first_doc"].to_pylist())}
        lines_n, dropped_n, kept = [], [], []
        for d, text in zip(group[doc].to_pylist(), group[text_col], strict=True):
            raw = (text.as_py() or "").encode()
            lines = raw.split(b"\n")
            hit = first.keys() & set(line_hashes(raw, min_chars)) if first else ()
            if any(first[k] != d for k in hit):
                stay = [x for x, k in zip(lines, line_hashes(raw, min_chars), strict=True) if first.get(k, d) == d]
            else:
                stay = lines
            lines_n.append(len(lines))
            dropped_n.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode())
        out = group.select(names)
        for name, values, kind in zip(outs, (lines_n, dropped_n, kept), (pa.int64(), pa.int64(), pa.string()), strict=True):
            out = out.append_column(name, pa.array(values, kind))
        return out

    schema = docs.schema
    for name, kind in zip(outs, ("long", "long", "string"), strict=True):
        schema = type(schema)(schema.fields[:]).add(name, kind)
    return dealt.groupBy(part).cogroup(answers.groupBy("part")).applyInArrow(drop, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, min(doc_id) AS first_id FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, coalesce(l.doc_id <> f.first_id, false) AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
