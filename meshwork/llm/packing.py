"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Capacity C = 2**c. What is left of a document after whole sequences of C is an item; its class is the
k with C / (k + 1) < length <= C / k. A bin of class k takes exactly k items, whole and in order of
arrival. The room that is then left in it, less than C / (k + 1), is filled with the head of the next
document, the only place where a document is cut to fill. So a bin carries no padding, and a document is cut once in k at most.

Each worker (one partition) fills its own bins and shares no state. A class's open bin holds fewer than k
items, so a worker holds fewer than C ids for each of about 2 sqrt(C) classes, less than a megabyte. What is open at the
end of a partition is laid end to end and cut into whole sequences and, for the last, powers of
two, which need no padding either.

Sequence ids hold the partition number in the high bits and are gapless below. A partition that
runs again gives the same pieces. No shuffle at all.

Defined cases: null or empty text is one piece of one id (the end id); null ids stay null; repeated
rows are packed each; a long document is held once at a time; long runs of one kind of character are encoded by the
library, as the faster encoder's regular expression would overflow; an empty table gives no piece;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import python_workers, table

CAPACITY = 2048
END_ID = 1
#: Texts with a longer run of blanks go to the library: the regular expression of the faster one backtracks by run.
LONG_RUN = 20_000
_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")
FIELDS = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))
_encoders: dict[str, object] = {}


def _encoder(name: str):
    """text -> ids as the tokenizers library gives them. The same vocabulary as ranks is faster; texts
    that hold a special token's string or a very long run of blanks go to the library itself."""
    if name not in _encoders:
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        exact = Tokenizer.from_file(public_tokenizers.path(name))
        special = tuple(t.content for t in exact.get_added_tokens_decoder().values())
        ranks = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
        with open(ranks, "rb") as f:
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in special) or len(text) >= LONG_RUN and _BLANKS.search(text):
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[name] = encode
    return _encoders[name]


class HarmonicBins:
    """The open bins of one worker. Pieces are (doc, start, ids as bytes, the document's ids); a bin that closes gives rows (doc, *FIELDS, bytes or None)."""

    def __init__(self, capacity: int, worker: int, with_ids: bool = False):
        self.capacity, self.next_id, self.with_ids = capacity, worker << 40, with_ids
        self.open: dict[int, list[tuple]] = {}
        self.waiting, self.room = [], 0  # the one bin that has its items and takes the next document's head

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for doc, start, raw, n in pieces:
            out.append((doc, start, len(raw) // 4, zlib.crc32(raw), n, self.next_id, at, raw if self.with_ids else None))
            at += len(raw) // 4
        self.next_id += 1
        return out

    def add(self, doc, raw: bytes) -> list[tuple]:
        """Places a document, given as the bytes of its ids, and returns the rows of the bins that it closes."""
        n, at, out = len(raw) // 4, 0, []
        piece = lambda size: (doc, at, raw[4 * at : 4 * (at + size)], n)
        if self.room:
            head = piece(min(self.room, n))
            self.waiting.append(head)
            at = len(head[2]) // 4
            self.room -= at
            if not self.room:
                out += self._close(self.waiting)
        while n - at >= self.capacity:
            out += self._close([piece(self.capacity)])
            at += self.capacity
        if at < n:  # the bin that waited is full now
            k = self.capacity // (n - at)
            held = self.open.setdefault(k, [])
            held.append(piece(n - at))
            if len(held) == k:
                del self.open[k]
                self.waiting, self.room = held, self.capacity - sum(len(p[2]) for p in held) // 4
                if not self.room:
                    out += self._close(held)
        return out

    def rest(self):
        """Rows of what is still open, end to end."""
        pieces = [*(self.waiting if self.room else ()), *(p for k in sorted(self.open) for p in self.open[k])][::-1]
        left = sum(len(p[2]) for p in pieces) // 4
        while left:
            size = room = min(self.capacity, 1 << (left.bit_length() - 1))
            filled = []
            while room:
                doc, start, raw, n = pieces.pop()
                if len(raw) > 4 * room:
                    pieces.append((doc, start + room, raw[4 * room :], n))
                    raw = raw[: 4 * room]
                filled.append((doc, start, raw, n))
                room -= len(raw) // 4
            yield from self._close(filled)
            left -= size


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; `with_ids` adds `ids`, the piece's ids as little-endian uint32 bytes."""
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    python_workers(spark)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode, ctx = _encoder(tokenizer), TaskContext.get()
        bins = HarmonicBins(capacity, ctx.partitionId() if ctx else 0, with_ids)

        def emit(rows: list, kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], kind), *(pa.array(c, t) for c, (_, t) in zip(cols[1:-1], FIELDS, strict=True))]
            names = [id_col, *(n for n, _ in FIELDS)]
            if with_ids:
                arrays.append(pa.array(cols[-1], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        out, kind = [], None
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                out += bins.add(doc, np.array(ids, "<u4").tobytes())
                if len(out) >= 20_000 or with_ids and len(out) >= 500:
                    yield emit(out, kind)
                    out = []
        out += bins.rest()
        if out:
            yield emit(out, kind)

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} bigint" for n, _ in FIELDS) + (", ids binary" if with_ids else "")
    return docs.select(id_col, docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
