"""Offset-preserving SentencePiece encoding and decoding.

Encoding: (1) normalise by the longest prefix in the model's compiled character map, noting for every
normalised byte the source byte it came from; (2) escape spaces and add the dummy prefix; (3)
segment into pieces; (4) project each piece back to its span of original bytes.

No learned piece has a word character followed by the space mark, so merges never cross
that place: the normalised text splits there into units whose segmentation is kept in a
bounded cache. Unseen units are segmented by the library under a copy of the model without
the normaliser, as normalising is done here. (Models with such a piece are segmented whole.)

Defined cases: null or empty text gives only the begin and end ids; repeated rows are encoded each;
null ids stay null; long texts are held once at a time; other columns stay untouched.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import python_workers, table

MODEL = "piece_bpe_32k.model"
CACHE_UNITS = 500_000
CHUNK_CHARS = 1 << 20
_MARK = "▁"
_codecs: dict[str, PieceCodec] = {}


class CharMap:
    """The compiled character map: a double-array trie over source prefixes and a pool of targets."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Target and source length of the longest source that starts at `at`, if any."""
        units, best = self.units, None
        if not units:
            return None
        u = units[0]
        pos = (u >> 10) << ((u & 0x200) >> 6)
        for k in range(at, len(text)):
            pos ^= text[k]
            if pos >= len(units):
                break
            u = units[pos]
            if u & 0x800000FF != text[k]:
                break
            pos ^= (u >> 10) << ((u & 0x200) >> 6)
            if u >> 8 & 1:
                best = (units[pos] & 0x7FFFFFFF, k + 1 - at)
        if best is None:
            return None
        return self.pool[best[0] : self.pool.index(b"\0", best[0])], best[1]


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = _MARK if self.escape else " "
        texts = [p.piece for p in model.pieces]
        normal = [p.piece for p in model.pieces if p.type in (1, 4, 5)]
        self.splits = model.trainer_spec.model_type == 2 and not model.trainer_spec.treat_whitespace_as_suffix and not any(p.type == 4 for p in model.pieces) and not any(self.space in t.lstrip(self.space) for t in normal)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.segmenter = sentencepiece.SentencePieceProcessor()
        self.segmenter.LoadFromSerializedProto(model.SerializeToString())
        self.bos, self.eos = self.segmenter.bos_id(), self.segmenter.eos_id()
        self.unk = self.segmenter.unk_id()
        #: For decoding: the bytes of each piece; control pieces have none.
        self.bytes_of = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else (model.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.replace(_MARK, " ").encode()) for p in model.pieces]
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start_of, self.pool = np.cumsum(self.size_of) - self.size_of, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        #: The bytes of normalised text that each piece covers.
        self.covers = np.array([0 if p.type == 3 else 1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.is_control = np.array([p.type == 3 for p in model.pieces])
        self.starts_space = np.array([t.startswith(_MARK) for t in texts])
        self.cache: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the source byte offset. None stands for
        the identity after the dummy prefix and escaping, as `align` derives it."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            out = text.replace(" ", self.space) if self.escape else text
            return (self.space + out if self.prefix else out), None
        raw, out, src, i = text.encode(), bytearray(), [], 0
        while i < len(raw):
            hit = self.map.longest(raw, i)
            if hit is None:
                b = raw[i]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = raw[i : i + n], n
            out += hit[0]
            src += [i] * len(hit[0])
            i += hit[1]
        src.append(len(raw))
        mark, final, at = self.space.encode(), bytearray(), []
        skip = self.squeeze
        chunks = bytes(out)
        end = len(chunks.rstrip(b" ")) if self.squeeze else len(chunks)
        begin = len(chunks) - len(chunks.lstrip(b" ")) if self.squeeze else 0
        if begin >= end:
            return "", np.array([len(raw)])
        if self.prefix:
            final += mark
            at += [src[begin]] * len(mark)
        for k in range(begin, end):
            c = chunks[k]
            if c == 32:
                if skip:
                    continue
                final += mark
                at += [src[k]] * len(mark)
                skip = self.squeeze
            else:
                final.append(c)
                at.append(src[k])
                skip = False
        at.append(src[end])
        return final.decode(), np.array(at, np.int64)

    def align(self, text: str) -> np.ndarray:
        """Source offsets of the identity case, made on demand. All bytes of a character come from its start."""
        raw = np.frombuffer(text.encode(), np.uint8)
        width = np.where(raw == 32, len(self.space.encode()), 1)
        start = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, np.arange(len(raw), dtype=np.int64))) if len(raw) else np.zeros(0, np.int64)
        out = np.repeat(start, width)
        lead = np.zeros(len(self.space.encode()) if self.prefix and len(raw) else 0, np.int64)
        return np.concatenate([lead, out, [len(raw)]])

    def units(self, normalised: str) -> list[str]:
        """The text cut before every run of space marks that follows another character."""
        if not self.splits or not normalised:
            return [normalised] if normalised else []
        s = self.space
        if s + s not in normalised and "\0" not in normalised:
            out = normalised.replace(s, "\0" + s).split("\0")
            return out if out[0] else out[1:]
        held, out = "", []
        for k, p in enumerate(normalised.split(s)):
            held += s * (k > 0)
            if p:
                out.append(held + p)
                held = ""
        return out + [held] if held else out

    def ids(self, normalised: list[str]) -> list[bytes]:
        """Begin, piece and end ids of each normalised text as little-endian uint32 bytes."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        cut = [self.units(t) for t in normalised]
        new = list(set(itertools.chain.from_iterable(cut)).difference(self.cache))
        fresh = dict(zip(new, (array("I", x).tobytes() for x in self.segmenter.encode(new, num_threads=1)), strict=True)) if new else {}
        if self.splits and len(self.cache) + len(fresh) <= CACHE_UNITS:
            self.cache.update(fresh)
            get = self.cache.__getitem__
        else:
            get = lambda u, old=self.cache.get, new=fresh.get: old(u) or new(u)
        return [b"".join((begin, *map(get, units), end)) for units in cut]

    def encode(self, texts):
        """(text, ids) of each, a bounded number of characters at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text.as_py() or "" if isinstance(text, pa.Scalar) else text)
            size += len(held[-1])
            if size >= CHUNK_CHARS:
                yield from zip(held, self.ids([self.normalise(t)[0] for t in held]), strict=True)
                held, size = [], 0
        yield from zip(held, self.ids([self.normalise(t)[0] for t in held]), strict=True)

    def spans(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """[begin, end) of original bytes for each id; byte pieces of one character share its start
        and the last carries its end; begin, end and dummy-prefix bytes have empty spans."""
        return list(zip(*(a.tolist() for a in self.bounds(text, ids)), strict=True))

    def bounds(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The spans as arrays of begins and ends."""
        _, at = self.normalise(text)
        at = self.align(text) if at is None else at
        size = self.covers[np.frombuffer(ids, "<u4")]
        upto = np.cumsum(size)
        return at[upto - size], at[upto]

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids): the first piece loses its leading space; malformed byte runs give one
        replacement character for each byte."""
        a = np.frombuffer(ids, "<u4")
        shown = np.flatnonzero(~self.is_control[a])
        if len(shown) and shown[-1] - shown[0] >= len(shown):  # control ids inside end a run of byte pieces
            runs = np.split(a[shown], np.flatnonzero(np.diff(shown) > 1) + 1)
            head = self.decode(runs[0].astype("<u4").tobytes())
            return head + "".join(self._text(r, not head) for r in runs[1:])
        return self._text(a, True)

    def _text(self, a: np.ndarray, begins: bool) -> str:
        size = self.size_of[a]
        total = int(size.sum())
        raw = self.pool[np.arange(total) + np.repeat(self.start_of[a] - (np.cumsum(size) - size), size)].tobytes()
        shown = np.flatnonzero(~self.is_control[a]) if begins else ()
        if len(shown) and (self.prefix or self.squeeze) and self.starts_space[a[shown[0]]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "piece_bytes")


def _one_each(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


def codec(model: str = MODEL) -> PieceCodec:
    if model not in _codecs:
        import codecs

        import public_tokenizers

        codecs.register_error("piece_bytes", _one_each)
        _codecs[model] = PieceCodec(public_tokenizers.path(model))
    return _codecs[model]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), kind))


def _slices(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in itertools.pairwise(ends)]


def _digests(full: pa.RecordBatch, id_col: str) -> pa.RecordBatch:
    """What is left of a batch of full output: counts and digests of its columns."""
    ids, starts, ends = (_slices(full.column(k)) for k in (1, 2, 3))
    sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
    spans = (np.stack(s, axis=1).astype("<i8").tobytes() for s in zip(starts, ends, strict=True))
    cols = [full.column(0), pa.array(map(len, ids), pa.int64()), sha(i.astype("<i4").tobytes() for i in ids), sha(spans), sha(t.encode() for t in full.column(4).to_pylist())]
    return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, model: str = MODEL, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, starts and ends array<long> (original byte spans of each id),
    decoded text. With `digest`: id, n_tokens, ids_sha256, spans_sha256 (start and end of each id in turn, as
    little-endian longs), decoded_sha256, all taken from that output, so that the long columns need not leave the worker."""
    python_workers(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(model)
        for batch in batches:
            rows, size, done = [], 0, 0
            for k, (text, ids) in enumerate(c.encode(batch.column(1)), 1):
                rows.append((np.frombuffer(ids, "<i4"), *c.bounds(text, ids), c.decode(ids)))
                size += len(text)
                if size < CHUNK_CHARS and k < batch.num_rows:
                    continue
                i, s, e, back = zip(*rows, strict=True)
                cols = [batch.column(0).slice(done, k - done), _lists(i, pa.int32()), _lists(s, pa.int64()), _lists(e, pa.int64()), pa.array(back, pa.string())]
                full = pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "starts", "ends", "decoded"])
                yield _digests(full, id_col) if digest else full
                rows, size, done = [], 0, k

    schema = f"`{id_col}` {id_type}, " + ("n_tokens bigint, ids_sha256 string, spans_sha256 string, decoded_sha256 string" if digest else "ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")
    return docs.select(id_col, docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def op5_offset_preserving_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)
