"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking.

1. Vectors are normalised in double precision; equal vectors are one class that its smallest vec_id stands for.
2. Iterative quantisation learns rotations for balanced binary codes on a bounded sample (FIT_ROWS classes
   by hash): the centred sample is rotated from a random start, and code and rotation are fitted in turn. A rotation gives as
   many bits as dimensions; several, each from its own start and half of the sample, give the full code. Codes are signs of the
   rotated vectors themselves: less their mean, a pair would be at a wider angle than the threshold's, without any bound.
   Vectors of a length too rare in the sample, or too long, to learn a rotation for have bits of random hyperplanes.
3. The code is cut into substrings, one Hamming table each; vectors meet where a substring is equal. A substring has
   log2(classes) + 2 bits, so a bucket of unrelated vectors stays small at any size (unless the vectors share a strong common
   direction: then unrelated ones meet too, which costs time but no links). The number of tables is measured: sample vectors get
   partners at the threshold's angle, in random directions and in directions to other vectors, and tables are added until
   the share RECALL of these pairs meets in one (and at least as many as random hyperplanes would need).
4. What meets is compared by the Hamming distance of whole codes first. The radius is measured on the same pairs: beyond all of them
   and eight standard deviations beyond their mean. Only codes travel so far; a pair counts in the first of its tables only,
   and rows without a pair that is left are dropped before any vector is fetched.
5. The rest is reranked with the original vectors in double precision. Buckets are split into blocks of BLOCK rows and compared block
   by block in tiles: no group is larger than two blocks, no list of pairs leaves a task, and a bucket gives one row per linked vector.
6. Linked vectors of a bucket point to their smallest fellow; components are taken over these edges.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing (n_links 0, their own component, kept); vectors link with vectors of their own length only; rows with a null
vec_id link with nothing, have no component and are kept; each repeated row is one more vector for its fellows' n_links; very
large and very small components are scaled first; an empty table gives an empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, python_workers, table
from .components import connected_components

COSINE = 0.95
RECALL = 0.999
FIT_ROWS = 8000
#: Learnt on: lengths of at most this many components, with this share of the sample.
LEARN_LENGTH, LEARN_SHARE = 4096, 0.01
ITERATIONS = 25
#: Rows of a block and of a group of blocks, for vectors of up to some 2,000 components; GROUP_BYTES holds them down for longer ones.
BLOCK = 4096
GROUP_ROWS = 30_000
GROUP_BYTES = 64 << 20
TILE = 512
SMALL = 32
MAX_BITS = 28


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def vectors(column: pa.ListArray):
    """(rows, matrix) of the vectors of each length that can link."""
    at, ok = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.cast(pa.float64()).fill_null(math.nan).to_numpy()
    size = np.where(ok, np.diff(at), 0)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = values[at[rows][:, None] + np.arange(n)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if good.any():
            yield rows[good], x[good]


def fit_rotation(sample: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A rotation that minimises |sign(VR) - VR| over half of the centred sample V, from a random start."""
    d = sample.shape[1]
    part = sample[rng.permutation(len(sample))[: max(d, len(sample) // 2)]]
    part = part - part.mean(axis=0)
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for _ in range(ITERATIONS):
        u, _, vt = np.linalg.svd(np.where(part @ rotation >= 0, 1.0, -1.0).T @ part)
        rotation = (u @ vt).T
    return rotation


def tables_for(classes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a substring, tables) that bits of random hyperplanes need."""
    bits = min(MAX_BITS, max(8, math.ceil(math.log2(max(2, classes))) + 2))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def partners(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector one at just that cosine: every other one in a random direction, the rest towards another vector."""
    away = np.where(np.arange(len(x))[:, None] % 2 == 0, rng.normal(size=x.shape), x[rng.permutation(len(x))])
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.where(size > 1e-6, away / np.maximum(size, 1e-6), 0.0)
    return cosine * x + math.sqrt(1 - cosine**2) * away


@dataclass
class Codes:
    """Learnt projections by vector length, and what all lengths have in common."""

    bits: int
    tables: int
    radius: int
    learnt: dict[int, np.ndarray]

    def signs(self, x: np.ndarray) -> np.ndarray:
        """[vectors, bits * tables] booleans."""
        d, n = x.shape[1], self.bits * self.tables
        if d in self.learnt:
            return (x @ self.learnt[d] >= 0)[:, :n]
        out = np.zeros((len(x), n), bool)
        for a in range(0, n, 64):
            out[:, a : a + 64] = (x @ np.random.default_rng([d, a]).normal(size=(d, 64)) >= 0)[:, : n - a]
        return out

    def substrings(self, signs: np.ndarray) -> np.ndarray:
        return signs.reshape(len(signs), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))

    def pack(self, signs: np.ndarray) -> np.ndarray:
        """Codes as whole 64-bit words."""
        wide = np.zeros((len(signs), -(-signs.shape[1] // 64) * 64), bool)
        wide[:, : signs.shape[1]] = signs
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def unpack(self, words: np.ndarray) -> np.ndarray:
        return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : self.bits * self.tables].astype(bool)


def learn(samples: dict[int, np.ndarray], classes: int, cosine: float = COSINE, recall: float = RECALL, seed: int = 5) -> Codes:
    """Codes from samples of unit vectors by length. Tables are added until `recall` of the measured pairs meets, up to three times what random
    hyperplanes need."""
    rng = np.random.default_rng(seed)
    bits, least = tables_for(classes, cosine, recall)
    tables, p = least, math.acos(cosine) / math.pi
    learnt, pairs = {d: np.zeros((d, 0)) for d in samples}, {d: (x, partners(x, cosine, rng)) for d, x in samples.items()}
    differ = {d: np.zeros((len(x), 0), bool) for d, x in samples.items()}
    for d, (x, y) in pairs.items():
        while True:
            while learnt[d].shape[1] < bits * tables:
                turn = fit_rotation(x, rng)
                learnt[d] = np.concatenate([learnt[d], turn], axis=1)
                differ[d] = np.concatenate([differ[d], (x @ turn >= 0) != (y @ turn >= 0)], axis=1)
            meet = ~differ[d][:, : bits * tables].reshape(len(x), tables, bits).any(axis=2)
            if meet.any(axis=1).mean() >= recall or tables >= 3 * least:
                break
            tables += max(1, least // 8)
    n = bits * tables
    radius = n * p + 8 * math.sqrt(n * p * (1 - p))
    for d, (x, _) in pairs.items():
        while learnt[d].shape[1] < n:
            learnt[d] = np.concatenate([learnt[d], fit_rotation(x, rng)], axis=1)
        far = (((pairs[d][0] @ learnt[d]) >= 0) != ((pairs[d][1] @ learnt[d]) >= 0))[:, :n].sum(axis=1)
        radius = max(radius, far.max(), far.mean() + 8 * far.std())
    return Codes(bits, tables, math.ceil(radius), learnt)


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index that each of n points reaches over the edges (u, v)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


class Compared:
    """Rows (slot, lo, hi, block, node, code, and copies and unit for reranking) of many block pairs, sorted into groups."""

    def __init__(self, t: pa.Table, codes: Codes, cosine: float | None):
        self.codes, self.cosine = codes, cosine
        self.words = np.frombuffer(b"".join(t["code"].to_pylist()), "<u8").reshape(t.num_rows, -1)
        self.keys = codes.substrings(codes.unpack(self.words)).astype(np.int32)
        self.slot, self.lo, self.hi, self.block = (t[k].to_numpy() for k in ("slot", "lo", "hi", "block"))
        self.table_no = (self.slot >> 28 & 1023).astype(np.int64)
        if cosine is not None:
            raw = t["unit"].to_pylist()
            self.size = np.array([len(r) for r in raw])
            self.raw = raw
        order = np.lexsort((self.block, self.hi, self.lo, self.slot))
        change = np.ones(t.num_rows, bool)
        for c in (self.slot, self.lo, self.hi):
            change[1:] &= c[order][1:] == c[order][:-1]
        change[1:] = ~change[1:]
        first = np.flatnonzero(change)
        self.order, self.first, self.count = order, first, np.diff(np.append(first, t.num_rows))

    def _near(self, i: np.ndarray, j: np.ndarray, fresh: bool) -> np.ndarray:
        """Which pairs are within the radius, met in no earlier table (`fresh` if that is known) and, in reranking, reach the cosine."""
        ok = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 14):
            p, q = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            k = np.flatnonzero(np.bitwise_count(self.words[p] ^ self.words[q]).sum(axis=1, dtype=np.int64) <= self.codes.radius)
            if not fresh and len(k):
                same = self.keys[p[k]] == self.keys[q[k]]
                k = k[~(same & (np.arange(self.keys.shape[1]) < self.table_no[p[k]][:, None])).any(axis=1)]
            if self.cosine is not None and len(k):
                for n in np.unique(self.size[p[k]]):
                    m = k[self.size[p[k]] == n]
                    x, y = (np.frombuffer(b"".join([self.raw[r] for r in rows[m]]), np.float64).reshape(len(m), -1) for rows in (p, q))
                    ok[a + m[(x * y).sum(axis=1) >= self.cosine]] = True
            else:
                ok[a + k] = True
        return ok

    def _tile(self, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.ones((len(a), len(b)), bool)
        if same:
            fresh = np.triu(fresh, 1)
        for k in range(self.table_no[a[0]]):
            fresh &= self.keys[a, k][:, None] != self.keys[b, k]
            if k % 4 == 3 and not fresh.any():
                break
        i, j = np.nonzero(fresh)
        i, j = a[i], b[j]
        ok = self._near(i, j, True)
        return i[ok], j[ok]

    def pairs(self):
        """(i, j) row numbers of pairs that are left, in bounded parts."""
        alone = self.lo[self.order[self.first]] == self.hi[self.order[self.first]]
        for s in range(2, SMALL + 1):
            at = self.first[alone & (self.count == s)]
            u, v = np.triu_indices(s, 1)
            step = max(1, (1 << 16) // len(u))
            for a in range(0, len(at), step):
                rows = self.order[at[a : a + step][:, None] + np.arange(s)]
                i, j = rows[:, u].ravel(), rows[:, v].ravel()
                ok = self._near(i, j, False)
                yield i[ok], j[ok]
        for at, n, one in zip(self.first.tolist(), self.count.tolist(), alone.tolist(), strict=True):
            if one and n <= SMALL:
                continue
            rows = self.order[at : at + n]
            left = rows if one else rows[self.block[rows] == self.lo[rows[0]]]
            right = rows if one else rows[self.block[rows] == self.hi[rows[0]]]
            for a in range(0, len(left), TILE):
                for b in range(a if one else 0, len(right), TILE):
                    yield self._tile(left[a : a + TILE], right[b : b + TILE], one and a == b)


def near_codes(t: pa.Table, codes: Codes) -> pa.Table:
    """The rows that have a pair within the Hamming radius which met in no earlier table."""
    some = np.zeros(t.num_rows, bool)
    for i, j in Compared(t, codes, None).pairs():
        some[i] = some[j] = True
    return t.filter(pa.array(some))


def link_group(t: pa.Table, codes: Codes, cosine: float) -> pa.Table:
    """Rows of many block pairs -> (node, links, root) of what is linked."""
    node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
    ids, at = np.unique(node, return_inverse=True)
    links, edges = np.zeros(len(ids), np.int64), []
    for i, j in Compared(t, codes, cosine).pairs():
        if not len(i):
            continue
        np.add.at(links, at[i], copies[j])
        np.add.at(links, at[j], copies[i])
        u, v = at[i], at[j]
        root = _labels(len(ids), u, v) if len(u) > len(ids) else None
        edges.append((u, v) if root is None else (np.flatnonzero(root != np.arange(len(ids))), root[root != np.arange(len(ids))]))
    some = np.flatnonzero(links)
    u, v = (np.concatenate(c) for c in zip(*edges, strict=True)) if edges else (some, some)
    root = ids[_labels(len(ids), u, v)]
    return pa.table({"node": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(root[some], pa.int64())})


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    python_workers(spark, 2000)

    def prepare(batches):
        for b in batches:
            digests, units = [None] * b.num_rows, [None] * b.num_rows
            named = b.column(0).is_valid().to_pylist()
            for rows, x in vectors(b.column(1)):
                for r, own, one in zip(rows.tolist(), x, unit(x), strict=True):
                    if named[r]:
                        digests[r], units[r] = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), one.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "digest", "unit"])

    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(prepare, "vec_id bigint, digest binary, unit binary")
    rows = materialise(rows, "vectors")
    classes = materialise(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "vector-classes")
    n, size = classes.agg(F.count("*"), F.coalesce(F.avg(F.octet_length("unit")), F.lit(1.0))).first()
    block, group_rows = (max(2, min(most, int(GROUP_BYTES / size))) for most in (BLOCK, GROUP_ROWS))
    every = max(1, -(-n // FIT_ROWS))
    # The limit bounds what a skewed hash could bring; lengths beyond LEARN_LENGTH are not learnt on.
    sample = [bytes(r[0]) for r in classes.where((F.pmod(F.xxhash64("digest"), F.lit(every)) == 0) & (F.octet_length("unit") <= 8 * LEARN_LENGTH)).select("unit").limit(2 * FIT_ROWS).collect()]
    common = [size for size, k in Counter(map(len, sample)).items() if k >= max(2, LEARN_SHARE * len(sample))]
    codes = learn({size // 8: np.frombuffer(b"".join(s for s in sample if len(s) == size), np.float64).reshape(-1, size // 8) for size in common}, n, cosine, recall)

    def code(batches):
        for b in batches:
            raw = b.column(2).to_pylist()
            size = np.array([len(r) for r in raw])
            words, slots = np.zeros((b.num_rows, -(-codes.bits * codes.tables // 64)), "<u8"), np.zeros((b.num_rows, codes.tables), np.int64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                signs = codes.signs(np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1))
                words[at] = codes.pack(signs)
                # A slot is the length, the table and the substring.
                slots[at] = (int(k) // 8 & 0x1FFFFFF) << 38 | np.arange(codes.tables) << 28 | codes.substrings(signs)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * codes.tables
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(slots.reshape(-1))), pa.array([w.tobytes() for w in words], pa.binary())], names=["node", "copies", "unit", "slots", "code"])

    coded = materialise(classes.select("node", "copies", "unit").mapInArrow(code, "node bigint, copies bigint, unit binary, slots array<bigint>, code binary"), "vector-codes")
    slots = coded.select("node", F.explode("slots").alias("slot"))
    shared = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    placed = slots.join(shared, "slot").withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("slot", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = materialise(dealt, "vector-slots")

    def grouped(df: DataFrame, count: int) -> DataFrame:
        return df.withColumn("g", F.pmod(F.xxhash64("slot", "lo", "hi"), F.lit(max(1, -(-count // group_rows))))).groupBy("g")

    schema = "slot bigint, node bigint, block bigint, lo bigint, hi bigint, code binary"
    names = [c.split()[0] for c in schema.split(", ")]
    met = grouped(dealt.join(coded.select("node", "code"), "node").select(names), dealt.count())
    near = materialise(met.applyInArrow(lambda t: near_codes(t.select(names), codes), schema), "vector-near")
    full = grouped(near.join(coded.select("node", "copies", "unit"), "node"), near.count())
    found = materialise(full.applyInArrow(lambda t: link_group(t, codes, cosine), "node bigint, links bigint, root bigint"), "vector-links")
    comps = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "vector-components")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.select("digest", "node", "copies").join(totals, "node", "left").join(comps, "node", "left")
    per_class = per_class.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("vec_id", "digest").join(per_class, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_itq_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.w FROM r JOIN l ON r.b = l.u),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM v JOIN m ON m.a = vec_id LEFT JOIN n ON n.u = vec_id
"""
