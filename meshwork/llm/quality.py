"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded (shares of byte kinds, word shape, hashed
word shares, then a learned tanh layer), a gated attention tanh(Vh) * sigmoid(Uh) learns from document labels
how much each passage weighs, and the score is the logistic of the weighted passage representation. Every
passage of every document is encoded and weighed; labels, language, source and ids are never inputs.

Fitting uses a documented bound on rows: at most FIT_DOCS of the labelled documents that are there, in the order of their ids' hashes, passing over
those with which their texts would exceed FIT_BYTES together. Of a chosen document all passages are fitted on. Rows with crc32(id as text) mod 5 = 0
are held out.

Defined cases: null, empty or blank text is one passage of zeros and gets a score too; null ids are not held out and not
fitted on; repeated rows get equal scores; labels of an id that repeats are taken once (the largest), and
so are texts of an id (the one of the least hash); without any label, or with one
label only, the score is that label's smoothed share for all; very long texts are encoded in ranges of whole
passages; an empty table gives an empty result; all columns of the input stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, pieces_of, python_workers, table, utf8, word_hashes, words

PASSAGE = 64
BUCKETS = 128
FIT_DOCS = 6000
FIT_BYTES = 64 << 20
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 40, 64, 3e-3, 1e-4
ACCEPT = 0.3
HELD_OUT_OF = 5

_KIND = np.full(256, 11, np.int64)
for _i, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\t\n\x0b\x0c\r", b".", b",", b"!?", b"'\"()-:;", b"|", b"#$%&*+/<=>@[\\]^_`{}~")):
    _KIND[list(_bytes)] = _i
_KIND[0x80:0xC0], _KIND[0xC0:] = 12, 13
KINDS = 14
SHAPE = 8
WIDTH = KINDS + SHAPE + BUCKETS


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features [passages, WIDTH], passages of each row)."""
    starts, lens, rows = words(data, off)
    n_docs = len(off) - 1
    per_doc = np.bincount(rows, minlength=n_docs)
    count = np.maximum(1, -(-per_doc // PASSAGE))
    base = np.cumsum(count) - count
    within = np.arange(len(rows)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    of_word = base[rows] + within // PASSAGE
    total = int(count.sum())
    x = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return x, count
    # A byte belongs to the passage of its row's last word that starts at or before it.
    spread = np.minimum(np.append(starts[1:], len(data)), off[rows + 1]) - starts
    of_byte = np.repeat(of_word, spread)
    at = np.arange(len(of_byte)) + np.repeat(starts - (np.cumsum(spread) - spread), spread)
    kinds = np.bincount(of_byte * KINDS + _KIND[data[at]], minlength=total * KINDS).reshape(total, KINDS).astype(np.float32)
    x[:, :KINDS] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    h = word_hashes(data, starts, lens)
    held = np.bincount(of_word, minlength=total).astype(np.float32)
    n = np.maximum(held, 1)
    mean = lambda v: np.bincount(of_word, weights=v, minlength=total) / n
    first, last = data[starts], data[starts + lens - 1]
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    bucket = np.bincount(of_word * BUCKETS + (h >> np.uint64(57)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    size = mean(lens)
    shape = (size / 10, np.sqrt(np.maximum(mean(lens.astype(float) ** 2) - size**2, 0)) / 10, mean(again), (bucket > 0).sum(axis=1) / n, mean(lens == 1), mean((first >= 65) & (first <= 90)), mean(_KIND[last] >= 5), held / PASSAGE)
    for k, v in enumerate(shape):
        x[:, KINDS + k] = v
    x[:, KINDS + SHAPE :] = bucket / n[:, None]
    return x, count


def bags(texts: pa.Array):
    """(first row, last row, features, counts) of ranges of rows of bounded size."""
    data, off = utf8(texts)
    for a, b in pieces_of(off):
        x, count = passages(data[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, x, count


class AttentionModel:
    """Parameters and passes; plain numpy."""

    def __init__(self, width: int = WIDTH, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda a, b: r.normal(size=(a, b)) / np.sqrt(a)
        self.p = {"W": g(width, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "a": g(GATE, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.std, self.constant = np.zeros(width), np.ones(width), None

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        p, first = self.p, np.cumsum(count) - count
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        w = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(w[:, None] * h, first, axis=0)
        return h, v, u, w, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, v, u, w, z, s = self.forward(x, count)
        ds = (s - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], count, axis=0)
        along = (dz * h).sum(axis=1)
        first = np.cumsum(count) - count
        de = w * (along - np.repeat(np.add.reduceat(w * along, first), count))
        dvu = de[:, None] * p["a"]
        dv, du = dvu * u * (1 - v**2), dvu * v * u * (1 - u)
        dh = (w[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def fit(self, xs: list[np.ndarray], y: np.ndarray, seed: int = 4) -> AttentionModel:
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        sizes = np.array([len(x) for x in xs])
        every = np.concatenate(xs)  # one float32 copy for all; the bags are slices of it
        self.mean, self.std = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3
        every -= self.mean.astype(np.float32)
        every /= self.std.astype(np.float32)
        xs = np.split(every, np.cumsum(sizes)[:-1])
        rng, step = np.random.default_rng(seed), 0
        m, q = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            order, rate = rng.permutation(len(y)), RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                g = self.gradients(np.concatenate([xs[i] for i in rows]), np.array([len(xs[i]) for i in rows]), y[rows])
                step += 1
                for k, v in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    q[k] = 0.999 * q[k] + 0.001 * g[k] ** 2
                    v -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8) + DECAY * v)
        return self

    def scores(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(count), self.constant)
        return self.forward((x - self.mean) / self.std, count)[-1]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> AttentionModel:
    python_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    # At most FIT_DOCS rows, by hash: the limit's order is total, so the choice does not depend on partitions.
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.join(own.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(most)
    once = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = materialise(once, "quality-sample")
    left, kept = most_bytes, []
    for doc, size in sample.orderBy(*order).select("doc_id", F.octet_length("text")).collect():
        if size <= left:
            kept.append(doc)
            left -= size

    def features(batches):
        for batch in batches:
            for a, b, x, count in bags(batch.column(2)):
                ends = np.cumsum(count)
                bag = [x[e - c : e].tobytes() for e, c in zip(ends, count, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(bag, pa.binary())], names=["doc_id", "y", "x"])

    found = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(d,) for d in kept], sample.select("doc_id").schema)), "doc_id").select("doc_id", "y", "text")
    rows = found.mapInArrow(features, f"doc_id {docs.schema[id_col].dataType.simpleString()}, y double, x binary").toArrow()
    order, bag = np.argsort(rows["doc_id"].to_numpy(), kind="stable"), rows["x"]
    xs = [np.frombuffer(bag[int(i)].as_buffer(), np.float32).reshape(-1, WIDTH) for i in order]  # views: `fit` makes the one copy
    return AttentionModel().fit(xs, rows["y"].to_numpy()[order])


def score_documents(docs: DataFrame, model: AttentionModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` and the score, under `name` or a free name like it."""
    python_workers(docs.sparkSession)
    [name] = free_name(docs, name)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, x, count in bags(batch.column(at).cast(pa.string())):
                scores[a:b] = model.scores(x, count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, type(docs.schema)(docs.schema.fields[:]).add(name, "double"))


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
