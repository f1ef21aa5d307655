"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star edges.

1. Each document's set of distinct 5-word shingles is hashed once. The hash range is cut into BINS bins; each keeps
   its least value. An empty bin borrows from the first non-empty bin in an order fixed for that
   bin (optimal densification), so short documents keep all bands.
2. Equal sets are one class; its smallest doc_id stands for it from here on.
3. BANDS bands of ROWS bins make buckets. At Jaccard 0.85 all bands miss with (1 - 0.85**6)**40 = 6e-9.
4. Star edges: each bucket's smallest document is paired with the others, so a group of m near copies gives
   about m distinct pairs over all bands. Pairs whose sizes rule a link out are dropped, the others
   are confirmed on full sets, and components are taken.
5. A star can miss a link between two documents that both differ from its hub. Buckets of three or more that still hold several
   components are gone through by an exact set-similarity join: their documents' shingles are ordered from rare to frequent,
   and two documents that link share one of the first n - ceil(0.85 n) + 1, at positions that leave room for enough more.
   Only such pairs of different components are confirmed. No pair is capped or sampled away: a link is lost
   only where all bands miss it.

Defined cases: null or blank text has an empty set (n_shingles 0), its own component, kept; rows that share an id
are one node, judged by the text with the least digest if these differ, and each row reports its own text's class; rows with a null id link with nothing, have no component and are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_limit, join_hot, materialise, mix, pieces_of, python_workers, table, utf8, word_hashes, words
from .components import connected_components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
BROADCAST_IDS = 1_000_000  # with digests


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE):
    """Per row the sorted distinct shingle hashes. With fewer than k words the whole sequence is one."""
    starts, lens, rows = words(data, off)
    h = word_hashes(data, starts, lens)
    count = np.bincount(rows, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        part = h[j : max(j, n - k + 1 + j)] * mix(np.array([j + 1], np.uint64))[0]
        rolled[: len(part)] += part
    rolled = mix(rolled)
    for a, m in zip(first.tolist(), count.tolist(), strict=True):
        if m >= k:
            s = np.sort(rolled[a : a + m - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif m:
            x = np.array([m], np.uint64)
            for i in range(a, a + m):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
            yield x
        else:
            yield np.zeros(0, np.uint64)


def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a lender: a fixed random permutation."""
    rng = np.random.default_rng(11)
    return np.argsort(rng.random((bins, bins)), axis=1)


_ORDERS = _orders(BINS)


def one_permutation(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Densified signatures [documents, bins] of non-empty sorted sets."""
    sig = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    for d, s in enumerate(sets):
        at = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        lead = np.concatenate([[True], at[1:] != at[:-1]])
        sig[d, at[lead]] = s[lead]
        filled[d, at[lead]] = True
    d, b = np.nonzero(~filled)
    for t in range(bins):
        if not len(d):
            break
        lender = _ORDERS[b, t]
        ok = filled[d, lender]
        sig[d[ok], b[ok]] = sig[d[ok], lender[ok]]
        d, b = d[~ok], b[~ok]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    bands = mix((mix(sig).reshape(len(sig), BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64))
    return mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, digest (16 bytes, null for the empty set), bands array<long>."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in pieces_of(off):
                sets = list(shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(one_permutation([sets[i] for i in full])) if full else np.zeros((0, BANDS), np.int64)
                has = np.zeros(len(sets), np.int64)
                has[full] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]), pa.int32()), pa.array(keys.reshape(-1)))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), bands], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, rep_digest) -> doc_id, shingles array<long>; texts with another digest are left out."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            data, off = utf8(batch.column(1))
            for a, b in pieces_of(off):
                sets = list(shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                own = [i for i, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == wanted[a + i]]
                ends = np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])])
                values = np.concatenate([sets[i] for i in own] or [np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(own, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold. A set crosses the network once per pair. A hub's pairs, many
    with one u, are dealt to copies of its set, one for each hot_limit of them, so no task gets them all."""
    pairs = materialise(pairs, "minhash-pairs")
    limit = hot_limit(pairs.count())
    hubs = F.broadcast(pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("u", F.ceil(F.col("n") / limit).alias("copies")))
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("s")).join(hubs, "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("t"))
    salted = pairs.join(hubs, "u", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("copies")), F.lit(0)).alias("salt"))
    both = salted.join(a, ["u", "salt"]).join(b, "v")
    common = F.size(F.array_intersect("s", "t"))
    return both.where(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("u", "v")


def prefix_pairs(docs: DataFrame, percent: int) -> DataFrame:
    """docs (doc_id, component, shingles) -> (u, v): all pairs of different components that may reach the threshold, by the prefix, length
    and position filters. A common shingle can stand in a prefix only where a document has hardly any rarer one."""
    n = F.size("shingles")
    each = docs.select("doc_id", "component", n.alias("n"), F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("f"))
    ordered = each.join(counts, "shingle").groupBy("doc_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    length = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    index = ordered.select("doc_id", "component", "n", F.posexplode(F.slice("s", F.lit(1), length.cast("int"))).alias("i", "t")).where("t.f > 1").select("doc_id", "component", "n", "i", F.col("t.shingle").alias("shingle"))
    a, b = (index.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "component", "n", "i")]) for side in "ab")
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    room = 1 + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) - 1
    met = a.join(b, "shingle").where((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (room >= need))
    return met.select(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    python_workers(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = materialise(sketch(texts), "minhash-sketches")
    named = sk.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")), "minhash-classes")
    reps = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.struct("digest", "size")).alias("c")).select("doc_id", F.col("c.digest").alias("rep_digest"), "c.size")
    banded = named.join(reps, "doc_id").where(F.col("digest") == F.col("rep_digest")).select("doc_id", "size", F.explode("bands").alias("band"))
    grouped = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top"), F.count("*").alias("n")).where("hub < top").select("band", "hub", "n")
    members = materialise(join_hot(banded, grouped, "band", "n", hot_limit(BANDS * classes.count())).select("band", "hub", "doc_id", "size").distinct(), "minhash-members")

    ids = materialise(members.select("doc_id").distinct().join(reps.select("doc_id", "rep_digest"), "doc_id"), "minhash-candidates")
    few = ids.count() <= BROADCAST_IDS  # 24 MB at most; beyond that a shuffled join
    sets = full_sets(texts.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "text", "rep_digest"))
    repeats = named.select("doc_id").count() > named.select("doc_id").distinct().count()
    sets = materialise(sets.dropDuplicates(["doc_id"]) if repeats else sets, "minhash-sets")
    sizes = classes.select(F.col("rep").alias("u"), F.col("size").alias("u_size"))

    star = members.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v"), F.col("size").alias("v_size")).distinct().join(sizes, "u")
    fits = lambda df: df.where(100 * F.least("u_size", "v_size") >= percent * F.greatest("u_size", "v_size")).select("u", "v")
    links = materialise(confirmed(fits(star), sets, percent), "minhash-links")
    comps = connected_components(links, "minhash-components")
    placed = members.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi AND n > 2").select("band")
    rest = materialise(placed.join(mixed, "band", "left_semi").select("doc_id", "component").distinct(), "minhash-mixed")
    more = materialise(confirmed(prefix_pairs(rest.join(sets, "doc_id"), percent), sets, percent), "minhash-links")
    if not more.isEmpty():
        comps = connected_components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), "minhash-components")

    final = classes.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sk.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
