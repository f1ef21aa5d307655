"""Sharding by a Feistel permutation with cycle walking over global row numbers (native).

Law `rows`: shard sizes differ by one row at most. A row's place is p = permutation(number); its
shard is p mod shards, its slot p div shards, so both are computable from the number alone.

Numbers depend on content only: rows are ordered by a hash of id, size and text checksum, then by these. Identical rows
are counted first (a hot group is one row after the map-side combine), the groups are dealt by the hash's first bits to
buckets of about BUCKET_ROWS and ordered there; a bucket starts where the buckets before it end. Nothing is ordered globally and no
text is shuffled. The order, and so the permutation, does not depend on the number of buckets.

A round is two multiplications modulo two primes, which any SQL engine can do in 64 bits.

Defined cases: null text has size 1 and crc32 0; null ids are one more id; repeated rows each get a
place of their own; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

#: Buckets are a power of two: MIN_BUCKETS at least, MAX_BUCKETS (all that is broadcast) at most.
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS = 200_000, 64, 1 << 20
ROUNDS = 6
WALKS = 96
BLOCK = 10_000
SEED = 7
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


def keys(seed: int) -> list[tuple[int, int, int]]:
    """An addend and two multipliers for each round."""
    out, x = [], seed
    for _ in range(3 * ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((x >> 33) % (PRIMES[1] - 2) + 1)
    return list(zip(out[::3], out[1::3], out[2::3], strict=True))


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half for 0..n-1."""
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def feistel(x: Column, n: int, seed: int) -> Column:
    """A permutation of 0..n-1 at `x`. The network permutes 0..2**bits-1 < 2n (or 4); results of n or more
    walk on. A walk leaves each step with a chance of about 1/2 or more; one of over WALKS steps (some 2**-96
    a row) raises an error and is never dropped."""
    high, low = widths(n)

    rounds = F.array(*[F.struct(*[F.lit(x).cast("long").alias(name) for name, x in zip(("add", "by", "again", "mask"), (*k, (1 << (low if i % 2 else high)) - 1), strict=True)]) for i, k in enumerate(keys(seed))])
    halves = lambda left, right: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        h = (acc["r"] + k["add"]) * k["by"] % PRIMES[0] * k["again"] % PRIMES[1]
        return halves(acc["r"], acc["l"].bitwiseXOR(h.bitwiseAND(k["mask"])))

    def step(v: Column) -> Column:
        start = halves(F.shiftrightunsigned(v, low), v.bitwiseAND(F.lit((1 << low) - 1)))
        return F.aggregate(rounds, start, turn, lambda acc: F.shiftleft(acc["l"], low).bitwiseOR(acc["r"]))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), step(x), lambda a, _: F.when(a < n, a).otherwise(step(a)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, row_number, shard, slot, grown_shard."""
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"))
    rows = rows.withColumn("size", F.col("size") + 1)
    groups = rows.groupBy(id_col, "size", "text_crc32").agg(F.count("*").alias("copies"))
    own = F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "size", "text_crc32")
    groups = materialise(groups.withColumn("hash", F.conv(F.substring(F.md5(own), 1, 8), 16, 10).cast("long")), "shard-groups")
    many, n = groups.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    buckets = MIN_BUCKETS
    while buckets < MAX_BUCKETS and buckets * BUCKET_ROWS < many:
        buckets *= 2
    groups = groups.withColumn("bucket", F.shiftright("hash", 32 - (buckets.bit_length() - 1)))
    per_bucket = groups.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    # At most MAX_BUCKETS rows: the running sum's one task and the broadcast are bounded.
    starts = per_bucket.select("bucket", (F.sum("in_bucket").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_bucket")).alias("bucket_start"))
    order = W.partitionBy("bucket").orderBy("hash", F.col(id_col).asc_nulls_last(), "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = groups.withColumn("before", F.sum("copies").over(order) - F.col("copies")).join(F.broadcast(starts), "bucket")
    # A large group is spread in blocks, so no array holds the whole of it.
    block = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BLOCK}"))))
    one = block.withColumn("i", F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("copies"), (F.col("block") + 1) * BLOCK) - 1)))
    numbered = one.withColumn("row_number", F.col("bucket_start") + F.col("before") + F.col("i"))
    p = numbered.withColumn("p", feistel(F.col("row_number"), max(n, 1), seed))
    return p.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "row_number", (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte through its table, and the network one round for each step of a recursion.
OP8_SQL = f"""
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT doc_id, length(h) // 2 + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::BIGINT)),
  lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) AS text_crc32 FROM d, crc),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || size || ' ' || text_crc32), 1, 8))::BIGINT, doc_id NULLS LAST, size, text_crc32) - 1 AS row_number FROM s),
w AS (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) // 2 AS low, greatest(2, length(bin(count(*) - 1))) - greatest(2, length(bin(count(*) - 1))) // 2 AS high,
  {[k[0] for k in keys(SEED)]} AS adds, {[k[1] for k in keys(SEED)]} AS bys, {[k[2] for k in keys(SEED)]} AS agains FROM o),
f(row_number, l, r, k) AS (
  SELECT row_number, row_number >> low, row_number & ((1::BIGINT << low) - 1), 0 FROM o, w
  UNION ALL
  SELECT row_number, CASE WHEN k = {ROUNDS} THEN l ELSE r END, CASE WHEN k = {ROUNDS} THEN r ELSE
      xor(l, ((r + adds[k + 1]) * bys[k + 1] % {PRIMES[0]} * agains[k + 1] % {PRIMES[1]}) & ((1::BIGINT << CASE WHEN k % 2 = 0 THEN high ELSE low END) - 1)) END,
    CASE WHEN k = {ROUNDS} THEN 0 ELSE k + 1 END
  FROM f, w WHERE k < {ROUNDS} OR ((l << low) | r) >= n),
p AS (SELECT row_number, (l << low) | r AS p FROM f, w WHERE k = {ROUNDS} AND ((l << low) | r) < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, row_number, (p % 16)::INTEGER AS shard, p // 16 AS slot, NULL::INTEGER AS grown_shard FROM o JOIN p USING (row_number)
"""
