"""Sharding by extendible hashing (operator 4), native DataFrame operations only.

Rows hash to a bit string. The directory starts at the depth that the total size suggests; its cells are summed once and
rolled up to every shorter prefix, and each row's shard is the shortest prefix of its hash whose rows fit the byte
limit, so only oversized buckets are split, one bit at a time. Cells that are still too large at that depth are the
only ones looked at again, STEP bits deeper each round, until all fit, hold a single row, or the hash is used up.

The hash covers the key. Rows of one key that together exceed the limit share its 60 bits; their directory goes on with
60 bits of a hash of key and row number, so that a heavily repeated key is split like any other. A row larger than the
limit ends alone in a shard that does not fit (fits = false); a very long text is only measured. A null key hashes as the
text 'null'; a null text has no bytes. Repeated rows are rows of their own. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise, table

LIMIT_BYTES = 256 << 10
HASH_BITS = 60
STEP = 6


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 of the key's text, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


def digits(p: Column, depth: Column) -> Column:
    """The first `depth` bits, `p`, in binary digits."""
    return F.when(depth == 0, "").otherwise(F.lpad(F.conv(p.cast("string"), 10, 2), depth.cast("int"), F.lit("0")))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """`rows` (parent, h, n_bytes and others), each with the shortest prefix (depth, p) of its hash whose rows fit the limit
    within its parent, and their sum and number. A cell that is too large when the hash is used up stays whole."""
    total = rows.groupBy("parent").agg(F.sum("n_bytes").alias("b")).agg(F.coalesce(F.max("b"), F.lit(0)).alias("b")).first().b
    low, high = 0, min(HASH_BITS, max(1, -(-int(total) // max(1, limit))).bit_length() + STEP // 2)
    found, rest = [], rows
    while True:
        cells = rest.groupBy("parent", prefix(F.col("h"), F.lit(high)).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        up = cells.select("parent", "cell", "b", "n", depths).withColumn("p", F.call_function("shiftright", "cell", (F.lit(high) - F.col("depth")).cast("int")))
        sums = up.groupBy("parent", "depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        last = (F.col("depth") == HASH_BITS) & (high == HASH_BITS)
        fitting = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | last)
        # a short prefix stands over many cells: it meets them in parts of eight, by their last bits
        parts = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.lit(high) - F.col("depth") - 3).cast("int"))
        salted = fitting.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        under = up.select("parent", "cell", "depth", "p", F.col("cell").bitwiseAND(parts - 1).alias("part"))
        best = under.join(salted, ["parent", "depth", "p", "part"]).groupBy("parent", "cell").agg(F.min(F.struct("depth", "p", "shard_bytes", "shard_rows")).alias("s"))
        best = materialise(best.withColumnRenamed("cell", "at").withColumnRenamed("parent", "of"), "directory")
        here = (F.col("parent") == F.col("of")) & (prefix(F.col("h"), F.lit(high)) == F.col("at"))
        found.append(rest.join(best, here).select(*rest.columns, "s.*"))
        if high == HASH_BITS:
            break
        rest = materialise(rest.join(best.select("of", "at"), here, "left_anti"), "oversized")
        if not rest.take(1):
            break
        low, high = high + 1, min(HASH_BITS, high + STEP)
    return reduce(DataFrame.unionByName, found)


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, shard (the prefix in binary digits), depth, shard_bytes, shard_rows, fits."""
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("uid"), hash_bits(F.col(key)).alias("h"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = materialise(rows.withColumn("parent", F.lit(-1).cast("long")), "hashed")
    found = directory(rows, limit)
    # rows that share the whole hash, and do not fit: the same, by a hash of the row
    crowded = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    same = materialise(found.where(crowded).select("key", "uid", "n_bytes", F.col("h").alias("parent"), hash_bits(F.concat_ws("/", F.col("key").cast("string"), F.col("uid").cast("string"))).alias("h")), "same-hash")
    own = digits(F.col("p"), F.col("depth"))
    columns = ["key", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]
    out = found.withColumn("shard", own)
    if same.take(1):
        more = directory(same, limit).withColumn("shard", F.concat(digits(F.col("parent"), F.lit(HASH_BITS)), own)).withColumn("depth", F.col("depth") + HASH_BITS)
        out = out.where(~crowded).select(*columns).unionByName(more.select(*columns))
    return out.select(F.col("key").alias(key), "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))


def op4_sharding(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS n_bytes FROM documents),
d AS (SELECT r.*, depth, h >> ({HASH_BITS} - depth)::INT AS p FROM r, (SELECT unnest(range(0, {HASH_BITS + 1})) AS depth)),
s AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM d GROUP BY 1, 2),
b AS (SELECT d.doc_id, d.h, d.n_bytes, d.depth, d.p, s.shard_bytes, s.shard_rows,
      row_number() OVER (PARTITION BY d.doc_id ORDER BY d.depth) AS k
      FROM d JOIN s ON s.depth = d.depth AND s.p = d.p
      WHERE s.shard_bytes <= {LIMIT_BYTES} OR s.shard_rows = 1 OR d.depth = {HASH_BITS})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth::INT, '0') END AS shard, depth, shard_bytes, shard_rows,
       shard_bytes <= {LIMIT_BYTES} AS fits FROM b WHERE k = 1
"""
