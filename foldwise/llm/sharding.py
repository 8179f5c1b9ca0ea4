"""Operator 6: shards by jump consistent hashing, with DataFrame functions only.

A key's shard is found by jumping through an increasing sequence of shard
numbers drawn from a generator seeded by the key; the last jump below the shard
count wins.  There is no ring table, the same sequence serves every shard
count, and one more shard only takes over the keys whose next jump lands on it
(about 1/(n+1) of them).

The generator is the minimal-standard multiplicative one (modulus 2^31 - 1),
which stays inside signed 64-bit arithmetic, so ANSI mode never overflows.

Edge cases: a null key hashes as the word ``null``; a null text has size 8 and
CRC 0; rows equal in key and text share a shard and get consecutive slots; an
empty table gives an empty result; other input columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch, partitions

MODULUS = 2147483647          # 2^31 - 1, prime
MULTIPLIER = 48271            # minimal-standard multiplier


def key_seed(key: Column) -> Column:
    """Seed in 1 .. MODULUS - 1 from the first 32 bits of the key's MD5."""
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10)
    return h.cast("bigint") % F.lit(MODULUS - 1) + F.lit(1)


def jump_shards(seed: Column, n_shards: int) -> Column:
    """Struct (shard, grown): the shard among ``n_shards`` and among one more."""
    long = lambda v: F.lit(v).cast("bigint")

    def step(acc: Column, _: Column) -> Column:
        nxt = (acc["state"] * F.lit(MULTIPLIER)) % F.lit(MODULUS)
        reach = (acc["jump"] + 1) * F.lit(MODULUS)
        target = (reach - reach % nxt) / nxt          # whole part of (jump + 1) / (nxt / MODULUS)
        moved = F.struct(F.when(acc["jump"] < n_shards, acc["jump"]).otherwise(acc["shard"]).alias("shard"),
                         acc["jump"].alias("grown"), target.cast("bigint").alias("jump"), nxt.alias("state"))
        return F.when(acc["jump"] <= n_shards, moved).otherwise(acc)

    start = F.struct(long(0).alias("shard"), long(0).alias("grown"), long(0).alias("jump"), seed.alias("state"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n_shards)), start, step)


def shard_documents(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text",
                    overhead: int = 8) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot): one row per input row.

    The text is read once; only narrow rows are shuffled.  Equal rows are
    counted before the shuffle.  Slots are numbered in two steps: rows are
    spread over hash buckets inside each shard, bucket totals (shards x buckets
    rows) become offsets, and a window numbers the rows of one bucket, so no
    task holds a whole shard."""
    spark = df.sparkSession
    buckets = partitions(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(F.col(key).alias("key"),
                     (F.octet_length(body) + F.lit(overhead)).cast("bigint").alias("size"),
                     F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = (slim.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("to", jump_shards(key_seed(F.col("key")), n_shards))
            .select("key", "size", "text_crc32", "n", F.col("to.shard").cast("int").alias("shard"),
                    F.col("to.grown").cast("int").alias("grown_shard"),
                    F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket")))
    rows = Scratch(spark, "shards").put(rows, "rows")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
               .select("shard", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")))
    inside = (Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = (rows.join(offsets, ["shard", "bucket"])
                .withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))))
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard", "grown_shard",
                           F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
