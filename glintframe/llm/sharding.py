"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Native: DataFrame functions only. Rows are dealt by a hash of their id into `P` source partitions.
The driver draws, from the P partition counts alone, how many rows each partition sends to each
shard: a table with exactly the margins of a uniform random permutation (multivariate
hypergeometric, row by row). Each partition is permuted locally (rank of a seeded hash) and cut at
the drawn counts; shards are then permuted again for the slots, in hashed sub-buckets whose sizes
give each one its first slot, so no task ever holds a whole shard.

Scale: counts per partition (at most `max_buckets`) and the P x shards matrix reach the driver,
never rows. Everything is a function of ids and the seed, so lost executors and reruns agree.
Rows move twice, as five numbers, without their texts.

Edge cases: null text has size 8 and crc32 0; null ids hash like any value; an empty table gives an
empty result; repeated rows are dealt as rows of their own. Only id and text are read, so further
columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

SHARDS = 24


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact draw of the number of good ones among n of good + bad, at any size.

    Inverts the distribution function around the mode; the ratios of neighbouring probabilities
    are exact, the tails left out weigh less than 1e-30.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    reach = int(12 * spread) + 24
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    total_weight = np.cumsum(weights)
    return a + int(np.searchsorted(total_weight, rng.random() * total_weight[-1], side="right").clip(0, b - a))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """(partitions x shards) row counts: row sums are `counts`, column sums differ by at most one."""
    rng = np.random.default_rng(seed)
    n = sum(counts)
    room = [n // shards + (j < n % shards) for j in range(shards)]
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, mine in enumerate(counts):
        rest, left = sum(room), mine
        for j in range(shards):
            rest -= room[j]
            out[p, j] = x = hypergeometric(rng, room[j], rest, left) if left else 0
            left -= x
        room = [r - int(x) for r, x in zip(room, out[p])]
    return out


def shuffle_into_shards(rows: DataFrame, key: str, shards: int = SHARDS, seed: int = 20_240_607, bucket_rows: int = 50_000, min_buckets: int = 256, max_buckets: int = 4096) -> DataFrame:
    """`rows` with `shard` (0..shards-1, counts at most one apart) and `slot` (gapless from 0 in each shard).

    `key` and the other columns order rows, so fully equal rows are interchangeable.
    """
    spark = rows.sparkSession
    names = rows.columns
    others = [c for c in names if c != key]
    n = rows.count()
    buckets = int(min(max_buckets, max(min_buckets, -(-n // bucket_rows))))
    first = F.xxhash64(F.lit(seed), F.col(key))
    second = F.xxhash64(F.lit(seed + 1), F.col(key))
    dealt = rows.withColumns({"__h": first, "__p": F.pmod(first, F.lit(buckets)).cast("int")})
    counted = {r["__p"]: r["n"] for r in dealt.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    counts = [counted.get(p, 0) for p in range(buckets)]
    cuts = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    # One row for each partition: at most max_buckets x shards numbers, 0.8 MB.
    sent = spark.createDataFrame([(p, [int(x) for x in c]) for p, c in enumerate(cuts)], "__q int, __cuts array<bigint>")
    local = Window.partitionBy("__p").orderBy("__h", key, *others)
    placed = (dealt.withColumn("__rank", F.row_number().over(local) - 1)
              .join(F.broadcast(sent), F.col("__p") == F.col("__q"))
              .select(*names, F.size(F.filter("__cuts", lambda c: c <= F.col("__rank"))).alias("shard")))
    placed = checkpointed(placed.withColumns({"__h": second, "__b": F.pmod(F.shiftrightunsigned(second, 17), F.lit(max(1, buckets // shards))).cast("int")}), gathered=True)
    parts = placed.groupBy("shard", "__b").agg(F.count("*").alias("__n"))  # at most shards x max_buckets / shards rows
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("shard").alias("__s"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    again = Window.partitionBy("shard", "__b").orderBy("__h", key, *others)
    return (placed.withColumn("__rank", F.row_number().over(again) - 1)
            .join(F.broadcast(parts), (F.col("shard") == F.col("__s")) & (F.col("__b") == F.col("__c")))
            .select(*names, "shard", (F.col("__from") + F.col("__rank")).cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs` (law `rows`).

    The method is a uniform shuffle, so equal texts spread over shards like any rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = shuffle_into_shards(rows, "doc_id", shards, **options)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
