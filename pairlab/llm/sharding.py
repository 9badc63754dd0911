"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import settle


def rendezvous(key: Column, weights: Mapping[int, float], seed: int = 0) -> Column:
    """The shard whose draw for this key is best.

    Every (key, shard) pair has its own uniform draw u; the shard with the smallest
    -ln(u) / weight takes the record, so shards hold shares in proportion to their weights.
    A new shard can only take records to itself, a removed one only gives its own away.
    Ties go to the smaller shard. A null key is one key: all its records share a shard.
    Weights must be positive; no shard at all is an error.
    """
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must name at least one shard, all positive")

    def cost(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11)
        unit = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(unit) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    costs = [cost(s, w) for s, w in sorted(weights.items())]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def assign_shards(
    df: DataFrame, key: str, text: str, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
    seed: int = 0,
) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of every record.

    `size` is the text's UTF-8 length plus 1 (null text: 1, checksum 0). `slot` numbers the
    records of a shard from 0 without gaps. `grown_shard` is the shard under the weights `grown`.

    No task holds a shard: slots are numbered within (shard, input partition) and moved by the
    counts of the partitions before, a table of shards times partitions rows. Hot keys, equal rows
    and null keys all split that way. The narrow record table is written first, so that counts and
    numbers see the same partitions even when an executor is lost. Empty input gives no rows; other
    columns of `df` are not read, and their names do not matter.
    """
    k, body = F.col(key), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    placed = settle(df.select(
        k.alias("key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(k, weights, seed).alias("shard"),
        (rendezvous(k, grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    ), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "part").orderBy("key", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(starts, ["shard", "part"])
        .select(
            F.col("key").alias(key), "size", "text_crc32", "shard",
            (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
