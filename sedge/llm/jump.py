"""Jump consistent hashing: rows to shards by a stable key, with no ring table.

Appending a shard moves only the rows that the new shard takes (one in n + 1 on
average); no row moves between old shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.scratch import materialized

# Fixed values of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)
NULL_KEY = 0x6E756C6C


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. All keys jump together until each lands beyond the last shard."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    place = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            place[moving] = ahead[moving]
            step = state[moving] * MULTIPLIER + np.uint64(1)
            state[moving] = step
            reach = float(1 << 31) / ((step >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[moving] = ((place[moving] + 1) * reach).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return place


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key column; a null key has a shard of its own choosing, the same for all nulls."""

    @F.pandas_udf("int")
    def shard_of(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard_of(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def shard_rows(df: DataFrame, key: str, text: str, shards: int, buckets: int | None = None) -> DataFrame:
    """Each row's place: ``size, text_crc32, law, shard, slot, grown_shard`` beside its key.

    * ``size``: UTF-8 bytes of the text (null: none) plus 8. ``text_crc32``: of the same bytes.
    * ``slot`` counts a shard's rows from 0 without gaps. A shard may hold any number
      of rows, so they are counted in hash buckets of keys first; a bucket's first
      slot is the sum of those before it, and only a bucket's rows are put in order.
      Rows with the same key are dealt over the buckets by their text's checksum
      and size, so that a key held by many rows is no single task.
    * Null keys form a key like any other. Empty tables give no rows. Repeated rows
      keep a slot each. Other columns of the input are not read.
    """
    spark = df.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + F.lit(8)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    placed = rows.select(
        "*",
        jump_shard(F.col("key"), shards).alias("shard"),
        jump_shard(F.col("key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    placed = materialized(placed, "shards")  # narrow, and read twice below; the texts are read once
    ranked = placed.select(
        "*",
        F.row_number()
        .over(Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size"))
        .alias("nth"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(starts, ["shard", "bucket"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("nth") - 1).alias("slot"),
        "grown_shard",
    )
