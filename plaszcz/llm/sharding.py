"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard depends on the key and the number of shards only; when a shard is appended,
the keys that move all move into it, about 1/(n+1) of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keeps_names, stage

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard in [0, n_shards) of each 64-bit key."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while live.size:
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * _STEP + np.uint64(1)
        ratio = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = np.floor((shard[live] + 1) * ratio).astype(np.int64)
        live = live[jump[live] < n_shards]
    return shard


def _jump_udf(n_shards: int):
    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(key.to_numpy(), n_shards).astype(np.int32))

    return shard_of


@keeps_names
def assign_shards(df: DataFrame, key: str, n_shards: int, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add shard, grown_shard (with one more shard) and slot (gapless from 0 within each shard).

    A null key is a key of its own. Rows that share a key share a shard. Slots are numbered
    without gathering a shard in one task: rows of a shard are split over buckets by a hash
    of the whole row, buckets are counted, and a row's slot is its bucket's start plus its
    rank in the bucket. Ties in the key are ordered by the row's hash; equal rows are
    interchangeable. The column names shard, slot and grown_shard are replaced if present;
    other columns are kept. An empty table gives an empty table.
    """
    clash = [c for c in ("shard", "slot", "grown_shard") if c in df.columns]
    mixed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null")))
    whole = F.xxhash64(*[F.col(c) for c in df.columns if c not in clash])
    base = (
        df.drop(*clash)
        .withColumn("_key", mixed)
        .withColumn("_row", whole)
        .withColumn("shard", _jump_udf(n_shards)("_key"))
        .withColumn("grown_shard", _jump_udf(n_shards + 1)("_key"))
    )
    base, _ = stage(base, "shards")
    buckets = max(16, -(-base.count() // (rows_per_bucket * n_shards)))
    base = base.withColumn("_bucket", F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(buckets)))
    starts = (
        base.groupBy("shard", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n"))
        .select("shard", "_bucket", "_start")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_first(), "_row"))
    return (
        base.withColumn("_rank", rank.cast("long"))
        .join(starts, ["shard", "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_rank") - 1)
        .drop("_key", "_row", "_bucket", "_rank", "_start")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 by doc_id, its slot, and its shard of 25."""
    from .store import table

    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign_shards(sized, "doc_id", 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
