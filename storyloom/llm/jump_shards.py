"""Sharding by jump consistent hashing.

A key's shard is a pure function of the key and the number of shards (Lamping
and Veach, 2014): no ring table, and going from n to n + 1 shards moves only
the keys that land in the new shard, 1 / (n + 1) of them on average.  The hash
loop runs over whole Arrow batches in numpy; a batch takes as many rounds as
its unluckiest key, about ln(n) on average.

Slots number the rows of a shard without gaps.  A shard grows with the data,
so no task ever orders a whole shard: rows are dealt into slices of a shard by
a hash of the key, numbered inside each slice, and shifted by the sizes of the
shard's earlier slices.

Defined results: rows with a null key share one fixed shard; repeated rows
share a shard and get slots of their own; a null text counts as no bytes and
has the checksum of the empty string; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys at once."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        key = state[live] * _STEP + np.uint64(1)
        state[live] = key
        jump = ((shard[live] + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
        jump = jump.astype(np.int64)
        going = jump < n_shards
        live = live[going]
        shard[live] = jump[going]
    return shard


def shard_of(key, n_shards: int):
    """Column: the shard of any key column, mixed to 64 bits first."""

    @F.pandas_udf("int")
    def jump(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(jump_hash(keys.to_numpy(), n_shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(docs: DataFrame, n_shards: int, key_col: str = "doc_id",
                  grown_by: int = 1) -> DataFrame:
    """``docs`` with ``shard`` of ``n_shards`` and ``grown_shard`` of ``n_shards + grown_by``."""
    return (docs.withColumn("shard", shard_of(F.col(key_col), n_shards))
            .withColumn("grown_shard", shard_of(F.col(key_col), n_shards + grown_by)))


def with_slots(sharded: DataFrame, key_col: str = "doc_id",
               order_cols: tuple[str, ...] = (), rows_per_slice: int = 100_000) -> DataFrame:
    """Add ``slot``: 0, 1, 2 … inside each shard.

    ``rows_per_slice`` bounds what one window task orders; the number of slices
    follows the row count.  Repeated keys beyond that bound share a slice only
    if they are the same key, so the other order columns join the slice hash.
    """
    slices = max(1, -(-sharded.count() // rows_per_slice))
    parts = [F.col(key_col), *[F.col(c) for c in order_cols]]
    cut = sharded.withColumn("_slice", F.pmod(F.xxhash64(F.lit(7), *parts), F.lit(slices)).cast("int"))
    sizes = cut.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_slice").orderBy(*parts)
    return (cut.withColumn("_at", F.row_number().over(within) - 1)
            .join(offsets, ["shard", "_slice"])
            .withColumn("slot", (F.col("_before") + F.col("_at")).cast("long"))
            .drop("_slice", "_at", "_before"))


def shard_manifest(docs: DataFrame, n_shards: int, key_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: key, size, checksum, shard, slot and the shard it
    would have with one shard more.  Texts are measured in the scan and never
    shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        F.col(key_col), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return with_slots(assign_shards(light, n_shards, key_col), key_col, ("text_crc32", "size"))
