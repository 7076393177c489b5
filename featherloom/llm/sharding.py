"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard draws a number for a key from a hash of both, and the key goes to
the shard with the least ``-ln(u) / weight``: shards get rows in proportion to
their weights, and adding one moves only the rows that it wins itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_rows, table

SHARDS = 24


def shard_of(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Number of the winning shard; a null key has a shard like any other. A
    shard whose weight is 0 or less gets nothing; ties go to the lower number."""
    bids = []
    for s, w in enumerate(weights):
        if w <= 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + 0.5) * 2.0**-53
        bids.append(F.struct((-F.ln(u) / float(w)).alias("bid"), F.lit(first + s).alias("shard")))
    if not bids:
        raise ValueError("no shard has a positive weight")
    return (F.least(*bids) if len(bids) > 1 else bids[0]).getField("shard")


def assign(records: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float]) -> DataFrame:
    """Adds shard, grown_shard (under ``grown_weights``) and slot, the record's
    gapless place in its shard. Repeated keys share a shard, each with a slot;
    other columns ride along, but for those with the name of a result."""
    records = records.drop("shard", "grown_shard", "slot")
    placed = records.withColumn("shard", shard_of(F.col(key), weights)).withColumn("grown_shard", shard_of(F.col(key), grown_weights))
    rest = [c for c in records.columns if c != key]
    return number_rows(placed, ["shard"], [key, *rest], "slot")


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(records, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
