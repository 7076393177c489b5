"""Helpers that several training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters outside these: space, and tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of a table for each slot over which number_rows deals a group, on average at most.
SLOT_ROWS = 16_384


def repeated(df: DataFrame, times: str, place: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``place``; a row that is
    repeated more than SLOT_ROWS times is dealt out in pieces."""
    n, start = F.col(times), f"{place}_from"
    spread = lambda d: d.withColumn(place, F.explode(F.sequence(F.col(start), F.least(n, F.col(start) + SLOT_ROWS) - 1)))
    few = df.where((n > 0) & (n <= SLOT_ROWS)).withColumn(start, F.lit(0).cast("long"))
    many = df.where(n > SLOT_ROWS).withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(SLOT_ROWS).cast("long"))))
    return spread(few).unionByName(spread(many.repartition(start))).drop(start)


def number_rows(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: a gapless number from 0 within each group.

    A group may hold any share of the rows: its rows are dealt over slots by a
    hash of ``order``, numbered in each slot, and shifted by the rows of the
    slots before it. There are as many slots as the table's rows ask for, so any
    session numbers alike. Equal rows are counted before they are dealt, so that
    any number of them is one row of a slot; rows equal in ``order`` alone share
    a slot, in any order. Other columns ride along, whatever their names. The
    rows are counted first, so ``df`` should be cheap to read.
    """
    n = max(1, -(-df.count() // SLOT_ROWS))
    own = df.select(F.struct(*df.columns).alias("row"), F.struct(*groups).alias("group"), F.struct(*order).alias("at"))
    each = own.groupBy("row", "group", "at").agg(F.count("*").alias("n")).withColumn("slot", F.pmod(F.xxhash64("at"), F.lit(n)).cast("int"))
    before = Window.partitionBy("group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.groupBy("group", "slot").agg(F.sum("n").alias("n")).select(F.col("group").alias("of"), F.col("slot").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("group", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = each.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    met = numbered.join(shift, F.col("group").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("in"))).select("row", "n", (F.col("first") + F.col("shift")).alias("first"))
    return repeated(met, "n", "k").select("row.*", (F.col("first") + F.col("k")).cast("long").alias(out))


def join_by_key(rows: DataFrame, stats: DataFrame, key: list[str], n: str, share: float = 0.001) -> DataFrame:
    """Inner join of ``rows`` with one row per key that has the key's count ``n``.

    A key with ``share`` of all counted rows or more is joined by broadcast:
    there are at most 1 / share of them. The others go by a shuffle in which
    none is large. Both inputs are read twice, so they should be cheap to read.
    """
    total = stats.agg(F.sum(n).alias("_total"))
    heavy = F.broadcast(stats.join(F.broadcast(total)).where(F.col(n) >= share * F.col("_total")).drop("_total"))
    rest = rows.join(heavy.select(*key), key, "left_anti").join(stats, key)
    return rows.join(heavy, key).unionByName(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
