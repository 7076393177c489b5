"""Feature blocks: (block_id, feature) tables against pair scores.

Block and pair tables have a row per feature or pair, so their joins are left
to the optimizer's own size checks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def placed_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the blocks of both features; features without a block drop out."""
    b = blocks.select("block_id", "feature")
    first, second = (b.select(F.col("block_id").alias(n), F.col("feature").alias(f)) for n, f in (("block_1", "f1"), ("block_2", "f2")))
    return pairs.join(first, "f1").join(second, "f2")


def within_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    p = placed_pairs(blocks, pairs).where("block_1 = block_2")
    return p.select(F.col("block_1").alias("block_id"), "f1", "f2", "score").orderBy("block_id", F.desc("score"), "f1", "f2")


def within_stats(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per block its size, features, statistics of its pairs (null for a
    singleton) and its weakest pair."""
    sizes = blocks.groupBy("block_id").agg(F.count("*").alias("block_size"), F.array_join(F.sort_array(F.collect_list("feature")), " | ").alias("features"))
    p = placed_pairs(blocks, pairs).where("block_1 = block_2")
    weakest = F.min_by(F.concat_ws(" <-> ", "f1", "f2"), F.struct("score", "f1", "f2"))
    stats = p.groupBy(F.col("block_1").alias("block_id")).agg(F.avg("score").alias("mean_within"), F.min("score").alias("min_within"), F.max("score").alias("max_within"), F.stddev_pop("score").alias("std_within"), weakest.alias("weakest_pair"))
    return sizes.join(stats, "block_id", "left")


def between_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    p = placed_pairs(blocks, pairs).where("block_1 <> block_2")
    return p.select(F.least("block_1", "block_2").alias("block_a"), F.greatest("block_1", "block_2").alias("block_b"), "f1", "f2", "score")


def between_stats(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    return between_pairs(blocks, pairs).groupBy("block_a", "block_b").agg(F.avg("score").alias("mean_between"), F.max("score").alias("max_between"), F.min("score").alias("min_between"), F.count("*").alias("n_pairs"))


def separation(blocks: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean score within and between blocks over all pairs, and their ratio; per
    value of ``by`` if the block table holds several configurations."""
    b = blocks.select(*by, "block_id", "feature")
    shared = [c for c in by if c in pairs.columns]
    p = pairs.join(b.withColumnsRenamed({"block_id": "block_1", "feature": "f1"}), ["f1", *shared]).join(b.withColumnsRenamed({"block_id": "block_2", "feature": "f2"}), ["f2", *by])
    same = F.col("block_1") == F.col("block_2")
    g = p.groupBy(*by).agg(F.avg(F.when(same, F.col("score"))).alias("mean_within"), F.avg(F.when(~same, F.col("score"))).alias("mean_between"), F.min(F.when(same, F.col("score"))).alias("min_within"), F.max(F.when(~same, F.col("score"))).alias("max_between"), F.count_if(same).alias("n_within"), F.count_if(~same).alias("n_between"))
    return g.withColumn("ratio", ratio(F.col("mean_within"), F.col("mean_between")))


def weak_pairs(blocks: DataFrame, pairs: DataFrame, below: float = 0.5) -> DataFrame:
    """Pairs inside a block whose score is too low."""
    return within_pairs(blocks, pairs).where(F.col("score") < below)


def suspicious(stats: DataFrame, below: float = 0.4) -> DataFrame:
    """Blocks whose weakest pair is too weak; singletons are exempt."""
    return stats.where((F.col("block_size") > 1) & (F.col("min_within") < below))


def block_sizes(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sizes = blocks.groupBy(*by, "block_id").agg(F.count("*").alias("size"))
    return sizes.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.count_if(F.col("size") == 1).alias("n_singletons"))


def rewrite(blocks: DataFrame, parts: Mapping[int, Sequence[Sequence[str]]]) -> DataFrame:
    """Blocks with some replaced by parts; ids run from 1, ``original`` keeps the old."""
    spark = blocks.sparkSession
    rows = [(old, i + 1, f) for old, ps in parts.items() for i, p in enumerate(ps) for f in p]
    new = spark.createDataFrame(rows, "original long, part int, feature string")
    old = blocks.where(~F.col("block_id").isin(*parts) if parts else F.lit(True)).select(F.col("block_id").alias("original"), F.lit(1).alias("part"), "feature")
    every = old.unionByName(new)
    return every.select(F.dense_rank().over(Window.orderBy("original", "part")).cast("long").alias("block_id"), "original", "feature")


def move_feature(blocks: DataFrame, feature: str, to: int) -> DataFrame:
    return blocks.withColumn("block_id", F.when(F.col("feature") == feature, F.lit(to).cast("long")).otherwise(F.col("block_id")))


def validation(blocks: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(problem, feature): features missing, unexpected, or placed more than once."""
    want = blocks.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in expected])).alias("feature"))
    have = blocks.groupBy("feature").agg(F.count("*").alias("n"))
    missing = want.join(have, "feature", "left_anti").select(F.lit("missing").alias("problem"), "feature")
    extra = have.join(want, "feature", "left_anti").select(F.lit("unexpected").alias("problem"), "feature")
    return missing.unionByName(extra).unionByName(have.where("n > 1").select(F.lit("repeated").alias("problem"), "feature"))


def checked(blocks: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The blocks; reading them raises if a feature is missing, unexpected or placed
    twice, or if there are none. The check is part of the same plan."""
    found = validation(blocks, expected).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "problem", "feature"))), ", ").alias("said"))
    size = blocks.agg(F.count("*").alias("n"))
    report = found.join(F.broadcast(size)).select(F.when(F.col("n") == 0, F.lit("no blocks")).when(F.col("said") != "", F.col("said")).alias("said"))  # one row
    # One row of the report meets all blocks, or stands alone where there are none.
    met = report.join(blocks, F.lit(True), "left")
    fine = F.when(F.col("said").isNotNull(), F.raise_error(F.concat(F.lit("blocks: "), "said")).cast("boolean")).otherwise(F.lit(True))
    return met.where(fine).select(*blocks.columns)


def by_size(blocks: DataFrame) -> DataFrame:
    """Blocks renumbered from 1, larger first, ties by their first feature."""
    g = blocks.groupBy("block_id").agg(F.count("*").alias("size"), F.min("feature").alias("first"))
    ids = g.select(F.col("block_id").alias("original"), F.row_number().over(Window.orderBy(F.desc("size"), "first")).cast("long").alias("block_id"), "size")
    return blocks.withColumnRenamed("block_id", "original").join(ids, "original").select("block_id", "original", "size", "feature")
