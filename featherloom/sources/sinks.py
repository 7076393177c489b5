"""Sinks: tables, matrices and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), one_file: bool = False) -> None:
    """Replaces what is at the path. One file is for reports only."""
    w = (df.coalesce(1) if one_file else df).write.mode("overwrite").format(format)
    if format == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def wide_matrix(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """A square table from (f1, f2, score), rows and columns in the given order."""
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("f1"))
    return pairs.where(F.col("f1").isin(*features)).groupBy("f1").pivot("f2", list(features)).agg(F.first("score")).orderBy(order)


def write_matrix(pairs: DataFrame, features: Sequence[str], path: str) -> None:
    write_table(wide_matrix(pairs, features), path, "csv", one_file=True)


def write_split(df: DataFrame, path: str) -> None:
    """One folder per value of ``split``."""
    write_table(df, path, partition_by=["split"])
