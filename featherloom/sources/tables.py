"""Sources: tables with declared columns, matrices, and block tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import any_of, as_number_strict, parse_list

#: Column names under which a block's id and features come.
BLOCK_IDS = ("Block_ID", "block_id", "Block", "component")
BLOCK_FEATURES = ("Features", "features", "Feature_List")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table under a declared schema: types are never guessed from data."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df if columns is None else require_columns(df, columns).select(*columns)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df if columns is None else require_columns(df, columns).select(*columns)


def read_chunks(spark: SparkSession, path: str, rows: int, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table with ``file`` and ``chunk``, the number from 0 of each run of
    ``rows`` rows of a file, whatever splits tasks read."""
    df = spark.read.parquet(path)
    names = df.columns if columns is None else require_columns(df, columns) and list(columns)
    return df.select(*names, F.col("_metadata.file_name").alias("file"), F.floor(F.col("_metadata.row_index") / rows).cast("long").alias("chunk"))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, without reading rows."""
    return spark.read.option("header", True).csv(path).columns


def size_gb(spark: SparkSession, path: str) -> DataFrame:
    """One row: GB of the files under a path, from their listing alone."""
    return spark.read.format("binaryFile").load(path).agg((F.sum("length") / 1024**3).alias("gb"))


def long_matrix(wide: DataFrame, index: str | None = None) -> DataFrame:
    """(f1, f2, score) of a square table whose first column names the rows."""
    index = index or wide.columns[0]
    names = [c for c in wide.columns if c != index]
    values = wide.select(F.col(f"`{index}`").alias("f1"), *[as_number_strict(F.col(f"`{c}`")).alias(c) for c in names])
    return values.unpivot("f1", names, "f2", "score")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return long_matrix(spark.read.option("header", True).csv(path))


def blocks(df: DataFrame) -> DataFrame:
    """(block_id, feature, position) of a block table under any of its accepted
    column names; without ids, blocks are numbered in the order of their features."""
    names, ids = any_of(BLOCK_FEATURES, df.columns), any_of(BLOCK_IDS, df.columns)
    if names is None:
        raise ValueError(f"no column of features among {df.columns}")
    kind = dict(df.dtypes)[names]
    parts = F.col(names) if kind.startswith("array") else parse_list(F.col(names))
    if ids is None:
        df = df.withColumn("block_id", F.row_number().over(Window.orderBy(names)))  # a block table is a report's size
        ids = "block_id"
    return df.where(F.size(parts) > 0).select(F.col(ids).cast("long").alias("block_id"), F.posexplode(parts).alias("position", "feature")).select("block_id", "feature", "position")


def labels(df: DataFrame) -> DataFrame:
    """(feature, label), from a list per block or one feature per row; a feature given twice raises."""
    rows = blocks(df).select("feature", F.col("block_id").alias("label")) if any_of(BLOCK_FEATURES, df.columns) else df.select(F.trim("feature").alias("feature"), F.col(any_of((*BLOCK_IDS, "label"), df.columns)).cast("long").alias("label"))
    twice = rows.groupBy("feature").agg(F.count("*").alias("n"), F.first("label").alias("label"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("feature given twice: "), F.col("feature"))).cast("long")).otherwise(F.col("label"))
    return twice.select("feature", checked.alias("label")).orderBy("feature")


def trials(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "trial")
