"""Row hygiene, splits, and fitted preprocessing state."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_number, finite, hash_bits, hash_unit, log1p, robust_scaled, rule_threshold, without_artifacts
from ..sources.tables import require_columns
from .order import quantiles
from .profile import with_share

#: The upper ends of the splits.
SPLITS = (("train", 0.7), ("validation", 0.85), ("test", 1.0))


def drop_identity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the given columns, all of which must be there."""
    return require_columns(df, columns).drop(*columns)


def drop_incomplete(df: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Rows without a null, where infinite numbers count as null too."""
    return df.withColumns({c: finite(F.col(c)) for c in numeric}).dropna("any")


def observed_hygiene(df: DataFrame, numeric: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """drop_incomplete, and what it saw: rows ``before``, ``removed``, and nulls of
    each column (``null_`` and its name). They are known when the first action over
    the rows has ended, from that same scan."""
    d = df.withColumns({c: finite(F.col(c)) for c in numeric})
    seen = Observation(f"hygiene-{uuid.uuid4().hex}")
    absent = F.greatest(*[F.col(f"`{c}`").isNull() for c in d.columns], F.lit(False))
    counted = d.observe(seen, F.count(F.lit(1)).alias("before"), F.count_if(absent).alias("removed"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in d.columns])
    return counted.dropna("any"), seen


def key_hash_split(df: DataFrame, key: Sequence[str], splits=SPLITS) -> DataFrame:
    """Adds ``split``: an independent draw per row by a hash of its key."""
    u = hash_unit(*[F.col(k) for k in key])
    out = F.lit(splits[-1][0])
    for name, below in reversed(splits[:-1]):
        out = F.when(u < below, F.lit(name)).otherwise(out)
    return df.withColumn("split", out)


def stratified_split(df: DataFrame, key: Sequence[str], group: str, splits=SPLITS, slot_rows: int = 65_536) -> DataFrame:
    """Adds ``split`` with the shares held within each group, but for a row per slot.

    Rows of a group are dealt over slots and ranked there, so no group is one
    task's. There is a slot for ``slot_rows`` rows of the table, in any session."""
    slots = max(1, -(-df.count() // slot_rows))
    u = hash_unit(*[F.col(k) for k in key])
    d = df.withColumn("_u", u).withColumn("_slot", F.pmod(hash_bits(*[F.col(k) for k in key]), F.lit(slots)))
    at = F.percent_rank().over(Window.partitionBy(group, "_slot").orderBy("_u", *key))
    out = F.lit(splits[-1][0])
    for name, below in reversed(splits[:-1]):
        out = F.when(at < below, F.lit(name)).otherwise(out)
    return d.withColumn("split", out).drop("_u", "_slot")


def split_comparison(df: DataFrame, group: str, splits: Sequence[str] = tuple(s for s, _ in SPLITS)) -> DataFrame:
    """(value, a count per split, 0 where absent)."""
    out = df.groupBy(F.col(group).alias("value")).pivot("split", list(splits)).count()
    return out.fillna(0, list(splits))


def split_sizes(df: DataFrame) -> DataFrame:
    g = df.groupBy("split").agg(F.count("*").alias("cnt"))
    return with_share(g)


def medians(df: DataFrame, columns: Sequence[str], artifacts: Mapping[str, float] | None = None) -> DataFrame:
    """(feature, median) of the finite values; with ``artifacts``, of those that are none."""
    cut = artifacts or {}
    q = quantiles(df, {c: without_artifacts(finite(F.col(c)), cut.get(c)) for c in columns}, [0.5])
    return q.select("feature", F.get("q", 0).alias("median"))


def clean(df: DataFrame, columns: Sequence[str], fill: DataFrame, artifacts: Mapping[str, float], logged: Sequence[str], clip_at_zero: bool = False) -> DataFrame:
    """Columns read as numbers, artifacts and non-finite values replaced by
    ``fill`` (feature, median; 0 for a feature without), and log1p of ``logged``."""
    row = fill.where(F.col("feature").isin(*columns)).groupBy().pivot("feature", list(columns)).agg(F.first("median"))
    named = row.select(*[F.col(c).alias(f"_fill_{c}") for c in columns])
    d = df.join(F.broadcast(named))  # one row

    def of(c: str):
        x = F.coalesce(without_artifacts(finite(F.col(c)), artifacts.get(c)), F.col(f"_fill_{c}"), F.lit(0.0))
        return log1p(x, clip_at_zero) if c in logged else x

    return d.withColumns({c: of(c) for c in columns}).drop(*named.columns)


def fit_robust_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, center, scale): exact median and interquartile range; 0 counts as 1."""
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    iqr = F.get("q", 2) - F.get("q", 0)
    return q.select("feature", F.get("q", 1).alias("center"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def scale(df: DataFrame, columns: Sequence[str], model: DataFrame) -> DataFrame:
    row = model.groupBy().pivot("feature", list(columns)).agg(F.first("center").alias("center"), F.first("scale").alias("scale"))
    d = df.join(F.broadcast(row))  # one row
    return d.withColumns({c: robust_scaled(F.col(c), F.col(f"{c}_center"), F.col(f"{c}_scale")) for c in columns}).drop(*row.columns)


def feature_rules(spark, features: Sequence[str], logged: Sequence[str], artifacts: Mapping[str, float]) -> DataFrame:
    """(feature, is_log1p, artifact_threshold)."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    return rows.select("feature", F.col("feature").isin(*logged).alias("is_log1p"), rule_threshold(F.col("feature"), artifacts).alias("artifact_threshold"))


def _by_hash(df: DataFrame, key: Sequence[str]):
    """By a key's hash, the key, and then all other columns that have an order, so that rows which share a key have one too."""
    own = [f.name for f in df.schema if f.name not in key and not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))]
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in own]
    return [hash_unit(*[F.col(k) for k in key]), *[F.col(k) for k in key], *rest]


def hash_sample(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """n rows in the order of a key's hash: the same rows at any partitioning.
    Rows that share a key come in the order of their other columns."""
    return df.orderBy(*_by_hash(df, key)).limit(n)


def chunk_samples(df: DataFrame, chunk: str, key: Sequence[str], n: int) -> DataFrame:
    """n rows of each chunk, those whose key hashes lowest, in one pass: what tasks
    keep of a chunk is merged by keeping the lowest again. Rows that share a key
    come in the order of their other columns, the least first."""
    order = Window.partitionBy(chunk).orderBy(*_by_hash(df, key))
    return df.withColumn("\x00r", F.row_number().over(order)).where(F.col("`\x00r`") <= n).drop("\x00r")


def feature_columns(df: DataFrame, metadata: Sequence[str]) -> list[str]:
    """The columns that are no metadata, in their order; metadata that is absent raises."""
    require_columns(df, metadata)
    return [c for c in df.columns if c not in metadata]


def cast_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: as_number(F.col(c)) for c in columns})
