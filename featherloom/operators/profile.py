"""Audits and profiles of wide tables: one scan, partial aggregates for all columns at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, as_number, finite, is_nonfinite, percent
from ..plans.lineage import checkpointed
from .order import quantiles as exact_quantiles

#: Quantiles of a profile.
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.999)
#: Fixed value: means and deviations are not reported for features with values from here on.
HUGE = 1e12


def per_column(df: DataFrame, columns: Sequence[str], measures: Mapping[str, callable], name: str = "feature") -> DataFrame:
    """A row per column with the given measures. All are aggregates of one scan;
    the single result row is then turned into rows, so the table is never exploded."""
    one = df.agg(*[m(F.col(c)).alias(f"{c}\x00{k}") for c in columns for k, m in measures.items()])
    rows = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"`{c}\x00{k}`").alias(k) for k in measures]) for c in columns])
    return one.select(F.inline(rows))


def with_share(counts: DataFrame) -> DataFrame:
    """Adds ``pct``, the share of ``cnt`` in its sum: one row, broadcast, however many categories there are."""
    total = counts.agg(F.sum("cnt").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("pct", percent(F.col("cnt"), F.col("_total"))).drop("_total")


def category_distribution(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """(value, cnt, pct), null as a category of its own unless dropped."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    g = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("cnt"))
    return with_share(g)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: all rows, distinct ones, and repeats of an earlier one, over the whole table."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """duplicate_rows over all columns. Rows are counted by 128 bits of hash, and
    only those that share them are compared in full."""
    sign = [F.xxhash64(*df.columns).alias("\x00h1"), F.xxhash64(F.lit(1), *df.columns).alias("\x00h2")]
    h1, h2 = F.col("`\x00h1`"), F.col("`\x00h2`")
    counts = checkpointed(df.select(*sign).groupBy(h1, h2).agg(F.count("*").alias("n")))
    again = df.select("*", *sign).join(counts.where("n > 1").drop("n").hint("merge"), ["\x00h1", "\x00h2"], "left_semi")
    exact = again.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("n")).agg(F.count("*").alias("exact"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count_if(F.col("n") == 1).alias("lone"))
    out = one.join(F.broadcast(exact))  # a row each
    distinct = F.col("lone") + F.col("exact")
    return out.select("total_rows", distinct.alias("distinct_rows"), (F.col("total_rows") - distinct).alias("duplicate_rows"))


def chunk_duplicates(df: DataFrame, chunk: str, keys: Sequence[str]) -> DataFrame:
    """duplicate_rows of each chunk by itself."""
    g = df.groupBy(chunk, *keys).agg(F.count("*").alias("n"))
    return g.groupBy(chunk).agg(F.sum("n").alias("total_rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    missing = lambda c, k: c.isNull() | F.isnan(c) if k in ("double", "float") else c.isNull()
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(missing(F.col(c), kinds[c])).alias(f"{c}\x00n") for c in columns])
    return one.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}\x00n`").alias("missing")) for c in columns])))


MOMENTS = {
    "n": lambda c: F.count(as_number(c)),
    "total": lambda c: F.sum(as_number(c)),
    "mean": lambda c: F.avg(as_number(c)),
    "std": lambda c: F.stddev_pop(as_number(c)),
    "minimum": lambda c: F.min(as_number(c)),
    "maximum": lambda c: F.max(as_number(c)),
}
VALUES = {
    "minimum": lambda c: F.min(as_number(c)),
    "maximum": lambda c: F.max(as_number(c)),
    "missing": lambda c: F.count_if(as_number(c).isNull()),
    "nonfinite": lambda c: F.count_if(is_nonfinite(c)),
    "infinite": lambda c: F.count_if(F.abs(as_number(c)) == INF),
    "negative": lambda c: F.count_if(as_number(c) < 0),
}


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(df, columns, MOMENTS)


def value_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(df, columns, VALUES)


def needs_attention(audit: DataFrame) -> DataFrame:
    """Features with missing, non-finite or negative values."""
    return audit.where((F.col("missing") > 0) | (F.col("nonfinite") > 0) | (F.col("negative") > 0))


def feature_profile(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Counts, extremes, exact quantiles of the finite values, and mean and
    deviation where no value is huge."""
    measures = {"n": lambda c: F.count("*")} | VALUES | {
        "mean": lambda c: F.when(F.max(F.abs(finite(c))) < HUGE, F.avg(finite(c))),
        "std": lambda c: F.when(F.max(F.abs(finite(c))) < HUGE, F.stddev_pop(finite(c))),
    }
    q = exact_quantiles(df, {c: finite(F.col(c)) for c in columns}, quantiles)
    out = per_column(df, columns, measures).join(q, "feature")  # a row per feature on either side
    named = [F.get("q", i).alias(f"q{100 * x:g}".replace(".", "_")) for i, x in enumerate(quantiles)]
    return out.select(*[c for c in out.columns if c != "q"], *named)


def threshold_counts(df: DataFrame, thresholds: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature, threshold, above, pct of the non-null), all in one scan."""
    pairs = [(c, float(t)) for c, ts in thresholds.items() for t in ts]
    one = df.agg(*[F.count_if(as_number(F.col(c)) > t).alias(f"a{i}") for i, (c, t) in enumerate(pairs)], *[F.count(as_number(F.col(c))).alias(f"n_{c}") for c in thresholds])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(t).alias("threshold"), F.col(f"a{i}").alias("above"), percent(F.col(f"a{i}"), F.col(f"n_{c}")).alias("pct")) for i, (c, t) in enumerate(pairs)])
    return one.select(F.inline(rows))


def top_values(df: DataFrame, column: str, key: Sequence[str], n: int) -> DataFrame:
    """The n rows with the largest values, ties by key: a top-k, never a full sort."""
    x = as_number(F.col(column))
    return df.select(*key, x.alias("value")).where(F.col("value").isNotNull()).orderBy(F.desc("value"), *key).limit(n)


def examples_above(df: DataFrame, column: str, threshold: float, keep: Sequence[str], n: int) -> DataFrame:
    """The first n rows above a threshold, in the order of ``keep``."""
    return df.where(as_number(F.col(column)) > threshold).select(*keep, F.col(column).alias("value")).orderBy(*keep).limit(n)


def above_by_group(df: DataFrame, column: str, threshold: float, group: str) -> DataFrame:
    return df.where(as_number(F.col(column)) > threshold).groupBy(F.col(group).alias("value")).agg(F.count("*").alias("cnt"))


def tail_thresholds(df: DataFrame, size: Column, quantiles: Sequence[float] = (0.9, 0.95, 0.975, 0.99)) -> DataFrame:
    q = exact_quantiles(df, {"size": finite(size)}, quantiles)
    return q.select(F.inline(F.array(*[F.struct(F.lit(float(x)).alias("quantile"), F.get("q", i).alias("threshold")) for i, x in enumerate(quantiles)])))
