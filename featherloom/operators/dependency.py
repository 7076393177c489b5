"""Pairwise dependency of features: Spearman, mutual information, and blends.

Pair scores are a long table (f1, f2, score) with f1 before f2 in the feature
list; matrices are made of it only at the sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, coded
from . import sums
from .order import average_ranks, order_statistics, ranked
from .sums import correlations

#: Bins of a feature, and what keeps the logarithm of an empty cell finite in entropies.
BINS, EPSILON = 32, 1e-12


def spearman(df: DataFrame, columns: Sequence[str], stable: bool = False) -> DataFrame:
    """Of the rows without a null; for ``stable`` see ``ranked``."""
    return correlations(ranked(df.dropna(subset=list(columns)), columns, stable), columns)


def _found_edges(df: DataFrame, columns: Sequence[str], bins: int, accuracy: int | None) -> dict[str, list[float]]:
    at = [i / bins for i in range(bins + 1)]
    found = order_statistics(df, columns, at, bins)
    if accuracy is not None:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(x) for x in at]), accuracy).alias(c) for c in columns]).first()
    out = {}
    for c, s in found.items():
        if s.few is not None:
            out[c] = [float("-inf"), *s.few, float("inf")]  # codes count interior edges: a value list gets an end on each side
        elif s.n:
            q = s.q if accuracy is None else row[c]
            merged = list(dict.fromkeys(q))
            # Quantiles that are all alike would leave one bin for many values: these get equal widths.
            out[c] = merged if len(merged) > 1 else [s.q[0] + (s.q[-1] - s.q[0]) * i / bins for i in range(bins + 1)]
    return out


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS, accuracy: int | None = None) -> DataFrame:
    """(feature, edges): for at most ``bins`` distinct values the values
    themselves, as interior edges; else quantile edges, equal ones merged.

    Quantiles are exact; with ``accuracy`` they are approximate.
    """
    return df.sparkSession.createDataFrame(list(_found_edges(df, columns, bins, accuracy).items()), "feature string, edges array<double>")


def equal_width(low, high, bins: int = BINS):
    """Edges of ``bins`` bins of one width between two numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: low + (high - low) * i / F.lit(float(bins)))


def _equal_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    ends = df.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns])
    found = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), equal_width(F.col(f"{c}.low"), F.col(f"{c}.high"), bins).alias("edges")) for c in columns])))
    return {r["feature"]: r["edges"] or [] for r in found.collect()}


def discretize(df: DataFrame, columns: Sequence[str], bins: int = BINS, equal: bool = False) -> DataFrame:
    """The columns replaced by codes from 0: of bin_edges, or of bins of ``equal`` width."""
    edges = _equal_edges(df, columns, bins) if equal else _found_edges(df, columns, bins, None)
    # At most bins + 2 numbers a feature: they become comparisons in the generated code.
    return df.select(*[coded(F.col(c), edges.get(c, [])).alias(c) for c in columns])


def joint_counts(codes: DataFrame, columns: Sequence[str], bins: int = BINS, only_own: bool = False) -> DataFrame:
    """(f1, f2, c1, c2, n) of all pairs of coded columns, and of each with itself, or of these alone."""
    return sums.joint_counts(codes, columns, bins + 1, only_own)


def binned_counts(df: DataFrame, columns: Sequence[str], bins: int = BINS, only_own: bool = False) -> DataFrame:
    """joint_counts of columns of values: their bins are those of bin_edges, found and counted in one scan each."""
    edges = _found_edges(df, columns, bins, None)
    return sums.joint_counts(df, columns, bins + 1, only_own, [edges.get(c, []) for c in columns])


def _totals(joint: DataFrame) -> DataFrame:
    return joint.withColumn("total", F.sum("n").over(Window.partitionBy("f1", "f2")))


def entropies(joint: DataFrame) -> DataFrame:
    """(feature, entropy) in nats."""
    p = F.col("n") / F.col("total")
    own = _totals(joint.where(F.col("f1") == F.col("f2")))
    return own.groupBy(F.col("f1").alias("feature")).agg((-F.sum(p * F.ln(p + EPSILON))).alias("entropy"))


def mutual_information(joint: DataFrame) -> DataFrame:
    """(f1, f2, mi, nmi); nmi is 0 where an entropy is."""
    w = lambda *c: F.sum("n").over(Window.partitionBy("f1", "f2", *c))
    cells = joint.where(F.col("f1") != F.col("f2")).withColumn("total", w()).withColumn("nx", w("c1")).withColumn("ny", w("c2"))
    term = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    mi = cells.groupBy("f1", "f2").agg(F.sum(term).alias("mi"))
    h = entropies(joint)
    both = mi.join(h.select(F.col("feature").alias("f1"), F.col("entropy").alias("h1")), "f1").join(h.select(F.col("feature").alias("f2"), F.col("entropy").alias("h2")), "f2")
    root = F.sqrt(F.greatest(F.col("h1") * F.col("h2"), F.lit(0.0)))
    return both.select("f1", "f2", "mi", F.when(root > 0, clamp(F.try_divide(F.col("mi"), root))).otherwise(0.0).alias("nmi"))


def blend(nmi: DataFrame, rho: DataFrame, alpha: float = 0.5, mode: str = "abs") -> DataFrame:
    """(f1, f2, score) from nmi and Spearman scores. 'abs' weighs |rho|;
    'signed_clip' weighs rho and clips to [0, 1]. A missing rho counts as 0."""
    r = F.coalesce(F.col("score"), F.lit(0.0))
    mixed = F.lit(alpha) * F.col("nmi") + F.lit(1 - alpha) * (F.abs(r) if mode == "abs" else r)
    return nmi.join(rho, ["f1", "f2"]).select("f1", "f2", (mixed if mode == "abs" else clamp(mixed)).alias("score"))


def pair_summary(pairs: DataFrame, quantiles: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99), thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """(measure, value): quantiles of the scores and counts from each threshold on."""
    one = pairs.agg(F.percentile("score", F.array(*[F.lit(q) for q in quantiles])).alias("q"), *[F.count_if(F.col("score") >= t).cast("double").alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = [F.struct(F.lit(f"q{100 * q:g}").alias("measure"), F.get("q", i).alias("value")) for i, q in enumerate(quantiles)] + [F.struct(F.lit(f"pairs_from_{t:g}").alias("measure"), F.col(f"t{i}").alias("value")) for i, t in enumerate(thresholds)]
    return one.select(F.inline(F.array(*rows)))


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """One row: least, largest and mean entry of a whole matrix."""
    return matrix.agg(F.min("score").alias("minimum"), F.max("score").alias("maximum"), F.avg("score").alias("mean"))


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "f1", "f2").limit(n)


def symmetric(pairs: DataFrame, features: Sequence[str], diagonal: float = 1.0) -> DataFrame:
    """All cells of the square matrix."""
    own = pairs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("f1")).select("f1", F.col("f1").alias("f2"), F.lit(float(diagonal)).alias("score"))
    return pairs.select("f1", "f2", "score").unionByName(pairs.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "score")).unionByName(own)


def to_distance(matrix: DataFrame) -> DataFrame:
    """1 - score, clipped to [0, 1], 0 on the diagonal, averaged over (f1, f2) and (f2, f1)."""
    d = matrix.select("f1", "f2", F.when(F.col("f1") == F.col("f2"), 0.0).otherwise(clamp(1 - F.col("score"))).alias("d"))
    other = d.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), F.col("d").alias("e"))
    return d.join(other, ["f1", "f2"]).select("f1", "f2", ((F.col("d") + F.col("e")) / 2).alias("distance"))


def matrix_report(matrix: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row: whether a matrix is square, symmetric, finite, with a diagonal of 1."""
    other = matrix.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), F.col("score").alias("t"))
    both = matrix.join(other, ["f1", "f2"], "full")
    own = F.col("f1") == F.col("f2")
    gap = F.max(F.abs(F.col("score") - F.col("t")))
    return both.agg(
        F.count("*").alias("cells"), F.count_distinct("f1").alias("features"),
        (F.count("*") == F.count_distinct("f1") * F.count_distinct("f1")).alias("is_square"),
        (F.coalesce(gap, F.lit(0.0)) <= tolerance).alias("is_symmetric"),
        (F.coalesce(F.max(F.when(own, F.abs(F.col("score") - 1))), F.lit(0.0)) <= tolerance).alias("has_unit_diagonal"),
        (F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))) == 0).alias("is_finite"),
    )
