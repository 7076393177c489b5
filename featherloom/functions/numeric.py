"""Column expressions with the null and non-finite rules of the feature pipeline.

A value is missing if it is null or NaN; Spark orders NaN above all numbers,
so every comparison comes after ``clean``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_number(c: Column) -> Column:
    """Double, null where it can't be read; NaN becomes null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def as_number_strict(c: Column) -> Column:
    """Double; raises under ANSI mode where it can't be read."""
    return c.cast("double")


def finite(c: Column) -> Column:
    """The value if it is finite, else null."""
    x = as_number(c)
    return F.when(F.abs(x) < INF, x)


def is_nonfinite(c: Column) -> Column:
    """Missing or infinite: a missing value counts as both."""
    return F.coalesce(F.abs(as_number(c)) == INF, F.lit(True))


def without_artifacts(c: Column, threshold: float | None) -> Column:
    return c if threshold is None else F.when(c > threshold, F.lit(None)).otherwise(c)


def log1p(c: Column, clip_at_zero: bool = False) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)) if clip_at_zero else c)


def robust_scaled(c: Column, center: Column, iqr: Column) -> Column:
    """(x - center) / iqr, with an iqr of 0 taken as 1."""
    return (c - center) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def ratio(a: Column, b: Column) -> Column:
    """a / b: infinite if only b is 0, null if both are 0 or one is null."""
    return F.when((b == 0) & (a > 0), F.lit(INF)).otherwise(F.try_divide(a, b))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def coded(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bin of a value: how many interior edges lie strictly below
    it, found by halving them."""
    inner = sorted(edges)[1:-1]

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.lit(float(inner[mid])) < c, within(mid + 1, high)).otherwise(within(low, mid))

    return F.when(c.isNotNull(), within(0, len(inner)))


def any_of(names: Sequence[str], columns: Sequence[str]) -> str | None:
    """The first of the names that is a column."""
    return next((n for n in names if n in columns), None)


def rule_threshold(feature: Column, rules: Mapping[str, float]) -> Column:
    """A feature's artifact threshold, null without a rule."""
    if not rules:
        return F.lit(None).cast("double")
    pairs = [x for k, v in rules.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.try_element_at(F.create_map(*pairs), feature)


def hash_bits(*keys: Column) -> Column:
    """The second 32 bits of a key's MD5, apart from those of hash_unit."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 9, 8), 16, 10).cast("long")


def hash_unit(*keys: Column) -> Column:
    """A number in [0, 1) from a key: the first 32 bits of its MD5. Unlike rand(),
    it depends on neither partitioning nor plan."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def parse_list(c: Column, separator: str = "|") -> Column:
    """Parts of a delimited list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, f"\\{separator}"), lambda x: F.trim(x)), lambda x: x != "")
