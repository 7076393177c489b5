"""Packing by optimal length buckets.

A histogram of lengths over all rows gives, by dynamic programming, the bucket
boundaries with the least padding; inside each bucket rows are batched to a
token budget, every row padded to the bucket's boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .common import number_rows, table, word_count

BUCKETS, BUDGET = 8, 16_384
#: Lengths are exact up to 2 ** BITS and rounded up to BITS significant bits above,
#: so the histogram has at most 2 ** BITS + 2 ** (BITS - 1) * 48 entries, whatever the input.
BITS = 14


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets that minimise the padding
    sum(count * (boundary - length)). Divide and conquer over the monotone
    best split points, n log n per bucket."""
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    n = len(x)
    if not n:
        return []
    total, mass = np.concatenate([[0.0], np.cumsum(c)]), np.concatenate([[0.0], np.cumsum(c * x)])
    # best[j]: least padding of the first j lengths
    best = np.concatenate([[0.0], x * total[1:] - mass[1:]])
    splits: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        new, arg = best.copy(), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            cost = best[i] + x[mid - 1] * (total[mid] - total[i]) - (mass[mid] - mass[i])
            k = int(np.argmin(cost))
            new[mid], arg[mid] = cost[k], i[k]
            todo += [(lo, mid - 1, a, i[k]), (mid + 1, hi, i[k], b)]
        splits.append(arg)
        best = new
    cuts, at = [n], n
    for arg in reversed(splits):
        at = int(arg[at])
        if at <= 0:
            break
        cuts.append(at)
    return [int(x[j - 1]) for j in sorted(set(cuts))]


def pack(rows: DataFrame, length: str, order: list[str], buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Adds bucket, bucket_len (padded length), batch and place (in the batch).

    A batch of bucket b holds max(1, budget // bucket_len) rows, so a row over
    the budget is alone. A null length counts as 0; rows of length 0 share a
    bucket that costs nothing to pad, with at most ``budget`` rows a batch.
    Repeated rows are packed each. An empty table gives an empty result. Columns
    of ``rows`` with the name of a result give way.
    """
    rows = rows.drop("bucket", "bucket_len", "batch", "place")
    # Read three times: for the histogram, for the numbering's counts and for its rows.
    rows = checkpointed(rows.withColumn(length, F.coalesce(F.col(length), F.lit(0)).cast("long")))
    step = F.when(F.col(length) < 2**BITS, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col(length).cast("double") + 0.5)) - (BITS - 1)).cast("long"))
    rounded = (F.ceil(F.col(length) / step) * step).cast("long")
    # At most 2 ** BITS + 2 ** (BITS - 1) * 48 rows reach the driver, by the rounding above.
    histogram = rows.groupBy(rounded.alias("length")).agg(F.count("*").alias("n")).toPandas()
    ends = boundaries(histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    bucket = bucket_len = F.lit(None)
    for k in reversed(range(len(ends))):
        fits = F.col(length) <= ends[k]
        bucket, bucket_len = F.when(fits, F.lit(k)).otherwise(bucket), F.when(fits, F.lit(ends[k]).cast("long")).otherwise(bucket_len)
    placed = rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", bucket_len.cast("long"))
    held = F.greatest(F.lit(1), F.floor(budget / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    at = "batch"  # a result's name: no column of the caller has it
    placed = number_rows(placed, ["bucket"], order, at)
    return placed.select(*[c for c in placed.columns if c != at], F.floor(F.col(at) / held).cast("long").alias("batch"), (F.col(at) % held).cast("long").alias("place"))


def packed_documents(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return pack(rows, "n_tokens", ["doc_id", "n_tokens"])


def op3(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))
