"""Mergeable sums over many columns at once: each task adds up its rows with numpy
and gives one small matrix or histogram, and these are added."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matrices that are added in one task.
FAN = 64
STATE = "part int, x binary"
#: Spread below this share of a column's squares is what rounding leaves of a constant.
ROUNDING = 1e-14


class Products:
    """Numbers, sums, squares and products of all pairs of columns, over the rows
    that have both, around a value of each column: ``shift``, nan before any."""

    def __init__(self, m: int, raw: bytes | None = None):
        x = np.zeros(m + 4 * m * m) if raw is None else np.frombuffer(raw, np.float64).copy()
        if raw is None:
            x[:m] = np.nan
        self.x, self.shift = x, x[:m]
        self.n, self.sum, self.square, self.product = x[m:].reshape(4, m, m)

    def add(self, rows: np.ndarray) -> None:
        """Takes rows in, nan where a value is absent."""
        for i in np.flatnonzero(np.isnan(self.shift)):
            own = rows[~np.isnan(rows[:, i]), i]
            if len(own):
                # A middle value: it is near the mean, and equals every value of a constant.
                self.shift[i] = np.partition(own, len(own) // 2)[len(own) // 2]
        d = rows - np.where(np.isnan(self.shift), 0.0, self.shift)
        there = ~np.isnan(rows)
        if there.all():
            self.n += len(rows)
            self.sum += d.sum(0)[:, None]
            self.square += (d * d).sum(0)[:, None]
        else:
            d[~there] = 0.0
            t = there.astype(np.float64)
            self.n += t.T @ t
            self.sum += d.T @ t
            self.square += (d * d).T @ t
        self.product += d.T @ d

    def merge(self, other: Products) -> None:
        new = np.isnan(self.shift)
        self.shift[new] = other.shift[new]
        d = np.nan_to_num(other.shift - self.shift, nan=0.0)[:, None]
        n, s = other.n, other.sum
        self.product += other.product + d * s.T + d.T * s + n * d * d.T
        self.square += other.square + 2 * d * s + n * d * d
        self.sum += s + n * d
        self.n += n

    def correlations(self) -> np.ndarray:
        """nan where a column is constant or a pair has no rows."""
        with np.errstate(all="ignore"):
            n = np.where(self.n > 0, self.n, np.nan)
            spread = self.square - self.sum * self.sum / n
            real = spread > self.square * ROUNDING
            r = (self.product - self.sum * self.sum.T / n) / np.sqrt(spread * spread.T)
            return np.where(real & real.T, np.clip(r, -1.0, 1.0), np.nan)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(np.float64)


def _summed(m: int):
    def run(batches):
        p = Products(m)
        for b in batches:
            if len(b):
                p.add(_rows(b))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([p.x.tobytes()], pa.binary())], ["part", "x"])

    return run


def _merged(m: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        p = Products(m)
        for x in rows.column("x"):
            p.merge(Products(m, x.as_py()))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([p.x.tobytes()], pa.binary())})

    return run


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(f1, f2, score): Pearson of all pairs over the rows that have both; null
    for a constant, or without rows. One scan, whatever the number of columns:
    each task gives one matrix of their products, and these are added in a tree."""
    m = len(columns)
    d = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    none = df.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(Products(m).x.tobytes()).alias("x"))
    sums = d.mapInArrow(_summed(m), STATE).unionByName(none)
    for left in (FAN, 1):
        sums = sums.groupBy(F.pmod("part", F.lit(left)).alias("of")).applyInArrow(_merged(m), STATE)
    pairs = list(combinations(range(m), 2))

    def scores(batches):
        for b in batches:
            for x in b.column("x"):
                r = Products(m, x.as_py()).correlations()
                score = np.array([r[i, j] for i, j in pairs])
                yield pa.RecordBatch.from_arrays([pa.array([columns[p[k]] for p in pairs], pa.string()) for k in (0, 1)] + [pa.array(score, pa.float64(), mask=np.isnan(score))], ["f1", "f2", "score"])

    return sums.mapInArrow(scores, "f1 string, f2 string, score double")


def _histograms(pairs: list[tuple[int, int]], bins: int, edges: list[np.ndarray] | None):
    def run(batches):
        side = bins + 1  # the last code stands for null
        cells = np.zeros((len(pairs), side * side), np.int64)
        for b in batches:
            if not len(b):
                continue
            codes = []
            for i, c in enumerate(b.columns):
                there = ~c.is_null().to_numpy(zero_copy_only=False)
                x = c.drop_null().to_numpy(zero_copy_only=False)
                code = np.full(len(b), bins, np.int64)
                code[there] = x if edges is None else np.searchsorted(edges[i], x, "left")
                codes.append(code)
            for k, (i, j) in enumerate(pairs):
                cells[k] += np.bincount(codes[i] * side + codes[j], minlength=side * side)
        k, at = np.nonzero(cells)
        full = (at // side < bins) & (at % side < bins)
        k, at = k[full], at[full]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array((at // side).astype(np.int32)), pa.array((at % side).astype(np.int32)), pa.array(cells[k, at])], ["pair", "c1", "c2", "n"])

    return run


def joint_counts(df: DataFrame, columns: Sequence[str], bins: int, only_own: bool = False, edges: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """(f1, f2, c1, c2, n) of all pairs, and of each feature with itself, or of
    these alone. The columns hold codes from 0, below ``bins``; with ``edges``,
    one list a column, they hold values, whose code is how many interior edges
    lie below. Each task gives a row for each cell it saw, whatever its rows."""
    place = range(len(columns))
    pairs = [*(() if only_own else combinations(place, 2)), *((i, i) for i in place)]
    inner = None if edges is None else [np.array(sorted(e)[1:-1], float) for e in edges]
    d = df.select(*[F.col(c).cast("double" if inner else "int").alias(f"_{i}") for i, c in enumerate(columns)])
    n = d.mapInArrow(_histograms(pairs, bins, inner), "pair int, c1 int, c2 int, n long").groupBy("pair", "c1", "c2").agg(F.sum("n").alias("n"))
    name = lambda k: F.element_at(F.array(*[F.lit(columns[p[k]]) for p in pairs]), F.col("pair") + 1)
    return n.select(name(0).alias("f1"), name(1).alias("f2"), "c1", "c2", "n")
