"""Order statistics of many columns at once, without moving every value.

Quantiles are selected between brackets: a mergeable sketch says between which
two values a wanted place lies, a scan counts what is below each bracket and
keeps the values inside, and only these are sorted. Ranks are worked out range
by range: a block's distinct values travel packed, one row for each block of rows,
feature and range, and their ranks come back the same way. Which row holds which
of them is packed apart and goes straight to where the block is put together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Of all rows, one in ACCURACY at most lies between a sketched value's place and its own.
ACCURACY = 10_000
#: Values of a bracket that are sorted in one task; a bracket of more is narrowed first.
INSIDE = 4_000_000
#: Values of a range, about, and ranges of a feature.
RANGE_ROWS, FEWEST_RANGES, MOST_RANGES = 1 << 20, 16, 8_192
#: Rows of a block: the place of a value among its distinct ones fits 16 bits.
BLOCK_ROWS = 1 << 16
#: Packed values that a task is dealt, about.
DEALT = 8_000_000


def _doubles(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> tuple[DataFrame, list[str]]:
    named = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    return df.select(*[x.cast("double").alias(f"_{i}") for i, x in enumerate(named.values())]), list(named)


def value_counts(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """(feature, value, n) of the non-null values of columns, or of expressions by name."""
    named = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    values = df.select(*[x.cast("double").alias(c) for c, x in named.items()])
    long = values.unpivot([], list(named), "feature", "value").where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, rank) of the distinct values: ranks from 1, ties averaged.
    They are dealt by range, counted up in each range, and shifted by the ranges before."""
    dealt = written(value_counts(df, columns).repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()), "values")
    up = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("feature", "part").agg(F.sum("n").alias("m")).withColumn("shift", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    local = dealt.withColumn("low", F.coalesce(F.sum("n").over(up), F.lit(0)))
    return local.join(shift, ["feature", "part"]).select("feature", "value", (F.col("shift") + F.col("low") + (F.col("n") + 1) / 2).alias("rank"))


@dataclass
class Statistics:
    """Of one feature: the number of values, wanted quantiles, and the distinct values where these are few."""

    n: int
    q: list[float] | None
    few: list[float] | None


@dataclass
class _Search:
    """Brackets of a feature's wanted places, as far as they are narrowed."""

    n: int
    low: np.ndarray  # brackets, apart from each other, ends included
    high: np.ndarray
    wanted: dict[int, float | None] = field(default_factory=dict)  # value by place


def _apart(low: Sequence[float], high: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """The union of brackets, as brackets that do not meet. NaN is above all."""
    out: list[list[float]] = []
    key = lambda x: (x != x, 0.0 if x != x else x)
    for a, b in sorted(zip(low, high, strict=True), key=lambda p: (key(p[0]), key(p[1]))):
        if out and key(a) <= key(out[-1][1]):
            out[-1][1] = max(out[-1][1], b, key=key)
        else:
            out.append([a, b])
    return np.array([x for x, _ in out]), np.array([x for _, x in out])


SLOTS = "feature int, slot int, value double, n long"


def _counted(brackets: list[tuple[np.ndarray, np.ndarray]], few: int):
    """A row for each gap between brackets with its count, for each value inside
    one, and in slot -1 for distinct values of a feature, few + 1 of them at most."""

    def run(batches):
        gaps = [np.zeros(2 * len(low) + 1, np.int64) for low, _ in brackets]
        seen = [np.empty(0) for _ in brackets]
        for b in batches:
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            for i, (low, high) in enumerate(brackets):
                x, n = np.unique(b.column(i).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                below = np.searchsorted(high, x, "left")
                inside = np.searchsorted(low, x, "right") > below
                np.add.at(gaps[i], 2 * below[~inside], n[~inside])
                out.append((i, (2 * below + 1)[inside].astype(np.int32), x[inside], n[inside]))
                if len(seen[i]) <= few:
                    seen[i] = np.unique(np.r_[seen[i], x])[: few + 1]
            yield _slots(out)
        yield _slots([(i, np.flatnonzero(g).astype(np.int32), np.full(int((g > 0).sum()), np.inf), g[g > 0]) for i, g in enumerate(gaps)], gap=True)
        if few:
            yield _slots([(i, np.full(len(s), -1, np.int32), s, np.ones(len(s), np.int64)) for i, s in enumerate(seen)])

    return run


def _slots(parts, gap: bool = False) -> pa.RecordBatch:
    n = [len(p[1]) for p in parts]
    value = np.concatenate([p[2] for p in parts])
    columns = [pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), n)), pa.array(np.concatenate([p[1] for p in parts])), pa.nulls(len(value), pa.float64()) if gap else pa.array(value, pa.float64()), pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["feature", "slot", "value", "n"])


def _places(n: int, at: Sequence[float]) -> list[tuple[int, int, float]]:
    """Of each quantile the two places it lies between, and how far from the first."""
    exact = [(n - 1) * p for p in at]
    return [(int(np.floor(x)), int(np.ceil(x)), float(x - np.floor(x))) for x in exact]


def order_statistics(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], at: Sequence[float], few: int = 0) -> dict[str, Statistics]:
    """Exact quantiles of each column's non-null values, between two values in
    proportion, and its distinct values where there are ``few`` at most. NaN is
    above all numbers. What reaches the driver are brackets and wanted values."""
    d, names = _doubles(df, columns)
    cols = d.columns
    # Every quantile's places for any number of rows: they lie within one place of p * (n - 1).
    probes = F.array(*[F.lit(x) for p in at for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))])
    first = d.agg(*[F.count(c).alias(f"n{c}") for c in cols], *[F.percentile_approx(_number(c), probes, ACCURACY).alias(f"q{c}") for c in cols]).first()
    searches: list[_Search] = []
    for c in cols:
        n, q = first[f"n{c}"], first[f"q{c}"]
        if not n or q is None:  # nothing, or NaN alone
            searches.append(_Search(n, np.empty(0), np.empty(0), {p: float("nan") for x in _places(n, at) for p in x[:2]} if n else {}))
            continue
        low, high = _apart(q[0::2], q[1::2])
        searches.append(_Search(n, low, high, {p: None for x in _places(n, at) for p in x[:2]}))
    distinct: dict[int, list[float]] = {}
    while True:
        brackets = [(s.low, s.high) for s in searches]
        kept = written(d.mapInArrow(_counted(brackets, 0 if distinct else few), SLOTS), "brackets")
        counts = {(r["feature"], r["slot"]): (r["n"], r["rows"]) for r in kept.where("slot >= 0").groupBy("feature", "slot").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
        if few and not distinct:
            held = kept.where("slot < 0").groupBy("feature").agg(F.collect_set("value").alias("v")).collect()  # few + 1 values a task and feature
            distinct = {r["feature"]: sorted(r["v"], key=lambda x: (x != x, x)) for r in held}
        found, wide = [], {}
        for i, s in enumerate(searches):
            before = np.cumsum([0, *[counts.get((i, k), (0, 0))[0] for k in range(2 * len(s.low) + 1)]])
            low, high = [], []
            for p in [p for p, v in s.wanted.items() if v is None]:
                slot = int(np.searchsorted(before, p, "right")) - 1
                if slot % 2:  # inside a bracket
                    a, b = s.low[slot // 2], s.high[slot // 2]
                    if a == b or a != a:
                        s.wanted[p] = float(a)
                    elif counts[i, slot][1] > INSIDE:
                        wide.setdefault(i, set()).add((a, b))
                    else:
                        found.append((i, slot, p, int(p - before[slot])))
                else:  # the sketch was off: the gap is the next bracket
                    low.append(s.high[slot // 2 - 1] if slot else -np.inf)
                    high.append(s.low[slot // 2] if slot // 2 < len(s.low) else np.nan)
            s.low, s.high = _apart(low, high)
        if found:
            _selected(kept, found, searches)
        if wide:
            _narrow(d, searches, wide)
        if not any(len(s.low) for s in searches):
            break
    out = {}
    for i, (name, s) in enumerate(zip(names, searches, strict=True)):
        q = [s.wanted[a] if s.wanted[a] == s.wanted[b] else (1 - t) * s.wanted[a] + t * s.wanted[b] for a, b, t in _places(s.n, at)] if s.n else None
        own = distinct.get(i, [])
        out[name] = Statistics(s.n, q, own if few and len(own) <= few else None)
    return out


def _selected(kept: DataFrame, found: list[tuple[int, int, int, int]], searches: list[_Search]) -> None:
    """Sorts what is inside brackets and reads the wanted places off."""
    spark = kept.sparkSession
    wanted = F.broadcast(spark.createDataFrame(found, "of int, bracket int, place long, offset long"))  # as many rows as wanted places
    each = kept.where("slot >= 0 and value is not null").groupBy("feature", "slot", "value").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("feature", "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    met = placed.join(wanted, (F.col("feature") == F.col("of")) & (F.col("slot") == F.col("bracket")) & (F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("before") + F.col("n")))
    for r in met.select("feature", "place", "value").collect():
        searches[r["feature"]].wanted[r["place"]] = r["value"]


def _number(c: str) -> Column:
    """Sketches know no NaN: it is above what they give, and found in the gap there."""
    return F.when(~F.isnan(c), F.col(c))


def _narrow(d: DataFrame, searches: list[_Search], wide: dict[int, set[tuple[float, float]]]) -> None:
    """Replaces brackets that hold too much by parts of them, from a sketch of what is inside each."""
    of = [(i, a, b) for i, ends in wide.items() for a, b in ends]
    inside = [F.percentile_approx(F.when((F.col(f"_{i}") >= F.lit(a)) & (F.col(f"_{i}") <= F.lit(b)), _number(f"_{i}")), F.array(*[F.lit(k / 64) for k in range(65)]), max(ACCURACY, 256)) for i, a, b in of]
    row = d.agg(*[x.alias(f"b{k}") for k, x in enumerate(inside)]).first()
    for i in wide:
        s, points = searches[i], set()
        for k, (j, a, b) in enumerate(of):
            if j == i:
                points |= {a, b, *(row[f"b{k}"] or [])}
        low, high = _split(points)
        s.low, s.high = (np.concatenate(x) for x in ((s.low, low), (s.high, high)))
        order = np.argsort(s.low, kind="stable")
        s.low, s.high = s.low[order], s.high[order]


def _split(ends: set[float]) -> tuple[np.ndarray, np.ndarray]:
    """Brackets from one end to the last: a value each, and what lies between two."""
    points = sorted(x for x in ends if x == x) + [np.nan] * any(x != x for x in ends)
    low, high = [], []
    for a, b in zip(points, [*points[1:], None], strict=True):
        low, high = [*low, a], [*high, a]
        after, before = np.nextafter(a, np.inf), np.inf if b is None or b != b else np.nextafter(b, -np.inf)
        if b is not None and after <= before and a < np.inf:
            low, high = [*low, after], [*high, before]
    return np.array(low), np.array(high)


def quantiles(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], at: Sequence[float]) -> DataFrame:
    """(feature, q) of every column: exact quantiles of its non-null values, a null array if it has none."""
    return df.sparkSession.createDataFrame([(c, s.q) for c, s in order_statistics(df, columns, at).items()], "feature string, q array<double>")


def _zipped(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzipped(raw: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def _packed(x: np.ndarray) -> bytes:
    """64-bit values as their differences, like bytes side by side: those of sorted values are mostly zero."""
    d = np.diff(x.view(np.uint64), prepend=np.uint64(0))
    return _zipped(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def _unpacked(raw: bytes, kind, n: int) -> np.ndarray:
    d = np.ascontiguousarray(_unzipped(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64).view(kind)


def _checksum(x: np.ndarray, n: np.ndarray) -> int:
    v = x.view(np.uint64)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return int(((v ^ (v >> np.uint64(32))) * n.astype(np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _blocks(batches):
    """Runs of BLOCK_ROWS rows of a partition, numbered."""
    block, held, size = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        while len(b):
            held.append(b.slice(0, BLOCK_ROWS - size))
            b, size = b.slice(BLOCK_ROWS - size), size + len(held[-1])
            if size == BLOCK_ROWS:
                yield block, held
                block, held, size = block + 1, [], 0
    if held:
        yield block, held


class _Ranges:
    """Cuts of each feature: code 2 * k is for what lies below cut k and not below
    the one before, 2 * k + 1 for the cut itself if it is heavy, and so has a rank at once."""

    def __init__(self, cuts: list[np.ndarray], heavy: list[np.ndarray]):
        self.cuts, self.heavy = cuts, heavy
        self.before: list[np.ndarray] = []

    def codes(self, i: int, x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.cuts[i], x, "left")
        if not len(self.heavy[i]):
            return 2 * k
        at = self.cuts[i][np.minimum(k, len(self.cuts[i]) - 1)]
        return 2 * k + ((x == at) & np.isin(at, self.heavy[i]))

    def distinct(self, column: pa.ChunkedArray):
        """Which rows have a value, the distinct values, which of them each row has, and how many rows they have."""
        there = ~column.is_null().to_numpy()
        x = column.drop_null().to_numpy() + 0.0  # one zero
        return there, *np.unique(x, return_inverse=True, return_counts=True)

    def count(self, batches):
        """(feature, code, n) of a partition."""
        sums = [np.zeros(2 * len(c) + 2, np.int64) for c in self.cuts]
        for b in batches:
            for i, s in enumerate(sums):
                s += np.bincount(self.codes(i, b.column(i).drop_null().to_numpy(zero_copy_only=False)), minlength=len(s))
        for i, s in enumerate(sums):
            code = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)), pa.array(code.astype(np.int32)), pa.array(s[code])], ["feature", "code", "n"])

    def counted(self, rows) -> None:
        """Takes the counts of all partitions in."""
        sums = [np.zeros(2 * len(c) + 2, np.int64) for c in self.cuts]
        for r in rows:
            sums[r["feature"]][r["code"]] = r["n"]
        self.before = [np.r_[0, np.cumsum(s)] for s in sums]

    def values(self, batches):
        """Rows of VALUES: the distinct values of a block in a range, but heavy ones."""
        for block, held in _blocks(batches):
            for i in range(len(self.cuts)):
                _, x, _, n = self.distinct(pa.chunked_array([b.column(i) for b in held]))
                code = self.codes(i, x)
                light = code % 2 == 0
                x, n, code = x[light], n[light], code[light]
                if not len(x):
                    continue
                edge = np.flatnonzero(np.r_[True, np.diff(code) != 0])
                each = [(x[a:b], n[a:b]) for a, b in zip(edge, [*edge[1:], len(x)], strict=True)]
                columns = [pa.array(np.full(len(edge), block, np.int64)), pa.array(np.full(len(edge), i, np.int32)), pa.array(code[edge].astype(np.int32)), pa.array([len(v) for v, _ in each], pa.int32())]
                packed = [pa.array([_packed(v) for v, _ in each], pa.binary()), pa.array([_packed(m) if (m > 1).any() else None for _, m in each], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *packed, pa.array([_checksum(v, m) for v, m in each], pa.int64())], ["block", "feature", "code", "n", "x", "counts", "check"])

    def rows(self, batches):
        """Rows of ROWS: which of its distinct values each row of a block has, and the ranks of heavy ones."""
        for block, held in _blocks(batches):
            size = sum(map(len, held))
            for i in range(len(self.cuts)):
                there, x, own, n = self.distinct(pa.chunked_array([b.column(i) for b in held]))
                code = self.codes(i, x)
                light = code % 2 == 0
                known = np.full(len(x), np.nan)
                up = self.before[i][code[~light]]
                known[~light] = up + (self.before[i][code[~light] + 1] - up + 1) / 2
                at = own.astype(np.uint8 if len(x) <= 256 else np.uint16)
                values = [block, i, size, None if there.all() else _zipped(np.packbits(there)), len(x), _zipped(at), _zipped(known), _checksum(x[light], n[light])]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["block", "feature", "size", "there", "n", "own", "known", "check"])

    def rank(self, key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Twice the ranks of one range's values, packed as they came."""
        sizes = rows.column("n").to_pylist()
        x = np.concatenate([_unpacked(v.as_py(), np.float64, n) for v, n in zip(rows.column("x"), sizes, strict=True)])
        m = np.concatenate([np.ones(n, np.int64) if c is None else _unpacked(c, np.int64, n) for c, n in zip(rows.column("counts").to_pylist(), sizes, strict=True)])
        order = np.argsort(x, kind="stable")
        y = x[order]
        new = np.r_[True, (y[1:] != y[:-1]) & ~(np.isnan(y[1:]) & np.isnan(y[:-1]))]
        count = np.add.reduceat(m[order], np.flatnonzero(new))
        twice = 2 * (int(self.before[key[0].as_py()][key[1].as_py()]) + np.cumsum(count) - count) + count + 1
        rank = np.empty(len(x), np.int64)
        rank[order] = twice[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        return pa.table({"block": rows.column("block"), "feature": rows.column("feature"), "n": rows.column("n"), "ranks": pa.array([_packed(rank[b - n : b]) for n, b in zip(sizes, ends, strict=True)], pa.binary()), "check": rows.column("check")})

    def assembled(self, rows: pa.Table) -> pa.Table:
        """A block: values and ranks have one order, so sorted ranks belong to its values in turn."""
        features = len(self.cuts)
        ranks: list[list[np.ndarray]] = [[] for _ in range(features)]
        seen, whole, out = [0] * features, {}, []
        for i, n, r, check, at in zip(*[rows.column(c).to_pylist() for c in ("feature", "n", "ranks", "check")], range(len(rows)), strict=True):
            if r is None:
                whole[i] = at
            else:
                ranks[i].append(_unpacked(r, np.int64, n) / 2)
                seen[i] += check
        for i in range(features):
            size, there, n, own, known, check = (rows.column(c)[whole[i]].as_py() for c in ("size", "there", "n", "own", "known", "check"))
            rank = _unzipped(known, np.float64, n).copy() if n else np.empty(0)
            light = np.sort(np.concatenate([np.empty(0), *ranks[i]]))
            if len(light) != np.isnan(rank).sum() or (seen[i] - check) % 2**64:
                raise ValueError("the rows came in another order when they were read again: write the table first")
            rank[np.isnan(rank)] = light
            has = np.ones(size, bool) if there is None else np.unpackbits(_unzipped(there, np.uint8, -(-size // 8)))[:size].astype(bool)
            column = np.full(size, np.nan)
            if n:
                column[has] = rank[_unzipped(own, np.uint8 if n <= 256 else np.uint16, int(has.sum()))]
            out.append(pa.array(column, mask=~has))
        return pa.table({f"_{i}": x for i, x in enumerate(out)})


VALUES = "block long, feature int, code int, n int, x binary, counts binary, check long"
ROWS = "block long, feature int, size int, there binary, n int, own binary, known binary, check long"
RANKED = "block long, feature int, n int, ranks binary, check long"


def ranked(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], stable: bool = False) -> DataFrame:
    """The columns replaced by their average ranks, from 1; null stays null. Other columns go.

    Values shared by many rows never travel: a value that a sketch shows at two
    places has a range of its own, whose one rank follows from counts. The rows
    are read several times: ``stable`` says that they come in the same order each
    time, as from files; else they are written first. Rows that do not are an error."""
    d, names = _doubles(df, columns)
    cols = d.columns
    if not stable:
        d = written(d, "values")
    n = d.count()
    ranges = int(min(MOST_RANGES, max(FEWEST_RANGES, -(-n // RANGE_ROWS))))
    probes = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    row = d.agg(*[F.percentile_approx(c, probes, max(ACCURACY, 4 * ranges)).alias(c) for c in cols]).first()
    cuts, heavy = [], []
    for c in cols:
        value, count = np.unique(np.array(row[c] or [], float), return_counts=True)
        cuts.append(value)
        heavy.append(value[(count > 1) & ~np.isnan(value)])
    r = _Ranges(cuts, heavy)
    r.counted(d.mapInArrow(r.count, "feature int, code int, n long").groupBy("feature", "code").agg(F.sum("n").alias("n")).collect())  # two rows a range
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n * len(cols) // DEALT))
    light = d.mapInArrow(r.values, VALUES).repartition(tasks, "feature", "code").groupBy("feature", "code").applyInArrow(lambda key, rows: r.rank(key, rows), RANKED)
    met = d.mapInArrow(r.rows, ROWS).unionByName(light, allowMissingColumns=True)
    out = met.repartition(tasks, "block").groupBy("block").applyInArrow(lambda key, rows: r.assembled(rows), ", ".join(f"{c} double" for c in cols))
    return out.select(*[F.col(c).alias(x) for c, x in zip(cols, names, strict=True)])
