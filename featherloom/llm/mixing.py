"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of the mix sets how many copies each of its documents gets on
average: a whole number, and a fraction that is rounded. Fractions are rounded
in pairs: words of probability move from one document to the other, in a
random direction with the right odds, until one of the two is 0 or 1. Each
document keeps its expected copies, and the source its expected words exactly,
until one residual is left. Pairs are formed inside slots of a source; what a
slot leaves over goes up a reduction tree, ``FAN`` slots to a node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .common import mix64, repeated, table, word_count

WEIGHTS, SHARE, MOST, FAN = (3.0, 1.0, 2.0), 1.5, 2.0, 64
#: Rows of all sources together for each slot: slots follow the rows alone, so any session draws the same mix.
SLOT_ROWS = 512
SEED = 7


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_no, source_size, target) of each source: null is one.

    Targets are in proportion to the weights, none above ``most`` times its
    source: min(cap, weight * level) with the level at which they add up. The
    two windows are over one row per source.
    """
    s = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    left = share * F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy(F.lit(1))))
    return s.select("source", "source_no", "source_size", F.least("cap", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rounds the fractions ``p`` inside each run of equal ``group``, pair by
    pair, until at most one of a group is still open. All pairs of a round are
    done at once; the rounds are as many as a group's rows halve."""
    p = p.copy()
    turn = 0
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        g = group[open_]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        a = np.flatnonzero((place % 2 == 0) & np.r_[g[1:] == g[:-1], False]) if len(g) else first
        if not len(a):
            return p
        i, j = open_[a], open_[a + 1]
        up_i, down_j = (1 - p[i]) * size[i], p[j] * size[j]
        down_i, up_j = p[i] * size[i], (1 - p[j]) * size[j]
        x, y = np.minimum(up_i, down_j), np.minimum(down_i, up_j)
        u = (mix64(key[i] ^ mix64(key[j] + np.full(1, turn, np.uint64))) >> np.uint64(11)) * 2.0**-53
        rise = u * (x + y) < y
        pi = np.where(rise, np.where(up_i <= down_j, 1.0, p[i] + x / size[i]), np.where(down_i <= up_j, 0.0, p[i] - y / size[i]))
        pj = np.where(rise, np.where(down_j <= up_i, 0.0, p[j] - x / size[j]), np.where(up_j <= down_i, 1.0, p[j] + y / size[j]))
        p[i], p[j] = np.clip(pi, 0, 1), np.clip(pj, 0, 1)
        turn += 1


def _round_slots(batches):
    """Rows sorted by source and slot. All of a slot's rows meet here: SLOT_ROWS
    at most on average, whatever share of the rows a source has."""
    kept = None
    for b in batches:
        b = b if kept is None else pd.concat([kept, b], ignore_index=True)
        if not len(b):
            continue
        no, slot = b["source_no"].to_numpy(), b["slot"].to_numpy()
        last = (no == no[-1]) & (slot == slot[-1])
        kept, b = b[last], b[~last]
        if len(b):
            yield _rounded(b)
    if kept is not None and len(kept):
        yield _rounded(kept)


def _rounded(b: pd.DataFrame) -> pd.DataFrame:
    no, slot = b["source_no"].to_numpy(), b["slot"].to_numpy()
    group = np.cumsum(np.r_[False, (no[1:] != no[:-1]) | (slot[1:] != slot[:-1])])
    p = pivot(b["p"].to_numpy(), b["size"].to_numpy().astype(float), b["key"].to_numpy().astype(np.uint64), group)
    return b.assign(p=p)


def copies(rows: DataFrame, slots: int) -> DataFrame:
    """``rows`` (source_no, p, size, key and others) with p rounded to 0 or 1."""
    level = rows.withColumn("slot", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(slots)).cast("int"))
    done = []
    while True:
        dealt = level.repartition("source_no", "slot").sortWithinPartitions("source_no", "slot", F.desc("size"), "key")
        out = checkpointed(dealt.mapInPandas(_round_slots, level.schema))
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~is_open))
        level = out.where(is_open).withColumn("slot", F.floor(F.col("slot") / FAN).cast("int"))
        if slots == 1:
            break
        slots = -(-slots // FAN)
    u = F.shiftrightunsigned(F.xxhash64("key", F.lit(SEED + 1)), 11).cast("double") * 2.0**-53
    result = level.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0))
    for d in done:
        result = result.unionByName(d)
    return result.drop("slot")


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds source_size, target, copies and taken (copies * size) to ``rows``,
    which have doc_id, source, size.

    A document of size 0 is taken as often as its source's whole part says and
    adds no words. A source without words has target 0 and its documents no
    copies. Equal rows are rounded as one, with their copies together, and share
    these out evenly; draws follow from all columns, so a hash of the text tells
    rows without an id apart. Null sources are one source, the last. Columns of
    ``rows`` with the name of a result give way, all others come back.
    """
    rows = rows.drop("source_size", "target", "copies", "taken")
    # Equal rows are counted before they are dealt out; numbered, they are fixed as soon as they are written.
    each = rows.groupBy(F.struct(*rows.columns).alias("row")).agg(F.count("*").alias("n"))
    each = checkpointed(each.select("row", "n", F.col("row.source").alias("source"), F.coalesce(F.col("row.size"), F.lit(0)).cast("long").alias("one"), F.xxhash64("row", F.lit(SEED)).alias("key"), F.monotonically_increasing_id().alias("id")))
    slots = max(1, -(-each.count() // SLOT_ROWS))
    t = targets(each.select("source", (F.col("one") * F.col("n")).alias("size")), weights, share, most)
    # As many rows as sources: joined by the session's own choice, never forced to broadcast.
    r = each.join(t.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("n")
    r = r.withColumn("whole", F.floor(per).cast("long")).withColumn("p", F.when(F.col("one") > 0, per - F.floor(per)).otherwise(0.0))
    drawn = copies(r.select("id", "source_no", "p", F.col("one").alias("size"), "key"), slots).select(F.col("id").alias("drawn"), "p")
    kept = r.select("id", "row", "n", "one", "whole", "source_size", "target")
    all_ = kept.join(drawn.hint("merge"), F.col("id") == F.col("drawn")).withColumn("copies", F.col("whole") + F.col("p").cast("long"))
    own = F.floor(F.col("copies") / F.col("n")).cast("long") + (F.col("k") < F.col("copies") % F.col("n")).cast("long")
    out = repeated(all_.select("row", "n", "one", "source_size", "target", "copies"), "n", "k").withColumn("copies", own)
    return out.select("row.*", "source_size", "target", "copies", (F.col("copies") * F.col("one")).alias("taken"))


def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "copies")
