"""Hierarchical clustering of features, and relational measures of clusterings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp
from ..plans.lineage import checkpointed
from . import graph as gr
from .blocks import separation

MAX_SIZE, KS = 7, tuple(range(6, 21))


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of the closest clusters, by the mean distance of
    their members; a merge's cluster takes the number n + its place. For a matrix
    at hand: ``linkage`` does the same over tables."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    names, sizes, alive, merges = list(range(n)), np.ones(n), np.ones(n, bool), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        merges.append((names[i], names[j], float(d[i, j])))
        mean = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        d[i] = d[:, i] = mean
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        alive[j], names[i] = False, n + step
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels from 0, in the order of first members, of at most k clusters:
    merges of one height are made together, so there may be fewer."""
    heights = sorted({h for *_, h in merges})
    at = next((h for h in [-np.inf, *heights] if n - sum(m[2] <= h for m in merges) <= k), np.inf)
    root = list(range(n + len(merges)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, b, h) in enumerate(merges):
        if h <= at:
            root[find(a)] = root[find(b)] = n + i
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen)) for i in range(n)])


#: Decimals to which heights are compared: sums of the same distances in another order are the same height.
HEIGHT_DIGITS = 12


def linkage(distances: DataFrame, by: str | None = None) -> DataFrame:
    """(by, a, b, height) of average linkage on (f1, f2, distance), which holds
    both directions: the cluster that ``b`` is the first member of joins that of ``a``.

    Rounds of joins: a pair of clusters that are each other's nearest merges, all
    such pairs in one round. Average linkage never makes a merged cluster nearer
    to a third than its parts were, so this is the tree that merging one closest
    pair after another gives, in about log(n) rounds. Ties go by a hash of the pair.
    """
    g = [by] if by else []
    pairs = checkpointed(distances.where(F.col("f1") != F.col("f2")).select(*g, F.col("f1").alias("c"), F.col("f2").alias("d"), F.col("distance").cast("double").alias("s"), F.lit(1).cast("long").alias("n")))
    done = []
    while True:
        low, high = F.least("c", "d"), F.greatest("c", "d")
        near = pairs.groupBy(*g, "c").agg(F.min(F.struct(F.round(F.col("s") / F.col("n"), HEIGHT_DIGITS).alias("h"), F.xxhash64(low, high).alias("tie"), low.alias("low"), high.alias("high"))).alias("x"))
        # Mutual pairs are named by both of their clusters.
        met = checkpointed(near.groupBy(*g, "x.low", "x.high").agg(F.min("x.h").alias("height"), F.count("*").alias("both")).where("both = 2").select(*g, F.col("low").alias("a"), F.col("high").alias("b"), "height"))
        if met.isEmpty():
            break
        done.append(met)
        for side in ("c", "d"):
            gone = met.select(*g, F.col("b").alias(side), F.col("a").alias("into"))
            pairs = pairs.join(gone, [*g, side], "left").withColumn(side, F.coalesce("into", side)).drop("into")
        pairs = checkpointed(pairs.where("c <> d").groupBy(*g, "c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    out = distances.sparkSession.createDataFrame([], met.schema)
    for m in done:
        out = out.unionByName(m)
    return out


def hierarchical_labels(distances: DataFrame, features: Sequence[str], ks: Sequence[int] = KS, by: str | None = None) -> DataFrame:
    """(by, k, feature, label) of average linkage on (f1, f2, distance), for each
    k and each value of ``by``: at most k clusters, labelled from 0 in the order
    of their first features. Merges of one height are made together, so there may be fewer."""
    g, n = [by] if by else [], len(features)
    d = checkpointed(distances.where(F.col("f1").isin(*features) & F.col("f2").isin(*features)).select(*g, "f1", "f2", "distance"))
    merges = checkpointed(linkage(d, by))
    # Clusters that are left after the merges up to each height: a row for each height.
    up = Window.partitionBy(*g).orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    left = merges.groupBy(*g, "height").agg(F.count("*").alias("m")).withColumn("left", n - F.sum("m").over(up))
    each = F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k")
    cuts = left.select(*g, "height", "left", each).where("left <= k and k < " + str(n)).groupBy(*g, "k").agg(F.min("height").alias("cut"))
    node = lambda f: F.concat_ws("|", F.col("k").cast("string"), *[F.col(x).cast("string") for x in g], f)
    kept = merges.join(cuts, g) if g else merges.join(F.broadcast(cuts))  # a row for each k
    edges = kept.where("height <= cut").select(node("a").alias("src"), node("b").alias("dst"))
    groups = d.select(*g).distinct() if g else d.sparkSession.range(1).select()
    place = F.posexplode(F.array(*[F.lit(f) for f in features])).alias("at", "feature")
    every = groups.select(*g, each).select(*g, "k", place)
    found = every.withColumn("node", node("feature")).join(gr.connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min("at").over(Window.partitionBy(*g, "k", "component"))
    label = F.dense_rank().over(Window.partitionBy(*g, "k").orderBy("first"))
    return found.withColumn("first", first).select(*g, "k", "feature", (label - 1).cast("long").alias("label"))


def labels_to_blocks(labels: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, block_id, features): a block per label, numbered from 1, its features in the order given."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    g = labels.groupBy(*by, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), "feature"))), lambda x: x["feature"]).alias("features"))
    return g.select(*by, F.dense_rank().over(Window.partitionBy(*by).orderBy("label")).cast("long").alias("block_id"), "features")


def silhouette(distances: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean silhouette per value of ``by``, of which the distances may have some too; a point alone in its cluster counts 0;
    null unless there are 2 to n - 1 clusters."""
    own = labels.select(*by, F.col("feature").alias("f1"), F.col("label").alias("own"))
    other = labels.select(*by, F.col("feature").alias("f2"), "label")
    shared = [c for c in by if c in distances.columns]  # a distance may be one of several
    sums = distances.where(F.col("f1") != F.col("f2")).join(own, ["f1", *shared]).join(other, ["f2", *by]).groupBy(*by, "f1", "own", "label").agg(F.avg("distance").alias("d"))
    ab = sums.groupBy(*by, "f1").agg(F.max(F.when(F.col("own") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("label"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    sizes = labels.groupBy(*by).agg(F.count_distinct("label").alias("clusters"), F.count("*").alias("n"))
    points = ab.groupBy(*by).agg(F.avg(s).alias("silhouette"))
    out = points.join(sizes, list(by)) if by else points.join(F.broadcast(sizes))
    return out.select(*by, F.when((F.col("clusters") >= 2) & (F.col("clusters") < F.col("n")), F.col("silhouette")).alias("silhouette"))


def cluster_sizes(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sizes = labels.groupBy(*by, "label").agg(F.count("*").alias("size"))
    return sizes.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"))


def evaluate(distances: DataFrame, labels: DataFrame, by: Sequence[str] = ("k",), max_size: int = MAX_SIZE) -> DataFrame:
    e = silhouette(distances, labels, by).join(cluster_sizes(labels, by), list(by))
    return e.withColumn("valid", F.col("max_size") <= max_size)


def choose_k(evaluation: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The row of the best silhouette among the valid ones, else among all; ties
    to the larger ratio, where there is one, then to the smaller k."""
    ratio = [F.desc_nulls_last("ratio")] if "ratio" in evaluation.columns else []
    order = Window.partitionBy(*by).orderBy(F.desc("valid"), F.desc_nulls_last("silhouette"), *ratio, "k")
    return evaluation.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Adds competition ranks by silhouette and by ratio, and their sum, best first."""
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    r = candidates.withColumn("rank_silhouette", rank("silhouette")).withColumn("rank_ratio", rank("ratio"))
    return r.withColumn("combined_rank", F.col("rank_silhouette") + F.col("rank_ratio")).orderBy("combined_rank", F.desc("silhouette"), F.desc("ratio"))


def alpha_grid(low: int = 20, high: int = 80, step: int = 5) -> list[float]:
    return [round(x / 100, 2) for x in range(low, high + 1, step)]


def adjusted_rand(labels: DataFrame, by: str) -> DataFrame:
    """(a, b, ari) of each pair of labelings, ``by`` telling them apart."""
    a = labels.select(F.col(by).alias("a"), "feature", F.col("label").alias("la"))
    b = labels.select(F.col(by).alias("b"), "feature", F.col("label").alias("lb"))
    cells = a.join(b, "feature").where("a < b").groupBy("a", "b", "la", "lb").agg(F.count("*").alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    side = lambda c, out: cells.groupBy("a", "b", c).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(two("n")).alias(out))
    g = cells.groupBy("a", "b").agg(F.sum(two("n")).alias("both"), F.sum("n").alias("n")).join(side("la", "sa"), ["a", "b"]).join(side("lb", "sb"), ["a", "b"])
    expected = F.try_divide(F.col("sa") * F.col("sb"), two("n"))
    top, bottom = F.col("both") - expected, (F.col("sa") + F.col("sb")) / 2 - expected
    return g.select("a", "b", F.coalesce(F.try_divide(top, bottom), F.lit(1.0)).alias("ari"))


def stability(ari: DataFrame) -> DataFrame:
    """Per labeling the mean, least and largest agreement with the others, most stable first."""
    both = ari.select(F.col("a").alias("labeling"), "ari").unionByName(ari.select(F.col("b").alias("labeling"), "ari"))
    return both.groupBy("labeling").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"), F.max("ari").alias("max_ari"), F.count("*").alias("n")).orderBy(F.desc("mean_ari"), "labeling")


def alpha_sweep(nmi: DataFrame, rho: DataFrame, features: Sequence[str], alphas: Sequence[float], ks: Sequence[int] = KS, max_size: int = MAX_SIZE) -> DataFrame:
    """The best valid clustering of the signed blend for each alpha, ranked. Raises if no alpha has one."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    both = nmi.join(rho, ["f1", "f2"]).select("f1", "f2", "nmi", F.coalesce("score", F.lit(0.0)).alias("rho"), grid)
    pairs = checkpointed(both.select("alpha", "f1", "f2", clamp(F.col("alpha") * F.col("nmi") + (1 - F.col("alpha")) * F.col("rho")).alias("score")))
    half = pairs.select("alpha", "f1", "f2", clamp(1 - F.col("score")).alias("distance"))
    dist = half.unionByName(half.select("alpha", F.col("f2").alias("f1"), F.col("f1").alias("f2"), "distance"))
    labels = checkpointed(hierarchical_labels(dist, features, ks, "alpha"))
    parts = separation(labels.withColumnRenamed("label", "block_id"), pairs, ("alpha", "k")).select("alpha", "k", "mean_within", "mean_between", "ratio")
    best = choose_k(evaluate(dist, labels, ("alpha", "k"), max_size).where("valid").join(parts, ["alpha", "k"]), ["alpha"])
    found = rank_candidates(checkpointed(best))
    if found.isEmpty():
        raise ValueError(f"no clustering keeps its blocks to {max_size} features")
    return found
