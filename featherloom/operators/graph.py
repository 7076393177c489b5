"""Graphs given as edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed

#: Edges that a task gathers before it reduces them to stars.
GATHER = 1 << 20
#: Edges that a task is dealt, about; of fewer edges each of the session's cores gets some.
DEALT = 1 << 17


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that is not the least of its component of the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _reduced(batches):
    """(u, v) of a partition as stars, and the distinct u that it was dealt."""
    u, v, dealt, held = [], [], [], 0
    for b in batches:
        u.append(b.column("u").to_numpy(zero_copy_only=False))
        v.append(b.column("v").to_numpy(zero_copy_only=False))
        dealt.append(u[-1])
        held += len(b)
        if held > GATHER:
            x, y = stars(np.concatenate(u), np.concatenate(v))
            u, v, dealt, held = [x], [y], [np.unique(np.concatenate(dealt))], 0
    if not u:
        return None
    return *stars(np.concatenate(u), np.concatenate(v)), np.unique(np.concatenate(dealt))


def _stars_of_task(batches):
    if (found := _reduced(batches)) is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[:2]], ["u", "v"])


def _stars_of_dealt(kind):
    """As above for edges dealt by u; ``own`` marks nodes that are dealt to this task, the only one to own them."""

    def run(batches):
        if (found := _reduced(batches)) is not None:
            x, y, dealt = found
            yield pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(y, kind), pa.array(np.isin(x, dealt))], ["u", "v", "own"])

    return run


def parents(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) of each node but the least one of its component.

    Each task reduces its edges to stars. They are dealt by their outer node and
    reduced again, so that a node is met by one row of each task at most,
    whatever its degree. Then each outer node follows its centre's own centre, in
    a join whose large keys Spark can split. Rounds end when nothing moves, after
    about log(n) of them. There are as many tasks of Python as the edges ask for,
    whatever the number of shuffle partitions.
    """
    kind, arrow = ("string", pa.string()) if dict(edges.dtypes)[a] == "string" else ("bigint", pa.int64())
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v"))
    pairs = checkpointed(pairs.mapInArrow(_stars_of_task, f"u {kind}, v {kind}"))
    # Rounds make no edges: the first count bounds all of them.
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // DEALT))
    while True:
        # The join reads it twice.
        reduced = checkpointed(pairs.coalesce(tasks).mapInArrow(_stars_of_task, f"u {kind}, v {kind}").repartition("u").coalesce(tasks).mapInArrow(_stars_of_dealt(arrow), f"u {kind}, v {kind}, own boolean"))
        up = reduced.where("own").select(F.col("u").alias("centre"), F.col("v").alias("next"))
        moved = reduced.join(up.hint("merge"), F.col("v") == F.col("centre"), "left").select("u", F.coalesce("next", "v").alias("v"), (F.col("next").isNotNull() | ~F.col("own")).alias("moved"))
        moved = checkpointed(moved)
        pairs = moved.select("u", "v")
        if moved.where("moved").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) of each node that has an edge: the component is named
    after its smallest node. Self-loops and repeated edges change nothing; an
    edge with a null end is none. Nodes are integers (long) or strings."""
    every = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = every.select(F.explode(F.array(a, b)).alias("node")).distinct()
    found = parents(edges, a, b)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def threshold_edges(pairs: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) of the pairs from the threshold on."""
    return pairs.where(F.col("score") >= threshold).select(F.col("f1").alias("src"), F.col("f2").alias("dst"))


def density(pairs: DataFrame, n: int, thresholds) -> DataFrame:
    """(threshold, edges, density) of the graphs over n features, in one scan of the pairs."""
    one = pairs.agg(*[F.count_if(F.col("score") >= t).alias(f"e{i}") for i, t in enumerate(thresholds)])
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"e{i}").alias("edges"), F.try_divide(F.col(f"e{i}").cast("double"), F.lit(n * (n - 1) / 2)).alias("density")) for i, t in enumerate(thresholds)]
    return one.select(F.inline(F.array(*rows)))


def components_of(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, component) of all features, those without an edge on their own."""
    found = connected_components(edges).withColumnRenamed("node", "feature")
    return features.select("feature").join(found, "feature", "left").select("feature", F.coalesce("component", "feature").alias("component"))


def component_report(components: DataFrame, small: int = 7) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") <= small).alias("small_components"))


def sparsified(matrix: DataFrame, threshold: float) -> DataFrame:
    """Off-diagonal entries from the threshold on; all others are 0 and left out."""
    return matrix.where((F.col("f1") != F.col("f2")) & (F.col("score") >= threshold))


def neighbour_counts(features: DataFrame, profiles: DataFrame) -> DataFrame:
    n = profiles.where("score > 0").groupBy(F.col("f1").alias("feature")).agg(F.count("*").alias("n"))
    return features.select("feature").join(n, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n_neighbours"))


def neighbour_summary(counts: DataFrame) -> DataFrame:
    """One row over all features: fewest, median, mean and most neighbours."""
    return counts.agg(F.min("n_neighbours").alias("minimum"), F.median("n_neighbours").alias("median"), F.avg("n_neighbours").alias("mean"), F.max("n_neighbours").alias("maximum"))


def cosine_similarity(profiles: DataFrame) -> DataFrame:
    """(f1, f2, score) of f1 < f2: cosine of the rows of (f1, f2, score), clipped
    to [0, 1]; 0 for a row of zeros. Rows meet on shared columns only."""
    a = profiles.select(F.col("f1"), F.col("f2").alias("c"), F.col("score").alias("x"))
    b = profiles.select(F.col("f1").alias("f2"), F.col("f2").alias("c"), F.col("score").alias("y"))
    dots = a.join(b, "c").where("f1 < f2").groupBy("f1", "f2").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    norms = profiles.groupBy("f1").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    both = dots.join(norms.withColumnRenamed("norm", "n1"), "f1").join(norms.select(F.col("f1").alias("f2"), F.col("norm").alias("n2")), "f2")
    return both.select("f1", "f2", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("dot"), F.col("n1") * F.col("n2")), F.lit(0.0)))).alias("score"))
