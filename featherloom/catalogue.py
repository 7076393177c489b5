"""Queries over the driver's tables, and the SQL they agree with.

Floating results are rounded to six decimals on both sides, and every top-k has
a total order.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .functions import numeric as fn
from .operators import blocks as bl
from .operators import cluster as cl
from .operators import dependency as dep
from .operators import graph as gr
from .operators import mask as mk
from .operators import prepare as pp
from .operators import profile as pr
from .operators.order import order_statistics
from .plans.lineage import checkpointed, shared_folder, written
from .sources import sinks, tables

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Features of the dependency queries, by their expression over lineitem.
FEATURES = {
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "disc_price": "l_extendedprice * (1 - l_discount)",
    "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "neg_price": "-l_extendedprice",
    "tax_amt": "l_extendedprice * l_tax",
}
NAMES = list(FEATURES)
#: As many features as a wide table has: columns of lineitem, their products, and squares.
BASE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
WIDE = {c: c for c in BASE} | {f"{a}_by_{b[2:]}": f"cast({a} as double) * {b}" for a, b in combinations(BASE, 2)} | {f"{c}_squared": f"cast({c} as double) * {c}" for c in BASE[:3]}
BLOCKS = [(1, "price"), (1, "disc_price"), (1, "charge"), (1, "neg_price"), (2, "quantity"), (3, "discount"), (3, "tax"), (4, "tax_amt")]
#: Clusterings of the features, by the correlation that joins them; blocks of one level are those that masks hide.
LEVELS, BLOCKS_AT = {"w": 0.04, "x": 0.65, "y": 0.9, "z": 0.9985}, "y"
ARTIFACTS = {"l_extendedprice": 90000.0}
RATIO = 0.25
#: Rows of a chunk, and rows kept of each.
CHUNK_ROWS, CHUNK_KEEP = 4_096, 20
COMPONENTS_AT = 0.6


def _read(spark, d: str, name: str, columns=None) -> DataFrame:
    return tables.read_parquet(spark, f"{d}/{name}.parquet", columns)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema if isinstance(f.dataType, DoubleType)})


def _lineitem(spark, d):
    return _read(spark, d, "lineitem", NUMERIC)


def _features(spark, d):
    return _lineitem(spark, d).select(*[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def _wide(spark, d):
    return _read(spark, d, "lineitem", BASE).select(*[F.expr(e).cast("double").alias(n) for n, e in WIDE.items()])


def _pairs(spark, d):
    """Absolute correlations, rounded so that thresholds cut alike everywhere: a row per pair, worked out once."""
    return checkpointed(dep.correlations(_features(spark, d), NAMES).select("f1", "f2", F.round(F.abs("score"), 6).alias("score")))


def _blocks(spark):
    return spark.createDataFrame(BLOCKS, "block_id long, feature string")


def _labelings(spark, d):
    """(labeling, feature, label): the components of the features at each level, all found as one graph."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("labeling"), F.lit(t).alias("level")) for k, t in LEVELS.items()])).alias("l")
    node = lambda f: F.concat_ws("|", "l.labeling", f)
    edges = _pairs(spark, d).select("f1", "f2", "score", levels).where("score >= l.level").select(node("f1").alias("src"), node("f2").alias("dst"))
    every = _names(spark).select("feature", levels).select(node("feature").alias("node"), "l.labeling", "feature")
    found = every.join(gr.connected_components(edges), "node", "left").select("labeling", "feature", F.coalesce("component", "node").alias("component"))
    return checkpointed(found.select("labeling", "feature", F.dense_rank().over(Window.partitionBy("labeling").orderBy("component")).cast("long").alias("label")))


def _found_blocks(spark, d):
    """(block_id, feature): the components at one level."""
    return _labelings(spark, d).where(F.col("labeling") == BLOCKS_AT).select(F.col("label").alias("block_id"), "feature")


def _block_list(spark, d):
    """The found blocks on the driver: as many rows as features."""
    return sorted((r["block_id"], r["feature"]) for r in _found_blocks(spark, d).collect())


def _listed(spark, d):
    """The found blocks as a file of lists, and read from there."""
    path = _folder(spark)
    lists = _found_blocks(spark, d).groupBy(F.col("block_id").alias("Block_ID")).agg(F.array_join(F.sort_array(F.collect_list("feature")), " | ").alias("Features"))
    sinks.write_table(lists, path, "csv")
    return tables.read_csv(spark, path, "Block_ID int, Features string")


def _refined(spark, d):
    """The block of prices in two: prices as they are, and what is made of them."""
    plain = ("price", "neg_price")
    blocks, parts = _block_list(spark, d), {}
    for i in {i for i, f in blocks if f in plain}:
        own = [f for k, f in blocks if k == i]
        parts[i] = [p for p in ([f for f in own if f in plain], [f for f in own if f not in plain]) if p]
    return bl.rewrite(_found_blocks(spark, d), parts)


def _placed_twice(spark, d):
    """The found blocks, and one feature in another block too."""
    b = _found_blocks(spark, d)
    return b.unionByName(b.where("feature = 'quantity'").select((F.col("block_id") + 100).alias("block_id"), "feature"))


def _candidates(spark, d):
    """(alpha, k, silhouette, ratio) of the clustering at each level."""
    labels, pairs = _labelings(spark, d), _pairs(spark, d)
    level = F.element_at(F.create_map(*[x for k, t in LEVELS.items() for x in (F.lit(k), F.lit(t))]), F.col("labeling"))
    parts = bl.separation(labels.withColumnRenamed("label", "block_id"), pairs, ("labeling",))
    e = cl.evaluate(dep.to_distance(dep.symmetric(pairs, NAMES)), labels, ("labeling",)).join(parts, "labeling")
    return checkpointed(e.select(level.alias("alpha"), F.col("n_clusters").alias("k"), F.round("silhouette", 6).alias("silhouette"), F.round("ratio", 6).alias("ratio")))


def _label_layouts(spark, d):
    """Labels from a written file of lists, and from one of a feature a row."""
    path = _folder(spark)
    sinks.write_table(_found_blocks(spark, d).select("feature", F.col("block_id").alias("label")), path)
    lists, rows = tables.labels(_listed(spark, d)), tables.labels(spark.read.parquet(path))
    return lists.withColumn("layout", F.lit("lists")).unionByName(rows.withColumn("layout", F.lit("rows")))


def _rules(spark, d):
    """Feature rules, an artifact being a price over the largest hundredth."""
    t = _lineitem(spark, d)
    limit = round(order_statistics(t, ["l_extendedprice"], [0.99])["l_extendedprice"].q[0], 6)
    return pp.feature_rules(spark, t.columns, ["l_extendedprice"], {"l_extendedprice": limit})


def _observed(spark, d):
    docs = _read(spark, d, "documents", ["doc_id", "source", "n_chars"]).join(_read(spark, d, "labels"), "doc_id", "left")
    kept, seen = pp.observed_hygiene(docs)
    left = written(kept, "hygiene")
    return left.agg(F.count("*").alias("after"), *[F.lit(v).cast("long").alias(k) for k, v in seen.get.items()])


def _chunks(spark, d):
    return tables.read_chunks(spark, f"{d}/lineitem.parquet", CHUNK_ROWS, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


def _chunk_samples(spark, d):
    """Samples of the returned columns alone, which then settle between rows of one key."""
    return pp.chunk_samples(_chunks(spark, d).select("chunk", "l_orderkey", "l_linenumber", "l_quantity"), "chunk", ["l_orderkey", "l_linenumber"], CHUNK_KEEP)


def _distances(spark, d):
    return dep.to_distance(dep.symmetric(_pairs(spark, d), NAMES))


def _trials(spark, d):
    """A trial for each customer."""
    return _read(spark, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("trial"))


def _masker_batch(spark, d):
    masked, _ = mk.BlockMasker(spark, _block_list(spark, d), RATIO).mask_batch(_features(spark, d))
    return pr.moments(masked, NAMES).select("feature", F.round("minimum", 6).alias("minimum"), F.round("maximum", 6).alias("maximum"))


def _exact_mean(c):
    """A mean from an exact decimal sum, so that no order of summation shows."""
    return F.round(F.sum(c.cast("decimal(18,6)")).cast("double") / F.count(c), 9)


def _moments(spark, d):
    six = {k: (lambda c, m=m: F.round(m(c), 6)) for k, m in pr.MOMENTS.items() if k in ("std", "minimum", "maximum")}
    return pr.per_column(_lineitem(spark, d), NUMERIC, {"n": pr.MOMENTS["n"], "total": lambda c: F.round(F.sum(c), 2), **six, "mean": _exact_mean})


def _masked_batch(spark, d):
    m = mk.apply_mask(_features(spark, d), ["price", "tax"])
    return pr.per_column(m, NAMES, {"maximum": lambda c: F.round(F.max(c), 6), "mean": _exact_mean})


def _profile(spark, d):
    return _rounded(pr.feature_profile(_lineitem(spark, d), NUMERIC).drop("n"))


def _hygiene(spark, d):
    docs = _read(spark, d, "documents", ["doc_id", "source", "n_chars"]).join(_read(spark, d, "labels"), "doc_id", "left")
    return pp.drop_incomplete(docs)


def _clean(spark, d):
    t = _lineitem(spark, d)
    c = pp.clean(t, NUMERIC, pp.medians(t, NUMERIC), ARTIFACTS, ["l_extendedprice", "l_quantity"])
    return _rounded(c.agg(F.count("*").alias("n"), *[F.sum(x).alias(f"sum_{x}") for x in NUMERIC]).select("n", *[F.round(f"sum_{x}", 2).alias(f"sum_{x}") for x in NUMERIC]))


def _scale(spark, d):
    t = _lineitem(spark, d)
    s = pp.scale(t, NUMERIC, pp.fit_robust_scaler(t, NUMERIC))
    return _rounded(pr.moments(s, NUMERIC).select("feature", "minimum", "maximum", F.round("mean", 4).alias("mean")))


def _split(spark, d):
    return pp.key_hash_split(_read(spark, d, "events", ["event_id", "event_type"]), ["event_id"])


def _mi(spark, d):
    return dep.mutual_information(dep.binned_counts(_features(spark, d), NAMES))


def _rho(spark, d):
    return dep.spearman(_features(spark, d), NAMES, stable=True)  # columns of a file


def _what_if(spark, d):
    b = _blocks(spark)
    both = b.withColumn("config", F.lit("as_is")).unionByName(bl.move_feature(b, "tax_amt", 3).withColumn("config", F.lit("moved")))
    return _rounded(bl.separation(both, _pairs(spark, d), ["config"]))


def _embedding_cosine(spark, d):
    e = _read(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    centroid = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy(F.col("label").cast("string").alias("f1"), F.col("pos").cast("string").alias("f2")).agg(F.avg(F.col("x").cast("double")).alias("score"))
    return _rounded(gr.cosine_similarity(centroid))


def _names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "feature string")


def _components(spark, d):
    return gr.components_of(_names(spark), gr.threshold_edges(_pairs(spark, d), COMPONENTS_AT))


def _threshold_blocks(spark, d):
    c = _components(spark, d).select(F.dense_rank().over(Window.orderBy("component")).cast("long").alias("block_id"), "feature")
    return _rounded(bl.separation(c, _pairs(spark, d)))


def _silhouette(spark, d):
    return _rounded(cl.silhouette(_distances(spark, d), _labelings(spark, d), ["labeling"]))


def _hierarchical(spark, d):
    distances = checkpointed(_distances(spark, d))
    return _rounded(cl.evaluate(distances, cl.hierarchical_labels(distances, NAMES, (2, 3, 4, 5)), ("k",), 4))


def _alpha_sweep(spark, d):
    nmi, rho = _mi(spark, d).select("f1", "f2", "nmi"), _rho(spark, d)
    return _rounded(cl.alpha_sweep(checkpointed(nmi), checkpointed(rho), NAMES, cl.alpha_grid(), (2, 3, 4, 5), 5))


def _block_masks(spark, d):
    return mk.block_masks(_trials(spark, d), _block_list(spark, d), RATIO)


def _random_masks(spark, d):
    return mk.random_masks(_trials(spark, d), NAMES, RATIO)


def _block_sides(spark, d):
    return mk.block_sides(_trials(spark, d), _block_list(spark, d), RATIO)


def _random_sides(spark, d):
    return mk.random_sides(_trials(spark, d), NAMES, RATIO)


def _shortcuts(spark, d, masks):
    return mk.shortcuts(masks(spark, d), _pairs(spark, d))


def _folder(spark):
    """A new folder beside the checkpoints, which all executors see."""
    return shared_folder(spark, "round-trip")


def _csv_round_trip(spark, d):
    path = _folder(spark)
    sinks.write_table(_read(spark, d, "supplier"), path, "csv")
    return tables.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", ["s_suppkey", "s_nationkey", "s_acctbal"])


def _split_round_trip(spark, d):
    path = _folder(spark)
    sinks.write_split(_split(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("cnt"), F.sum("event_id").alias("ids"))


def _matrix_round_trip(spark, d):
    path = _folder(spark)
    sinks.write_matrix(dep.symmetric(_pairs(spark, d), NAMES), NAMES, path)
    return tables.read_matrix(spark, path)


def _scaler_round_trip(spark, d):
    path = _folder(spark)
    sinks.write_table(pp.fit_robust_scaler(_lineitem(spark, d), NUMERIC), path)
    return _rounded(pr.moments(pp.scale(_lineitem(spark, d), NUMERIC, spark.read.parquet(path)), NUMERIC).select("feature", "minimum", "maximum"))


def _clipped_log(spark, d):
    t = _read(spark, d, "customer", ["c_acctbal"]).select(fn.log1p(F.col("c_acctbal"), True).alias("x"))
    return t.agg(F.count("x").alias("n"), F.min("x").alias("minimum"), F.round(F.max("x"), 6).alias("maximum"), F.round(F.sum("x"), 3).alias("total"))


def _equal_width(spark, d):
    codes = dep.discretize(_features(spark, d), ["quantity", "price"], equal=True)
    return dep.joint_counts(codes, ["quantity", "price"], only_own=True).select(F.col("f1").alias("feature"), F.col("c1").alias("code"), "n")


def queries():
    q = {
        "category_distribution": lambda s, d: _rounded(pr.category_distribution(_read(s, d, "lineitem", ["l_returnflag"]), "l_returnflag")),
        "multi_category_distribution": lambda s, d: _rounded(_multi(s, d)),
        "null_audit": lambda s, d: pr.null_audit(_read(s, d, "documents").join(_read(s, d, "labels"), "doc_id", "left"), ["doc_id", "lang", "quality", "toxic"]),
        "duplicate_rows": lambda s, d: pr.duplicate_rows(_read(s, d, "lineitem", ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"]),
        "repeated_rows": lambda s, d: pr.repeated_rows(_read(s, d, "lineitem")),
        "chunk_duplicates": lambda s, d: pr.chunk_duplicates(_chunks(s, d), "chunk", ["l_partkey", "l_quantity"]),
        "chunk_samples": _chunk_samples,
        "capped_sample": lambda s, d: pp.hash_sample(_chunk_samples(s, d).drop("chunk"), ["l_linenumber", "l_orderkey"], 100),
        "observed_hygiene": _observed,
        "numeric_moments": _moments,
        "csv_round_trip": _csv_round_trip,
        "split_round_trip": _split_round_trip,
        "matrix_round_trip": _matrix_round_trip,
        "scaler_round_trip": _scaler_round_trip,
        "clipped_log": _clipped_log,
        "equal_width_bins": _equal_width,
        "label_layouts": _label_layouts,
        "feature_columns": lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(pp.feature_columns(_read(s, d, "documents"), ["doc_id", "lang", "source"]))], "position long, feature string"),
        "table_header": lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(_read(s, d, "supplier").columns)], "position long, feature string"),
        "value_audit": lambda s, d: _rounded(pr.value_audit(_read(s, d, "customer"), ["c_acctbal", "c_nationkey"])),
        "attention_features": lambda s, d: _rounded(pr.needs_attention(pr.value_audit(_read(s, d, "customer"), ["c_acctbal", "c_nationkey"]))),
        "threshold_counts": lambda s, d: _rounded(pr.threshold_counts(_read(s, d, "lineitem"), {"l_extendedprice": [1000.0, 50000.0, 90000.0], "l_quantity": [25.0]})),
        "top_extremes": lambda s, d: pr.top_values(_read(s, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 15),
        "suspicious_examples": lambda s, d: pr.examples_above(_read(s, d, "events"), "value", 90.0, ["event_id", "user_id"], 10),
        "suspicious_by_source": lambda s, d: pr.above_by_group(_read(s, d, "events", ["value", "event_type"]), "value", 50.0, "event_type"),
        "feature_profile": _profile,
        "hygiene_dropna": _hygiene,
        "drop_identity": lambda s, d: pp.drop_identity(_read(s, d, "supplier"), ["s_name", "s_nationkey"]),
        "key_hash_split": lambda s, d: _rounded(pp.split_sizes(_split(s, d))),
        "split_comparison": lambda s, d: pp.split_comparison(_split(s, d), "event_type"),
        "stratified_split": lambda s, d: pp.stratified_split(_read(s, d, "events", ["event_id", "event_type"]), ["event_id"], "event_type").groupBy("split").agg(F.count("*").alias("cnt")),
        "train_medians": lambda s, d: _rounded(pp.medians(_lineitem(s, d), NUMERIC)),
        "medians_without_artifacts": lambda s, d: _rounded(pp.medians(_lineitem(s, d), NUMERIC, ARTIFACTS)),
        "clean_features": _clean,
        "robust_scaler": lambda s, d: _rounded(pp.fit_robust_scaler(_lineitem(s, d), NUMERIC)),
        "robust_scale": _scale,
        "tail_thresholds": lambda s, d: _rounded(pr.tail_thresholds(_lineitem(s, d), F.expr("l_extendedprice + l_extendedprice * l_tax"))),
        "feature_rules": _rules,
        "hash_sample": lambda s, d: pp.hash_sample(_read(s, d, "events", ["event_id", "event_type"]), ["event_id"], 100),
        "spearman_pairs": lambda s, d: _rounded(_rho(s, d)),
        "wide_correlations": lambda s, d: _rounded(dep.correlations(_wide(s, d), list(WIDE))),
        "wide_spearman": lambda s, d: _rounded(dep.spearman(_wide(s, d), list(WIDE), stable=True)),
        "wide_normalized_mi": lambda s, d: _rounded(dep.mutual_information(dep.binned_counts(_wide(s, d), list(WIDE))).select("f1", "f2", "nmi")),
        "feature_entropy": lambda s, d: _rounded(dep.entropies(dep.binned_counts(_features(s, d), NAMES, only_own=True))),
        "mutual_information": lambda s, d: _rounded(_mi(s, d).select("f1", "f2", "mi")),
        "normalized_mi": lambda s, d: _rounded(_mi(s, d).select("f1", "f2", "nmi")),
        "unified_dependency": lambda s, d: _rounded(dep.blend(_mi(s, d), _rho(s, d), 0.5, "abs")),
        "signed_dependency": lambda s, d: _rounded(dep.blend(_mi(s, d), _rho(s, d), 0.35, "signed_clip")),
        "dependency_summary": lambda s, d: _rounded(dep.pair_summary(_pairs(s, d))),
        "matrix_summary": lambda s, d: _rounded(dep.matrix_summary(dep.symmetric(_pairs(s, d), NAMES))),
        "top_pairs": lambda s, d: dep.top_pairs(_pairs(s, d), 10),
        "matrix_validation": lambda s, d: dep.matrix_report(dep.symmetric(_pairs(s, d), NAMES)),
        "wide_matrix": lambda s, d: sinks.wide_matrix(dep.symmetric(_pairs(s, d), NAMES), NAMES),
        "long_matrix": lambda s, d: tables.long_matrix(sinks.wide_matrix(dep.symmetric(_pairs(s, d), NAMES), NAMES)),
        "dependency_distance": lambda s, d: _rounded(_distances(s, d)),
        "within_pairs": lambda s, d: bl.within_pairs(_blocks(s), _pairs(s, d)),
        "within_block_stats": lambda s, d: _rounded(bl.within_stats(_blocks(s), _pairs(s, d))),
        "between_block_stats": lambda s, d: _rounded(bl.between_stats(_blocks(s), _pairs(s, d))),
        "block_separation": lambda s, d: _rounded(bl.separation(_blocks(s), _pairs(s, d))),
        "weak_blocks": lambda s, d: _rounded(bl.suspicious(bl.within_stats(_blocks(s), _pairs(s, d))).select("block_id", "block_size", "min_within", "weakest_pair")),
        "weak_pairs": lambda s, d: bl.weak_pairs(s.createDataFrame([(1, n) for n in NAMES[:3]] + [(2, n) for n in NAMES[3:]], "block_id long, feature string"), _pairs(s, d)),
        "labels_to_blocks": lambda s, d: cl.labels_to_blocks(_labelings(s, d), NAMES, ["labeling"]).withColumn("features", F.array_join("features", " | ")),
        "strong_cross_pairs": lambda s, d: bl.between_pairs(_blocks(s), _pairs(s, d)).where("score >= 0.6"),
        "block_sizes": lambda s, d: _rounded(bl.block_sizes(_found_blocks(s, d))),
        "blocks_by_size": lambda s, d: bl.by_size(_found_blocks(s, d)),
        "refined_blocks": _refined,
        "block_whatif": _what_if,
        "block_validation": lambda s, d: bl.validation(_placed_twice(s, d), [*NAMES[:-1], "absent"]),
        "block_lists": lambda s, d: tables.blocks(_listed(s, d)),
        "block_lists_unnumbered": lambda s, d: tables.blocks(_listed(s, d).select("Features")),
        "selected_block": lambda s, d: bl.within_pairs(_found_blocks(s, d), _pairs(s, d)).where("block_id = 1").select("f1", "f2", "score"),
        "checked_blocks": lambda s, d: bl.checked(_found_blocks(s, d), NAMES),
        "silhouette_precomputed": _silhouette,
        "cluster_sizes": lambda s, d: _rounded(cl.cluster_sizes(_labelings(s, d), ["labeling"])),
        "choose_k": lambda s, d: cl.choose_k(_candidates(s, d).select("k", "silhouette", (F.col("k") <= 5).alias("valid"))),
        "alpha_ranking": lambda s, d: cl.rank_candidates(_candidates(s, d)),
        "adjusted_rand": lambda s, d: _rounded(cl.adjusted_rand(_labelings(s, d), "labeling")),
        "ari_stability": lambda s, d: _rounded(cl.stability(cl.adjusted_rand(_labelings(s, d), "labeling"))),
        "hierarchical_blocks": _hierarchical,
        "alpha_sweep": _alpha_sweep,
        "cosine_fingerprints": lambda s, d: _rounded(gr.cosine_similarity(dep.symmetric(_pairs(s, d), NAMES, 0.0))),
        "embedding_cosine": _embedding_cosine,
        "strong_neighbors": lambda s, d: gr.neighbour_counts(_names(s), gr.sparsified(dep.symmetric(_pairs(s, d), NAMES), 0.6)),
        "neighbor_summary": lambda s, d: _rounded(gr.neighbour_summary(gr.neighbour_counts(_names(s), gr.sparsified(dep.symmetric(_pairs(s, d), NAMES), 0.6)))),
        "graph_density": lambda s, d: _rounded(gr.density(_pairs(s, d), len(NAMES), [0.3, 0.6, 0.9])),
        "connected_components": _components,
        "component_report": lambda s, d: gr.component_report(_components(s, d), 2),
        "threshold_blocks": _threshold_blocks,
        "block_masks": _block_masks,
        "mask_integrity": lambda s, d: mk.integrity(_block_masks(s, d)),
        "mask_trials": lambda s, d: _rounded(mk.trial_stats(_block_masks(s, d))),
        "random_masks": _random_masks,
        "mask_lists": lambda s, d: mk.mask_lists(_block_masks(s, d)).withColumn("masked", F.array_join("masked", " | ")),
        "shortcut_analysis": lambda s, d: _rounded(_shortcuts(s, d, _random_sides)),
        "shortcut_comparison": lambda s, d: _rounded(mk.shortcut_comparison(_shortcuts(s, d, _block_sides), _shortcuts(s, d, _random_sides))),
        "masked_batch": _masked_batch,
        "masker_batch": _masker_batch,
    }
    return q


def _multi(s, d):
    out = None
    for table, c in (("events", "event_type"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment")):
        g = pr.category_distribution(_read(s, d, table, [c]), c).withColumn("column", F.lit(c))
        out = g if out is None else out.unionByName(g)
    return out


# SQL ---------------------------------------------------------------------------------------------

X = "x AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in FEATURES.items()) + " FROM lineitem)"


def _each(template: str, names=NUMERIC, glue=" UNION ALL ") -> str:
    return glue.join(template.replace("@", n) for n in names)


def _each_pair(template: str) -> str:
    return " UNION ALL ".join(template.replace("@a", a).replace("@b", b) for a, b in combinations(NAMES, 2))


P = X + ", p AS (" + _each_pair("SELECT '@a' AS f1, '@b' AS f2, round(abs(corr(@a, @b)), 6) AS score FROM x") + ")"
B = "b(block_id, feature) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{f}')" for i, f in BLOCKS) + ")"
PLACED = f"{P}, {B}, pl AS (SELECT b1.block_id AS block_1, b2.block_id AS block_2, f1, f2, score FROM p JOIN b b1 ON b1.feature = f1 JOIN b b2 ON b2.feature = f2)"
N = "names(feature) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ")"
#: Components of the features at each level (l); wants WITH RECURSIVE, and P and N before it.
L = (
    "lv(labeling, t) AS (VALUES " + ", ".join(f"('{k}', {t}::DOUBLE)" for k, t in LEVELS.items()) + "), le AS (SELECT labeling, f1 AS a, f2 AS b FROM p JOIN lv ON score >= t UNION ALL SELECT labeling, f2, f1 FROM p JOIN lv ON score >= t), "
    "lg(labeling, feature, c) AS (SELECT labeling, feature, feature FROM lv, names UNION SELECT lg.labeling, le.b, lg.c FROM lg JOIN le ON le.a = lg.feature AND le.labeling = lg.labeling WHERE lg.c < le.b), "
    "l AS (SELECT labeling, feature, dense_rank() OVER (PARTITION BY labeling ORDER BY c) AS label FROM (SELECT labeling, feature, min(c) AS c FROM lg GROUP BY ALL))"
)
#: The blocks of one level (b).
FOUND = f"{P}, {N}, {L}, b AS (SELECT label AS block_id, feature FROM l WHERE labeling = '{BLOCKS_AT}')"
M = P + ", " + N + ", m AS (SELECT f1, f2, score FROM p UNION ALL SELECT f2, f1, score FROM p UNION ALL SELECT feature, feature, 1.0::DOUBLE FROM names)"
D = M + ", dist AS (SELECT f1, f2, CASE WHEN f1 = f2 THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, 1 - score)) END AS distance FROM m)"
RANKS = X + ", r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE AS {n}" for n in NAMES) + " FROM x)"
RHO = RANKS + ", rho AS (" + _each_pair("SELECT '@a' AS f1, '@b' AS f2, corr(@a, @b) AS score FROM r") + ")"
_EDGES = ", ".join(f"list_distinct(quantile_cont({n}, [{', '.join(f'{i}/32.0' for i in range(33))}])) AS {n}_q, count(DISTINCT {n}) AS {n}_d, list_sort(list(DISTINCT {n})) AS {n}_v" for n in NAMES)
CODES = X + f", e AS (SELECT {_EDGES} FROM x), c AS (SELECT " + ", ".join(f"CASE WHEN {n}_d <= 32 THEN len(list_filter({n}_v, lambda v: v < {n})) ELSE len(list_filter(list_sort({n}_q)[2:-2], lambda v: v < {n})) END AS {n}" for n in NAMES) + " FROM x, e)"
ENT = CODES + ", h AS (" + _each("SELECT '@' AS feature, -sum(n / t * ln(n / t + 1e-12)) AS entropy FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM c GROUP BY @)", NAMES) + ")"
MI = ENT + ", mi AS (" + _each_pair("SELECT '@a' AS f1, '@b' AS f2, sum(n / t * ln(n * t / (na * nb))) AS mi FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t, sum(count(*)) OVER (PARTITION BY @a)::DOUBLE AS na, sum(count(*)) OVER (PARTITION BY @b)::DOUBLE AS nb FROM c GROUP BY @a, @b)") + "), nmi AS (SELECT f1, f2, mi, CASE WHEN h1.entropy * h2.entropy > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, mi / sqrt(h1.entropy * h2.entropy))) ELSE 0 END AS nmi FROM mi JOIN h h1 ON h1.feature = f1 JOIN h h2 ON h2.feature = f2)"
BLEND = MI + ", r AS " + RHO.split(", r AS ", 1)[1]
SPLIT = "s AS (SELECT *, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events), z AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM s)"
SEP = "avg(score) FILTER (block_1 = block_2) AS mean_within, avg(score) FILTER (block_1 <> block_2) AS mean_between, min(score) FILTER (block_1 = block_2) AS min_within, max(score) FILTER (block_1 <> block_2) AS max_between, count(*) FILTER (block_1 = block_2) AS n_within, count(*) FILTER (block_1 <> block_2) AS n_between"
SEP_R = "SELECT {by}round(mean_within, 6) AS mean_within, round(mean_between, 6) AS mean_between, min_within, max_between, n_within, n_between, round(mean_within / mean_between, 6) AS ratio"
RANDOM = f"t AS (SELECT c_custkey AS trial FROM customer), rm AS (SELECT trial, feature, row_number() OVER (PARTITION BY trial ORDER BY ('0x' || substr(md5(trial || '|' || feature), 1, 8))::BIGINT, feature) <= {mk.mask_size(len(NAMES), RATIO)} AS masked FROM t, names)"


def _blocked(trials: str = "SELECT c_custkey AS trial FROM customer") -> str:
    """Whole-block masks (bm): the sums reached block by block, in a recursive query. Wants names bt, sz, o, dp and ch to be free."""
    total, target = len(NAMES), mk.mask_size(len(NAMES), RATIO)
    return f"""{FOUND}, bt AS ({trials}), sz AS (SELECT block_id, count(*)::INTEGER AS size FROM b GROUP BY block_id),
o AS (SELECT trial, block_id, size, row_number() OVER (PARTITION BY trial ORDER BY ('0x' || substr(md5(trial || '|' || block_id), 1, 8))::BIGINT, block_id) AS pos FROM bt, sz),
dp(trial, step, s, path) AS (SELECT trial, 0::BIGINT, 0, []::BIGINT[] FROM bt UNION ALL SELECT trial, step + 1, s, arg_min(path, taken) FROM (
  SELECT dp.trial, dp.step, dp.s + k.taken * o.size AS s, CASE WHEN k.taken = 1 THEN list_append(dp.path, o.block_id) ELSE dp.path END AS path, k.taken AS taken
  FROM dp JOIN o ON o.trial = dp.trial AND o.pos = dp.step + 1, (VALUES (0), (1)) AS k(taken)) WHERE s < {total} GROUP BY trial, step, s),
ch AS (SELECT trial, arg_min(path, abs(s - {target}) * 1000 + s) AS chosen FROM dp WHERE step = (SELECT count(*) FROM sz) GROUP BY trial),
bm AS (SELECT trial, block_id, feature, list_contains(chosen, block_id) AS masked FROM ch, b)"""


#: Clusterings at each level as candidates (c).
CANDIDATES = f"""{D}, {L}, s AS (SELECT a.labeling, f1, a.label AS own, b.label, avg(distance) AS d FROM dist JOIN l a ON a.feature = f1 JOIN l b ON b.feature = f2 AND b.labeling = a.labeling WHERE f1 <> f2 GROUP BY ALL),
ab AS (SELECT labeling, f1, max(d) FILTER (own = label) AS a, min(d) FILTER (own <> label) AS b FROM s GROUP BY labeling, f1),
si AS (SELECT labeling, avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS silhouette FROM ab GROUP BY labeling),
sz AS (SELECT labeling, count(DISTINCT label) AS k, count(*) AS n FROM l GROUP BY labeling),
pl AS (SELECT x.labeling, x.label AS block_1, y.label AS block_2, score FROM p JOIN l x ON x.feature = f1 JOIN l y ON y.feature = f2 AND y.labeling = x.labeling),
sp AS (SELECT labeling, {SEP} FROM pl GROUP BY labeling),
c AS (SELECT t AS alpha, k, CASE WHEN k >= 2 AND k < n THEN round(silhouette, 6) END AS silhouette, round(mean_within / mean_between, 6) AS ratio FROM lv JOIN sz USING (labeling) JOIN si USING (labeling) JOIN sp USING (labeling))"""
CHUNKS = f"ch AS (SELECT *, (row_number() OVER () - 1) // {CHUNK_ROWS} AS chunk FROM lineitem)"
EDGES = "ed AS (SELECT f1 AS feature, f2 AS partner FROM p WHERE score >= 0.7 UNION ALL SELECT f2, f1 FROM p WHERE score >= 0.7)"
HIT = "SELECT m.trial, m.feature, count(v.feature) AS n FROM {m} m LEFT JOIN ed ON ed.feature = m.feature LEFT JOIN {m} v ON v.trial = m.trial AND v.feature = ed.partner AND NOT v.masked WHERE m.masked GROUP BY ALL"
CUSTOMER = ["c_acctbal", "c_nationkey"]
AUDIT = _each("SELECT '@' AS feature, round(min(@)::DOUBLE, 6) AS minimum, round(max(@)::DOUBLE, 6) AS maximum, count(*) FILTER (@ IS NULL) AS missing, count(*) FILTER (@ IS NULL OR isinf(@::DOUBLE)) AS nonfinite, count(*) FILTER (isinf(@::DOUBLE)) AS infinite, count(*) FILTER (@ < 0) AS negative FROM customer", CUSTOMER)
QS = [f"q{100 * q:g}".replace(".", "_") for q in pr.QUANTILES]


W = list(WIDE)
WX = "x AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in WIDE.items()) + " FROM lineitem)"


def _wide_pairs(table: str) -> str:
    """Correlations of all pairs of wide features, as lists that are unnested side by side."""
    pairs = list(combinations(W, 2))
    names = lambda k: "[" + ", ".join(f"'{p[k]}'" for p in pairs) + "]"
    return f"SELECT unnest({names(0)}) AS f1, unnest({names(1)}) AS f2, round(unnest([" + ", ".join(f"corr({a}, {b})" for a, b in pairs) + f"]), 6) AS score FROM {table}"


WIDE_RANKS = WX + ", r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE AS {n}" for n in W) + " FROM x)"
WIDE_MI = (
    WX + ", lo AS (SELECT i, f, v, r FROM (SELECT row_number() OVER () AS r, * FROM x) UNPIVOT (v FOR f IN (" + ", ".join(W) + ")) JOIN (SELECT unnest([" + ", ".join(f"'{n}'" for n in W) + f"]) AS f, unnest(range({len(W)})) AS i) USING (f)), "
    f"e AS (SELECT f, CASE WHEN count(DISTINCT v) <= 32 THEN list_sort(list(DISTINCT v)) ELSE list_sort(list_distinct(quantile_cont(v, [{', '.join(f'{i}/32.0' for i in range(33))}])))[2:-2] END AS inner_ FROM lo GROUP BY f), "
    "c AS (SELECT i, f, r, len(list_filter(inner_, lambda y: y < v)) AS code FROM lo JOIN e USING (f)), "
    "h AS (SELECT f, -sum(n / t * ln(n / t + 1e-12)) AS entropy FROM (SELECT f, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY f)::DOUBLE AS t FROM c GROUP BY f, code) GROUP BY f), "
    "j AS (SELECT a.f AS f1, b.f AS f2, a.code AS c1, b.code AS c2, count(*)::DOUBLE AS n FROM c a JOIN c b ON a.r = b.r AND a.i < b.i GROUP BY ALL), "
    "mi AS (SELECT f1, f2, sum(n / t * ln(n * t / (na * nb))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY f1, f2) AS t, sum(n) OVER (PARTITION BY f1, f2, c1) AS na, sum(n) OVER (PARTITION BY f1, f2, c2) AS nb FROM j) GROUP BY f1, f2)"
)


def oracle_sql():
    pct = lambda c, t: f"SELECT {c}::VARCHAR AS value, count(*) AS cnt, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {t} GROUP BY {c}"
    comps = f"{P}, {N}, e AS (SELECT f1 AS a, f2 AS b FROM p WHERE score >= {COMPONENTS_AT} UNION ALL SELECT f2, f1 FROM p WHERE score >= {COMPONENTS_AT}), g(feature, c) AS (SELECT feature, feature FROM names UNION SELECT e.b, g.c FROM g JOIN e ON e.a = g.feature WHERE g.c < e.b), comp AS (SELECT feature, min(c) AS component FROM g GROUP BY feature)"
    shortcut = f"{P}, {N}, {RANDOM}, {EDGES}, hit AS ({HIT.format(m='rm')})"
    both = f"{_blocked()}, {RANDOM}, {EDGES}, hr AS ({HIT.format(m='rm')}), hb AS ({HIT.format(m='bm')}), r AS (SELECT 'random' AS kind, trial, count(*) FILTER (n > 0) / count(*)::DOUBLE AS rate FROM hr GROUP BY trial UNION ALL SELECT 'block', trial, count(*) FILTER (n > 0) / count(*)::DOUBLE FROM hb GROUP BY trial), st AS (SELECT avg(rate) FILTER (kind = 'block') AS block_rate, stddev_pop(rate) FILTER (kind = 'block') AS block_std, avg(rate) FILTER (kind = 'random') AS random_rate, stddev_pop(rate) FILTER (kind = 'random') AS random_std FROM r)"
    ari = f"{P}, {N}, {L}, cells AS (SELECT a.labeling AS a, b.labeling AS b, a.label AS la, b.label AS lb, count(*) AS n FROM l a JOIN l b ON a.feature = b.feature AND a.labeling < b.labeling GROUP BY ALL), i AS (SELECT a, b, sum(n * (n - 1) / 2.0::DOUBLE) AS both_in, sum(n)::DOUBLE AS n FROM cells GROUP BY a, b), sa AS (SELECT a, b, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT a, b, la, sum(n) AS n FROM cells GROUP BY a, b, la) GROUP BY a, b), sb AS (SELECT a, b, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT a, b, lb, sum(n) AS n FROM cells GROUP BY a, b, lb) GROUP BY a, b), ari AS (SELECT a, b, coalesce((both_in - sa.s * sb.s / (n * (n - 1) / 2)) / nullif((sa.s + sb.s) / 2 - sa.s * sb.s / (n * (n - 1) / 2), 0), 1) AS ari FROM i JOIN sa USING (a, b) JOIN sb USING (a, b))"
    return {
        "category_distribution": pct("l_returnflag", "lineitem"),
        "multi_category_distribution": " UNION ALL ".join(f"SELECT *, '{c}' AS \"column\" FROM ({pct(c, t)})" for t, c in (("events", "event_type"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"))),
        "null_audit": "WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) " + _each("SELECT count(*) AS rows, '@' AS feature, count(*) FILTER (@ IS NULL) AS missing FROM j", ["doc_id", "lang", "quality", "toxic"]),
        "duplicate_rows": "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT sum(n)::BIGINT AS total_rows, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM g",
        "numeric_moments": _each("SELECT '@' AS feature, count(@) AS n, round(sum(@), 2) AS total, round(sum(@::DECIMAL(18,6))::DOUBLE / count(@), 9) AS mean, round(stddev_pop(@), 6) AS std, round(min(@), 6) AS minimum, round(max(@), 6) AS maximum FROM lineitem"),
        "value_audit": AUDIT,
        "attention_features": f"SELECT * FROM ({AUDIT}) WHERE missing > 0 OR nonfinite > 0 OR negative > 0",
        "threshold_counts": " UNION ALL ".join(f"SELECT '{c}' AS feature, {t}::DOUBLE AS threshold, count(*) FILTER ({c} > {t}) AS above, round(100.0::DOUBLE * count(*) FILTER ({c} > {t}) / count({c}), 6) AS pct FROM lineitem" for c, t in (("l_extendedprice", 1000.0), ("l_extendedprice", 50000.0), ("l_extendedprice", 90000.0), ("l_quantity", 25.0))),
        "top_extremes": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS value FROM lineitem ORDER BY value DESC, l_orderkey, l_linenumber, l_partkey LIMIT 15",
        "suspicious_examples": "SELECT event_id, user_id, value FROM events WHERE value > 90 ORDER BY event_id, user_id LIMIT 10",
        "suspicious_by_source": "SELECT event_type AS value, count(*) AS cnt FROM events WHERE value > 50 GROUP BY event_type",
        "feature_profile": _each("SELECT '@' AS feature, round(min(@), 6) AS minimum, round(max(@), 6) AS maximum, count(*) FILTER (@ IS NULL) AS missing, count(*) FILTER (@ IS NULL OR isinf(@)) AS nonfinite, count(*) FILTER (isinf(@)) AS infinite, count(*) FILTER (@ < 0) AS negative, CASE WHEN max(abs(@)) < 1e12 THEN round(avg(@), 6) END AS mean, CASE WHEN max(abs(@)) < 1e12 THEN round(stddev_pop(@), 6) END AS std, " + ", ".join(f"round(quantile_cont(@, {q}), 6) AS {n}" for q, n in zip(pr.QUANTILES, QS, strict=True)) + " FROM lineitem"),
        "hygiene_dropna": "SELECT doc_id, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL",
        "drop_identity": "SELECT s_suppkey, s_acctbal FROM supplier",
        "key_hash_split": f"WITH {SPLIT} SELECT split, count(*) AS cnt, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM z GROUP BY split",
        "split_comparison": f"WITH {SPLIT} SELECT event_type AS value, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM z GROUP BY event_type",
        "train_medians": _each("SELECT '@' AS feature, round(median(@), 6) AS median FROM lineitem"),
        "medians_without_artifacts": _each("SELECT '@' AS feature, round(median(@), 6) AS median FROM lineitem WHERE '@' <> 'l_extendedprice' OR l_extendedprice <= 90000"),
        "clean_features": "SELECT count(*) AS n, round(sum(ln(1 + l_quantity)), 2) AS sum_l_quantity, round(sum(ln(1 + CASE WHEN l_extendedprice > 90000 THEN (SELECT median(l_extendedprice) FROM lineitem) ELSE l_extendedprice END)), 2) AS sum_l_extendedprice, round(sum(l_discount), 2) AS sum_l_discount, round(sum(l_tax), 2) AS sum_l_tax FROM lineitem",
        "robust_scaler": _each("SELECT '@' AS feature, round(median(@), 6) AS center, round(CASE WHEN quantile_cont(@, 0.75) = quantile_cont(@, 0.25) THEN 1 ELSE quantile_cont(@, 0.75) - quantile_cont(@, 0.25) END, 6) AS scale FROM lineitem"),
        "robust_scale": _each("SELECT '@' AS feature, round((min(@) - median(@)) / (quantile_cont(@, 0.75) - quantile_cont(@, 0.25)), 6) AS minimum, round((max(@) - median(@)) / (quantile_cont(@, 0.75) - quantile_cont(@, 0.25)), 6) AS maximum, round((avg(@) - median(@)) / (quantile_cont(@, 0.75) - quantile_cont(@, 0.25)), 4) AS mean FROM lineitem"),
        "tail_thresholds": " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(l_extendedprice + l_extendedprice * l_tax, {q}), 6) AS threshold FROM lineitem" for q in (0.9, 0.95, 0.975, 0.99)),
        "feature_rules": " UNION ALL ".join(f"SELECT '{n}' AS feature, {n == 'l_extendedprice'} AS is_log1p, {'(SELECT round(quantile_cont(l_extendedprice, 0.99), 6) FROM lineitem)' if n in ARTIFACTS else 'NULL'}::DOUBLE AS artifact_threshold" for n in NUMERIC),
        "hash_sample": "SELECT event_id, event_type FROM events ORDER BY ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT, event_id LIMIT 100",
        "spearman_pairs": f"WITH {RHO} SELECT f1, f2, round(score, 6) AS score FROM rho",
        "wide_correlations": f"WITH {WX} {_wide_pairs('x')}",
        "wide_spearman": f"WITH {WIDE_RANKS} {_wide_pairs('r')}",
        "wide_normalized_mi": f"WITH {WIDE_MI} SELECT f1, f2, round(CASE WHEN x.entropy * y.entropy > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, mi / sqrt(x.entropy * y.entropy))) ELSE 0 END, 6) AS nmi FROM mi JOIN h x ON x.f = f1 JOIN h y ON y.f = f2",
        "feature_entropy": f"WITH {ENT} SELECT feature, round(entropy, 6) AS entropy FROM h",
        "mutual_information": f"WITH {MI} SELECT f1, f2, round(mi, 6) AS mi FROM mi",
        "normalized_mi": f"WITH {MI} SELECT f1, f2, round(nmi, 6) AS nmi FROM nmi",
        "unified_dependency": f"WITH {BLEND} SELECT f1, f2, round(0.5::DOUBLE * nmi + 0.5::DOUBLE * abs(coalesce(score, 0)), 6) AS score FROM nmi JOIN rho USING (f1, f2)",
        "signed_dependency": f"WITH {BLEND} SELECT f1, f2, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.35::DOUBLE * nmi + 0.65::DOUBLE * coalesce(score, 0))), 6) AS score FROM nmi JOIN rho USING (f1, f2)",
        "dependency_summary": f"WITH {P} " + " UNION ALL ".join([f"SELECT 'q{100 * q:g}' AS measure, round(quantile_cont(score, {q}), 6) AS value FROM p" for q in (0.5, 0.75, 0.9, 0.95, 0.99)] + [f"SELECT 'pairs_from_{t:g}', count(*) FILTER (score >= {t})::DOUBLE FROM p" for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)]),
        "top_pairs": f"WITH {P} SELECT f1, f2, score FROM p ORDER BY score DESC, f1, f2 LIMIT 10",
        "matrix_validation": f"WITH {M} SELECT count(*) AS cells, count(DISTINCT f1) AS features, count(*) = count(DISTINCT f1) * count(DISTINCT f1) AS is_square, (SELECT max(abs(a.score - b.score)) <= 1e-8 FROM m a JOIN m b ON a.f1 = b.f2 AND a.f2 = b.f1) AS is_symmetric, max(CASE WHEN f1 = f2 THEN abs(score - 1) ELSE 0 END) <= 1e-8 AS has_unit_diagonal, bool_and(score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)) AS is_finite FROM m",
        "wide_matrix": f"WITH {M} SELECT f1, " + ", ".join(f"max(score) FILTER (f2 = '{n}') AS {n}" for n in NAMES) + " FROM m GROUP BY f1",
        "long_matrix": f"WITH {M} SELECT f1, f2, score FROM m",
        "dependency_distance": f"WITH {D} SELECT f1, f2, round(distance, 6) AS distance FROM dist",
        "within_pairs": f"WITH {PLACED} SELECT block_1 AS block_id, f1, f2, score FROM pl WHERE block_1 = block_2",
        "within_block_stats": f"WITH {PLACED}, st AS (SELECT block_1 AS block_id, round(avg(score), 6) AS mean_within, min(score) AS min_within, max(score) AS max_within, round(stddev_pop(score), 6) AS std_within, arg_min(f1 || ' <-> ' || f2, {{'s': score, 'a': f1, 'b': f2}}) AS weakest_pair FROM pl WHERE block_1 = block_2 GROUP BY block_1), sz AS (SELECT block_id, count(*) AS block_size, string_agg(feature, ' | ' ORDER BY feature) AS features FROM b GROUP BY block_id) SELECT sz.*, mean_within, min_within, max_within, std_within, weakest_pair FROM sz LEFT JOIN st USING (block_id)",
        "between_block_stats": f"WITH {PLACED} SELECT least(block_1, block_2) AS block_a, greatest(block_1, block_2) AS block_b, round(avg(score), 6) AS mean_between, max(score) AS max_between, min(score) AS min_between, count(*) AS n_pairs FROM pl WHERE block_1 <> block_2 GROUP BY ALL",
        "block_separation": f"WITH {PLACED}, s AS (SELECT {SEP} FROM pl) {SEP_R.format(by='')} FROM s",
        "weak_blocks": f"WITH {PLACED} SELECT block_1 AS block_id, (SELECT count(*) FROM b WHERE b.block_id = block_1) AS block_size, min(score) AS min_within, arg_min(f1 || ' <-> ' || f2, {{'s': score, 'a': f1, 'b': f2}}) AS weakest_pair FROM pl WHERE block_1 = block_2 GROUP BY block_1 HAVING min(score) < 0.4",
        "strong_cross_pairs": f"WITH {PLACED} SELECT least(block_1, block_2) AS block_a, greatest(block_1, block_2) AS block_b, f1, f2, score FROM pl WHERE block_1 <> block_2 AND score >= 0.6",
        "block_sizes": f"WITH RECURSIVE {FOUND}, s AS (SELECT block_id, count(*) AS size FROM b GROUP BY block_id) SELECT count(*) AS n_blocks, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, count(*) FILTER (size = 1) AS n_singletons FROM s",
        "blocks_by_size": f"WITH RECURSIVE {FOUND}, g AS (SELECT block_id AS original, count(*) AS size, min(feature) AS first FROM b GROUP BY block_id), i AS (SELECT original, size, row_number() OVER (ORDER BY size DESC, first) AS block_id FROM g) SELECT i.block_id, original, size, feature FROM i JOIN b ON b.block_id = original",
        "refined_blocks": f"WITH RECURSIVE {FOUND}, e AS (SELECT block_id AS original, CASE WHEN feature IN ('price', 'neg_price') THEN 1 WHEN block_id IN (SELECT block_id FROM b WHERE feature IN ('price', 'neg_price')) THEN 2 ELSE 1 END AS part, feature FROM b) SELECT dense_rank() OVER (ORDER BY original, part) AS block_id, original, feature FROM e",
        "block_whatif": f"WITH {P}, {B}, c AS (SELECT 'as_is' AS config, block_id, feature FROM b UNION ALL SELECT 'moved', CASE WHEN feature = 'tax_amt' THEN 3 ELSE block_id END, feature FROM b), pl AS (SELECT c1.config, c1.block_id AS block_1, c2.block_id AS block_2, score FROM p JOIN c c1 ON c1.feature = f1 JOIN c c2 ON c2.feature = f2 AND c2.config = c1.config), s AS (SELECT config, {SEP} FROM pl GROUP BY config) {SEP_R.format(by='config, ')} FROM s",
        "block_validation": f"WITH RECURSIVE {FOUND}, b2 AS (SELECT * FROM b UNION ALL SELECT block_id + 100, feature FROM b WHERE feature = 'quantity'), w(feature) AS (VALUES " + ", ".join(f"('{n}')" for n in [*NAMES[:-1], "absent"]) + ") SELECT 'missing' AS problem, feature FROM w WHERE feature NOT IN (SELECT feature FROM b2) UNION ALL SELECT 'unexpected', feature FROM b2 WHERE feature NOT IN (SELECT feature FROM w) GROUP BY feature UNION ALL SELECT 'repeated', feature FROM b2 GROUP BY feature HAVING count(*) > 1",
        "block_lists": f"WITH RECURSIVE {FOUND} SELECT block_id, feature, (row_number() OVER (PARTITION BY block_id ORDER BY feature) - 1)::INTEGER AS position FROM b",
        "block_lists_unnumbered": f"WITH RECURSIVE {FOUND}, ls AS (SELECT string_agg(feature, ' | ' ORDER BY feature) AS f FROM b GROUP BY block_id), nu AS (SELECT row_number() OVER (ORDER BY f) AS block_id, string_split(f, ' | ') AS fs FROM ls) SELECT block_id, unnest(fs) AS feature, (unnest(range(len(fs))))::INTEGER AS position FROM nu",
        "selected_block": f"WITH RECURSIVE {FOUND} SELECT f1, f2, score FROM p JOIN b x ON x.feature = f1 JOIN b y ON y.feature = f2 WHERE x.block_id = 1 AND y.block_id = 1",
        "checked_blocks": f"WITH RECURSIVE {FOUND} SELECT block_id, feature FROM b",
        "silhouette_precomputed": f"WITH RECURSIVE {D}, {L}, s AS (SELECT a.labeling, f1, a.label AS own, b.label, avg(distance) AS d FROM dist JOIN l a ON a.feature = f1 JOIN l b ON b.feature = f2 AND b.labeling = a.labeling WHERE f1 <> f2 GROUP BY ALL), ab AS (SELECT labeling, f1, max(d) FILTER (own = label) AS a, min(d) FILTER (own <> label) AS b FROM s GROUP BY labeling, f1) SELECT labeling, round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM ab GROUP BY labeling",
        "cluster_sizes": f"WITH RECURSIVE {P}, {N}, {L}, s AS (SELECT labeling, label, count(*) AS size FROM l GROUP BY ALL) SELECT labeling, count(*) AS n_clusters, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size FROM s GROUP BY labeling",
        "choose_k": f"WITH RECURSIVE {CANDIDATES} SELECT k, silhouette, k <= 5 AS valid FROM c ORDER BY valid DESC, silhouette DESC NULLS LAST, k LIMIT 1",
        "alpha_ranking": f"WITH RECURSIVE {CANDIDATES}, r AS (SELECT *, rank() OVER (ORDER BY silhouette DESC NULLS LAST)::INTEGER AS rank_silhouette, rank() OVER (ORDER BY ratio DESC NULLS LAST)::INTEGER AS rank_ratio FROM c) SELECT *, rank_silhouette + rank_ratio AS combined_rank FROM r",
        "repeated_rows": "SELECT total_rows, distinct_rows, total_rows - distinct_rows AS duplicate_rows FROM (SELECT count(*) AS total_rows FROM lineitem), (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM lineitem))",
        "chunk_duplicates": f"WITH {CHUNKS}, g AS (SELECT chunk, count(*) AS n FROM ch GROUP BY chunk, l_partkey, l_quantity) SELECT chunk, sum(n)::BIGINT AS total_rows, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM g GROUP BY chunk",
        "chunk_samples": f"WITH {CHUNKS} SELECT chunk, l_orderkey, l_linenumber, l_quantity FROM ch QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY ('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT, l_orderkey, l_linenumber) <= {CHUNK_KEEP}",
        "capped_sample": f"WITH {CHUNKS}, sm AS (SELECT l_orderkey, l_linenumber, l_quantity FROM ch QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY ('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT, l_orderkey, l_linenumber) <= {CHUNK_KEEP}) SELECT * FROM sm ORDER BY ('0x' || substr(md5(l_linenumber || '|' || l_orderkey), 1, 8))::BIGINT, l_linenumber, l_orderkey LIMIT 100",
        "observed_hygiene": "WITH j AS (SELECT doc_id, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT count(*) FILTER (doc_id IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL) AS after, count(*) AS before, before - after AS removed, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("doc_id", "source", "n_chars", "quality", "toxic")) + " FROM j",
        "adjusted_rand": f"WITH RECURSIVE {ari} SELECT a, b, round(ari, 6) AS ari FROM ari",
        "ari_stability": f"WITH RECURSIVE {ari}, u AS (SELECT a AS labeling, ari FROM ari UNION ALL SELECT b, ari FROM ari) SELECT labeling, round(avg(ari), 6) AS mean_ari, round(min(ari), 6) AS min_ari, round(max(ari), 6) AS max_ari, count(*) AS n FROM u GROUP BY labeling",
        "cosine_fingerprints": f"WITH {M}, m0 AS (SELECT f1, f2, CASE WHEN f1 = f2 THEN 0 ELSE score END AS s FROM m), n AS (SELECT f1, sqrt(sum(s * s)) AS n FROM m0 GROUP BY f1) SELECT a.f1, b.f1 AS f2, round(greatest(0::DOUBLE, least(1::DOUBLE, sum(a.s * b.s) / any_value(na.n * nb.n))), 6) AS score FROM m0 a JOIN m0 b ON a.f2 = b.f2 AND a.f1 < b.f1 JOIN n na ON na.f1 = a.f1 JOIN n nb ON nb.f1 = b.f1 GROUP BY a.f1, b.f1",
        "embedding_cosine": "WITH u AS (SELECT label::VARCHAR AS f1, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT f1, pos, avg(x) AS s FROM u GROUP BY ALL), n AS (SELECT f1, sqrt(sum(s * s)) AS n FROM c GROUP BY f1) SELECT a.f1, b.f1 AS f2, round(greatest(0::DOUBLE, least(1::DOUBLE, sum(a.s * b.s) / any_value(na.n * nb.n))), 6) AS score FROM c a JOIN c b ON a.pos = b.pos AND a.f1 < b.f1 JOIN n na ON na.f1 = a.f1 JOIN n nb ON nb.f1 = b.f1 GROUP BY a.f1, b.f1",
        "strong_neighbors": f"WITH {M} SELECT feature, count(f2) AS n_neighbours FROM names LEFT JOIN m ON f1 = feature AND f1 <> f2 AND score >= 0.6 GROUP BY feature",
        "graph_density": f"WITH {P} " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (score >= {t}) AS edges, round(count(*) FILTER (score >= {t}) / {len(NAMES) * (len(NAMES) - 1) // 2}::DOUBLE, 6) AS density FROM p" for t in (0.3, 0.6, 0.9)),
        "connected_components": f"WITH RECURSIVE {comps} SELECT feature, component FROM comp",
        "component_report": f"WITH RECURSIVE {comps}, s AS (SELECT count(*) AS size FROM comp GROUP BY component) SELECT count(*) AS components, max(size) AS largest, count(*) FILTER (size <= 2) AS small_components FROM s",
        "threshold_blocks": f"WITH RECURSIVE {comps}, pl AS (SELECT c1.component AS block_1, c2.component AS block_2, score FROM p JOIN comp c1 ON c1.feature = f1 JOIN comp c2 ON c2.feature = f2), s AS (SELECT {SEP} FROM pl) {SEP_R.format(by='')} FROM s",
        "block_masks": f"WITH RECURSIVE {_blocked()} SELECT * FROM bm",
        "mask_lists": f"WITH RECURSIVE {_blocked()} SELECT trial, coalesce(string_agg(feature, ' | ' ORDER BY feature) FILTER (masked), '') AS masked FROM bm GROUP BY trial",
        "mask_integrity": f"WITH RECURSIVE {_blocked()}, g AS (SELECT trial, block_id, bool_and(masked) AS every_, bool_or(masked) AS some_ FROM bm GROUP BY ALL) SELECT trial, count(*) FILTER (every_) AS masked_blocks, count(*) FILTER (some_ AND NOT every_) AS violations FROM g GROUP BY trial",
        "mask_trials": f"WITH RECURSIVE {_blocked()}, g AS (SELECT trial, count(DISTINCT block_id) FILTER (masked) AS b, count(*) FILTER (masked) / count(*)::DOUBLE AS r FROM bm GROUP BY trial) SELECT count(*) AS trials, " + ", ".join(f"round({f}({x}), 6) AS {n}_{c}" if f in ("avg", "stddev_pop") or x == "r" else f"{f}({x}) AS {n}_{c}" for x, c in (("r", "masked_ratio"), ("b", "masked_blocks")) for f, n in (("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev_pop", "std"))) + ", (SELECT count(*) FROM (SELECT trial, block_id FROM bm GROUP BY ALL HAVING bool_or(masked) AND NOT bool_and(masked))) AS violations FROM g",
        "shortcut_comparison": f"WITH RECURSIVE {both} SELECT round(block_rate, 6) AS block_rate, round(block_std, 6) AS block_std, round(random_rate, 6) AS random_rate, round(random_std, 6) AS random_std, round((random_rate - block_rate) * 100 / nullif(random_rate, 0), 6) AS reduction_pct FROM st",
        "stratified_split": "WITH s AS (SELECT event_type, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT AS u, ('0x' || substr(md5(event_id::VARCHAR), 9, 8))::BIGINT % greatest(1, (SELECT (count(*) + 65535) // 65536 FROM events)) AS slot, event_id FROM events), r AS (SELECT percent_rank() OVER (PARTITION BY event_type, slot ORDER BY u, event_id) AS rate FROM s) SELECT CASE WHEN rate < 0.7 THEN 'train' WHEN rate < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS cnt FROM r GROUP BY ALL",
        "csv_round_trip": "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier",
        "split_round_trip": f"WITH {SPLIT} SELECT split, count(*) AS cnt, sum(event_id)::BIGINT AS ids FROM z GROUP BY split",
        "matrix_round_trip": f"WITH {M} SELECT f1, f2, score FROM m",
        "scaler_round_trip": _each("SELECT '@' AS feature, round((min(@) - median(@)) / (quantile_cont(@, 0.75) - quantile_cont(@, 0.25)), 6) AS minimum, round((max(@) - median(@)) / (quantile_cont(@, 0.75) - quantile_cont(@, 0.25)), 6) AS maximum FROM lineitem"),
        "clipped_log": "SELECT count(c_acctbal) AS n, min(ln(1 + greatest(c_acctbal, 0))) AS minimum, round(max(ln(1 + greatest(c_acctbal, 0))), 6) AS maximum, round(sum(ln(1 + greatest(c_acctbal, 0))), 3) AS total FROM customer",
        "equal_width_bins": f"WITH {X}, e AS (" + _each("SELECT '@' AS feature, list_transform(range(1, 32), lambda i: min(@) + (max(@) - min(@)) * i / 32.0::DOUBLE) AS inner_ FROM x", ["quantity", "price"]) + "), v AS (" + _each("SELECT '@' AS feature, @ AS v FROM x", ["quantity", "price"]) + ") SELECT feature, len(list_filter(inner_, lambda y: y < v))::INTEGER AS code, count(*) AS n FROM v JOIN e USING (feature) GROUP BY ALL",
        "label_layouts": f"WITH RECURSIVE {FOUND} SELECT feature, block_id AS label, layout FROM b, (VALUES ('lists'), ('rows')) AS t(layout)",
        "feature_columns": "SELECT row_number() OVER (ORDER BY column_index) - 1 AS position, column_name AS feature FROM (SELECT * FROM duckdb_columns() WHERE table_name = 'documents') WHERE column_name NOT IN ('doc_id', 'lang', 'source')",
        "table_header": "SELECT row_number() OVER (ORDER BY column_index) - 1 AS position, column_name AS feature FROM duckdb_columns() WHERE table_name = 'supplier'",
        "matrix_summary": f"WITH {M} SELECT min(score) AS minimum, max(score) AS maximum, round(avg(score), 6) AS mean FROM m",
        "weak_pairs": f"WITH {P} SELECT CASE WHEN f1 IN ({', '.join(repr(n) for n in NAMES[:3])}) THEN 1 ELSE 2 END::BIGINT AS block_id, f1, f2, score FROM p WHERE (f1 IN ({', '.join(repr(n) for n in NAMES[:3])})) = (f2 IN ({', '.join(repr(n) for n in NAMES[:3])})) AND score < 0.5",
        "labels_to_blocks": f"WITH RECURSIVE {P}, {N}, {L}, o(feature, pos) AS (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(NAMES)) + ") SELECT labeling, dense_rank() OVER (PARTITION BY labeling ORDER BY label) AS block_id, string_agg(feature, ' | ' ORDER BY pos) AS features FROM l JOIN o USING (feature) GROUP BY labeling, label",
        "neighbor_summary": f"WITH {M}, c AS (SELECT feature, count(f2) AS n FROM names LEFT JOIN m ON f1 = feature AND f1 <> f2 AND score >= 0.6 GROUP BY feature) SELECT min(n) AS minimum, round(median(n), 6) AS median, round(avg(n), 6) AS mean, max(n) AS maximum FROM c",
        "masker_batch": f"WITH RECURSIVE {_blocked("SELECT range AS trial FROM range(43)")}, v AS (" + _each("SELECT '@' AS feature, min(@) AS lo, max(@) AS hi FROM x", NAMES) + ") SELECT feature, round(CASE WHEN masked THEN 0 ELSE lo END, 6) AS minimum, round(CASE WHEN masked THEN 0 ELSE hi END, 6) AS maximum FROM v JOIN bm USING (feature) WHERE trial = 42",
        "random_masks": f"WITH {N}, {RANDOM} SELECT trial, feature, masked FROM rm",
        "shortcut_analysis": f"WITH {shortcut} SELECT trial, count(*) AS n_masked, count(*) FILTER (n > 0) AS with_partner, sum(n)::BIGINT AS visible_pairs, round(count(*) FILTER (n > 0) / count(*)::DOUBLE, 6) AS rate FROM hit GROUP BY trial",
        "masked_batch": f"WITH {X} " + _each("SELECT '@' AS feature, round(sum(@::DECIMAL(18,6))::DOUBLE / count(@), 9) AS mean, round(max(@), 6) AS maximum FROM x", [n for n in NAMES if n not in ("price", "tax")]) + " UNION ALL SELECT 'price', 0, 0 UNION ALL SELECT 'tax', 0, 0",
    }
