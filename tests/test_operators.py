import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featherloom.functions import numeric as fn
from featherloom.operators import blocks as bl
from featherloom.operators import cluster as cl
from featherloom.operators import dependency as dep
from featherloom.operators import graph as gr
from featherloom.operators import mask as mk
from featherloom.operators import order
from featherloom.operators import prepare as pp
from featherloom.operators import profile as pr
from featherloom.sources import sinks, tables


def test_average_linkage_by_hand():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    assert cl.average_linkage(d) == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 4.5)]
    assert cl.cut(cl.average_linkage(d), 4, 2).tolist() == [0, 0, 1, 1]


def test_ties_merge_together():
    d = 1.0 - np.eye(5)
    merges = cl.average_linkage(d)
    assert cl.cut(merges, 5, 3).tolist() == [0] * 5
    assert cl.cut(merges, 5, 5).tolist() == [0, 1, 2, 3, 4]


def test_choose_blocks():
    sizes = {1: 3, 2: 4}
    assert mk.choose_blocks([1, 2], sizes, 1) == []  # the empty choice is nearer than three features
    assert mk.choose_blocks([2, 1], sizes, 4) == [2]
    many = {i: 1 for i in range(10)} | {10: 6, 11: 7}
    got = mk.choose_blocks(list(many), many, 8)
    assert sum(many[b] for b in got) == 8
    assert mk.mask_size(39, 0.25) == 10 and mk.mask_size(10, 0.25) == 2 and mk.mask_size(2, 0.01) == 1
    with pytest.raises(ValueError):
        mk.mask_size(5, 1.0)


def test_block_masks_hold_whole_blocks(spark):
    blocks = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (4, "f"), (4, "g"), (5, "h")]
    masks = mk.block_masks(tables.trials(spark, 50), blocks, 0.25)
    stats = mk.trial_stats(masks).first()
    assert stats["violations"] == 0 and stats["min_masked_ratio"] == stats["max_masked_ratio"] == 0.25
    assert len({tuple(r["mask"]) for r in mk.mask_vector(masks, [f for _, f in blocks]).collect()}) == 4


def test_random_masks_give_partners_away_as_chance_says(spark):
    names = [f"f{i}" for i in range(39)]
    pairs = spark.createDataFrame([(names[0], names[i], 0.9) for i in range(1, 4)], "f1 string, f2 string, score double")
    masks = mk.random_masks(tables.trials(spark, 3000), names, 0.25).cache()
    masked = masks.where("masked and feature = 'f0'").count()
    m = mk.shortcuts(masks.where(F.col("feature") != "x"), pairs)
    edges = masks.where("masked and feature = 'f0'").select("trial").join(masks.where("not masked and feature in ('f1', 'f2', 'f3')").select("trial").distinct(), "trial").count()
    assert m.count() == 3000
    assert abs(edges / masked - (1 - math.comb(35, 6) / math.comb(38, 9))) < 0.05


def test_masker(spark):
    m = mk.BlockMasker(spark, [(1, "a"), (2, "b"), (3, "c")], 0.34, -1.0)
    df, masked = m.mask_batch(spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double"))
    assert len(masked) == 1 and df.first()[masked[0]] == -1.0
    with pytest.raises(ValueError):
        mk.BlockMasker(spark, [(1, "a"), (2, "a")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (300, 300), (101, 100)]
    got = {r["node"]: r["component"] for r in gr.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and got[300] == 300 and len(got) == 44
    assert gr.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("inf",), ("-2",), ("NaN",)], "v string")
    r = pr.value_audit(df, ["v"]).first()
    assert (r["missing"], r["nonfinite"], r["infinite"], r["negative"], r["minimum"]) == (3, 4, 1, 1, -2.0)
    assert [x[0] for x in df.select(fn.finite(F.col("v"))).collect()] == [1.0, None, None, None, -2.0, None]
    assert pr.feature_profile(df, ["v"]).first()["q50"] == -0.5


def test_average_ranks_match_the_definition(spark):
    v = [5.0, 1.0, 5.0, 2.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(x, -x, 3.0) for x in v], "a double, b double, c double")
    ranks = {(r["feature"], r["value"]): r["rank"] for r in dep.average_ranks(df, ["a"]).collect()}
    assert ranks == {("a", 1.0): 1.0, ("a", 2.0): 3.0, ("a", 5.0): 5.5, ("a", 9.0): 7.0}
    got = {(r["f1"], r["f2"]): r["score"] for r in dep.spearman(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(-1) and got[("a", "c")] is None


def test_information_of_a_copy_is_its_entropy(spark):
    df = spark.createDataFrame([(float(i % 4), float(i % 4), float(i)) for i in range(400)], "a double, b double, c double")
    mi = {(r["f1"], r["f2"]): r for r in dep.mutual_information(dep.joint_counts(dep.discretize(df, ["a", "b", "c"]), ["a", "b", "c"])).collect()}
    assert mi[("a", "b")]["nmi"] == pytest.approx(1) and mi[("a", "b")]["mi"] == pytest.approx(math.log(4))
    assert all(0 <= r["nmi"] <= 1 and r["mi"] >= -1e-9 for r in mi.values())
    assert dep.discretize(df, ["c"]).agg(F.max("c"), F.count_distinct("c")).first() == (31, 32)


def test_blend_modes(spark):
    nmi = spark.createDataFrame([("a", "b", 0.5998)], "f1 string, f2 string, nmi double")
    rho = spark.createDataFrame([("a", "b", -0.8751)], "f1 string, f2 string, score double")
    assert dep.blend(nmi, rho, 0.5).first()["score"] == pytest.approx(0.73745)
    assert dep.blend(nmi, rho, 0.35, "signed_clip").first()["score"] == 0.0


def test_rand_index(spark):
    rows = [("p", f, l) for f, l in zip("abcdef", [0, 0, 1, 1, 2, 2], strict=True)] + [("q", f, l) for f, l in zip("abcdef", [0, 0, 1, 2, 2, 2], strict=True)]
    assert cl.adjusted_rand(spark.createDataFrame(rows, "w string, feature string, label long"), "w").first()["ari"] == pytest.approx(4 / 9, abs=1e-6)


def test_split_is_by_key_alone(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in pp.key_hash_split(df, ["k"]).collect()}
    b = {r["k"]: r["split"] for r in pp.key_hash_split(df.repartition(7), ["k"]).collect()}
    assert a == b and abs(sum(v == "train" for v in a.values()) / 5000 - 0.7) < 0.03


def test_scaler_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (9.0, 4.0)], "a double, b double")
    m = pp.fit_robust_scaler(df, ["a", "b"])
    assert {r["feature"]: (r["center"], r["scale"]) for r in m.collect()} == {"a": (2.0, 4.0), "b": (4.0, 1.0)}
    assert [tuple(r) for r in pp.scale(df, ["a", "b"], m).collect()] == [(-0.25, 0.0), (0.0, 0.0), (1.75, 0.0)]


def test_sources_and_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 0.25)], "f1 string, f2 string, score double")
    sinks.write_matrix(dep.symmetric(pairs, ["a", "b"]), ["a", "b"], f"{tmp_path}/m")
    assert {(r["f1"], r["f2"], r["score"]) for r in tables.read_matrix(spark, f"{tmp_path}/m").collect()} == {("a", "b", 0.25), ("b", "a", 0.25), ("a", "a", 1.0), ("b", "b", 1.0)}
    assert tables.header(spark, f"{tmp_path}/m") == ["f1", "a", "b"]
    df = pp.key_hash_split(spark.range(50).withColumnRenamed("id", "k"), ["k"])
    sinks.write_split(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 50
    with pytest.raises(ValueError):
        tables.require_columns(df, ["k", "absent"])
    with pytest.raises(ValueError):
        pp.drop_identity(df, ["absent"])
    labels = tables.labels(spark.createDataFrame([(1, "b | a"), (2, "c")], "Block_ID int, Features string"))
    assert [tuple(r) for r in labels.collect()] == [("a", 1), ("b", 1), ("c", 2)]
    with pytest.raises(Exception, match="given twice"):
        tables.labels(spark.createDataFrame([(1, "b | a"), (2, "a")], "Block_ID int, Features string")).collect()


def test_block_rules(spark):
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "block_id long, feature string")
    assert {(r["problem"], r["feature"]) for r in bl.validation(b, ["a", "b", "d"]).collect()} == {("missing", "d"), ("unexpected", "c")}
    pairs = spark.createDataFrame([(x, y, 0.5) for x, y in combinations("abc", 2)], "f1 string, f2 string, score double")
    stats = {r["block_id"]: r for r in bl.within_stats(b, pairs).collect()}
    assert stats[2]["mean_within"] is None and stats[1]["weakest_pair"] == "a <-> b"
    assert bl.separation(b, pairs).first()["ratio"] == 1.0


def test_no_valid_clustering_raises(spark):
    names = ["a", "b", "c"]
    nmi = spark.createDataFrame([(x, y, 0.5) for x, y in combinations(names, 2)], "f1 string, f2 string, nmi double")
    rho = nmi.withColumnRenamed("nmi", "score")
    with pytest.raises(ValueError):
        cl.alpha_sweep(nmi, rho, names, [0.5], (2,), 1)


def test_quantiles_ranks_and_correlations_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x = {"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)), "d": np.full(n, 0.1)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in x.values()) for i in range(n)], "a double, b double, c double, d double").repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    got = {r["feature"]: r["q"] for r in order.quantiles(df, list(x), at).collect()}
    for c, v in x.items():
        assert got[c] == pytest.approx(np.quantile(v, at).tolist(), abs=1e-12)
    score = {(r["f1"], r["f2"]): r["score"] for r in dep.correlations(df, list(x)).collect()}
    assert score[("a", "c")] == pytest.approx(np.corrcoef(x["a"], x["c"])[0, 1]) and score[("a", "d")] is None
    ranks = lambda v: np.array([np.flatnonzero(np.sort(v) == t).mean() for t in v])
    rho = {(r["f1"], r["f2"]): r["score"] for r in dep.spearman(df, list(x)).collect()}
    assert rho[("a", "c")] == pytest.approx(np.corrcoef(ranks(x["a"]), ranks(x["c"]))[0, 1]) and rho[("c", "d")] is None
    holes = df.withColumn("a", F.when(F.col("b") > 0, F.col("a")))
    keep = x["b"] > 0
    assert {(r["f1"], r["f2"]): r["score"] for r in dep.correlations(holes, ["a", "c"]).collect()}[("a", "c")] == pytest.approx(np.corrcoef(x["a"][keep], x["c"][keep])[0, 1])
    empty = order.quantiles(df.limit(0), ["a"], [0.5]).collect()
    assert [(r["feature"], r["q"]) for r in empty] == [("a", None)]


@pytest.mark.parametrize("ranges", [16, 300])
def test_ranks_of_ties_nulls_and_many_ranges(spark, monkeypatch, ranges):
    """A value on half of the rows, nulls, an empty column, and more ranges than values."""
    monkeypatch.setattr(order, "FEWEST_RANGES", ranges)
    rng = np.random.default_rng(9)
    n = 4000
    x = pd.DataFrame({"half": np.where(rng.random(n) < 0.5, 0.25, rng.normal(size=n)), "few": rng.integers(0, 3, n).astype(float), "all": rng.permutation(n) - 100.0, "none": np.nan, "holes": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 900, n))})
    df = spark.createDataFrame([[None if v != v else float(v) for v in r] for r in x.values], ", ".join(f"{c} double" for c in x)).repartition(7)
    got = order.ranked(df.withColumns({c: F.col(c) for c in x}), list(x)).toPandas()
    want = x.rank()
    key = ["all"]  # without ties, so it tells the rows apart
    got, want = (d.sort_values(key).reset_index(drop=True).astype(float) for d in (got, want))
    pd.testing.assert_frame_equal(got, want)
    assert order.ranked(df.limit(0), list(x)).count() == 0
    assert order.ranked(df.limit(1), ["half"]).collect()[0][0] == 1.0


@pytest.mark.parametrize("accuracy", [10_000, 20, 2])
def test_brackets_are_narrowed_until_a_task_can_sort_them(spark, monkeypatch, accuracy):
    """Coarse sketches and small brackets lead to the same quantiles, in more scans."""
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    monkeypatch.setattr(order, "INSIDE", 40)
    rng = np.random.default_rng(2)
    n = 5000
    x = {"a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.5, 3.0, rng.normal(size=n)), "c": rng.integers(0, 6, n).astype(float), "d": np.exp(rng.normal(size=n) * 9)}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in x.values()], strict=True)), ", ".join(f"{c} double" for c in x)).repartition(3)
    at = [0.0, 0.001, 0.31, 0.5, 0.77, 0.999, 1.0]
    got = order.order_statistics(df, list(x), at, 6)
    for c, v in x.items():
        assert got[c].q == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12) and got[c].n == n
    assert got["c"].few == [0, 1, 2, 3, 4, 5] and got["a"].few is None


def test_nan_and_infinity_in_order(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(x,) for x in (1.0, nan, inf, None, -inf, 2.0)], "x double")
    got = order.order_statistics(df, ["x"], [0.0, 0.5, 0.75, 1.0], 9)["x"]
    assert got.n == 5 and got.q[:3] == [-inf, 2.0, inf] and got.q[3] != got.q[3] and len(got.few) == 5


def test_sums_of_many_features_in_parts(spark):
    """39 features with holes and far apart in size: pair by pair as numpy over the rows that have both."""
    rng = np.random.default_rng(6)
    n, m = 1500, 39
    x = rng.normal(size=(n, m)) * 10.0 ** rng.integers(-6, 9, m) + 10.0 ** rng.integers(-3, 6, m)
    x[:, 5], x[:, 6] = 0.1, x[:, 7] * -3
    x[rng.random((n, m)) < 0.05] = np.nan
    names = [f"f{i}" for i in range(m)]
    df = spark.createDataFrame([[None if v != v else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r["f1"], r["f2"]): r["score"] for r in dep.correlations(df, names).collect()}
    assert len(got) == m * (m - 1) // 2 and got["f6", "f7"] == pytest.approx(-1)
    for i, j in combinations(range(m), 2):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        want = None if 5 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert got[names[i], names[j]] == (want if want is None else pytest.approx(want, abs=1e-7))
    empty = dep.correlations(df.limit(0), names[:3]).collect()
    assert len(empty) == 3 and all(r["score"] is None for r in empty)
    # Histograms of the same features, in one scan, against those of codes.
    codes = dep.discretize(df, names[:6], 8)
    cells = lambda d: sorted(map(tuple, d.collect()))
    assert cells(dep.binned_counts(df, names[:6], 8)) == cells(dep.joint_counts(codes, names[:6], 8))
    own = codes.groupBy("f0", "f1").count().where("f0 is not null and f1 is not null").collect()
    assert {(r["c1"], r["c2"]): r["n"] for r in dep.binned_counts(df, names[:2], 8).where("f1 = 'f0' and f2 = 'f1'").collect()} == {(r[0], r[1]): r[2] for r in own}


def test_a_star_of_many_leaves(spark):
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).repartition(6)
    got = gr.connected_components(edges)
    assert got.count() == 100_001 and got.agg(F.max("component")).first()[0] == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 800, (700, 2))]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = gr.connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long").repartition(5))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in root}


def test_linkage_against_mean_distances(spark):
    rng = np.random.default_rng(1)
    for n in (4, 7, 9):
        d = rng.random((n, n))
        d = (d + d.T) / 2
        groups, heights = {i: [i] for i in range(n)}, []
        while len(groups) > 1:
            h, a, b = min((np.mean([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a, b in combinations(groups, 2))
            heights.append(h)
            groups[n + len(heights)] = groups.pop(a) + groups.pop(b)
        assert [m[2] for m in cl.average_linkage(d)] == pytest.approx(heights)
    features = ["a", "b", "c", "d"]
    rows = [(features[i], features[j], abs(i - j) / 4 if i // 2 == j // 2 else 0.9) for i in range(4) for j in range(4)]
    labels = cl.hierarchical_labels(spark.createDataFrame(rows, "f1 string, f2 string, distance double"), features, (2,))
    blocks = cl.labels_to_blocks(labels, features)
    assert sorted(tuple(r["features"]) for r in blocks.collect()) == [("a", "b"), ("c", "d")]


def test_linkage_in_rounds_equals_one_merge_after_another(spark):
    """Two matrices at once, one of them with ties and fewer values; any cut is that of the serial kernel."""
    rng = np.random.default_rng(3)
    n = 18
    names = [f"f{i:02d}" for i in range(n)]
    mats = {0.25: rng.random((n, n)), 0.5: rng.random((n, n)) ** 3}
    rows = []
    for k, d in mats.items():
        mats[k] = d = np.round((d + d.T) / 2, 9)
        rows += [(k, names[i], names[j], float(d[i, j])) for i in range(n) for j in range(n) if i != j]
    df = spark.createDataFrame(rows, "alpha double, f1 string, f2 string, distance double").repartition(5)
    got = cl.linkage(df, "alpha").collect()
    for k, d in mats.items():
        assert sorted(r["height"] for r in got if r["alpha"] == k) == pytest.approx(sorted(m[2] for m in cl.average_linkage(d)), abs=1e-9)
    ks = (1, 2, 7, 17, 18, 30)
    labels = {(r["alpha"], r["k"], r["feature"]): r["label"] for r in cl.hierarchical_labels(df, names, ks, "alpha").collect()}
    for a, d in mats.items():
        for k in ks:
            assert [labels[a, k, f] for f in names] == cl.cut(cl.average_linkage(d), n, k).tolist(), (a, k)
    same = spark.createDataFrame([(x, y, 1.0) for x in names[:9] for y in names[:9] if x != y], "f1 string, f2 string, distance double")
    even = cl.hierarchical_labels(same, names[:9], (3, 9)).collect()
    assert {r["label"] for r in even if r["k"] == 3} == {0} and sorted(r["label"] for r in even if r["k"] == 9) == list(range(9))


def test_choice_of_blocks_is_that_of_the_rule(spark):
    """The fold in the engine against the rule, for blocks of many sizes, and without a Python worker."""
    rng = np.random.default_rng(4)
    for n in (2, 5, 9):
        blocks = [(int(b) * 3, f"f{b}_{i}") for b in range(n) for i in range(rng.integers(1, 7))]
        sizes = {b: sum(x == b for x, _ in blocks) for b, _ in blocks}
        masks = mk.block_masks(tables.trials(spark, 40), blocks, 0.4)
        assert "Python" not in masks._jdf.queryExecution().executedPlan().toString()
        order = spark.range(40).select("id", mk._drawn("id", list(sizes), "long").alias("o")).collect()
        got = {}
        for r in masks.where("masked").collect():
            got.setdefault(r["trial"], set()).add(r["block_id"])
        for r in order:
            assert got.get(r["id"], set()) == set(mk.choose_blocks(r["o"], sizes, mk.mask_size(len(blocks), 0.4)))
    with pytest.raises(ValueError):
        mk.block_masks(tables.trials(spark, 3), [(1, "a"), (1, "b")], 0.5)


def test_checks_that_ride_along(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "block_id long, feature string")
    assert bl.checked(blocks, ["a", "b", "c"]).count() == 3
    for bad, expected in ((blocks, ["a", "b"]), (blocks, ["a", "b", "c", "d"]), (blocks.unionByName(blocks.limit(1)), ["a", "b", "c"]), (blocks.limit(0), [])):
        with pytest.raises(Exception, match="blocks: "):
            bl.checked(bad, expected).collect()
    rows = spark.createDataFrame([(1, 1.0, None), (2, None, "x"), (3, float("inf"), "y"), (4, 2.0, "z"), (4, 2.0, "z"), (4, 2.0, "z")], "i int, v double, t string")
    kept, seen = pp.observed_hygiene(rows, ["v"])
    kept.write.parquet(str(tmp_path / "kept"))
    assert seen.get == {"before": 6, "removed": 3, "null_i": 0, "null_v": 2, "null_t": 1} and spark.read.parquet(str(tmp_path / "kept")).count() == 3
    # Equal hashes are not taken for equal rows: a null shifts what is hashed.
    odd = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), ("b", "c"), ("b", "c"), ("b", "c")], "x string, y string")
    assert tuple(pr.repeated_rows(odd).first()) == (6, 3, 3) and tuple(pr.repeated_rows(odd.limit(0)).first()) == (0, 0, 0)
    assert tuple(pr.repeated_rows(rows).first()) == (6, 4, 2)


def test_chunks_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", (F.col("id") % 50).alias("v")).repartitionByRange(2, "id").write.option("parquet.block.size", 1024).parquet(path)
    d = tables.read_chunks(spark, path, 150, ["id", "v"])
    sizes = sorted(r["count"] for r in d.groupBy("file", "chunk").count().collect())
    assert sum(sizes) == 1000 and sizes[-1] == 150 and len(sizes) == d.select("file").distinct().count() * 4
    got = pp.chunk_samples(d.where("file is not null"), "chunk", ["id"], 10)
    assert got.groupBy("chunk").count().where("count <> 10").count() == 0 and got.columns == d.columns
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in pp.chunk_samples(d.repartition(9), "chunk", ["id"], 10).collect()}
    dup = pr.chunk_duplicates(d, "chunk", ["v"]).agg(F.sum("total_rows"), F.min("distinct_rows")).first()
    assert tuple(dup) == (1000, 50)


def test_samples_of_rows_that_share_a_key(spark):
    """Of rows equal in chunk and key the least are kept, in any order of reading."""
    rows = spark.createDataFrame([(0, 7, float(v), {v: v}) for v in range(40)], "chunk int, id int, `v.x` double, m map<int,int>")
    for d in (rows.coalesce(1), rows.coalesce(1).orderBy(F.desc("`v.x`")), rows.repartition(5)):
        for got in (pp.chunk_samples(d, "chunk", ["id"], 3), pp.hash_sample(d, ["id"], 3)):
            assert sorted(r["v.x"] for r in got.collect()) == [0.0, 1.0, 2.0] and got.columns == d.columns


def test_shortcuts_of_a_row_a_trial(spark):
    """Both forms of masks give the same, and a row a trial needs no shuffle of trials."""
    blocks = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "e")]
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "e", 0.7), ("d", "e", 0.1)], "f1 string, f2 string, score double")
    trials = spark.range(200).withColumnRenamed("id", "trial")
    names = [f for _, f in blocks]
    for rows, lists in ((mk.block_masks(trials, blocks, 0.4), mk.block_sides(trials, blocks, 0.4)), (mk.random_masks(trials, names, 0.4), mk.random_sides(trials, names, 0.4))):
        got = mk.shortcuts(lists, pairs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mk.shortcuts(rows, pairs).collect())) and got.count() == 200
        masked = {(r["trial"], r["feature"]): r["masked"] for r in rows.collect()}
        edges = [(a, b) for x in pairs.collect() if x["score"] >= 0.7 for a, b in ((x["f1"], x["f2"]), (x["f2"], x["f1"]))]
        for r in got.collect():
            hit = [a for a, b in edges if masked[r["trial"], a] and not masked[r["trial"], b]]
            own = sum(masked[r["trial"], f] for f in names)
            assert (r["n_masked"], r["with_partner"], r["visible_pairs"], r["rate"]) == (own, len(set(hit)), len(hit), len(set(hit)) / own)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(trial" not in plan
    assert mk.shortcuts(mk.block_sides(trials, blocks, 0.4), pairs.limit(0)).where("with_partner > 0 or rate <> 0").count() == 0


def _ranges_of(d, m):
    r = order._Ranges([np.linspace(0, 2e5, 9)] * m, [np.empty(0)] * m)
    r.counted(d.mapInArrow(r.count, "feature int, code int, n long").groupBy("feature", "code").agg(F.sum("n").alias("n")).collect())
    return r


def test_ranks_travel_packed(spark):
    """Of values that all differ less than 6 bytes a value go out, with the rows they belong to, and 2 come back."""
    d = spark.range(0, 150_000, 1, 1).select((F.col("id") * 7919 % 150_001).cast("double").alias("_0"))
    r = _ranges_of(d, 1)
    values = d.mapInArrow(r.values, order.VALUES)
    out = values.agg(F.sum(F.length("x")), F.sum("n")).first()
    own = d.mapInArrow(r.rows, order.ROWS).agg(F.sum(F.length("own") + F.length("known"))).first()[0]
    back = values.groupBy("feature", "code").applyInArrow(lambda key, rows: r.rank(key, rows), order.RANKED).agg(F.sum(F.length("ranks"))).first()[0]
    assert out[1] == 150_000 and out[0] + own < 6 * 150_000 and back < 2 * 150_000
    got = order.ranked(d, {"a": F.col("_0"), "b": -F.col("_0"), "c": F.col("_0") % 3}, stable=True)
    x = pd.Series([i * 7919 % 150_001 for i in range(150_000)], dtype=float)
    want = sorted(zip(x.rank(), (-x).rank(), (x % 3).rank(), strict=True))
    assert sorted(map(tuple, got.collect())) == want


def test_blocks_are_bounded(spark):
    """What a task holds of its rows at once does not depend on the table or on the size of batches."""
    d = spark.range(0, 200_000, 1, 1).select((F.col("id") % 3).cast("double").alias("_0"))
    sizes = [x["size"] for x in d.mapInArrow(_ranges_of(d, 1).rows, order.ROWS).select("size").collect()]
    assert sorted(sizes) == [200_000 - 3 * order.BLOCK_ROWS, *[order.BLOCK_ROWS] * 3] and order.BLOCK_ROWS <= 1 << 16


def test_rows_that_change_between_readings_are_an_error(spark):
    def drawn(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.random.default_rng().random(len(b)))], ["x"])

    d = spark.range(500).mapInArrow(drawn, "x double")
    with pytest.raises(Exception, match="another order"):
        order.ranked(d, ["x"], stable=True).collect()
    assert order.ranked(d, ["x"]).agg(F.sum("x")).first()[0] == 500 * 501 / 2  # written first


def test_mask_errors(spark):
    blocks = [(1, "a"), (1, "b"), (2, "c")]
    assert mk.mask_of(["c", "b", "a"], blocks, [1]) == [False, True, True]
    for call in (lambda: mk.mask_of(["a", "b", "c"], blocks, [3]), lambda: mk.mask_of(["a", "b"], blocks, [1]), lambda: mk.choose_blocks([1, 9], {1: 2, 2: 1}, 1), lambda: mk.choose_blocks([1], {1: 3}, 1), lambda: mk.apply_mask(spark.range(1), ["x"])):
        with pytest.raises(ValueError):
            call()


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(65)], "x double")
    codes = [r["x"] for r in dep.discretize(df, ["x"], equal=True).collect()]
    assert codes[:3] == [0, 0, 0] and codes[3:5] == [1, 1] and codes[-1] == 31


def test_sources_without_ids_or_rows(spark, tmp_path):
    lists = spark.createDataFrame([("b | c",), ("a",)], "features string")
    assert {(r["block_id"], r["feature"]) for r in tables.blocks(lists).collect()} == {(1, "a"), (2, "b"), (2, "c")}
    assert tables.blocks(lists.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tables.blocks(lists.withColumnRenamed("features", "x"))
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert 0 < tables.size_gb(spark, f"{tmp_path}/t/*.parquet").first()["gb"] < 1e-3
    with pytest.raises(ValueError):
        pp.feature_columns(spark.range(1), ["absent"])
    assert pp.cast_all(spark.createDataFrame([("7", "x")], "a string, b string"), ["a", "b"]).first() == (7.0, None)


def test_rounds_of_the_alpha_sweep_prefer_the_larger_ratio(spark):
    rows = spark.createDataFrame([(4, 0.5, True, 2.0), (5, 0.5, True, 3.0), (6, 0.9, False, 9.0)], "k long, silhouette double, valid boolean, ratio double")
    assert cl.choose_k(rows).first()["k"] == 5 and cl.choose_k(rows.drop("ratio")).first()["k"] == 4


def test_rounds_of_components_take_few_python_tasks(spark):
    """Many shuffle partitions are no Python tasks when there are few edges; the answer is that of one partition."""
    edges = spark.range(400).select((F.col("id") * 37 % 401).alias("src"), ((F.col("id") + 1) * 37 % 401).alias("dst")).where("src % 50 <> 0")
    want = sorted(map(tuple, gr.parents(edges).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    real = gr.checkpointed
    try:
        gr.checkpointed = lambda df, tidy=False: (seen.append(df.rdd.getNumPartitions()) if "own" in df.columns else None, real(df, tidy))[1]
        assert sorted(map(tuple, gr.parents(edges).collect())) == want
    finally:
        gr.checkpointed = real
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
