from itertools import combinations

import numpy as np
import pytest

from featherloom import catalogue
from tests.conftest import SF, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, duck, name):
    assert QUERIES[name](spark, SF).count() > 0


def _matrix(spark):
    names = catalogue.NAMES
    d = np.zeros((len(names), len(names)))
    for r in catalogue._pairs(spark, SF).collect():
        d[names.index(r["f1"]), names.index(r["f2"])] = d[names.index(r["f2"]), names.index(r["f1"])] = min(1.0, max(0.0, 1 - r["score"]))
    return d


def _clusters(d, k):
    """Average linkage by the definition: the mean distance of all pairs of two groups."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        _, a, b = min((np.mean([d[i, j] for i in g for j in h]), x, y) for (x, g), (y, h) in combinations(enumerate(groups), 2))
        groups[a] += groups.pop(b)
    return groups


def _silhouette(d, groups):
    out = []
    for g in groups:
        for i in g:
            a = np.mean([d[i, j] for j in g if j != i]) if len(g) > 1 else None
            b = min(np.mean([d[i, j] for j in h]) for h in groups if h is not g)
            out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


def test_clusterings_against_numpy(spark, duck):
    d = _matrix(spark)
    rows = {r["k"]: r for r in QUERIES["hierarchical_blocks"](spark, SF).collect()}
    assert set(rows) == {2, 3, 4, 5}
    for k, r in rows.items():
        groups = _clusters(d, k)
        sizes = [len(g) for g in groups]
        assert (r["n_clusters"], r["min_size"], r["max_size"], r["valid"]) == (k, min(sizes), max(sizes), max(sizes) <= 4)
        assert r["silhouette"] == pytest.approx(_silhouette(d, groups), abs=1e-5)


def test_alpha_sweep_against_numpy(spark, duck):
    names = catalogue.NAMES
    nmi = {(r["f1"], r["f2"]): r["nmi"] for r in QUERIES["normalized_mi"](spark, SF).collect()}
    rho = {(r["f1"], r["f2"]): r["score"] for r in QUERIES["spearman_pairs"](spark, SF).collect()}
    got = {r["alpha"]: r for r in QUERIES["alpha_sweep"](spark, SF).collect()}
    assert set(got) == {x / 100 for x in range(20, 81, 5)}
    for alpha, r in got.items():
        d = np.zeros((len(names), len(names)))
        for (a, b), x in nmi.items():
            s = min(1.0, max(0.0, alpha * x + (1 - alpha) * rho[a, b]))
            d[names.index(a), names.index(b)] = d[names.index(b), names.index(a)] = 1 - s
        found = []
        for k in (2, 3, 4, 5):
            g = _clusters(d, k)
            if max(map(len, g)) <= 5:
                found.append((_silhouette(d, g), k))
        assert r["silhouette"] == pytest.approx(max(found)[0], abs=1e-4)


def test_columns_are_pruned_and_filters_pushed(spark, duck):
    plan = QUERIES["category_distribution"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in plan
    plan = QUERIES["suspicious_by_source"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value" in plan or "value" in plan.split("PushedFilters")[1][:80]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
