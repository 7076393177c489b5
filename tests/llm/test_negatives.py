"""Hard negatives against a plain search in Python's whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherloom.llm import negatives

KIND = "vec_id long, label int, embedding array<double>"


def by_hand(rows, anchors, positives=5, negatives_=3, low=50, high=95):
    most = 2**63 - 1
    dot = lambda x, y: max(-most - 1, min(most, sum(a * b for a, b in zip(x, y, strict=True))))
    whole = {}
    for i, c, v in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], [math.floor(256 * x) for x in r[2]])):
        whole.setdefault(i, (c, [math.floor(256 * x) for x in v]))
    out = set()
    for a in whole:
        if a not in anchors:
            continue
        c, x = whole[a]
        scored = sorted((-dot(x, y), i, d) for i, (d, y) in whole.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == c][:positives]:
            inside = [(-n, i) for n, i, d in scored if d != c and low * -s <= 100 * -n <= high * -s][:negatives_]
            out |= {(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(inside)}
    return out


def mined(spark, rows, anchors, parts=3):
    df = negatives.whole_numbers(spark.createDataFrame(rows, KIND).repartition(parts).withColumns({"x": F.lit("y"), "rank": F.lit(0)}))
    got = negatives.hard_negatives(df, df.where(F.col("vec_id").isin(sorted(anchors)))).collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_equals_plain_search(spark, monkeypatch, scale):
    """Ties, one label on most rows, small blocks; and numbers beyond 2 ** 53, whose products are exact all the same."""
    monkeypatch.setattr(negatives, "CHUNK", 40)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), [round(rng.uniform(-0.2, 1), 1) * scale + (scale > 1) * rng.random() for _ in range(6)]) for i in range(200)]
    anchors = set(range(0, 200, 9))
    want = by_hand(rows, anchors)
    assert len(want) > 100 and mined(spark, rows, anchors) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.6, 0.5]), (2, 2, [0.6, 0.5]), (3, 2, [0.7, 0.1]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [1.0, inf]), (8, 2, [1.0, None]), (None, 1, [1.0, 1.0]), (10, 3, [0.0, 0.0]), (11, 3, [-1.0, -1.0]), (12, 3, [1.0, 1.0])]
    assert mined(spark, rows, {0, 4, 5, 6, 10, 11}) == by_hand(rows, {0, 4, 5, 6, 10, 11})
    twice = [(0, 1, [1.0, 1.0]), (1, 2, [0.9, 0.0]), (1, 1, [0.9, 0.9]), (2, 2, [0.7, 0.7])]  # the least label and vector counts
    assert mined(spark, twice, {0}) == by_hand(twice, {0}) != set()
    other = [*rows, (20, 1, [1.0]), (21, 2, [1.0, 1.0, 1.0])]  # other lengths than most take no part
    assert mined(spark, other, {0, 20}) == by_hand(rows, {0})
    assert mined(spark, [], {0}) == mined(spark, [(5, None, None)], {5}) == set()
    assert mined(spark, [(0, 1, [1e308, -1e308]), (1, 1, [1e308, 0.0]), (2, 2, [1.0, 0.0])], {0}) == set()


def test_exact_products():
    x = np.array([[2.0**27 + 1, 3.0], [5.0, -7.0]])
    assert negatives.products(x, x).tolist() == [[(2**27 + 1) ** 2 + 9, 5 * (2**27 + 1) - 21], [5 * (2**27 + 1) - 21, 74]]
