"""The recurrent model against finite differences and a plain forward pass; the scores against counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from featherloom.llm import language_model, recurrent
from tests.conftest import SF

WORDS = re.compile("[^\x20\x09-\x0d]+")


def model(rng, symbols=40, hidden=5, classes=6):
    w = recurrent.new_model(np.sort(rng.integers(1, 500, symbols))[::-1].astype(float), hidden, classes)
    return w | {k: w[k] + rng.normal(0, 0.4, w[k].shape).astype(np.float32) for k in recurrent.WEIGHTS}


def plain(w, text):
    """Logarithm of one text's probability, symbol by symbol in doubles."""
    w = {k: v.astype(float) for k, v in w.items()}
    starts, m = w["starts"].astype(int), len(w["back"])
    h, before, total = np.zeros(m), 0, 0.0
    soft = lambda x: x - np.log(np.exp(x).sum())
    for y in text:
        a, g = w["table"][before] + w["bias"], h @ w["back"]
        z, r = (1 / (1 + np.exp(-(a + g)[i * m : (i + 1) * m])) for i in (0, 1))
        c = np.tanh(a[2 * m :] + r * g[2 * m :])
        h = z * h + (1 - z) * c
        k = np.searchsorted(starts, y, "right") - 1
        total += soft(w["class_w"] @ h + w["class_b"])[k] + soft(w["word_w"][starts[k] : starts[k + 1]] @ h + w["word_b"][starts[k] : starts[k + 1]])[y - starts[k]]
        before = y
    return total


def test_state_goes_through_whole_texts():
    """Texts of all lengths, longer than any window, score as if each were alone."""
    rng = np.random.default_rng(2)
    w = model(rng)
    texts = [rng.integers(0, 40, n) for n in [1, 2, 900, 3, 77, 1500, 24, 25, *rng.integers(1, 60, 80)]]
    got = recurrent.score(w, texts)
    assert np.allclose(got, [plain(w, t) for t in texts], rtol=1e-4)
    assert len(recurrent.score(w, [])) == 0
    # A distribution: the probabilities of what may follow add up to 1.
    assert abs(sum(math.exp(plain(w, [3, y])) for y in range(40)) / math.exp(plain(w, [3])) - 1) < 1e-9


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(5)
    w = {k: (v if k == "starts" else v.astype(np.float64)) for k, v in model(rng, 12, 4, 3).items()}
    x, y = rng.integers(0, 12, (9, 3)), rng.integers(0, 12, (9, 3))
    first = np.zeros((9, 3), bool)
    first[0], first[4, 1] = True, True
    there = np.ones((9, 3), bool)
    there[7:, 2] = False

    def loss(w):
        s, *_ = recurrent.states(w, x, first, np.zeros((3, 4)))
        return -recurrent.log_probabilities(w, s[there], y[there])[0].sum()

    grad = {k: np.zeros_like(w[k]) for k in recurrent.WEIGHTS}
    s, gates, before = recurrent.states(w, x, first, np.zeros((3, 4)), keep=True)
    _, by_state = recurrent.log_probabilities(w, s[there], y[there], grad)
    dh = np.zeros(s.shape)
    dh[there] = by_state
    recurrent._way_back(w, x, first, before, gates, dh, grad)
    for k in recurrent.WEIGHTS:
        for at in rng.integers(0, w[k].size, 12):
            d = np.zeros(w[k].size)
            d[at] = 1e-4
            d = d.reshape(w[k].shape)
            slope = (loss(w | {k: w[k] + d}) - loss(w | {k: w[k] - d})) / 2e-4
            assert abs(slope - grad[k].ravel()[at]) < 1e-4 * max(1, abs(slope)), k


def test_untrained_model_is_the_base_and_training_learns_order():
    counts = np.array([400.0, 300, 200, 100])
    w = recurrent.new_model(counts, 8, 2)
    rng = np.random.default_rng(1)
    texts = [(np.arange(60) + k) % 4 for k in rng.integers(0, 4, 200)]
    assert np.allclose(recurrent.score(w, texts[:5]), [np.log(counts[t] / 1000).sum() for t in texts[:5]], rtol=1e-4)
    adam = None
    for _ in range(15):
        w, adam = recurrent.train(w, texts, 0.03, adam)
    assert recurrent.score(w, texts).sum() / (200 * 60) > -0.3  # of 4 symbols the next is known


def test_lanes_hold_each_text_once():
    rng = np.random.default_rng(3)
    for n in ([5], [3] * 700, [1, 10_000], rng.integers(1, 400, 900).tolist()):
        n = np.array(n)
        own = recurrent.lanes(n)
        assert sorted(np.concatenate(own).tolist()) == list(range(len(n)))
        total = [n[x].sum() for x in own]
        assert total == sorted(total, reverse=True) and total[0] <= max(n.max(), 2 * n.sum() / len(own) + n.max())


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def bases(rows):
    """(tokens, known, base score) of each row, and the number of training tokens."""
    cut = [["".join(c.lower() if c.isascii() else c for c in w) for w in WORDS.findall(t or "")] + [None] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, cut, strict=True) if not held_out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in cut], n


def scored(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    return language_model.score_documents(docs.withColumns({"held_out": fold == 1, "score": F.lit("x"), "unit": F.lit(1)})).collect()


def same_rows(rows, got):
    want, n = bases(rows)
    assert sorted(((i, *w[:2], round(w[2], 6)) for (i, _), w in zip(rows, want, strict=True)), key=str) == sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got), key=str)
    assert all(r["train_tokens"] == n and r["held_out"] == held_out(r["doc_id"]) and r["score"] <= 1e-6 for r in got)


def test_odd_tables(spark):
    rows = [(None, None), (None, "a a"), (1, ""), (1, "Über A\tb\x0bA \n ÜBER"), (2, " "), (3, "a b " * 3000), (3, "a b " * 3000), (4, "x" * 100_000 + " a"), *[(i, "the a the b") for i in range(5, 40)]]
    same_rows(rows, scored(spark, rows))
    none = [(i, "only held out texts") for i in range(200) if held_out(i)]  # nothing to learn from
    got = scored(spark, none)
    same_rows(none, got)
    assert len(got) == len(none) and scored(spark, []) == []


def test_held_out_texts_score_better_than_the_base(spark, duck):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = language_model.op11(spark, SF).collect()
    same_rows(rows, got)
    held = [r for r in got if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / tokens > sum(r["base_score"] for r in held) / tokens + 0.03


def test_order_counts_and_scores_are_distributions(spark):
    """Sentences of one order: the held-out ones score far above the base, and above the same words in another order."""
    rng = random.Random(8)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    line = lambda: " ".join(w for _ in range(30) for w in ("the", rng.choice(nouns), "will", rng.choice(verbs)))
    rows = [(i, line()) for i in range(400)]
    mixed = [(i + 1000, " ".join(rng.sample(t.split(), 120))) for i, t in rows if held_out(i + 1000)]
    got = {r["doc_id"]: r for r in scored(spark, rows + mixed)}
    mean = lambda rs, c: sum(r[c] / r["n_tokens"] for r in rs) / len(rs)
    held = [r for i, r in got.items() if i < 1000 and r["held_out"]]
    assert mean(held, "score") > mean(held, "base_score") + 0.3
    assert mean(held, "score") > mean([r for i, r in got.items() if i >= 1000], "score") + 0.3
