"""Equal rows in any number, callers' columns of any name, and words that sums of letters confuse."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featherloom.llm import common, minhash, mixing, packing, quality, sharding
from featherloom.llm.texthash import PIECE, shingle_sets
from tests.conftest import SF

#: Names of columns that some step works with.
TAKEN = [
    "_", "_n", "_s", "_t", "_w", "_h", "_p", "_lines", "_tok", "_uni", "_bi", "_llr", "_sum", "_row", "_slot", "_at", "_before", "_s0", "_rows", "_copies", "_id", "_t1", "_t2", "row", "group", "at", "n", "in", "of", "shift", "first", "k",
    "slot_", "key", "p", "whole", "id", "t1", "t2", "times", "one", "drawn", "source_no", "size_", "rows", "copies_",
]


def marked(df):
    return df.withColumns({c: F.lit(f"own {i}") for i, c in enumerate(TAKEN)})


def comes_back(df):
    assert set(TAKEN) <= set(df.columns)
    rows = df.select(*TAKEN).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"own {i}" for i in range(len(TAKEN)))]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"{'abcdefgh'[(i * j) % 8]}{i}{j}" for j in range(60 + i)), "en", "st"[i % 2], 9) for i in range(40)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), (1, "", "en", None, 0)], DOCS)


def test_columns_of_the_caller_come_back(spark, docs):
    comes_back(packing.pack(marked(docs.select("doc_id", F.length("text").alias("len"))), "len", ["doc_id", "len"]))
    comes_back(sharding.assign(marked(docs.select("doc_id")), "doc_id", [1.0, 2.0], [1.0, 2.0, 1.0]))
    comes_back(mixing.mix(marked(docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size")))))
    comes_back(quality.judge(marked(docs), docs.select("doc_id").limit(9)))
    comes_back(minhash.without_near_duplicates(marked(docs)))


def test_stages_give_back_all_columns(spark, docs):
    plain = {n: s for n, s in corpus_pipeline.STAGES[:-1]}
    extra = marked(docs.withColumns({c: F.lit(7) for c in ("kept", "score", "copies", "target", "bucket", "n_words")}))
    for name, stage in plain.items():
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns, name
        comes_back(out)
        same = lambda d: Counter((r["doc_id"], r["text"]) for r in d.collect())
        if name != "source_mixing":  # whose draws follow from what it sees
            assert same(out) == same(stage(spark, docs, SF)), name
        assert out.where("kept <> 7 or score <> 7 or copies <> 7").count() == 0


@pytest.fixture
def uncoalesced(spark):
    """Partitions of a few bytes stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_equal_rows_are_spread(spark, uncoalesced):
    n = 300_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(12).cast("long").alias("len")).unionByName(spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("len")))
    packed = packing.pack(rows, "len", ["doc_id", "len"], buckets=3, budget=120).checkpoint()
    assert packed.count() == n + 1000 and packed.dropDuplicates(["bucket", "batch", "place"]).count() == n + 1000
    per = packed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per < 0.8 * n
    slots = sharding.assign(rows, "doc_id", [1.0] * 3, [1.0] * 4).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("d")).collect()
    assert sum(r["n"] for r in slots) == n + 1000 and all((r["low"], r["high"], r["d"]) == (0, r["n"] - 1, r["n"]) for r in slots)


def test_equal_rows_share_a_mix(spark):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(3).cast("long").alias("size")).unionByName(spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "b").otherwise("c").alias("source"), (F.col("id") % 40).alias("size")))
    out = mixing.mix(rows)
    r = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.count("*").alias("n")).collect()
    assert sum(x["n"] for x in r) == 50_900
    assert all(abs(x["taken"] - x["target"]) <= 40 and x["most"] <= 2 for x in r)
    equal = out.where("doc_id is null").agg(F.max("copies") - F.min("copies")).first()[0]
    assert equal <= 1


def test_number_rows_follows_the_rows(spark):
    rows = spark.createDataFrame([(i % 5, i % 3, None if i % 4 else 1) for i in range(500)], "g int, a int, b int")
    one = common.number_rows(rows, ["g"], ["a", "b"], "at").collect()
    two = common.number_rows(rows.repartition(7, "a"), ["g"], ["a", "b"], "at").collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    assert sorted((r["g"], r["at"]) for r in one) == [(g, k) for g in range(5) for k in range(100)]
    assert common.number_rows(rows.limit(0), ["g"], ["a"], "at").count() == 0


def thue_morse(k: int, a: str, b: str) -> str:
    for _ in range(k):
        a, b = a + b, b + a
    return a


def test_thue_morse_words_are_different_words(spark):
    """Words that a sum of letters times powers of any odd number modulo 2**64 confuses."""
    x, y = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    assert len(x) == 2048 and x != y
    for width in (1, 2, 5):
        sets = shingle_sets(pa.array([x, y, x.upper(), f"q {x} r s t", f"q {y} r s t"]), width)
        assert sets[0].tolist() != sets[1].tolist() and sets[0].tolist() == sets[2].tolist() and len(set(sets[3]) & set(sets[4])) == {1: 4, 2: 2, 5: 0}[width]
    for width in (2, 5):
        got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string"), width=width).collect()}
        assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_words_of_long_texts_are_those_of_short_ones():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcXYZé"), n)) for n in rng.integers(1, 60, 400)]
    giant = "Q" * (PIECE * 2 + 5)
    long = " ".join(words * 600)
    assert len(long.encode()) > PIECE
    short = shingle_sets(pa.array([" ".join(words * 2)]), 2)[0]
    assert shingle_sets(pa.array([long]), 2)[0].tolist() == short.tolist()
    a, b = shingle_sets(pa.array([f"{giant} x", f"{long} {giant}\n x"]), 2)
    assert set(a) <= set(b) and len(shingle_sets(pa.array([giant.lower(), giant]), 1)[0]) == 1


def test_the_tree_of_pivots_by_hand(spark, monkeypatch):
    """Slots, levels and the last residuals of each source, pair after pair in Python."""
    from tests.llm.test_operators import pivot_by_hand

    monkeypatch.setattr(mixing, "FAN", 3)
    rng = np.random.default_rng(12)
    n, slots = 400, 20
    data = [(int(rng.integers(1, 4)), float(rng.random()), float(rng.integers(1, 90)), int(rng.integers(-(2**63), 2**63 - 1))) for _ in range(n)]
    rows = spark.createDataFrame(data, "source_no int, p double, size double, key long")
    hashed = {r["key"]: (r["slot"], r["last"]) for r in rows.select("key", F.pmod(F.xxhash64("key", F.lit(mixing.SEED)), F.lit(slots)).alias("slot"), F.shiftrightunsigned(F.xxhash64("key", F.lit(mixing.SEED + 1)), 11).alias("last")).collect()}
    level = [(no, hashed[k][0], p, size, k) for no, p, size, k in data]
    want, left = {}, slots
    while True:
        groups = {}
        for row in level:
            groups.setdefault(row[:2], []).append(row)
        level = []
        for (no, slot), own in groups.items():
            own.sort(key=lambda r: (-r[3], r[4]))
            for r, p in zip(own, pivot_by_hand([r[2] for r in own], [r[3] for r in own], [r[4] % 2**64 for r in own]), strict=True):
                if 0 < p < 1:
                    level.append((no, slot // 3, p, r[3], r[4]))
                else:
                    want[r[4]] = p
        if left == 1:
            break
        left = -(-left // 3)
    want |= {k: float(hashed[k][1] * 2.0**-53 < p) for _, _, p, _, k in level}
    assert len(level) <= 3  # one residual a source
    got = {r["key"]: r["p"] for r in mixing.copies(rows.repartition(4), slots).collect()}
    assert got == want
