"""Alignment by distinct segments against whole texts, tokenised and walked through token by token."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featherloom.llm import alignment
from featherloom.llm.texthash import text_bytes
from tests.conftest import SF

FILES = [f"{alignment.TOKENIZERS}/{x}" for x in (alignment.BYTE_BPE, alignment.PIECE_BPE)]


@pytest.fixture(scope="module")
def both():
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        return alignment.Tokenizers(f.read(), g.read())


def walked(both, text):
    """(A ids, B ids, groups, links) of a whole text, or None."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    if not b"".join(x) == b"".join(y) == (" " + text).encode():
        return None
    i = j = end_a = end_b = 0
    groups, links, left, right = [], [], [], []
    while i < len(a):
        links.append((a[i], b[j]))
        stop_a, stop_b = end_a + len(x[i]), end_b + len(y[j])
        if stop_a <= stop_b:
            left, end_a, i = [*left, a[i]], stop_a, i + 1
        if stop_b <= stop_a:
            right, end_b, j = [*right, b[j]], stop_b, j + 1
        if stop_a == stop_b:
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            left, right = [], []
    return a, b, groups, links


def expected(both, texts):
    found = [walked(both, t) for t in texts]
    count, most = Counter(x for f in found if f for x in set(f[3])), defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[x] == most[x[0]] for x in f[3]), sum(count[x] for x in f[3]), ";".join(f[2])) for f in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def aligned(spark, texts, parts=3, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_a": F.lit("x"), "groups": F.lit(1), "block": F.lit(2)})
    rows = sorted(alignment.align(docs.repartition(parts), **more).collect())
    return [tuple(r[c] for c in COLUMNS) for r in rows]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a b", "a  b", "a \n b", "a\tb", "a \t", "\n\n x", "a  b", "a  b   c", "x  y　 z", "x  y​ z \x85 w\x1c v", "it's they'll  we 've", "<|endoftext|> </s> <0x0A> <s>",
    "a▁b", "▁", "a ▁ b", "日本語 の テキスト 漢字", "😀 😀😀 é é ﬁ", "\x00 \x01 \x7f", "naïve  café — “quoted” …", "12 345.67 8%", "a b", "a b", "über Straße " * 3, "x" * 5000, " ".join("ab" * 50), "tail   ", "\r\n a \r\n",
]


def test_equals_whole_texts(spark, both):
    rng = random.Random(4)
    letters = ["a", "B", " ", " ", "  ", "\n", "\t", "é", " ", " ", "'s", "ing", "the", "9", ".", "漢", "😀", "▁", "<", "\x85", "\x1f"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    assert aligned(spark, texts) == expected(both, texts)


def test_digest_long_texts_and_partitions(spark, both):
    rng = random.Random(6)
    word = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(word) for _ in range(200_000)), "y" * 300_000, *ODD, "again and again"]
    want = expected(both, texts)
    assert aligned(spark, texts, 1) == want
    assert aligned(spark, texts, 5, digest=True) == [(*w[:-1], w[-1] and hashlib.sha256(w[-1].encode()).hexdigest()) for w in want]


def test_rows_without_ids_repeated_and_none(spark, both):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.align(docs).collect()), key=str)
    one = expected(both, ["a b", "a b", "a b"])[0]
    assert got == sorted([(None, *one), (None, *one), (1, *one), (1, 0, 0, 0, 0, 0, 0, "")], key=str)
    assert alignment.align(docs.limit(0)).count() == 0
    assert [r["groups"] for r in alignment.align(docs.where("text is null")).collect()] == [""]


def test_cuts_are_verified(both):
    rules = json.load(open(FILES[0], encoding="utf-8"))
    assert both.cuts
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "use_regex": False}}, {"pre_tokenizer": None}):
        assert not alignment.cuts_hold(rules | change, both)

    class Crossing:
        a_bytes, b, pieces = [*both.a_bytes, b"of the"], both.b, both.pieces

    assert not alignment.cuts_hold(rules, Crossing)
    Crossing.a_bytes, Crossing.pieces = both.a_bytes, [*both.pieces, "of▁the"]
    assert not alignment.cuts_hold(rules, Crossing)


def test_one_segment_where_cuts_do_not_hold():
    data, ends = text_bytes(pa.array(["a b  c", None, "", "d e"]))
    raw, offsets, count = alignment.segments(data, ends)
    cut = lambda o: [raw.tobytes()[i:j].decode() for i, j in zip(o[:-1], o[1:], strict=True)]
    assert cut(offsets) == [" a", " b", "  c", " d", " e"] and count.tolist() == [3, 0, 0, 2]
    _, whole, count = alignment.segments(data, ends, cuts=False)
    assert cut(whole) == [" a b  c", " d e"] and count.tolist() == [1, 0, 0, 1]


def test_query_over_the_table(spark, duck, both):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, expected(both, docs.values()), strict=True))
    got = alignment.op13(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        *numbers, groups = want[r["doc_id"]]
        assert [r[c] for c in COLUMNS[:-1]] == numbers and r["groups_sha256"] == (groups and hashlib.sha256(groups.encode()).hexdigest())


def test_units_survive_packing():
    from featherloom.llm.units import packed, unpacked

    for x in (np.empty(0, np.int64), np.arange(7, dtype=np.uint16), np.array([-1, 5], np.int32)):
        y = unpacked(packed(x))
        assert y.dtype == x.dtype and y.tolist() == x.tolist()
