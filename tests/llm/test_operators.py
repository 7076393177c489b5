"""Each operator on awkward tables, and against brute force on small ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featherloom.llm import chat, minhash, mixing, neighbours, packing, quality, sharding, suffix_dedup, toxicity, url_filter
from featherloom.llm.common import word_count
from featherloom.llm.texthash import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßø") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 150))) for _ in range(12)]
    texts = []
    for b in base:
        texts += [b, b, b.upper() if rng.random() < 0.3 else b]
        for edits in (1, 2, 4, 8, 12):
            w = b.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary) + "x"
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [f"{rng.choice(vocabulary)} {passage} {rng.choice(vocabulary)}" for _ in range(6)]
    texts += ["", None, " \t\n", "one", "one", "One", "a b", "é" * 300, "la " * 400, "x" * 99, "x" * 100, "x" * 101, " ".join(vocabulary * 20)]
    rng.shuffle(texts)
    return texts


def odd_docs(spark):
    """Nulls everywhere, repeated rows, one id with two texts, clashing and extra columns."""
    rows = [(None, None, None, None, None), (1, "a b c " * 40, "en", "s", 1), (1, "a b c " * 40, "en", "s", 1), (1, "other text", None, None, 2), (2, "", "en", "t", 0), (3, "a b c " * 40, "de", "t", 5), (None, "a b c " * 40, "en", None, None)]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit(9) for c in ("kept", "score", "size", "shard", "slot", "bucket", "target", "removed", "node")})


# op2 ---------------------------------------------------------------------------------------------


def shingles(text, width):
    w = [x for x in WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_groups(texts, width):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, corpus, width):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, corpus), width=width).collect()}
    want = near_groups(corpus, width)
    assert got == {i: (n, c, i == c) for i, (n, c) in enumerate(want)}


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join([f"x{k}_{i}" if i < 4 * k else w for i, w in enumerate(words)] if k % 2 else [f"y{i}" if i < 4 * k else w for i, w in enumerate(words)]) for k in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, chain), width=2).collect()}
    assert got == {i: c for i, (_, c) in enumerate(near_groups(chain, 2))}


def test_a_family_just_under_the_threshold_keeps_every_link(spark, monkeypatch):
    """Texts that share buckets but are seldom linked go through the blocks of sets."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(150)]
    texts = [" ".join([*common, *(f"own{k // 3}_{i}" for i in range(36)), *(f"x{k}_{i}" for i in range(rng.randint(1, 20)))]) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts), width=2).collect()}
    want = {i: c for i, (_, c) in enumerate(near_groups(texts, 2))}
    assert got == want and 5 < len(set(want.values())) < 60


def test_near_duplicates_of_odd_rows(spark):
    rows = minhash.near_duplicates(odd_docs(spark), width=2).collect()
    assert len(rows) == 7
    assert {r["component_id"] for r in rows if r["n_shingles"] == 3} == {1}
    assert minhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0
    kept = minhash.without_near_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    # The repeated text once, the other text of its id, and a row each for null and empty text.
    assert sorted((str(r["doc_id"]), r["text"] and r["text"][:5]) for r in kept.collect()) == [("1", "a b c"), ("1", "other"), ("2", ""), ("None", None)]
    assert minhash.without_near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_texts_without_an_id_link_no_strangers(spark):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, words[0], "en", "s", 0), (2, words[1], "en", "s", 0), (None, words[0] + " x", "en", "s", 0), (None, words[1] + " x", "en", "s", 0), (None, words[2], "en", "s", 0)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == {(1, 1, True): 1, (2, 2, True): 1, (None, 1, False): 1, (None, 2, False): 1, (None, None, True): 1}


def test_sketches_fill_and_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 1000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (minhash.sketch(x) != 0).all()
    seen = []
    for _ in range(30):
        x = rng.integers(0, 2**64, 600, dtype=np.uint64)
        a, b = np.unique(x[:540]), np.unique(x[60:])
        seen.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(seen) - 480 / 600) < 0.02


def test_shingle_sets_follow_the_words():
    column = pa.array(["A b  a\tb", "a", None, "", "a b", "é É", "b a"])
    got = shingle_sets(column, 2)
    assert [len(x) for x in got] == [2, 1, 0, 0, 1, 1, 1]
    assert set(got[4]) < set(got[0]) and set(got[6]) < set(got[0])


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_long_texts_are_hashed_in_pieces_alike(monkeypatch, corpus, piece):
    from featherloom.llm import texthash

    texts = [t for t in corpus if t and len(t) > 70] + ["a" * 500 + " b " + "c" * 100, " " * 90, "x" * 200]
    whole = [shingle_sets(pa.array([t]), 3)[0].tolist() for t in texts]
    monkeypatch.setattr(texthash, "PIECE", piece)
    assert [shingle_sets(pa.array([t]), 3)[0].tolist() for t in texts] == whole


# op5 ---------------------------------------------------------------------------------------------


def cut_by_hand(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def digest5(df):
    rows = df.select("doc_id", "n_bytes", "kept", "removed").collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]) // 2, hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows}


def test_repeats_against_all_windows(spark, corpus):
    assert digest5(suffix_dedup.cut_repeats(docs_of(spark, corpus))) == dict(enumerate(cut_by_hand(corpus)))


def test_repeats_across_pieces_of_a_long_text(spark, monkeypatch, corpus):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd ") for _ in range(500))
    long = "".join(rng.choice("efgh ") for _ in range(1500)) + passage + "".join(rng.choice("efgh ") for _ in range(1500))
    b = np.frombuffer(long.encode(), np.uint8)
    whole = suffix_dedup.sampled_runs(b, np.array([0, len(b)]))
    assert whole[4].sum() == len(b) - 99
    assert digest5(suffix_dedup.cut_repeats(docs_of(spark, [passage, long, passage + long]))) == dict(enumerate(cut_by_hand([passage, long, passage + long])))


def test_a_common_triple_in_many_contexts_is_no_repeat(spark):
    """Two texts that share 24 bytes, whose names once met in 32 bits."""
    one = "ijzvomcklsxcfpasgmzjluemgfpjzjgmtukiagoeqmvzwzymfeppqidxceipwvwcwhiixqfbmeskaxgcizyiyzbasifgaggrnwtemqkihlszyrwkogmdinxzejipbmzcyibjztjcgyefogsopvfnewrqbgbeqbknovxshijbgqgilxazjdmzdasktprcntqrguizkuzc"
    two = "zghnfhvbythkdadjstgbcltsfazeliavzyzypuqgerxpvojirlxevgpcgvldcbwaitpdaawiyprcrqfsrlchcgkosifgaggrnwtemqkihlszyrwkzircwziffdelsjlimstehgjipnhtfltktgodemancvpwdxbwnontwlrcsjcuhocennhzhrcdxerctdidczerajpy"
    assert [(r["doc_id"], len(r["kept"])) for r in suffix_dedup.cut_repeats(docs_of(spark, [one, two])).orderBy("doc_id").collect()] == [(0, 200), (1, 200)]


@pytest.mark.parametrize("often", [2, 64])
def test_names_dealt_by_both_lose_no_repeat(spark, monkeypatch, often):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", often)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    line = " ".join(word() for _ in range(14))
    halves = [" ".join(word() for _ in range(12)) for _ in range(12)]
    texts = [f"{rng.choice(halves)} {line} {rng.choice(halves)}" for _ in range(300)]
    found = suffix_dedup.spread_names(docs_of(spark, texts).select(F.col("doc_id").alias("dk"), "text", F.lit(0).alias("th")))
    assert all(len(x) > 0 for x in found)
    assert digest5(suffix_dedup.cut_repeats(docs_of(spark, texts).repartition(6))) == dict(enumerate(cut_by_hand(texts)))


def test_a_very_long_text_is_read_in_pieces_alike(monkeypatch, corpus):
    from featherloom.llm import texthash

    texts = [" ".join(t for t in corpus if t)[:4000], *[t or "" for t in corpus[:20]], " ".join(t for t in corpus if t)[1000:5000]]
    ids, th = pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64())
    found = lambda: np.concatenate([np.stack([r[0], r[3], r[4], r[5]]) for r in suffix_dedup._found(pa.RecordBatch.from_arrays([ids, th, pa.array(texts)], ["dk", "th", "text"]))], 1)
    whole = found()
    listed = [suffix_dedup.run_of(*whole[1:, whole[0] == i]).tolist() for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([ids, th, pa.array(texts), pa.array(listed, pa.list_(pa.int64()))], ["dk", "th", "text", "runs"])
    rows = lambda f: sorted(tuple(r.values()) for b in f([batch]) for r in b.to_pylist())
    blocks, windows = rows(suffix_dedup._blocks(np.empty(0, np.uint64))), rows(suffix_dedup._windows)
    monkeypatch.setattr(suffix_dedup, "PIECE", 200)
    monkeypatch.setattr(texthash, "RUN", 150)
    seen = found()
    assert all(seen[2][seen[0] == i].sum() == max(0, len(t.encode()) - 99) for i, t in enumerate(texts))
    assert rows(suffix_dedup._blocks(np.empty(0, np.uint64))) == blocks and rows(suffix_dedup._windows) == windows and len(windows) > 7000


def test_repeats_of_odd_rows(spark):
    rows = suffix_dedup.cut_repeats(odd_docs(spark)).collect()
    assert len(rows) == 7 and sum(len(r["kept"]) for r in rows) > 0
    both = suffix_dedup.without_repeats(odd_docs(spark))
    assert both.columns == odd_docs(spark).columns and both.count() == 7
    assert suffix_dedup.cut_repeats(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_equal_rows_are_one_document_in_one_batch_too(spark, corpus, parts):
    words = sorted({w for t in corpus for w in (t or "").split()})
    passage = " ".join(words[:60])
    texts = [passage + " one", " ".join(words[60:120]), "two " + passage]
    want = cut_by_hand(texts)
    rows = [(i, texts[i], "en", "s", 0) for i in (0, 1, 2, 0, 1, 2, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(parts) if parts > 1 else spark.createDataFrame(rows, DOCS).coalesce(1)
    got = [(r["doc_id"], (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]) // 2, hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in suffix_dedup.cut_repeats(df).collect()]
    assert sorted(got) == sorted((r[0], want[r[0]]) for r in rows)
    assert want[0][1] == want[1][1] == 0 < want[2][1]


# op4 ---------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST] \\ [\\\\/INST] <\\s> <s>", "[[INST]", "", None, "a\nb", "<</s>", "[INST", "\\"]
    rows, want = [], defaultdict(list)
    rng = random.Random(2)
    for c in range(40):
        for k in range(rng.randint(1, 7)):
            role, text = rng.choice(["user", "assistant", "system", "assistant", None, "[/INST]"]), rng.choice(hard)
            rows.append((c, k, role, text))
            want[c].append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(df)).collect()}
    for c, turns in want.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.expand(df)
    replies = sum(r == "assistant" for t in want.values() for r, _ in t)
    assert examples.where("loss_end > loss_start or formatted like '%</s>'").count() >= replies > 0
    odd = spark.createDataFrame([(None, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b")], "conv_id long, turn long, role string, text string")
    clashing = odd.withColumns({c: F.lit(9) for c in ("example", "part", "at", "end", "whole", "formatted")})
    assert {r["conv_id"]: r["n_turns"] for r in chat.digest(chat.expand(clashing)).collect()} == {None: 1, 1: 2}
    long = spark.createDataFrame([(1, 0, "user", "<s> x" * 400_000), (1, 1, "assistant", "[INST]" * 200_000)], "conv_id long, turn long, role string, text string")
    one = chat.digest(chat.expand(long)).first()
    assert (one["loss_chars"], one["loss_sha256"]) == (1_200_000, hashlib.sha256(b"[INST]" * 200_000).hexdigest())
    assert chat.digest(chat.expand(odd.limit(0))).count() == 0


def test_only_the_reply_is_trained(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (1, 3, "assistant", "no"), (1, 4, "user", "bye")], "conv_id long, turn long, role string, text string")
    rows = chat.expand(df).orderBy("example").collect()
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in rows] == ["yes", "no", ""]
    assert rows[1]["formatted"] == "[INST]user<s>hi[/INST]yes</s>[INST]user<s>so[/INST]no</s>"


# op1 ---------------------------------------------------------------------------------------------


def test_rules_and_urls(spark):
    urls = ["http://A.Net/x", "http://a.net", "http://b.example.net/en/1", "http://example.com/de/", "http://fr.org/fr/?q", "notnet.example.com/de/", "x://planet/", None, "", "http://h.example.com?/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, good int")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [("a.net", "/x", "net/"), ("a.net", "", None), ("b.example.net", "/en/1", "example.net/en/"), ("example.com", "/de/", "example.com/de/"), ("fr.org", "/fr/", "org/fr/"), ("", "", None), ("planet", "/", None), ("", "", None), ("", "", None), ("h.example.com", "", None)]
    assert [got[i]["verdict"] for i in range(4)] == ["block", "allow", "allow", "block"]


def test_bad_hosts_are_blocked_and_unknown_ones_are_not(spark):
    pages = [(i, f"http://{'bad' if i < 60 else 'good' if i < 300 else f'new{i}'}.example.org/{i}") for i in range(320)]
    outcomes = [(i, 0 if i < 55 else 1) for i in range(300)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    assert Counter(got[i] for i in range(60)) == {"block": 60} and Counter(got[i] for i in range(60, 320)) == {"allow": 260}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, url_filter.page_outcomes(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_registered_domains_follow_the_suffix_rules(spark):
    hosts = ["a.co.uk", "x.b.co.uk", "co.uk", "uk", "h.example.com", "example.com", "www.site.org", "a.b.city.jp", "c.city.jp", "main.city.jp", "", "a.co.uk:80"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *url_filter.domains(F.col("host"), (*url_filter.PLATFORMS, "*.city.jp", "!main.city.jp"))).collect()
    want = [("co.uk", "a.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("example.com", "h.example.com"), ("example.com", "example.com"), ("org", "site.org"), ("b.city.jp", "a.b.city.jp"), ("c.city.jp", "c.city.jp"), ("jp", "city.jp"), ("", ""), ("co.uk", "a.co.uk")]
    assert [tuple(r)[1:] for r in got] == want
    pages = [(i, f"http://w{i % 4}.{'a' if i < 80 else 'b'}.co.uk/{i}") for i in range(160)]
    df, good = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(i, int(i >= 80)) for i in range(160)], "page_id long, good int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df.withColumn("verdict", F.lit(1)).unionByName(df.withColumn("verdict", F.lit(1)).limit(1)), good).collect()}
    assert all(got[i] == ("block" if i < 80 else "allow") for i in range(160))


# op6, op7, op3 -----------------------------------------------------------------------------------


def rendezvous_by_hand(keys, shards):
    """Spark's 64-bit hash of (key, shard), then the least bid, in Python."""
    import math

    import xxhash

    def bid(k, s):
        h = xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), h)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53)

    return [min(range(shards), key=lambda s: (bid(k, s), s)) for k in keys]


def test_rendezvous_against_python(spark):
    keys = [*range(-50, 400), 2**62]
    got = sharding.assign(spark.createDataFrame([(k,) for k in keys], "k long"), "k", [1.0] * 24, [1.0] * 25).collect()
    by = {r["k"]: r for r in got}
    assert [by[k]["shard"] for k in keys] == rendezvous_by_hand(keys, 24) and [by[k]["grown_shard"] for k in keys] == rendezvous_by_hand(keys, 25)


def test_places_are_the_same_in_any_session(spark, monkeypatch):
    from featherloom.llm import common

    monkeypatch.setattr(common, "SLOT_ROWS", 100)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 301).alias("n"))
    seen = []
    for parts in ("4", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append((sorted(map(tuple, packing.pack(docs, "n", ["doc_id"]).collect())), sorted(map(tuple, sharding.assign(docs, "doc_id", [1.0] * 5, [1.0] * 6).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_rendezvous(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    rows = sharding.assign(df, "k", [1.0] * 8, [1.0] * 9).collect()
    n = Counter(r["shard"] for r in rows)
    assert set(n) == set(range(8)) and max(n.values()) < 1.1 * 2500
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and abs(sum(r["grown_shard"] == 8 for r in rows) / 20_000 - 1 / 9) < 0.02
    for s in n:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    heavy = Counter(r["s"] for r in df.select(sharding.shard_of(F.col("k"), [3.0, 1.0, 0.0]).alias("s")).collect())
    assert set(heavy) == {0, 1} and abs(heavy[0] / 20_000 - 0.75) < 0.02
    odd = sharding.assign(odd_docs(spark).select("doc_id", "text", "shard"), "doc_id", [1.0] * 3, [1.0] * 4)
    assert odd.count() == 7 and sorted(r["slot"] for r in odd.where("doc_id = 1").collect())[0] >= 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [0.0])


def test_targets_fill_up_to_their_caps(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    # 1.5 * 1115 words by weights 3, 1, 2, 3: a and the null source stop at 20 and 10, b at 200
    assert got["a"] == 20 and got[None] == 10 and got["b"] == 200 and got["c"] == pytest.approx(1672.5 - 230)


def test_mix_reaches_targets_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, f"s{i % 5}" if i % 7 else None, rng.randint(0, 300)) for i in range(3000)], "doc_id long, source string, size long").withColumn("target", F.lit(1))
    one = mixing.mix(rows).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    two = mixing.mix(rows.repartition(9)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(map(tuple, one)) == Counter(map(tuple, two)) and len(one) == 3000
    taken, target = defaultdict(int), {}
    for r in one:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 300 for s, t in target.items())
    assert mixing.mix(rows.limit(0)).count() == 0
    assert mixing.mix(odd_docs(spark).select("doc_id", "source", word_count(F.col("text")).alias("size"))).count() == 7


def test_pivot_keeps_words_and_leaves_one():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 50, 500).astype(float)
    out = mixing.pivot(p, size, rng.integers(0, 2**63, 500).astype(np.uint64), np.zeros(500, int))
    assert ((out > 0) & (out < 1)).sum() <= 1 and (out * size).sum() == pytest.approx((p * size).sum())
    mean = np.mean([mixing.pivot(np.array([0.3, 0.6, 0.5]), np.array([1.0, 2.0, 4.0]), rng.integers(0, 2**63, 3).astype(np.uint64), np.zeros(3, int)) for _ in range(4000)], axis=0)
    assert np.abs(mean - [0.3, 0.6, 0.5]).max() < 0.03


def pivot_by_hand(p, size, key):
    """One group, pair after pair: the same draws, one float at a time."""
    p, turn = list(p), 0
    while True:
        open_ = [i for i, x in enumerate(p) if 0 < x < 1]
        if len(open_) < 2:
            return p
        for i, j in zip(open_[::2], open_[1::2]):
            x = min((1 - p[i]) * size[i], p[j] * size[j])  # words that may move from j to i
            y = min(p[i] * size[i], (1 - p[j]) * size[j])
            u = int(mixing.mix64(np.array([key[i]], np.uint64) ^ mixing.mix64(np.array([key[j]], np.uint64) + np.uint64(turn)))[0] >> np.uint64(11)) * 2.0**-53
            if u * (x + y) < y:
                p[i], p[j] = (1.0, p[j] - x / size[j]) if (1 - p[i]) * size[i] < p[j] * size[j] else (p[i] + x / size[i], 0.0)
            else:
                p[i], p[j] = (0.0, p[j] + y / size[j]) if p[i] * size[i] < (1 - p[j]) * size[j] else (p[i] - y / size[i], 1.0)
        turn += 1


def test_pivot_against_pairs_one_by_one():
    rng = np.random.default_rng(5)
    for n in (2, 3, 10, 77):
        group = np.repeat([0, 1], [n, n + 1])
        p, size, key = rng.random(len(group)), rng.integers(1, 500, len(group)).astype(float), rng.integers(0, 2**63, len(group)).astype(np.uint64)
        want = np.concatenate([pivot_by_hand(p[group == g], size[group == g], key[group == g]) for g in (0, 1)])
        assert np.abs(mixing.pivot(p, size, key, group) - want).max() < 1e-9


def test_buckets_of_a_table_pad_least(spark, corpus):
    n = [len(WORDS.findall(t or "")) for t in corpus]
    rows = packing.packed_documents(docs_of(spark, corpus)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter(enumerate(n))
    x = sorted(n)
    best = [[0.0] * (len(x) + 1)] + [[float("inf")] * (len(x) + 1) for _ in range(packing.BUCKETS)]
    best[0] = [0.0] + [float("inf")] * len(x)
    for k in range(1, packing.BUCKETS + 1):
        best[k][0] = 0.0
        for j in range(1, len(x) + 1):
            best[k][j] = min(best[k - 1][i] + sum(x[j - 1] - v for v in x[i:j]) for i in range(j))
    assert sum(r["bucket_len"] - r["n_tokens"] for r in rows) == best[packing.BUCKETS][len(x)]
    for b in {r["bucket"] for r in rows}:
        own = [r for r in rows if r["bucket"] == b]
        held = max(1, packing.BUDGET // max(1, own[0]["bucket_len"]))
        assert sorted(r["batch"] * held + r["place"] for r in own) == list(range(len(own)))


def test_bucket_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.unique(rng.integers(0, 60, 9))
        c = rng.integers(1, 9, len(x))
        cost = lambda ends: sum(n * (min(e for e in ends if e >= v) - v) for v, n in zip(x, c))  # noqa: E731, B023
        for k in (1, 2, 3):
            best = min(cost([*e, x[-1]]) for m in range(k) for e in combinations(x[:-1], m))
            ends = packing.boundaries(x, c, k)
            assert len(ends) <= k and cost(ends) == best


def test_packing_holds_the_budget(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.choice([0, 3, 50, 51, 400, 20_000, None])) for i in range(500)], "doc_id long, n long")
    out = packing.pack(rows.withColumn("bucket", F.lit("x")), "n", ["doc_id"], 3, 1000).collect()
    assert len(out) == 500
    batches = defaultdict(list)
    for r in out:
        assert r["n"] <= r["bucket_len"]
        batches[r["bucket"], r["batch"]].append(r)
    for b in batches.values():
        assert len(b) == 1 or len(b) * b[0]["bucket_len"] <= 1000
        assert sorted(r["place"] for r in b) == list(range(len(b)))
    assert packing.pack(rows.limit(0), "n", ["doc_id"]).count() == 0
    assert packing.packed_documents(odd_docs(spark)).count() == 7


# op8, op9, op10 ----------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_accepts_what_the_distance_says():
    rng = random.Random(8)
    terms = list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(25)})
    fuzzy = [len(t) >= 5 for t in terms]
    a = toxicity.Automaton(terms, fuzzy)
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        near = [(d, k) for k, t in enumerate(terms) if (d := distance(w, t)) == 0 or (d == 1 and fuzzy[k])]
        got = a.match(w)
        assert (got is None) == (not near) and (not near or got[0] == min(near)[0])


def test_quoted_terms_count_apart():
    r = toxicity.Reader(["idiot"], [1.0], [True])
    assert r.features("you idiot")[0] > 0 and r.features("you idiott")[1] > 0
    for text in ('he wrote "idiot" in a letter', "they said 'idiot' to him", '"you are an idiot," she said'):
        assert r.features(text)[0] == 0 and r.features(text)[2] > 0, text
    for text in ("don’t be an idiot, he’s here", "he said you idiot", "that's an idiot isn't it"):
        assert r.features(text)[0] > 0 and r.features(text)[2] == 0, text
    assert not r.features(None).any() and not r.features("").any()


def test_toxic_documents_are_found_in_the_held_out_fold(spark):
    rng = random.Random(6)
    plain, bad = [f"word{i}" for i in range(200)], ["grobian", "scoundrel", "blackguard"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if toxic:
            t = rng.choice(bad)
            w[rng.randrange(30)] = t if rng.random() < 0.8 else t[:3] + "z" + t[3:]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None), (5000, ""), (5001, "plain " * 300_000 + bad[0])], "doc_id long, text string").withColumn("score", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lab).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[5000] < 0.5 < 0.7 <= got[5001] and len(got) == 903
    assert {r["score"] for r in toxicity.score(docs, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), lab).count() == 0


def test_terms_that_clean_documents_quote_are_scored_by_their_use(spark):
    rng = random.Random(7)
    plain, bad = [f"word{i}" for i in range(200)], ["grobian", "scoundrel", "blackguard"]
    rows, labels, kinds = [], [], []
    for i in range(2000):
        kind = {0: "used", 10: "used", 5: "quoted"}.get(i % 20, "plain")
        w = [rng.choice(plain) for _ in range(30)]
        t = rng.choice(bad)
        t = t if rng.random() < 0.7 else t[:3] + "z" + t[3:]
        if kind != "plain":
            w[rng.randrange(2, 28)] = t if kind == "used" else f'wrote "{t}"'
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind == "used")))
        kinds.append(kind)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert set(bad) <= set(toxicity.learn_lexicon(toxicity.labelled_sample(docs, lab))[0])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lab).collect()}
    share = lambda kind: np.mean([got[i] >= toxicity.THRESHOLD for i, k in enumerate(kinds) if k == kind and zlib.crc32(str(i).encode()) % 3 == 1])
    assert share("used") > 0.85 and share("quoted") < 0.1 and share("plain") < 0.03


def base_by_hand(text):
    w, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c, covered = Counter(tri), set()
    for k, x in enumerate(tri):
        if c[x] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_rules_against_python(spark, corpus):
    texts = [*corpus, "a b c a b c", "a b c d", "x\nx\n \n\ny\r\nx", "# $ <b>\n# $ <b>", "a a a a", "a\x0bb\x0cc\x85d\u00a0e", "😀 é # é"]
    got = {r["doc_id"]: r for r in quality.base_rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_by_hand(t), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def ratio_by_hand(texts, trusted):
    """Scores of the n-gram ratio, over the same buckets."""
    import math
    import string

    import xxhash

    def grams(t):
        tokens = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("([" + re.escape(string.punctuation) + "]+)", r" \1 ", t or "")) if x]
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in tokens]
        two = [xxhash.xxh64_intdigest(y.to_bytes(8, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)) for x, y in zip(one, one[1:])]
        return [x % quality.BUCKETS for x in one + two]

    each = [grams(t) for t in texts]
    every, own = Counter(g for x in each for g in x), Counter(g for i, x in enumerate(each) if i in trusted for g in x)
    share = sum(own.values()) / max(1, sum(every.values()))
    ratio = lambda g: round(1e6 * math.log((own[g] + quality.PRIOR) / (every[g] * share + quality.PRIOR)))
    return [sum(map(ratio, x)) / max(1, len(x)) / 1e6 for x in each]


def test_ratio_against_python(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", "!?", "$"]) for _ in range(rng.randint(1, 200))) for _ in range(150)] + ["", None, "one", "...", "x" * 300_000 + " y"]
    trusted = set(range(0, 150, 3))
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    want = ratio_by_hand(texts, trusted)
    assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(want, abs=2e-6)
    assert all(got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= quality.THRESHOLD) for i in range(len(texts)))


def test_ratio_tells_junk_from_prose(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(200)]
    junk = [" ".join(rng.choice(words) + rng.choice(["***", "$$$"]) for _ in range(80)) for _ in range(60)]
    docs = docs_of(spark, good + junk)
    trusted = quality.trusted_ids(spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(250, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"] for r in quality.judge(docs, trusted).where("kept").select("doc_id").collect()} == set(range(200))
    odd = quality.judge(odd_docs(spark), trusted)
    assert odd.count() == 7 and odd.where("kept").count() == 0
    assert quality.judge(odd_docs(spark).limit(0), trusted.limit(0)).count() == 0


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[2000:2600] = x[7]  # copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [1.0, None] * 12), (9004, [1.0]), (None, [1.0] * 24), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y, hit = x.astype(float), 0
    for q in range(0, 3000, 50):
        s = neighbours.cosines(y[q], y)
        s[q] = -9
        want = np.lexsort((np.arange(3000), -s))[:5]
        hit += len({v for v, _ in got[q]} & set(want.tolist()))
        assert [v for v, _ in got[q]] == [v for _, v in sorted((-s[v], v) for v, _ in got[q])]
    assert set(got) == set(range(0, 3000, 50)) and hit / (5 * 60) >= 0.9
    assert [v for v, _ in got[2000]] == [7, 2001, 2002, 2003, 2004]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    few = neighbours.search(df.where("vec_id < 3"), df.where("vec_id = 0"))
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] != [] and few.count() == 2
