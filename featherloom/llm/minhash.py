"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set of shingles is thrown into ``BINS`` bins in rounds of fresh
hashes; a bin keeps the least value of the first round that reaches it, and
after ``BINS`` rounds each bin still empty is served by a round of its own. So
every coordinate fills, and the share of equal coordinates of two documents is
their Jaccard similarity, concentrated as for independent hashes. Bands of
coordinates give candidates, and full sets confirm them.

Copies are never compared pair by pair. Documents with equal sets are one
class, numbered once. Classes that share a bucket are a family, and what a class
shares with none of its family bounds every similarity it can have: shingles of
its own keep it out of buckets where no partner is small enough. In each bucket
that is left, all classes are compared with one hub, the one with the fewest
shingles of its own; linked ones then count as one component. Where a bucket
still holds several components, the classes outside a family's largest one are
compared with all of the family that share a band with them, in blocks of
about CHUNK by CHUNK sets, so that no table of pairs is made. No bucket is
capped. Joins on a bucket, class or hub are sort-merge joins on plain shuffles,
whose large keys Spark splits at run time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import parents
from ..plans.lineage import checkpointed
from .common import mix64, table
from .texthash import pieces, shingle_sets

BINS = 256  # a bin is the top 8 bits of a hash
ROWS = 5
BANDS = BINS // ROWS
SEEDS = mix64(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOW = np.uint64(2**48 - 1)
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
#: Sets of a block, about, and their shingles together.
CHUNK, CHUNK_SHINGLES = 48, 1 << 20


def sketch(h: np.ndarray) -> np.ndarray:
    """BINS coordinates of a non-empty sorted set of hashes."""
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)

    def take(m: np.ndarray, first: int) -> None:
        at = np.searchsorted(m, EDGES)
        hit = at < len(m)
        hit[hit] = (m[at[hit]] >> np.uint64(56)).astype(np.int64) == np.flatnonzero(hit)
        hit &= ~filled
        out[hit] = mix64(m[at[hit]] + np.uint64(first))
        filled[hit] = True

    take(h, 0)
    r = 1
    while r < BINS and not filled.all():
        k = min(BINS - r, max(1, 2048 // len(h)))
        m = mix64(h[None, :] ^ SEEDS[r : r + k, None])
        m = (m & (np.uint64(255) << np.uint64(56))) | (np.arange(k, dtype=np.uint64) << np.uint64(48))[:, None] | (m & LOW)
        # The place in the chunk is part of the value; chunks of equal sets need not be equal, so the round replaces it.
        m = np.sort(m, axis=None)
        at = np.searchsorted(m, EDGES)
        hit = at < len(m)
        hit[hit] = (m[at[hit]] >> np.uint64(56)).astype(np.int64) == np.flatnonzero(hit)
        hit &= ~filled
        got = m[at[hit]]
        out[hit] = mix64((got & LOW) ^ SEEDS[r + ((got >> np.uint64(48)) & np.uint64(255)).astype(np.int64)])
        filled[hit] = True
        r += k
    for b in np.flatnonzero(~filled):
        out[b] = mix64((mix64(h ^ SEEDS[BINS + b]) & LOW).min() ^ SEEDS[BINS + b])[0]
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for c in coordinates[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + c)
    return key


def _sign(width: int):
    def run(batches):
        for b in pieces(batches):
            sets = shingle_sets(b.column("text"), width)
            n = np.array([len(s) for s in sets], np.int64)
            h1 = np.array([mix64(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            h2 = np.array([mix64(s ^ SEEDS[0]).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            keys = [band_keys(sketch(s)) for s in sets if len(s)]
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array(n), pa.array(h1), pa.array(h2), bands], [*KEY, "n", "h1", "h2", "bands"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap in ``percent`` of their union."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _verify(width: int, percent: int):
    def run(batches):
        for b in pieces(batches):
            a_ids, b_ids = b.column("a").to_numpy(), b.column("b").to_numpy()
            cache: dict[int, np.ndarray] = {}
            for ids, texts in ((a_ids, b.column("text_a")), (b_ids, b.column("text_b"))):
                new = [k for k, i in enumerate(ids) if i not in cache and not cache.update({i: None})]
                if new:
                    cache.update(zip(ids[new].tolist(), shingle_sets(texts.take(pa.array(new)), width), strict=True))
            keep = np.array([_similar(cache[i], cache[j], percent) for i, j in zip(a_ids.tolist(), b_ids.tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a_ids[keep]), pa.array(b_ids[keep])], ["a", "b"])

    return run


def _shingle_rows(width: int):
    def run(batches):
        for b in pieces(batches):
            sets = shingle_sets(b.column("text"), width)
            row = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("family").take(row), pa.array(flat), b.column("c").take(row)], ["family", "shingle", "c"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (hub, c) whose full sets are similar enough. The hub's
    text, which many pairs need, is joined last: it is copied in memory only."""
    one = texts.select("c", F.col("text").alias("text_b")).hint("merge")
    hub = texts.select(F.col("c").alias("hub"), F.col("text").alias("text_a")).hint("merge")
    both = pairs.join(one, "c").join(hub, "hub").select(F.col("hub").alias("a"), F.col("c").alias("b"), "text_a", "text_b")
    return both.mapInArrow(_verify(width, percent), "a long, b long")


def _possible(n: str, s: str, m: str, t: str, percent: int):
    """Whether sets of n and m shingles, s and t of them shared with any other, can be similar enough."""
    n, s, m, t = (F.col(c) for c in (n, s, m, t))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(s, t) * (100 + percent) >= (n + m) * percent)


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, c, n, first, least) of each band of a class that another class
    shares: the bucket's smallest class, and its smallest set."""
    rows = classes.select("c", "n", F.explode("bands").alias("key"))
    shared = checkpointed(rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("c").alias("first"), F.min("n").alias("least")).where("rows > 1").drop("rows"))
    return checkpointed(rows.join(shared.hint("merge"), "key"), tidy=True)


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, hub, nh, sh, rows): of each bucket the member with the least share of shingles of its own."""
    own = F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), F.col("c").alias("hub"), F.col("n").alias("nh"), F.col("s").alias("sh"))
    return rows.groupBy("key").agg(F.min(own).alias("h"), F.count("*").alias("rows")).where("rows > 1").select("key", "h.hub", "h.nh", "h.sh", "rows")


def _families(inside: DataFrame) -> DataFrame:
    """(c, family) of classes that buckets connect."""
    found = parents(inside.where("first <> c").select(F.col("first").alias("src"), F.col("c").alias("dst")).distinct())
    return inside.select("c").distinct().join(found.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("component", "c").alias("family"))


def _shared_shingles(inside: DataFrame, family: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(c, family, s): how many shingles of a class occur in another of its family."""
    rows = texts.join(family.hint("merge"), "c").select("family", "c", "text").mapInArrow(_shingle_rows(width), "family long, shingle long, c long")
    lone = rows.groupBy("family", "shingle").agg(F.min("c").alias("c"), F.max("c").alias("other")).where("c = other").groupBy("c").agg(F.count("*").alias("u"))
    sizes = inside.groupBy("c").agg(F.min("n").alias("n"))
    return sizes.join(family, "c").join(lone, "c", "left").select("c", "family", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"))


def _compare(width: int, percent: int):
    """Links between the sets of two blocks: of pairs from different components
    that share a band and that sizes and bounds leave possible."""

    def run(batches):
        for b in batches:
            a_ids, b_ids = [], []
            for k in range(len(b)):  # one pair of blocks at a time becomes Python objects
                x, y = b.column("left")[k].as_py(), b.column("right")[k].as_py()
                if not x or not y:
                    continue
                sx, sy = (shingle_sets(pa.array([m["text"] for m in side], pa.string()), width) for side in (x, y))
                bx, by = (np.array([m["bands"] for m in side], np.int64) for side in (x, y))
                cx, cy = (np.array([m["comp"] for m in side]) for side in (x, y))
                nx, ny = (np.array([m["n"] for m in side], np.int64) for side in (x, y))
                ux, uy = (np.array([m["s"] for m in side], np.int64) for side in (x, y))
                least, most = np.minimum(nx[:, None], ny), np.maximum(nx[:, None], ny)
                go = (cx[:, None] != cy) & (100 * least >= percent * most) & ((100 + percent) * np.minimum(ux[:, None], uy) >= percent * (nx[:, None] + ny))
                go &= (bx[:, None, :] == by[None, :, :]).any(2)
                for i, j in zip(*np.nonzero(go), strict=True):
                    if _similar(sx[i], sy[j], percent):
                        a_ids.append(x[i]["c"])
                        b_ids.append(y[j]["c"])
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], ["a", "b"])

    return run


def _late_links(open_: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components inside families. ``open_`` has family, c, comp, n, s."""
    sizes = open_.groupBy("family", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w")).groupBy("family").agg(F.max(F.struct("k", "comp", "w")).alias("m"), F.sum("k").alias("k"), F.sum("w").alias("w"))
    blocks = lambda k, w: F.greatest(F.ceil(k / CHUNK), F.ceil(w / CHUNK_SHINGLES), F.lit(1)).cast("int")
    sizes = sizes.select("family", F.col("m.comp").alias("main"), blocks(F.col("m.k"), F.col("m.w")).alias("mains"), blocks(F.col("k") - F.col("m.k"), F.col("w") - F.col("m.w")).alias("minors"))
    minor = F.col("comp") != F.col("main")
    placed = open_.join(sizes, "family").withColumn("minor", minor).withColumn("block", F.pmod(F.xxhash64("c"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("mains"))).cast("int"))
    full = placed.join(classes.select("c", "bands").hint("merge"), "c").join(texts.hint("merge"), "c")
    blocks_ = checkpointed(full.groupBy("family", "minor", "block").agg(F.first("mains").alias("mains"), F.first("minors").alias("minors"), F.collect_list(F.struct("c", "comp", "n", "s", "bands", "text")).alias("members")))
    # Of two minor blocks the smaller number goes left; every main block meets every minor one.
    named = lambda minor, first, n: F.transform(F.sequence(first, F.col(n) - 1), lambda i: F.struct(F.lit(minor).alias("minor"), i.alias("block")))
    met = F.concat(named(False, F.lit(0), "mains"), named(True, F.col("block"), "minors"))
    left = blocks_.where("minor").select("family", F.col("members").alias("left"), F.explode(met).alias("x")).select("family", "x.minor", "x.block", "left")
    right = blocks_.select("family", "minor", "block", F.col("members").alias("right"))
    return left.join(right.hint("merge"), ["family", "minor", "block"]).select("left", "right").mapInArrow(_compare(width, percent), "a long, b long")


def _components(classes: DataFrame, texts_of, width: int, percent: int) -> DataFrame:
    """(c, comp) of the classes that are linked with others, but the least of each component."""
    inside = _buckets(classes)
    texts = checkpointed(texts_of(inside.select("c").distinct()), tidy=True)
    family = checkpointed(_families(inside))
    shared = _shared_shingles(inside, family, texts, width)
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    rows = checkpointed(inside.join(shared.hint("merge"), "c").where(F.col("s") * (100 + percent) >= (F.col("n") + partner) * percent).select("key", "c", "family", "n", "s"), tidy=True)
    rows = checkpointed(rows.join(checkpointed(_hubs(rows)).hint("merge"), "key"))
    ends = F.least("hub", "c").alias("x"), F.greatest("hub", "c").alias("y")
    pairs = rows.where((F.col("c") != F.col("hub")) & _possible("n", "s", "nh", "sh", percent)).groupBy(*ends).agg(F.min("hub").alias("hub"))
    pairs = pairs.select("hub", F.when(F.col("hub") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("c"))
    links = checkpointed(_links(pairs, texts, width, percent), tidy=True)
    comp = parents(links, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("comp"))
    named = rows.where("rows > 2").select("key", "c", "family", "n", "s").join(comp.hint("merge"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed = checkpointed(named.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other").select("key"))
    open_ = checkpointed(named.join(mixed.hint("merge"), "key", "left_semi").groupBy("c", "family", "n", "s", "comp").agg(F.lit(1).alias("_")).drop("_"))
    if open_.isEmpty():
        return comp
    late = checkpointed(_late_links(open_, classes, texts, width, percent), tidy=True)
    if late.isEmpty():
        return comp
    # Components so far are stars: with the links between them they are the whole graph.
    return parents(comp.select(F.col("c").alias("a"), F.col("comp").alias("b")).unionByName(late), "a", "b").select(F.col("node").alias("c"), F.col("component").alias("comp"))


#: A row is told apart by its id and its text: two hashes of it, 96 bits.
KEY = ("id", "t1", "t2")


def _keyed(docs: DataFrame, id: str, *more) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), *more)


def _first(*key: str):
    """Orders rows: by id, null after all others, then by the hashes of the text."""
    return F.struct(F.col(key[0]).isNull().alias("none"), *[F.col(k).alias(n) for k, n in zip(key, KEY, strict=True)])


def _same(a: DataFrame, b: DataFrame):
    return [a[k].eqNullSafe(b[k]) for k in KEY]


def _classified(docs: DataFrame, id: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (KEY, n, h1, h2), and (h1, h2, n, own, first) of each class with words: its first row and its component's."""
    texts = _keyed(docs, id, "text")
    kinds = "id long, t1 long, t2 int, n long, h1 long, h2 long, bands array<long>"
    signed = checkpointed(texts.mapInArrow(_sign(width), kinds))
    made = signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(_first(*KEY)).alias("own"), F.first("bands").alias("bands"))
    classes = checkpointed(made.withColumn("c", F.monotonically_increasing_id()), tidy=True)  # fixed as soon as it is written

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(c, text) of some classes: of the class's first row, however often it is repeated."""
        first = classes.join(wanted.hint("merge"), "c", "left_semi").select("c", "own.id", "own.t1", "own.t2")
        each = texts.groupBy(*KEY).agg(F.first("text").alias("text"))
        return each.join(first.hint("merge"), _same(each, first)).select("c", "text")

    comp = _components(classes, texts_of, width, percent)
    own = classes.select("c", "own")
    # Of a component's classes the least in number need not have its first row.
    linked = checkpointed(comp.unionByName(comp.select(F.col("comp").alias("c"), "comp").distinct()).join(own.hint("merge"), "c"))
    first = checkpointed(linked.groupBy("comp").agg(F.min("own").alias("first")))
    named = linked.select("c", "comp").join(first.hint("merge"), "comp").select("c", "first")
    rated = classes.select("c", "h1", "h2", "n", "own").join(named.hint("merge"), "c", "left")
    return signed.select(*KEY, "n", "h1", "h2"), checkpointed(rated.select("h1", "h2", "n", "own", F.coalesce("first", "own").alias("first")))


def near_duplicates(docs: DataFrame, id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``docs``.

    Rows whose sets overlap in ``percent`` of their union are linked; a
    component is named after its smallest id, a null id after all others. Rows
    without text or words have an empty set, are linked with nothing and kept.
    Each row is a document of its own, whatever its id: rows that share an id,
    or have none, are linked by their texts alone. Other columns are ignored.
    The id must be an integer or read as one.
    """
    rows, classes = _classified(docs, id, width, percent)
    worded = rows.where("n > 0").join(classes.select("h1", "h2", "n", F.col("first.id").alias("comp")).hint("merge"), ["h1", "h2", "n"]).select("id", "n", "comp")
    every = worded.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("comp")))
    return every.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("id").eqNullSafe(F.col("comp")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component of near-duplicates, and each row without
    words, once: of rows equal in id and text the least in its other columns.
    The first is the one of the least id, null last, then of the least hash of text."""
    rows, classes = _classified(docs, id, width, percent)
    kept = classes.where("own = first").select("own.id", "own.t1", "own.t2").unionByName(rows.where("n = 0").select(*KEY).distinct())
    # Repeated rows are combined before they are dealt out. The kept documents grow with all: merged, never broadcast.
    once = _keyed(docs, id, F.struct(*docs.columns).alias("row")).groupBy(*KEY).agg(F.min("row").alias("row"))
    return once.join(kept.hint("merge"), _same(once, kept), "left_semi").select("row.*")


def op2(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_sql() -> str:
    return """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT s.doc_id, sh, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, sh) AS pos FROM s JOIN n USING (doc_id) JOIN (SELECT sh, count(*) df FROM s GROUP BY sh) USING (sh)),
pre AS (SELECT doc_id, sh, n FROM rare WHERE pos <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
hit AS (SELECT a, b, na, nb, count(*) AS i FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY ALL),
e AS (SELECT a, b FROM hit WHERE 100 * i >= 80 * (na + nb - i) UNION ALL SELECT b, a FROM hit WHERE 100 * i >= 80 * (na + nb - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
