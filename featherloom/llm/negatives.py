"""Hard negatives by blocked matrix products over whole-number vectors.

Anchors and candidates are dealt into blocks, one packed row each, and every
block of anchors meets every block of candidates: one matrix product, in
doubles, which is exact while no sum of products can reach 2 ** 53. A first pass
finds each anchor's best positives. The best of some blocks are found again in
the best of all, so partial results are merged by taking the best once more. A
second pass takes, for each anchor and positive, the best negatives whose score
lies in a window under the positive's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .common import table

POSITIVES, NEGATIVES = 5, 3
#: The window: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 50, 95
SCALE, ANCHOR_STEP = 256, 50
#: Rows of a block of candidates and of anchors.
CHUNK, BLOCK = 8_192, 1_024
EXACT, LONG, LARGEST = 2**53, 2**63 - 1, float(np.finfo(np.float64).max)


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): rows with an id, a label and a vector of finite
    components, as floor(scale * component), held to the largest double."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a column would give whole numbers of 64 bits; the remainder leaves doubles of any size.
    held = lambda y: F.greatest(F.least(y, F.lit(LARGEST)), F.lit(-LARGEST))
    floor = lambda y: y - F.pmod(y, F.lit(1.0))
    return v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(finite).select("vec_id", "label", F.transform("e", lambda x: floor(held(x * F.lit(float(scale))))).alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, dim)


def _packed(dim: int):
    """One row of a block's ids, labels and vectors, in order of ids. Rows of one
    id count once, by their least label and vector."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, labels, x = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("x"), dim)
        order = np.lexsort((*x.T[::-1], labels, ids))
        first = order[np.r_[True, np.diff(ids[order]) != 0]]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([v[first].tobytes()], pa.binary()) for n, v in (("ids", ids), ("labels", labels), ("vectors", x))}})

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exactly: in doubles where no sum
    can reach 2 ** 53, else in Python's numbers, held to what 64 bits hold."""
    most = lambda m: np.abs(m).max(initial=0.0)
    if q.shape[1] * most(q) * most(x) < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(exact(q).dot(exact(x).T), -LONG - 1, LONG).astype(np.int64)


def _arrays(row: dict, dim: int, side: str = ""):
    whole = lambda c: np.frombuffer(row[side + c], np.int64)
    return whole("ids"), whole("labels"), np.frombuffer(row[side + "vectors"], np.float64).reshape(-1, dim)


def _pairs_of_blocks(batches):
    for b in batches:
        for k in range(len(b)):  # one pair of blocks at a time
            yield b.slice(k, 1).to_pylist()[0]


def _table(columns: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.empty(0, np.int64)) for v in columns.values()], list(columns))


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of the places ``at`` with the best scores, best first, ties to the first place."""
    s = score[at]
    if len(at) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= edge]
        s = score[at]
    return at[np.argsort(-s, kind="stable")[:k]]


def _positives(dim: int, k: int):
    def run(batches):
        for row in _pairs_of_blocks(batches):
            qi, ql, q = _arrays(row, dim, "q_")
            vi, vl, v = _arrays(row, dim)
            s = products(q, v)
            out = {"anchor_id": [], "vec_id": [], "score": []}
            own = {c: np.flatnonzero(vl == c) for c in np.unique(ql).tolist()}
            for i in range(len(qi)):
                at = own[ql[i]]
                at = _best(s[i], at[vi[at] != qi[i]], k)
                out["anchor_id"].append(np.full(len(at), qi[i]))
                out["vec_id"].append(vi[at])
                out["score"].append(s[i][at])
            yield _table(out)

    return run


def _negatives(dim: int, k: int, low: int, high: int):
    def run(batches):
        for row in _pairs_of_blocks(batches):
            qi, ql, q = _arrays(row, dim, "q_")
            vi, vl, v = _arrays(row, dim)
            s = products(q, v)
            positives = row["positives"]
            out = {"anchor_id": [], "positive_id": [], "positive_score": [], "negative_id": [], "negative_score": []}
            other = {c: np.flatnonzero(vl != c) for c in np.unique(ql).tolist()}
            for p in positives:
                i = int(np.searchsorted(qi, p["anchor_id"]))
                at = other[ql[i]]
                score = p["score"]
                # 100 * negative within these, in whole numbers of any size.
                t, least, most = s[i][at], -(-low * score // 100), high * score // 100
                if least > most:  # a negative positive has no window
                    continue
                at = _best(s[i], at[(t >= least) & (t <= most)], k)
                for c, x in (("anchor_id", qi[i]), ("positive_id", p["vec_id"]), ("positive_score", score)):
                    out[c].append(np.full(len(at), x, np.int64))
                out["negative_id"].append(vi[at])
                out["negative_score"].append(s[i][at])
            yield _table(out)

    return run


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors``, some of them, have vec_id, label and x (see
    ``whole_numbers``). An anchor's positives are its best other rows of the
    same label by inner product, ties to the smaller id; for each, the best rows
    of another label with low * positive <= 100 * negative <= high * positive.
    With fewer, all are returned; a negative positive score leaves none. Rows of
    one id count once, by the least label and vector; vectors of another length
    than most take no part; no rows give none. Scores beyond 64 bits count as
    the largest number they hold.
    """
    spark = rows.sparkSession
    rows = checkpointed(rows)  # read for the lengths and for two passes
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, n = lengths["dim"], lengths["n"]
    rows, asked = rows.where(F.size("x") == dim), anchors.where(F.size("x") == dim)
    chunks, blocks = -(-n // CHUNK), max(1, -(-asked.count() // BLOCK))
    deal = lambda df, k: df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")).groupBy("part").applyInArrow(_packed(dim), "part int, ids binary, labels binary, vectors binary")
    candidates = checkpointed(deal(rows, chunks))
    queries = checkpointed(deal(asked, blocks).select(F.col("part").alias("q_part"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "vectors")]))
    each = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("part")
    merged = lambda df, by, score, id, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id))).where(F.col("rank") <= k)
    met = queries.select("q_ids", "q_labels", "q_vectors", each).join(candidates.hint("shuffle_hash"), "part").drop("part")
    found = met.mapInArrow(_positives(dim, positives), "anchor_id long, vec_id long, score long")
    best = checkpointed(merged(found, ["anchor_id"], "score", "vec_id", positives).drop("rank"))
    # A block's anchors have BLOCK * positives of them, about.
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int").alias("q_part")
    listed = best.groupBy(part).agg(F.collect_list(F.struct("anchor_id", "vec_id", "score")).alias("positives"))
    again = queries.join(listed, "q_part").select("q_ids", "q_labels", "q_vectors", "positives", each).join(candidates.hint("shuffle_hash"), "part").drop("part")
    kinds = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    out = merged(again.mapInArrow(_negatives(dim, negatives, low, high), kinds), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    rows = whole_numbers(vectors)
    return hard_negatives(rows, rows.where(F.col("vec_id") % ANCHOR_STEP == 0))


def op12_sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS vec_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
