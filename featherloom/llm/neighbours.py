"""Nearest neighbours by score-aware quantisation.

Unit vectors are cut into two-dimensional pieces, each of which is coded by one
of 16 centres, four bits. Codes and centres minimise an anisotropic loss: the
part of the residual that is parallel to the vector changes its inner products
most where they are large, so it weighs more than the rest. A query's inner
products with the centres are tables; sums of table entries rank all vectors of
a block, and the best are ranked again on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

PIECE, CENTRES = 2, 16
#: Centres are fitted on so many vectors at most, those whose ids hash lowest.
FIT, SWEEPS = 8_192, 6
#: Inner products from this on are those that count: it sets the weight of the parallel residual.
SCORE_AT = 0.2
CHUNK, BLOCK = 4_096, 512
#: Vectors of a chunk that are ranked again for each query, at first: four times as many as
#: long as the last of them is within MARGIN standard errors of the nearest.
RERANK, MARGIN = 100, 3.0
QUERY_STEP, NEAREST = 50, 5


def parallel_weight(dim: int, at: float = SCORE_AT) -> float:
    return max(1.0, (dim - 1) * at * at / (1 - at * at))


def _pieces(x: np.ndarray) -> np.ndarray:
    short = -x.shape[1] % PIECE
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, PIECE)


def encode(x: np.ndarray, centres: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes of unit vectors, by coordinate descent on the anisotropic loss."""
    p = _pieces(x)
    n, m, _ = p.shape
    codes = np.empty((n, m), np.uint8)
    along = np.empty((n, m, CENTRES))  # residual times vector, by piece and centre
    loss = np.empty((n, m, CENTRES))
    for s in range(m):
        r = p[:, s, None, :] - centres[None, s]
        loss[:, s] = (r * r).sum(2)
        along[:, s] = (r * p[:, s, None, :]).sum(2)
        codes[:, s] = loss[:, s].argmin(1)
    rows = np.arange(n)
    total = sum(along[rows, s, codes[:, s]] for s in range(m))
    for _ in range(sweeps):
        for s in range(m):
            rest = total - along[rows, s, codes[:, s]]
            codes[:, s] = (loss[:, s] + (weight - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
            total = rest + along[rows, s, codes[:, s]]
    return codes


def fit(x: np.ndarray, weight: float, sweeps: int = SWEEPS) -> np.ndarray:
    """Centres (pieces, 16, PIECE) for unit vectors: k-means, then weighted
    least squares under the anisotropic loss, alternating with the codes."""
    p = _pieces(x)
    n, m, _ = p.shape
    pick = np.linspace(0, n - 1, CENTRES).astype(int)
    centres = np.stack([p[np.lexsort(p[:, s].T)][pick, s] for s in range(m)])
    for _ in range(sweeps):
        for s in range(m):
            code = ((p[:, s, None, :] - centres[None, s]) ** 2).sum(2).argmin(1)
            for k in np.unique(code):
                centres[s, k] = p[code == k, s].mean(0)
    for _ in range(sweeps):
        codes = encode(x, centres, weight, 1)
        part = np.stack([((p[:, s] - centres[s][codes[:, s]]) * p[:, s]).sum(1) for s in range(m)], 1)
        total = part.sum(1)
        for s in range(m):
            rest = total - part[:, s]
            for k in np.unique(codes[:, s]):
                i = codes[:, s] == k
                v = p[i, s]
                a = len(v) * np.eye(PIECE) + (weight - 1) * v.T @ v
                centres[s, k] = np.linalg.solve(a, v.sum(0) + (weight - 1) * ((rest[i] + (v * v).sum(1))[:, None] * v).sum(0))
            part[:, s] = ((p[:, s] - centres[s][codes[:, s]]) * p[:, s]).sum(1)
            total = rest + part[:, s]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dim)


def _nibbles(codes: np.ndarray) -> np.ndarray:
    """Four-bit codes, two in a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return even[:, ::2] << 4 | even[:, 1::2]


def _packed(dim: int, centres: np.ndarray | None, weight: float):
    """One row of a group's ids, vectors and codes. Rows of one id count once, by their least vector."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"), dim)
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        ids, x = ids[first], x[first]
        codes = b"" if centres is None else _nibbles(encode(_unit(x), centres, weight)).tobytes()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()), "codes": pa.array([codes], pa.binary())})

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, even = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
    return np.sort(np.r_[above, even[: k - len(above)]])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with many, summed in order of the components."""
    dot, qq, xx = np.zeros(len(x)), 0.0, np.zeros(len(x))
    for j in range(x.shape[1]):
        dot += q[j] * x[:, j]
        qq += q[j] * q[j]
        xx += x[:, j] * x[:, j]
    return np.clip(dot / np.sqrt(qq * xx), -1.0, 1.0)


def _scan(dim: int, centres: np.ndarray, nearest: int, rerank: int):
    def run(batches):
        for b in batches:
            for row in (b.slice(k, 1).to_pylist()[0] for k in range(len(b))):  # one pair of blocks at a time
                qi, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dim)
                vi, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                pairs = np.frombuffer(row["codes"], np.uint8).reshape(len(vi), -1)
                tables = np.einsum("qsp,skp->qsk", _pieces(_unit(q)), centres).astype(np.float32)
                out_q, out_v, out_s = [], [], []
                columns = [np.ascontiguousarray(pairs[:, s // 2] & 15 if s % 2 else pairs[:, s // 2] >> 4) for s in range(tables.shape[1])]
                for i in range(len(qi)):
                    near = np.zeros(len(vi), np.float32)
                    for s, c in enumerate(columns):
                        near += tables[i, s][c]
                    near[vi == qi[i]] = -np.inf
                    k = rerank
                    while True:
                        at = _best(near, k)
                        at = at[vi[at] != qi[i]]
                        exact = cosines(q[i], v[at])
                        # Go on while one left out could still be among the nearest, by the errors seen.
                        if k >= len(vi) or len(at) < nearest or near[at].min() + MARGIN * np.std(near[at] - exact) < np.partition(exact, -nearest)[-nearest]:
                            break
                        k *= 4
                    at, exact = at[top := np.lexsort((vi[at], -exact))[:nearest]], exact[top]
                    out_q.append(np.full(len(at), qi[i]))
                    out_v.append(vi[at])
                    out_s.append(exact)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a non-zero vector of finite components, as doubles, of the most common length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(sound)


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, nearest first, ties to the smaller id.

    Queries meet all vectors, block by block. Unusable vectors and those of
    another length than most take no part; with fewer candidates than asked
    for, all are returned; no usable vectors give no rows.
    """
    spark = vectors.sparkSession
    good, asked = usable(vectors), usable(queries)
    lengths = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths["dim"], lengths["n"]
    good, asked = (x.where(F.size("embedding") == dim) for x in (good, asked))
    # At most FIT vectors reach the driver.
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).select("embedding").toArrow()
    weight = parallel_weight(dim)
    centres = fit(_unit(_matrix(sample.column(0), dim)), weight)
    chunks = -(-n // CHUNK)
    blocks = max(1, -(-asked.count() // BLOCK))
    packed = "part int, ids binary, vectors binary, codes binary"
    by = lambda df, k: df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")).groupBy("part")
    v = by(good, chunks).applyInArrow(_packed(dim, centres, weight), packed)
    q = by(asked, blocks).applyInArrow(_packed(dim, None, weight), packed).select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    met = q.join(v.hint("shuffle_hash"), "part").select("q_ids", "q_vectors", "ids", "vectors", "codes")
    found = met.mapInArrow(_scan(dim, centres, nearest, rerank), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


def op10_sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {NEAREST}
"""
