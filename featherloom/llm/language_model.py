"""Scoring documents with a gated recurrent language model trained on the corpus.

Words are counted over all learning documents. The most frequent ones are the
model's symbols, beside one for all rarer words and one for the end of a text; a
rare word's probability is that of its symbol times its share of the rare
words' counts, half a count added to each and to what was never seen. So the
model and the unigram base are distributions over the same words, and the
untrained model is the base.

All learning documents are trained on, dealt over ROUNDS rounds. In a round
tasks train copies of the model on their own documents; the copies are averaged
by the tokens they saw, slice by slice of the weights, and go into the next round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import drop, shared_folder, written
from . import recurrent
from .common import table
from .texthash import _ASCII_LOWER, _SPACE
from .units import block_of, block_rows, dictionary_blocks, unit_rows

SYMBOLS, ROUNDS, RATE = 1_024, 4, 0.012
#: Tokens of a task in a round, about, and of the texts that are scored side by side.
TASK_TOKENS, SCORE_TOKENS = 1 << 22, 1 << 22
#: Tasks of a round at most; a round over fewer tokens than SEEN goes over them up to PASSES times.
MODELS, SEEN, PASSES = 4_096, 1 << 22, 8
SLICES, FAN = 16, 64
END, RARE = "end", "rare"


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, words of each text) of UTF-8 texts, A-Z in lower case."""
    b = _ASCII_LOWER[data]
    word = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(word & (np.r_[True, ~word[:-1]][: len(b)] | edge[:-1]))
    stop = np.flatnonzero(word & (np.r_[~word[1:], True][: len(b)] | edge[1:])) + 1
    return b[word], np.r_[0, np.cumsum(stop - start)], np.diff(np.searchsorted(start, ends))


class Vocabulary:
    """Counts of the learning documents, as far as the driver needs them: totals
    and the SYMBOLS - 2 most frequent words at most."""

    def __init__(self, tokens: int, distinct: int, texts: int, top: list[tuple[str, int]]):
        self.total, self.distinct, self.texts = tokens + texts, distinct + (texts > 0), texts
        self.whole = self.total + 0.5 * (self.distinct + 1)
        self.rare_mass = tokens - sum(c for _, c in top) + 0.5 * (distinct - len(top) + 1)
        mass = sorted([(self.rare_mass, RARE, ""), (texts + 0.5, END, ""), *((c + 0.5, "word", w) for w, c in top)], key=lambda x: (-x[0], x[1:]))
        self.mass = np.array([m for m, *_ in mass])
        self.end, self.rare = ([k for _, k, _ in mass].index(x) for x in (END, RARE))
        self.words = [(w, i) for i, (_, k, w) in enumerate(mass) if k == "word"]


SEQUENCES = "id long, learn boolean, n_tokens long, n_known long, base_score double, rare_score double, symbols binary"


def _sequences(v: Vocabulary):
    def run(docs: pa.Table, units: pa.Table) -> pa.Table:
        ids, learn, starts, codes = block_of(docs)
        n = len(ids)
        count, symbol = np.zeros(len(units), np.int64), np.zeros(len(units), np.uint16)
        place = units.column("code").to_numpy()
        count[place], symbol[place] = units.column("c").to_numpy(), units.column("symbol").to_numpy()
        of = np.repeat(np.arange(n), np.diff(starts))
        summed = lambda x: np.bincount(of, weights=x[codes], minlength=n)
        with np.errstate(divide="ignore"):
            base, rare = np.log10((count + 0.5) / v.whole), np.where(symbol == v.rare, np.log10((count + 0.5) / v.rare_mass), 0.0)
        end = np.log10((v.texts + 0.5) / v.whole)
        at = np.r_[0, np.cumsum(np.diff(starts) + 1)]
        every = np.full(at[-1], v.end, np.uint16)
        every[np.arange(len(codes)) + of] = symbol[codes]
        symbols = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((at * 2).astype(np.int64)), pa.py_buffer(every)])
        known = np.bincount(of, weights=(count > 0)[codes], minlength=n).astype(np.int64) + (v.texts > 0)
        return pa.table({"id": ids, "learn": learn, "n_tokens": np.diff(at), "n_known": known, "base_score": summed(base) + end, "rare_score": summed(rare), "symbols": symbols.cast(pa.binary())})

    return run


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("symbols")]


def _trainer(weights: dict, rate: float, passes: int, seed: int):
    """Trains a copy of the model on a task's documents; gives its weights, cut into slices."""

    def run(batches):
        w, adam, held, tokens, seen = weights, None, [], 0, 0

        def train(w, adam):
            for k in range(passes):
                order = np.random.default_rng([seed, seen, k]).permutation(len(held))
                w, adam = recurrent.train(w, [held[i] for i in order], rate / (1 + k), adam)
            return w, adam

        for b in batches:
            for t in _texts(b):
                held.append(t)
                tokens += len(t)
                if tokens >= TASK_TOKENS:
                    w, adam = train(w, adam)
                    held, tokens, seen = [], 0, seen + tokens
        if held:
            w, adam = train(w, adam)
            seen += tokens
        if seen:
            parts = np.array_split(recurrent.flat(w).astype(np.float64) * seen, SLICES)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([part] * SLICES, pa.int32()), pa.array([float(seen)] * SLICES), pa.array([p.tobytes() for p in parts])], ["slice", "part", "weight", "x"])

    return run


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums of FAN slices at most."""
    x = sum(np.frombuffer(v.as_py(), np.float64) for v in rows.column("x"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "weight": [float(np.sum(rows.column("weight").to_numpy()))], "x": [x.tobytes()]})


def train(sequences: DataFrame, v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """The model's weights after all rounds over the learning documents of
    ``sequences``. What reaches the driver is one set of weights a round."""
    w = recurrent.new_model(v.mass, seed=seed)
    learning = sequences.where("learn")
    rounds = max(1, min(ROUNDS, v.total // TASK_TOKENS))
    tasks = max(1, min(MODELS, v.total // (rounds * TASK_TOKENS)))
    passes = max(1, min(PASSES, -(-SEEN // max(1, v.total))))
    kind = "slice int, part int, weight double, x binary"
    for r in range(rounds):
        own = learning.where(F.pmod(F.xxhash64("id", "n_tokens", "base_score"), F.lit(rounds)) == r).select("symbols")
        sums = own.coalesce(tasks).mapInArrow(_trainer(w, RATE / (1 + r), passes, seed + r), kind)
        left = tasks
        while True:
            left = -(-left // FAN)
            sums = sums.withColumn("part", F.pmod(F.col("part"), F.lit(left)).cast("int")).groupBy("slice", "part").applyInArrow(_added, kind)
            if left == 1:
                break
        found = sorted(sums.select("slice", "weight", "x").collect())  # SLICES rows, the weights of one model
        if found:
            w = recurrent.shaped(w, np.concatenate([np.frombuffer(x, np.float64) / n for _, n, x in found]).astype(np.float32))
    return w


SCORED = "id long, learn boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(w: dict):
    def run(batches):
        held, tokens = [], 0

        def scored():
            rows = pa.Table.from_batches(held)
            got = recurrent.score(w, [t for b in held for t in _texts(b)]) / np.log(10)
            out = rows.select(["id", "learn", "n_tokens", "n_known", "base_score"]).append_column("score", pa.array(got + rows.column("rare_score").to_numpy()))
            return out.combine_chunks().to_batches()

        for b in batches:
            at, ends = 0, np.cumsum(b.column("n_tokens").to_numpy())
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCORE_TOKENS - tokens, "right")))
                held.append(b.slice(at, to - at))
                tokens += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if tokens >= SCORE_TOKENS or at < len(b):
                    yield from scored()
                    held, tokens = [], 0
        if held:
            yield from scored()

    return run


def score_documents(docs: DataFrame, id: str = "doc_id", held_out: str = "held_out", symbols: int = SYMBOLS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    The rows whose ``held_out`` is not true are learned from, each as often as it
    occurs. Scores are base-10 logarithms of the probability of a whole text's
    words and its end, under unigram counts and under the recurrent model, whose
    state goes through the whole text. Null and empty texts are an end alone;
    with nothing to learn from, the base gives every word probability 1 and the
    model knows an end and unseen words only. Repeated rows, or rows without an
    id, are scored each; other columns are ignored; no rows give none.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), "text", (~F.coalesce(F.col(held_out), F.lit(False))).alias("mark"))
    encoded = dictionary_blocks(rows, words, path := shared_folder(docs.sparkSession, "words"))
    units = unit_rows(encoded)
    counts = written(units.groupBy("unit").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    top = [(r["unit"], r["c"]) for r in counts.orderBy(F.desc("c"), "unit").limit(symbols - 2).collect()]  # SYMBOLS rows at most
    v = Vocabulary(whole["tokens"], whole["distinct"], rows.where("mark").count(), top)
    named = F.broadcast(docs.sparkSession.createDataFrame(v.words, "unit string, symbol int"))  # as many rows as symbols
    rated = counts.join(named, "unit", "left")
    known = units.select(F.col("block").alias("of"), "unit", "code").join(rated.hint("merge"), "unit", "left").select("of", "code", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("symbol", F.lit(v.rare)).alias("symbol"))
    sequences = written(block_rows(encoded).groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_sequences(v), SEQUENCES), "sequences")
    drop(docs.sparkSession, path)
    w = train(sequences, v)
    out = sequences.mapInArrow(_scorer(w), SCORED)
    return out.select(F.col("id").alias(id), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


#: Folds by a hash of the id: one of FOLDS is held out.
FOLDS, HELD_OUT = 5, 1


def op11(spark, sf_dir):
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", (fold == HELD_OUT).alias("held_out")))
