"""Toxicity: a lexicon met with Levenshtein automata, scored in context.

The lexicon is learned: terms that labelled toxic documents hold far more often
than others. Texts are read by one automaton, the lexicon's trie intersected
with the Levenshtein automata of its terms: a state is a set of (trie node,
edits so far), and states are made when first reached. A hit is exact or
misspelled, and its window of tokens decides whether it is quoted or reported.
A small logistic model weighs these counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .common import table

#: The lexicon and the model are fitted on so many labelled documents at most, those whose ids hash lowest.
SAMPLE = 20_000
#: Fewest toxic documents of a term; least lower bound of its log-odds, and least log-odds of its misspellings. SAMPLE
#: bounds the lexicon too: a term needs SUPPORT of its documents.
SUPPORT, BOUND = 5, 1.5
#: Terms from this length on are found with one edit.
FUZZY_FROM = 5
WINDOW = 6
TOKEN = r"[^\W_]+"
#: An apostrophe counts as a mark only beside a word, not inside one.
QUOTES = re.compile(r"[\"“”„«»‹›‘’](?!\w)|(?<!\w)[\"“”„«»‹›‘’']|'(?!\w)")
#: Words that report another's speech (fixed values, four languages).
REPORTING = frozenset(
    """said says wrote writes quoted quote called calls reported reports slur term word
    sagte sagt schrieb zitiert nannte wort begriff dit disait écrit cité appelé mot terme
    dijo dice escribió citó llamó palabra término""".split()
)
FEATURES = 5
THRESHOLD = 0.7


class Automaton:
    """Deterministic automaton of all words within a term's allowed edits."""

    def __init__(self, terms: list[str], fuzzy: list[bool]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.bends = [any(fuzzy)]  # whether a term below a node may be misspelled
        for k, t in enumerate(terms):
            at = 0
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                    self.bends.append(False)
                at = self.children[at][c]
                self.bends[at] |= fuzzy[k]
            self.ends[at] = k
        self.fuzzy = fuzzy
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, positions: set[tuple[int, int]]) -> int:
        # A missing character of the term costs an edit and reads nothing.
        found, todo = set(), list(positions)
        while todo:
            node, e = todo.pop()
            if (node, e) in found or (e and ((node, e - 1) in found or not self.bends[node])):
                continue
            found.add((node, e))
            if e == 0:
                todo += [(n, 1) for n in self.children[node].values()]
        found = {(n, e) for n, e in found if not e or (n, 0) not in found}
        key = frozenset(found)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            hits = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and (not e or self.fuzzy[self.ends[n]])]
            self.accepts.append(min(hits) if hits else None)
        return self.ids[key]

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        at = self.start
        for c in word:
            nxt = self.moves[at].get(c)
            if nxt is None:
                to = set()
                for node, e in self.states[at]:
                    down = self.children[node]
                    if c in down:
                        to.add((down[c], e))
                    if e == 0:
                        to.add((node, 1))
                        to.update((n, 1) for n in down.values())
                nxt = self.moves[at][c] = self._state(to) if to else -1
                if nxt >= 0 and not self.states[nxt]:
                    nxt = self.moves[at][c] = -1
            if nxt < 0:
                return None
            at = nxt
        return self.accepts[at]


class Reader:
    """Features of texts: weight of exact and misspelled hits, used and quoted,
    and the most hits in one window."""

    def __init__(self, terms: list[str], weights: list[float], fuzzy: list[bool]):
        self.automaton, self.weights = Automaton(terms, fuzzy), weights
        self.token = re.compile(TOKEN)
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, low: str) -> list[tuple[int, tuple[int, int]]]:
        """(token, (edits, term)) of each hit in a lower-case text."""
        known, match = self.known, self.automaton.match
        if len(known) > 300_000:
            known.clear()
        out = []
        for i, w in enumerate(self.token.findall(low)):
            try:
                m = known[w]
            except KeyError:
                m = known[w] = match(w)
            if m is not None:
                out.append((i, m))
        return out

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        low = (text or "").lower()
        if not (hits := self.hits(low)):
            return out
        spans = [m.span() for m in self.token.finditer(low)]
        for i, (e, t) in hits:
            out[e + 2 * self._quoted(low, spans, i)] += self.weights[t]
        at = np.array([i for i, _ in hits])
        out[4] = np.max(np.searchsorted(at, at + WINDOW, "right") - np.arange(len(at)))
        return np.log1p(out)

    def _quoted(self, text: str, spans: list[tuple[int, int]], i: int) -> bool:
        """Whether token ``i`` stands between quotation marks near by, or a word of
        reporting leads to it with one on either side. Marks inside words and words of
        reporting alone quote nothing."""
        a, b = max(0, i - WINDOW), min(len(spans), i + WINDOW + 1)
        start, end = max(0, spans[a][0] - 1), spans[b - 1][1] + 1
        left = any(m.end() <= spans[i][0] for m in QUOTES.finditer(text, start, end))
        right = any(m.start() >= spans[i][1] for m in QUOTES.finditer(text, spans[i][1], end))
        return (left and right) or ((left or right) and any(text[s:e] in REPORTING for s, e in spans[a:i]))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights with the intercept first; Newton steps on the penalised likelihood."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_not_negative(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """fit_logistic where more of a hit never makes a text cleaner: a feature whose
    weight comes out negative gets 0, and the others are fitted again without it."""
    use = np.ones(x.shape[1], bool)
    while True:
        v = fit_logistic(x[:, use], y)
        if (v[1:] >= 0).all():
            w = np.zeros(x.shape[1] + 1)
            w[0], w[1:][use] = v[0], v[1:]
            return w
        use[np.flatnonzero(use)[np.argmin(v[1:])]] = False


def in_fold(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled documents outside the held-out fold; repeated texts count once."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the bound of this broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # Of rows with one text: the least id, and toxic if any label says so.
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[float]]:
    """Terms and weights: the lower bounds of their log-odds of being in a toxic document."""
    n = sample.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    if not n["n"] or not n["p"] or n["p"] == n["n"]:
        return [], []
    pos, neg = float(n["p"]), float(n["n"] - n["p"])
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)[^\W_]+"), F.lit(0)))).alias("term")
    seen = sample.select("toxic", word).groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("a"))
    t, c = F.col("t") + 0.5, F.col("a") - F.col("t") + 0.5
    bound = F.log(t / (pos + 1)) - F.log(c / (neg + 1)) - 1.96 * F.sqrt(1 / t + 1 / c)
    best = seen.where(F.col("t") >= SUPPORT).withColumn("w", bound).where(F.col("w") >= BOUND).orderBy(F.desc("w"), "term").collect()
    return [r["term"] for r in best], [float(r["w"]) for r in best]


def _spelled(terms, weights, fuzzy):
    def run(batches):
        reader = Reader(terms, weights, fuzzy)
        for b in batches:
            toxic = b.column("toxic").to_pylist()
            found = [(t, y) for text, y in zip(b.column("text").to_pylist(), toxic, strict=True) for t in {t for _, (e, t) in reader.hits((text or "").lower()) if e}]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["term", "toxic"])

    return run


def misspellable(sample: DataFrame, terms: list[str], weights: list[float]) -> list[bool]:
    """Which terms to find with an edit: long ones, unless their neighbours are
    ordinary words, which shows in the log-odds of what the sample holds of them."""
    fuzzy = [len(t) >= FUZZY_FROM for t in terms]
    seen = sample.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(_spelled(terms, weights, fuzzy), "term long, toxic long")
    # One row a term at most.
    n = sample.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    t, c = F.col("t") + 0.5, F.col("a") - F.col("t") + 0.5
    odds = F.log(t / (float(n["p"]) + 1)) - F.log(c / (float(n["n"] - n["p"]) + 1))
    for r in seen.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("a")).where(odds < BOUND).collect():
        fuzzy[r["term"]] = False
    return fuzzy


def _features(terms, weights, fuzzy):
    def run(batches):
        reader = Reader(terms, weights, fuzzy)
        for b in batches:
            x = [reader.features(t) for t in b.column("text").to_pylist()]
            flat = pa.array(np.concatenate(x) if x else np.empty(0))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in b.schema.names if k != "text"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), flat)], [*(k for k in b.schema.names if k != "text"), "x"])

    return run


def _score(terms, weights, fuzzy, w):
    def run(batches):
        reader = Reader(terms, weights, fuzzy)
        for b in batches:
            x = np.array([reader.features(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            s = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of each row of ``docs``.

    Null and empty texts have no hits and score as such. Without labels of both
    kinds the lexicon is empty and every score is 0. Repeated rows score alike.
    """
    sample = checkpointed(labelled_sample(docs, labels))
    terms, weights = learn_lexicon(sample)
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    fuzzy = misspellable(sample, terms, weights)
    # At most SAMPLE rows of FEATURES numbers.
    rows = sample.select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(_features(terms, weights, fuzzy), "doc_id long, toxic long, x array<double>").toPandas().sort_values(["doc_id", "toxic"])
    w = fit_not_negative(np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(float))
    return docs.select("doc_id", "text").mapInArrow(_score(terms, weights, fuzzy, w), "doc_id long, score double")


def op8(spark, sf_dir):
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
