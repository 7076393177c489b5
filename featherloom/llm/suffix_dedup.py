"""Removal of repeated substrings by a distributed difference-cover suffix sort.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier.
Suffixes need to be told apart by their first LENGTH bytes only, so the sort
is cut at that depth:

1. Difference cover. Of each window of LENGTH bytes one position is sampled,
   the least hash of a triple of 8-byte words. The choice depends on the
   window's bytes alone, so equal windows are sampled at equal offsets, as a
   difference cover demands, and one position in forty is sampled.
2. Sorted triples. Sampled positions are sorted by the name of their triple.
   A name that occurs once belongs to no repeat; its suffixes are done.
3. Names of names. A sampled position stands for a run of consecutive windows,
   all of which hold its triple. Runs of one triple are named again by all
   bytes of their windows. The first of a name stands for its windows; for all
   others each window is a repeat.
4. Remaining suffixes. Where a triple has several second names, the runs may
   share some windows. They are cut into blocks of BLOCK windows, which are
   named and sorted in the same way by the bytes common to the block's windows,
   then by all their bytes; what is still open is cut into single windows, and
   these are merged in sorted order: of equal neighbours the first stays.

Names only bring together what may be equal; second names, 64-bit fingerprints
of all bytes of a run or block, decide. A single window is named by 96 bits of
its bytes. A name with many second names would be one task's: the most frequent
ones of a sample of the documents are dealt by both names instead, and their
runs go on as open whatever else there is, so the sample steers the work alone.
No step holds a group in memory: names are streamed in sorted order, and one
row waits for its successor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .common import mix64, table
from .texthash import Prefix, text_bytes, runs

LENGTH = 100
WORD_BYTES = 8
TRIPLE = 3 * WORD_BYTES
SPREAD = LENGTH - TRIPLE + 1  # triples of a window
BLOCK = 16
AT_BITS = np.uint64(24)
AT = np.uint64(2**24 - 1)
#: A longer text is read in pieces of so many windows; their runs may differ at the seams, which step 4 settles.
PIECE = 1 << 22
#: Rows that a task gathers before it passes them on.
EMIT = 200_000
#: Names with so many second names in one of SAMPLED documents are dealt by both; at most so many of each kind.
SAMPLED, CONTEXTS, SPREAD_NAMES = 64, 64, 1_000
#: Marks the runs of such names. A run's number is below it, a known repeat's is negative.
SPREAD_MARK = 1 << 62
C1, C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
NO_ID = -(2**63)


def triples(b: np.ndarray) -> np.ndarray:
    """A hash of the three 8-byte words from each position."""
    w = np.ndarray((len(b) - WORD_BYTES + 1,), "<u8", buffer=np.ascontiguousarray(b).data, strides=(1,))
    n = len(b) - TRIPLE + 1
    x = (w[:n] ^ (w[:n] >> np.uint64(32))) * C1
    for k in (WORD_BYTES, 2 * WORD_BYTES):
        x += w[k : k + n]
        x = (x ^ (x >> np.uint64(29))) * C2
    return mix64(x)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    grid = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled_runs(b: np.ndarray, off: np.ndarray):
    """Of texts b[off[i]:off[i + 1]]: (text, name, second name, first window, windows, offset of the sample) of each sampled position."""
    if len(b) < LENGTH:
        return None
    own = np.ones(len(b) - LENGTH + 1, bool)
    for i in range(len(off) - 1):
        own[max(off[i], off[i + 1] - LENGTH + 1) : off[i + 1]] = False
    p = np.flatnonzero(own)
    if not len(p):
        return None
    g = triples(b)
    least = window_minima((g & ~AT) | np.arange(len(g), dtype=np.uint64), SPREAD)
    a = (least[p] & AT).astype(np.int64)
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    lo, hi = p[start], p[np.r_[start[1:], len(p)] - 1]
    a = a[start]
    second = mix64(Prefix(b).of(lo, hi + LENGTH) + (a - lo).astype(np.uint64) * C1 + (hi - lo).astype(np.uint64) * C2)
    text = np.searchsorted(off, lo, "right") - 1
    return text, g[a], second, lo - off[text], hi - lo + 1, a - lo


def run_of(lo, n, at):
    """A run in one number: its first window, its number of windows (under 128), the sample's offset from the first (under 128)."""
    return (lo * 128 + n) * 128 + at


def _rows(name, second, dk, th, run, again=None, spread=None) -> pa.RecordBatch:
    """Rows for the sort by names. Of rows with equal names in a batch only the
    first can stand for them: the others, and those given as ``again``, are
    known repeats. They go along under a name of their document, with run < 0,
    so that equal rows of one name are no more than the batches that hold it. A row
    equal to another in place too is a copy of its document's row, which speaks
    for both: it repeats nothing and does not go along. Names in ``spread`` are
    mixed with their second names, and the runs marked."""
    sure = np.zeros(len(run), bool) if again is None else again.copy()
    key = mix64(name + second * C1) if len(name) else name
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order[1:]] == key[order[:-1]]] if len(key) else np.empty(0, bool)
    i = order[same | np.r_[same[1:], False]] if len(key) else order
    i = i[~sure[i]]
    i = i[np.lexsort((run[i], th[i], dk[i], second[i], name[i]))]
    as_before = (name[i[1:]] == name[i[:-1]]) & (second[i[1:]] == second[i[:-1]])
    copy = as_before & (dk[i[1:]] == dk[i[:-1]]) & (th[i[1:]] == th[i[:-1]]) & (run[i[1:]] == run[i[:-1]])
    i, copies, as_before = np.r_[i[:1], i[1:][~copy]], i[1:][copy], as_before[~copy]
    sure[i[1:][as_before]] = True
    if len(copies):
        stays = np.ones(len(run), bool)
        stays[copies] = False
        name, second, dk, th, run, sure = (c[stays] for c in (name, second, dk, th, run, sure))
    if spread is not None and len(spread):
        hot = np.isin(name, spread) & ~sure
        name, run = np.where(hot, mix64(name ^ second * C2), name), np.where(hot, run | SPREAD_MARK, run)
    # A document's known repeats share a name, so they lie together and compress.
    name = np.where(sure, mix64(dk.view(np.uint64) ^ th.view(np.uint64) * C2) if len(run) else name, name)
    second = np.where(sure, np.uint64(0), second)
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(second.view(np.int64)), pa.array(dk), pa.array(th), pa.array(np.where(sure, -run - 1, run))], ["name", "second", "dk", "th", "run"])


def _found(batch: pa.RecordBatch):
    """sampled_runs of the texts of a batch, (row of the batch, ...), some texts or a piece of one at a time."""
    data, ends = text_bytes(batch.column("text"))
    for i, j in runs(ends):
        if ends[j] - ends[i] > PIECE:
            for s in range(0, ends[j] - ends[i], PIECE):
                b = data[ends[i] + s : min(ends[j], ends[i] + s + PIECE + LENGTH - 1)]
                if r := sampled_runs(b, np.array([0, len(b)])):
                    yield (r[0] + i, r[1], r[2], r[3] + s, *r[4:])
        elif r := sampled_runs(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]):
            yield (r[0] + i, *r[1:])


def _sample(spread: np.ndarray):
    def run(batches):
        for batch in batches:
            found, held = [], 0
            for r in _found(batch):
                if held > EMIT:
                    yield _placed(batch, found, spread)
                    found, held = [], 0
                found.append(r)
                held += len(r[0])
            if found:
                yield _placed(batch, found, spread)

    return run


def _placed(batch: pa.RecordBatch, found: list, spread: np.ndarray) -> pa.RecordBatch:
    text, name, second, lo, n, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return _rows(name, second, batch.column("dk").to_numpy()[text], batch.column("th").to_numpy()[text], run_of(lo, n, at), spread=spread)


def _names(batches):
    """(kind, name, second) of all runs (0) and of all their blocks (1)."""
    for batch in batches:
        data, ends = text_bytes(batch.column("text"))
        for text, name, second, lo, n, at in _found(batch):
            p, shift = _spanned(data, ends[text] + lo, n)
            blocks = [x[1:3] for x in _cut_blocks(p, ends[text] + lo - shift, n, at)]
            kinds = [np.zeros(len(name), np.int64), *(np.ones(len(x[0]), np.int64) for x in blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), *(pa.array(np.concatenate([own, *(x[k] for x in blocks)]).view(np.int64)) for k, own in enumerate((name, second)))], ["kind", "name", "second"])


def _spanned(data: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[Prefix, int]:
    """Hashes over the bytes that runs and their blocks need, and where those begin."""
    base, end = int(lo.min()), int((lo + n).max()) + LENGTH + BLOCK
    return Prefix(data[base:end]), base


def _cut_blocks(p: Prefix, lo: np.ndarray, n: np.ndarray, at: np.ndarray):
    """Of runs at places of p: (run, name, second name, first window, windows) of their blocks, counted back from the sample."""
    a, hi = lo + at, lo + n - 1
    for j in range(SPREAD // BLOCK + 1):
        top = a - BLOCK * j  # the block's last window, at the most
        s, e = np.maximum(lo, top - BLOCK + 1), np.minimum(hi, top)
        k = np.flatnonzero(s <= e)
        if len(k):
            s, e, t = s[k], e[k], top[k]
            # Named by the bytes that all windows of a whole block would share.
            name = mix64(p.of(t, t - BLOCK + 1 + LENGTH) + np.full(1, j, np.uint64) * C1)
            yield k, name, mix64(p.of(s, e + LENGTH) + (t - s).astype(np.uint64) * C1 + (e - s).astype(np.uint64) * C2), s, e - s + 1


def _judge(batches):
    """Of rows sorted by name, second name and place: runs that repeat, and (open)
    runs that may share windows with others of their name. Of a run that stands
    alone nothing is said. One row waits for its successor."""
    names = ("name", "second", "dk", "th", "run")
    held = None  # (row as a table, whether another second name came before, whether it is still to be judged)
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held[0], t])
        t = t.combine_chunks()
        if not len(t):
            continue
        c = [t.column(k).to_numpy() for k in names]
        n = len(t)
        as_name = np.r_[False, c[0][1:] == c[0][:-1]]
        as_second = as_name & np.r_[False, c[1][1:] == c[1][:-1]]
        copy = as_second & np.r_[False, (c[2][1:] == c[2][:-1]) & (c[3][1:] == c[3][:-1]) & (c[4][1:] == c[4][:-1])]
        # Each stretch of equal (name, second) is stood for by its first row, unless that came in an earlier batch.
        first = np.flatnonzero(~as_second)
        other_before = as_name[first].copy()
        pending = np.ones(len(first), bool)
        if held is not None:
            other_before[0], pending[0] = held[1], held[2]
        other_after = np.r_[as_name[first[1:]], False]
        sure, marked = c[4] < 0, c[4] >= SPREAD_MARK
        repeat = np.flatnonzero((as_second & ~copy) | sure)
        contested = first[pending & (other_before | other_after | marked[first]) & ~sure[first]]
        rows = np.r_[repeat, contested]
        is_open = np.r_[np.zeros(len(repeat), bool), np.ones(len(contested), bool)]
        run = c[4][rows]
        yield pa.RecordBatch.from_arrays([pa.array(c[2][rows]), pa.array(c[3][rows]), pa.array(np.where(run < 0, -run - 1, run & (SPREAD_MARK - 1))), pa.array(is_open)], [*names[2:], "open"])
        # The last stretch goes on in the next batch, with its first row if that is still to be judged.
        last = len(first) - 1
        waits = bool(pending[last] and not other_before[last] and not marked[first[last]])
        held = (t.slice(first[last] if waits else n - 1, 1), bool(other_before[last]), waits)


def _stretches(batch: pa.RecordBatch):
    """(row of the batch, run, first window's place in the batch's bytes) of the
    runs listed with texts, for some texts or a piece of one at a time."""
    data, ends = text_bytes(batch.column("text"))
    lists = batch.column("runs")
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for i, j in runs(ends):
        r = values[at[i] : at[j]]
        if not len(r):
            continue
        row = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
        place = ends[row] + (np.where(r < 0, -r - 1, r) >> 14)
        piece = (place - ends[i]) // (PIECE if ends[j] - ends[i] > PIECE else 2 * PIECE)
        for k in np.unique(piece):
            own = piece == k
            yield data, row[own], r[own], place[own]


def _blocks(spread: np.ndarray):
    """Blocks of the open runs of texts."""

    def run(batches):
        for batch in batches:
            out, held = [], 0
            dk, th = batch.column("dk").to_numpy(), batch.column("th").to_numpy()
            rows = lambda out: _rows(*(np.concatenate(x) for x in zip(*out, strict=True)), spread=spread)
            for data, row, r, place in _stretches(batch):
                n, at = (r >> 7) & 127, r & 127
                p, shift = _spanned(data, place, n)
                for k, name, second, s, m in _cut_blocks(p, place - shift, n, at):
                    out.append((name, second, dk[row[k]], th[row[k]], run_of((r[k] >> 14) + s + shift - place[k], m, 0)))
                    held += len(k)
                if held > EMIT:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    return run


def _windows(batches):
    """Single windows of open blocks; known repeats (listed as -run - 1) go along as such."""
    for batch in batches:
        out, held = [], 0
        dk, th = batch.column("dk").to_numpy(), batch.column("th").to_numpy()
        rows = lambda out: _rows(*(np.concatenate(x) for x in zip(*out, strict=True)))
        for data, row, r, place in _stretches(batch):
            again = r < 0
            if again.any():
                none = np.zeros(int(again.sum()), np.uint64)
                out.append((none, none, dk[row[again]], th[row[again]], -r[again] - 1, np.ones(len(none), bool)))
                held += len(none)
            row, r, place = row[~again], r[~again], place[~again]
            if len(r):
                n = (r >> 7) & 127
                x, shift = _spanned(data, place, n)
                run = np.repeat(np.arange(len(r)), n)
                k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                p, half = place[run] + k - shift, LENGTH // 2
                second = mix64(x.of(p, p + half) * C1 + mix64(x.of(p + half, p + LENGTH)))
                out.append((x.of(p, p + LENGTH), second >> np.uint64(32), dk[row[run]], th[row[run]], run_of((r[run] >> 14) + k, 1, 0), np.zeros(len(run), bool)))
                held += len(run)
            if held > EMIT:
                yield rows(out)
                out, held = [], 0
        if out:
            yield rows(out)


def _cut(batches):
    """Texts without their repeats: the kept bytes, the removed runs as [start, end) pairs, and all other columns."""
    for batch in batches:
        others = [k for k in batch.schema.names if k not in ("text", "runs")]
        data, ends = text_bytes(batch.column("text"))
        lists = batch.column("runs")
        ra, rv = lists.offsets.to_numpy(), lists.values.to_numpy()
        kept, spans = [], []
        for i in range(len(batch)):
            b = data[ends[i] : ends[i + 1]]
            r = np.sort(rv[ra[i] : ra[i + 1]])
            cut = np.empty(0, np.int64)
            if len(r):
                lo, end = r >> 14, np.maximum.accumulate((r >> 14) + ((r >> 7) & 127) - 1 + LENGTH)
                new = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
                cut = np.stack([lo[new], end[np.r_[new[1:], len(r)] - 1]], 1).ravel()
            spans.append(cut)
            if len(cut):
                edges = np.r_[0, cut, len(b)]
                b = np.concatenate([b[s:e] for s, e in edges.reshape(-1, 2)])
            kept.append(b.tobytes())
        sizes = np.r_[0, np.cumsum([len(x) for x in spans])].astype(np.int32)
        flat = pa.array(np.concatenate(spans) if spans else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(np.diff(ends)), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), flat)], [*others, "n_bytes", "kept", "removed"])


def _decoded(batches):
    """Kept bytes as text, without what is left of characters that lost bytes."""
    for batch in batches:
        text = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if k == "kept" else batch.column(k) for k in batch.schema.names], ["text" if k == "kept" else k for k in batch.schema.names])


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("name").sortWithinPartitions("name", "second", "dk", "th", "run")


def spread_names(docs: DataFrame) -> list[np.ndarray]:
    """Names of runs, and of blocks, with the most second names in a sample of the
    documents, SPREAD_NAMES of each at most."""
    few = docs.where(F.pmod(F.xxhash64("dk", "th"), F.lit(SAMPLED)) == 0).select("text")
    seen = few.mapInArrow(_names, "kind long, name long, second long").groupBy("kind", "name", "second").agg(F.lit(1).alias("_"))
    often = seen.groupBy("kind", "name").agg(F.count("*").alias("n")).where(F.col("n") >= CONTEXTS).orderBy(F.desc("n"), "kind", "name").limit(SPREAD_NAMES).collect()
    return [np.array(sorted(r["name"] for r in often if r["kind"] == k), np.int64).view(np.uint64) for k in (0, 1)]


def cut_repeats(docs: DataFrame, id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, kept, removed) of each row: the bytes that stay, and the
    removed runs as a flat array of starts and ends. The columns named in
    ``carry`` come along; they are not called text, runs, n_bytes, kept or removed.

    Null and empty texts keep nothing and lose nothing, nor do texts under
    LENGTH bytes. A null id comes before all others; the id is an integer or
    reads as one. Rows equal in id and text are one document, each returned;
    other texts of one id count as documents of their own, in the order of a
    hash, of 64 bits where the id is null and of 32 elsewhere.
    """
    d = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("dk"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    along = [f"carry_{i}" for i in range(len(carry))]
    d = d.withColumn("th", F.when(F.col("dk") == NO_ID, F.xxhash64("text")).otherwise(F.hash("text").cast("long")))
    place = "dk long, th long, run long"
    hot_names, hot_blocks = spread_names(d)
    sampled = d.select("dk", "th", "text").mapInArrow(_sample(hot_names), f"name long, second long, {place}")
    # Of a document as many runs as it has bytes at most.
    runs_ = checkpointed(_sorted(sampled).mapInArrow(_judge, f"{place}, open boolean").groupBy("dk", "th").agg(F.collect_list(F.when(~F.col("open"), F.col("run"))).alias("cut"), F.collect_list(F.when(F.col("open"), F.col("run"))).alias("runs")))
    # All three joins deal the texts out alike, in one query, so that they share one shuffle.
    none = F.array().cast("array<long>")
    with_text = lambda listed: d.join(listed.hint("merge"), ["dk", "th"]).select("dk", "th", "text", "runs", *along)
    blocks = with_text(runs_.where(F.size("runs") > 0).select("dk", "th", "runs")).mapInArrow(_blocks(hot_blocks), f"name long, second long, {place}")
    blocks = _sorted(blocks).mapInArrow(_judge, f"{place}, open boolean").groupBy("dk", "th").agg(F.collect_list(F.when(F.col("open"), F.col("run")).otherwise(-F.col("run") - 1)).alias("runs"))
    windows = _sorted(with_text(blocks).mapInArrow(_windows, f"name long, second long, {place}")).mapInArrow(_judge, f"{place}, open boolean")
    late = windows.where("not open").groupBy("dk", "th").agg(F.collect_list("run").alias("late"))
    plan = runs_.select("dk", "th", "cut").join(late, ["dk", "th"], "left").select("dk", "th", F.concat("cut", F.coalesce("late", none)).alias("runs"))
    whole = d.join(plan.hint("merge"), ["dk", "th"], "left").select(F.when(F.col("dk") != NO_ID, F.col("dk")).alias("id"), "text", F.coalesce("runs", none).alias("runs"), *along)
    kinds = "".join(f", {a} {docs.schema[c].dataType.simpleString()}" for a, c in zip(along, carry, strict=True))
    out = whole.mapInArrow(_cut, f"id long{kinds}, n_bytes long, kept binary, removed array<long>")
    return out.select(F.col("id").alias(id), *[F.col(a).alias(c) for a, c in zip(along, carry, strict=True)], "n_bytes", "kept", "removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, others) with what cut_repeats keeps as text.
    Documents of which nothing is left stay, with an empty text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = [f"other_{i}" for i in range(len(others))]  # no name of theirs can clash
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(p) for c, p in zip(others, plain, strict=True)])
    cut = cut_repeats(renamed, "doc_id", tuple(plain)).select("doc_id", *plain, "kept")
    kinds = "".join(f", {p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(others, plain, strict=True))
    return cut.mapInArrow(_decoded, f"doc_id long{kinds}, text string").select(*[F.col(dict(zip(others, plain, strict=True)).get(c, c)).alias(c) for c in docs.columns])


def op5(spark, sf_dir):
    out = cut_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_sql() -> str:
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM d, unnest(range(0, greatest(n - 99, 0))) AS u(p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w),
s AS (SELECT doc_id, p, CASE WHEN p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 OR row_number() OVER (PARTITION BY doc_id ORDER BY p) = 1 THEN 1 ELSE 0 END AS fresh FROM r WHERE k > 1),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
c AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * coalesce(prev, 0) + 1, 2 * (lo - coalesce(prev, 0))), '' ORDER BY lo) AS kept, max(hi) AS last
  FROM (SELECT c.*, lag(hi) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM c) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
