"""Aligning two tokenizers' tokens over a corpus, by distinct segments.

A text is cut before runs of spaces at places that no token of either
vocabulary can cross. Segments are told apart block by block and brought
together corpus-wide, so each distinct one is tokenised and aligned once; the
alignments are joined back to the blocks, where documents are composed of them.

A cut before a space is sound for a byte-level tokenizer whose splitting rule
never puts a space behind other characters into one piece, and for a piece
tokenizer if no piece has a space behind another character, as a merge across
the cut would make one. Both are verified on the vocabularies (``cuts_hold``);
where that fails a whole text is one segment, with the same results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import drop, shared_folder, written
from .common import table
from .texthash import text_bytes
from .units import block_of, block_rows, dictionary_blocks, packed, per_document, unit_rows, unpacked

#: Where the vocabulary files are, unless a caller says otherwise. Only the driver reads them.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments that are tokenised at once, and their bytes, about.
SEGMENTS, SEGMENT_BYTES = 4_096, 1 << 20
_MARK = "▁"  # a piece's space


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token if c in letters)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        one_byte = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(one_byte.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.cuts = cuts_hold(json.loads(byte_bpe), self)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments, each beginning with the space that the piece tokenizer adds by itself."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return a, self.b.encode([s[1:] for s in segments], num_threads=1)


def cuts_hold(rules: dict, both: Tokenizers) -> bool:
    """Whether no token of either tokenizer crosses a cut, and neither looks across one."""
    pre = rules.get("pre_tokenizer") or {}
    a = rules.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    a = a and all(t.get("special") for t in rules.get("added_tokens", [])) and not any(re.search(r"\S ", x.decode(errors="replace")) for x in both.a_bytes)
    probe = " a  b\t ﬁ é "  # nothing may be folded, stripped or composed
    b = both.b.normalize(probe) == _MARK + probe.replace(" ", _MARK) and not any(_MARK in p.lstrip(_MARK) for p in both.pieces)
    return bool(a and b)


def segments(data: np.ndarray, ends: np.ndarray, cuts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, segments of each text) of UTF-8 texts with a space before
    each. Cuts are before a space that other spaces or characters follow and
    that follows a character other than white space. Empty texts have none."""
    size = np.diff(ends)
    full = np.flatnonzero(size)
    d = np.insert(data, ends[:-1][full], 32) if len(full) else data
    first = ends[:-1][full] + np.arange(len(full))
    if not len(d):
        return d, np.zeros(1, np.int64), np.zeros(len(size), np.int64)
    head = np.zeros(len(d) + 1, bool)
    head[first] = True
    head[-1] = True
    if cuts:
        white = (d == 32) | ((d >= 9) & (d <= 13)) | ((d >= 28) & (d <= 31))
        one, two, three = d, np.r_[np.uint8(0), d[:-1]], np.r_[np.zeros(2, np.uint8), d[:-2]]
        wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
        wide |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | np.isin(one, [0xA8, 0xA9, 0xAF])) | (two == 0x81) & (one == 0x9F))
        head[1:-1] |= (d[1:] == 32) & ~(white | wide)[:-1] & ~head[2:]
    offsets = np.flatnonzero(head)
    count = np.zeros(len(size), np.int64)
    count[full] = np.diff(np.searchsorted(offsets, np.r_[first, len(d)]))
    return d, offsets, count


#: What ends with a link, the next piece of a text: a token of A, one of B, or one of each.
ONLY_A, ONLY_B, BOTH = 0, 1, 2


def linked(a: list[list[int]], b: list[list[int]], a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A ids, B ids, what ends with each link, links up to the end of each text) of
    texts whose A and B tokens cover the same bytes.

    The ends of A and B tokens cut a text into pieces; each is inside one A and
    one B token, so pieces and links are the same.
    """
    ia, ib = (np.array([i for x in y for i in x], np.int64) for y in (a, b))
    ea, eb = np.cumsum(a_length[ia]), np.cumsum(b_length[ib])
    every = np.union1d(ea, eb)
    left, right = np.searchsorted(ea, every), np.searchsorted(eb, every)
    step = np.where(ea[left] == every, np.where(eb[right] == every, BOTH, ONLY_A), ONLY_B).astype(np.uint8)
    text_of = np.searchsorted(np.cumsum([len(x) for x in a]), left, "right")
    return ia, ib, step, np.searchsorted(text_of, np.arange(len(a)), "right")


def links_of(ia: np.ndarray, ib: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Pairs a << 32 | b of the links."""
    before = lambda ends: np.r_[0, np.cumsum(ends)[:-1]] if len(ends) else np.empty(0, np.int64)
    return ia.astype(np.int64)[before(step != ONLY_B)] << 32 | ib.astype(np.int64)[before(step != ONLY_A)]


def group_texts(ia: np.ndarray, ib: np.ndarray, step: np.ndarray, tokens_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all groups as text, each followed by a semicolon, and where the
    token numbered so (A and B counted together, at a text's start) begins."""
    # The group of each token: groups end where both do.
    ended = np.cumsum(step == BOTH) - (step == BOTH)
    group_a, group_b = ended[step != ONLY_B], ended[step != ONLY_A]
    last = lambda g: np.r_[np.diff(g) != 0, np.ones(min(1, len(g)), bool)].astype(np.int64)
    # In the text a group's A tokens go before its B tokens.
    order = np.lexsort((np.r_[np.zeros(len(ia), int), np.ones(len(ib), int)], np.r_[group_a, group_b]))
    ids, mark = np.r_[ia, ib].astype(np.int64)[order], np.r_[last(group_a), 2 * last(group_b)][order]
    key, place = np.unique(ids * 3 + mark, return_inverse=True)
    words = pa.array([f"{k // 3}{',|;'[k % 3]}" for k in key.tolist()], pa.large_binary())
    data, ends = text_bytes(words.take(pa.array(place)))
    return data[ends[0] : ends[-1]], (ends - ends[0])[tokens_before]


@functools.lru_cache(2)
def _both(byte_bpe: str, piece_bpe: bytes) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


#: Alignments of a task's segments leave it in packets, one a block, of so many rows together.
PACKET_ROWS = 1 << 17
ALIGNED = "block long, codes binary, sizes binary, a binary, b binary, steps binary"


def _aligned(units: list[str], both: Tokenizers) -> pa.Table:
    """(n_a, n_b, n_links, a, b, steps) of segments; all empty where a tokenizer does not give one back."""
    a, b = both.encode(units)
    good = [b"".join(map(both.a_bytes.__getitem__, x)) == u.encode() == b"".join(map(both.b_bytes.__getitem__, y)) for x, y, u in zip(a, b, units, strict=True)]
    a, b = ([x if g else [] for x, g in zip(y, good, strict=True)] for y in (a, b))
    ia, ib, step, ends = linked(a, b, both.a_length, both.b_length)
    held = lambda x, n: pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(np.r_[0, n * x.itemsize].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    na, nb = (np.array([len(x) for x in y], np.int32) for y in (a, b))
    return pa.table({"n_a": na, "n_b": nb, "n_links": np.diff(ends, prepend=0).astype(np.int32), "a": held(ia.astype(np.int32), np.cumsum(na)), "b": held(ib.astype(np.int32), np.cumsum(nb)), "steps": held(step, ends)})


def _packets(held: list[pa.Table]) -> pa.RecordBatch:
    rows = pa.concat_tables(held).sort_by([("block", "ascending"), ("code", "ascending")]).combine_chunks()
    block, code = rows.column("block").to_numpy(), rows.column("code").to_numpy()
    sizes = np.stack([rows.column(c).to_numpy() for c in ("n_a", "n_b", "n_links")])
    raw = {c: (*text_bytes(rows.column(c).combine_chunks()), k) for c, k in (("a", np.int32), ("b", np.int32), ("steps", np.uint8))}
    edge = np.flatnonzero(np.r_[True, np.diff(block) != 0])
    out = {c.split(" ")[0]: [] for c in ALIGNED.split(", ")}
    for i, j in zip(edge, [*edge[1:], len(block)], strict=True):
        out["block"].append(block[i])
        out["codes"].append(packed(np.diff(code[i:j], prepend=np.int32(0)).astype(np.int32)))
        out["sizes"].append(packed(np.ascontiguousarray(sizes[:, i:j]).ravel()))
        for c, (data, at, kind) in raw.items():
            out[c].append(packed(np.frombuffer(data[at[i] : at[j]].tobytes(), kind)))
    return pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), *[pa.array(out[c], pa.binary()) for c in list(out)[1:]]], list(out))


def _unpacked(packets: pa.Table):
    """(sizes, A ids, B ids, steps) of a block's segments, in order of their codes."""
    get = lambda c: [unpacked(x.as_py()) for x in packets.column(c)]
    code = np.concatenate([np.empty(0, np.int64), *[np.cumsum(x) for x in get("codes")]])
    sizes = np.concatenate([np.empty((3, 0), np.int64), *[x.reshape(3, -1) for x in get("sizes")]], 1)
    order = np.argsort(code, kind="stable")

    def moved(c: str, n: np.ndarray, kind) -> np.ndarray:
        x, m = np.concatenate([np.empty(0, kind), *get(c)]), n[order]
        return x[np.repeat(np.cumsum(n)[order] - m - np.cumsum(m) + m, m) + np.arange(m.sum())]

    return sizes[:, order], moved("a", sizes[0], np.int32), moved("b", sizes[1], np.int32), moved("steps", sizes[2], np.uint8)


def _aligner(files: tuple[str, bytes]):
    """Rows sorted by segment: equal ones are neighbours and are worked out once."""

    def run(batches):
        both, last, known, held, n = _both(*files), None, None, [], 0
        for whole in batches:
            size = np.r_[0, np.cumsum(pc.binary_length(whole.column("unit")).to_numpy(zero_copy_only=False))]
            at = 0
            while at < len(whole):
                to = min(len(whole), at + SEGMENTS, max(at + 1, int(np.searchsorted(size, size[at] + SEGMENT_BYTES, "right")) - 1))
                rows = whole.slice(at, to - at)
                at = to
                coded = rows.column("unit").dictionary_encode()
                units = coded.dictionary.to_pylist()
                goes_on = units[0] == last
                new = units[goes_on:]
                found = pa.concat_tables([known] * goes_on + ([_aligned(new, both)] if new else []))
                last, known = units[-1], found.slice(len(units) - 1, 1)
                held.append(found.take(coded.indices).append_column("block", rows.column("block")).append_column("code", rows.column("code")))
                n += len(rows)
                if n >= PACKET_ROWS:
                    yield _packets(held)
                    held, n = [], 0
        if held:
            yield _packets(held)

    return run


COMPOSED = "block long, ids binary, n_a binary, n_b binary, n_groups binary, n_links binary, groups array<string>, ends binary, codes binary, link_ends binary, link_pairs binary, pair long, place int, n long"


def _compose(digest: bool):
    """A block's documents from the alignments of its segments, and how many of them hold each pair."""

    def run(docs: pa.Table, aligned: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        _, _, starts, codes = block_of(docs)
        (na, nb, links), ia, ib, step = _unpacked(aligned)
        ok, n_segments, ends = na > 0, len(na), np.cumsum(links)
        ng = per_document((step == BOTH).astype(np.int64), np.r_[0, ends])
        good = (np.diff(starts) > 0) & (per_document((~ok[codes]).astype(np.int64), starts) == 0)
        sums = {k: np.where(good, per_document(x[codes].astype(np.int64), starts), 0) for k, x in (("n_a", na), ("n_b", nb), ("n_groups", ng), ("n_links", links))}
        texts, at = group_texts(ia, ib, step, np.r_[0, np.cumsum(na + nb)])
        texts = pa.Array.from_buffers(pa.large_binary(), n_segments, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(texts))])
        distinct, place = np.unique(links_of(ia, ib, step), return_inverse=True)
        groups, n = [], np.zeros(len(distinct), np.int64)
        for i, j in _document_runs(starts, RUN_UNITS):
            own = codes[starts[i] : starts[j]]
            # Each document's text of groups is a run of one buffer.
            data, at = text_bytes(texts.take(pa.array(own)))
            for k in range(i, j):
                run = data[at[starts[k] - starts[i]] : at[starts[k + 1] - starts[i]] - 1] if good[k] else b""  # without the last semicolon
                groups.append("" if not good[k] else hashlib.sha256(run).hexdigest() if digest else bytes(run).decode())
            # Pairs that good documents hold, once each.
            of = np.repeat(np.arange(j - i), np.diff(starts[i : j + 1]))
            doc, code = np.divmod(np.unique((of * max(1, n_segments) + own)[good[i:j][of]]), max(1, n_segments))
            many = links[code]
            flat = np.repeat(ends[code] - many - np.cumsum(many) + many, many) + np.arange(many.sum())
            n += np.bincount(np.unique(np.repeat(doc, many) * max(1, len(distinct)) + place[flat]) % max(1, len(distinct)), minlength=len(distinct))
        of = np.repeat(np.arange(len(good)), np.diff(starts))
        one = {"block": [block], "ids": [docs.column("ids")[0].as_py()], **{k: [packed(v)] for k, v in sums.items()}, "groups": [groups], "ends": [packed(starts[1:])], "codes": [packed(np.where(good[of], codes.astype(np.int32), -1))], "link_ends": [packed(ends)], "link_pairs": [packed(place.astype(np.int32))]}
        some = {"block": np.full(len(distinct), block), "pair": distinct, "place": np.arange(len(distinct), dtype=np.int32), "n": n}
        schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[k]) for c, k in (x.split(" ") for x in COMPOSED.split(", "))])
        made = [pa.table({f.name: pa.array(x[f.name], f.type) if f.name in x else pa.nulls(len(x["block"]), f.type) for f in schema}, schema) for x in (one, some)]
        return pa.concat_tables(made)

    return run


#: Units of documents whose pairs are counted side by side.
RUN_UNITS = 1 << 18


def _document_runs(starts: np.ndarray, step: int):
    """Ranges of documents of about ``step`` units together."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(starts, starts[i] + step, "right")) - 1))
        yield i, j
        i = j


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _weigh(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Adds to a block's documents what its pairs count corpus-wide."""
    get = lambda c: unpacked(docs.column(c)[0].as_py())
    count, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    place = counts.column("place").to_numpy()
    count[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
    ends, pairs, codes, starts = get("link_ends"), get("link_pairs"), get("codes"), np.r_[0, get("ends")].astype(np.int64)
    numbers, none = get("ids").reshape(2, -1)
    edge = np.r_[0, ends].astype(np.int64)
    of_segment = [np.r_[per_document(x[pairs], edge), 0] for x in (best, count)]  # a segment of a text without tokens has the last code
    sums = [per_document(x[codes], starts) for x in of_segment]
    return pa.table({"id": pa.array(numbers, mask=none.astype(bool)), **{c: get(c) for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": sums[0], "count_sum": sums[1], "groups": docs.column("groups").combine_chunks().flatten()})


def align(docs: DataFrame, id: str = "doc_id", tokenizers: str = TOKENIZERS, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row.

    A is the byte-level tokenizer in ``byte_bpe``, B the piece tokenizer in
    ``piece_bpe``, both files of the folder ``tokenizers`` on the driver. A text
    with a space before it is cut into groups where tokens of both end:
    ``groups`` lists them as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its
    SHA-256, worked out where the text is composed. Links are pairs of tokens
    that share bytes; a pair's count is how many rows hold it, and a link is
    best if no pair of its A token counts more. Texts that are null, empty, or
    that a tokenizer does not give back byte by byte have no tokens: zeros and
    ''. Rows are documents of their own, repeated or without an id; other
    columns are ignored; no rows give none.
    """
    with open(os.path.join(tokenizers, byte_bpe), encoding="utf-8") as f, open(os.path.join(tokenizers, piece_bpe), "rb") as g:
        files = f.read(), g.read()  # a few megabytes, whatever the input: they go along with the tasks
    cuts = _both(*files).cuts
    rows = docs.select(F.col(id).cast("long").alias("id"), "text", F.lit(True).alias("mark"))
    encoded = dictionary_blocks(rows, functools.partial(segments, cuts=cuts), path := shared_folder(docs.sparkSession, "segments"))
    dealt = unit_rows(encoded).select("unit", "block", "code").repartition("unit").sortWithinPartitions("unit")
    aligned = dealt.mapInArrow(_aligner(files), ALIGNED)
    composed = written(block_rows(encoded).groupBy("block").cogroup(aligned.groupBy("block")).applyInArrow(_compose(digest), COMPOSED), "composed")
    drop(docs.sparkSession, path)
    pairs = composed.where("pair is not null").select("block", "pair", "place", "n")
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32))
    # An A token has as many pairs as B has tokens, at most.
    counts = counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))).select("pair", "count", "best")
    known = pairs.join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    blocks = composed.where("ids is not null").drop("pair", "place", "n")
    out = blocks.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_weigh, RESULT)
    return out.withColumnRenamed("id", id)


def op13(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
