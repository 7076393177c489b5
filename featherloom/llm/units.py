"""Texts as codes into dictionaries of their units (words, segments), block by block.

A block is some documents of one Arrow batch, about BLOCK_BYTES of text. Its
units are told apart once; a document is the row of their codes. What is known
of a unit corpus-wide is joined to the blocks' dictionaries, whose rows are far
fewer than the units of the texts, and meets the codes in one group a block. A
unit has one dictionary row a block at most, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .texthash import text_bytes

BLOCK_BYTES = 12 << 20
#: Rows of dictionary that leave a task at once.
OUT_ROWS = 1 << 16
_CODEC = pa.Codec("zstd", compression_level=3)
KIND = "block long, ids binary, marks binary, ends binary, codes binary, unit string, code int, n long"


def packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed place by place: the first of all numbers, then the second, and so on."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return len(x).to_bytes(8, "little") + x.dtype.str.encode().ljust(8) + (_CODEC.compress(np.ascontiguousarray(planes).data, asbytes=True) if len(x) else b"")


def unpacked(b: bytes) -> np.ndarray:
    n, kind = int.from_bytes(b[:8], "little"), np.dtype(b[8:16].decode().strip())
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(_CODEC.decompress(b[16:], n * kind.itemsize), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _ranges(ends: np.ndarray):
    """Ranges [i, j) of documents of about BLOCK_BYTES together; a longer one is alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_BYTES, "right")) - 1))
        yield i, j
        i = j


def dictionary_blocks(docs: DataFrame, cut: Callable, path: str) -> DataFrame:
    """Encodes ``docs`` (id long, text string, mark boolean) into a table at ``path``.

    ``cut(data, ends)`` gives (bytes, unit offsets, number of units of each text)
    of some UTF-8 texts. Block rows hold ids (with a null bit), marks, and each
    document's end among codes; dictionary rows hold unit, code, and n, how often
    the unit occurs in marked documents of the block. Null texts are empty.
    """

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            data, ends = text_bytes(b.column("text"))
            ids = b.column("id")
            numbers, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            marks = b.column("mark").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in _ranges(ends):
                block = (part << 32) | k
                k += 1
                raw, offsets, count = cut(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                units = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
                coded = units.dictionary_encode()
                codes, words = coded.indices.to_numpy().astype(np.int32), coded.dictionary
                order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # small codes for frequent units
                place = np.empty(len(words), np.int32)
                place[order] = np.arange(len(words), dtype=np.int32)
                codes, words = place[codes], words.take(pa.array(order))
                n = np.bincount(codes[np.repeat(marks[i:j], count)], minlength=len(words))
                one = [block, packed(np.stack([numbers[i:j], none[i:j].astype(np.int64)]).ravel()), packed(marks[i:j].astype(np.uint8)), packed(np.cumsum(count)), packed(codes.astype(np.uint16) if len(words) < 1 << 16 else codes), None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, _TYPES, strict=True)], _NAMES)
                for a in range(0, len(words), OUT_ROWS):
                    w = words.slice(a, OUT_ROWS)
                    m, nothing = len(w), [pa.nulls(len(w), pa.binary())] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), *nothing, w.cast(pa.string()), pa.array(np.arange(a, a + m, dtype=np.int32)), pa.array(n[a : a + m].astype(np.int64))], _NAMES)

    return written(docs.select("id", "text", F.coalesce("mark", F.lit(False)).alias("mark")).mapInArrow(run, KIND), "", path)


_NAMES = ["block", "ids", "marks", "ends", "codes", "unit", "code", "n"]
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64()]


def block_rows(encoded: DataFrame) -> DataFrame:
    return encoded.where("unit is null").select("block", "ids", "marks", "ends", "codes")


def unit_rows(encoded: DataFrame) -> DataFrame:
    return encoded.where("unit is not null").select("block", "unit", "code", "n")


def block_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, marks, starts with a last end, codes) of a table's single block row."""
    ids, marks, ends, codes = (unpacked(table.column(c)[0].as_py()) for c in ("ids", "marks", "ends", "codes"))
    numbers, none = ids.reshape(2, -1)
    return pa.array(numbers, mask=none.astype(bool)), marks.astype(bool), np.r_[0, ends].astype(np.int64), codes


def per_document(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of each document's values."""
    total = np.r_[np.zeros(1, values.dtype), np.cumsum(values)]
    return total[starts[1:]] - total[starts[:-1]]
