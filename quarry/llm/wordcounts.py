"""Exact word and n-gram counts of text chunks over Arrow buffers, and bounded hash filters.

Words of a chunk are numbered by Arrow's dictionary encoding, so counts are of
the words themselves, not of hashes. Hashes serve only as positions in a
``HashFilter``, a bit set of bounded size that driver and tasks share: it may
let a wrong key through, never hold back a right one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.textkit import Words, mix, utf8_rows

#: Text bytes counted together in a task.
CHUNK_BYTES = 4 << 20
#: Partial counts handed over at once.
OUTPUT_ROWS = 50_000
#: Bounds of a filter's size in bits; between them it has 16 bits a key.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26

_U = np.uint64
_STEPS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


def text_chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Join batches up to about ``limit`` bytes of the text column; cut batches that hold more between rows."""
    held, size = [], 0
    for batch in batches:
        _, offsets = utf8_rows(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit - size, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(offsets[stop] - offsets[start])
            start = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def string_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings (A-Z as a-z); null as the empty string."""
    raw, offsets = utf8_rows(values)
    return Words(raw, offsets).span_hash(offsets[:-1], offsets[1:])


def combined(parts: Sequence[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    out = np.zeros(len(parts[0]), _U)
    for part, step in zip(parts, _STEPS):
        out = mix(out * step + part)
    return out


class HashFilter:
    """A bit set: ``passes(hashes)`` is true for every key it was built from."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & _U(self.bits - 1)
        return (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) != 0


def column_hashes(columns: Sequence[pa.Array]) -> np.ndarray:
    return combined([string_hashes(c) for c in columns])


def hash_filter(keys: DataFrame, columns: Sequence[str], n_keys: int,
                hashes: Callable[[Sequence[pa.Array]], np.ndarray] = column_hashes) -> HashFilter:
    """Bit set of the key columns' hashes.

    The bits are set and merged in Spark; the driver receives at most one
    number per 64 bits (``MOST_BITS / 64`` rows), however many keys there are.
    """
    bits = LEAST_BITS
    while bits < min(16 * n_keys, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = hashes(b.columns) & _U(bits - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))],
                names=["slot", "mask"])

    merged = keys.select(*columns).mapInArrow(run, "slot long, mask long").groupBy("slot").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, _U)
    words[merged["slot"].to_numpy()] = merged["mask"].to_numpy().view(_U)
    return HashFilter(bits, words)


class Tokens:
    """Words of one chunk: ``kind`` numbers the distinct (group, word) pairs, ``joined`` says that a word follows
    the one before it in the same piece of text.

    ``separators`` end words; ``breaks`` (a subset) also end pieces. A-Z count as a-z.
    """

    def __init__(self, texts: pa.ChunkedArray, groups: pa.ChunkedArray, separators: bytes, breaks: bytes):
        raw, offsets = utf8_rows(texts)
        n = len(raw)
        table = np.zeros(256, np.uint8)
        table[list(separators)] = 1
        table[list(breaks)] = 2
        what = table[raw]
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = what == 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        row = np.searchsorted(offsets, start, "right") - 1
        broken = np.concatenate([[0], np.cumsum(what == 2)])
        self.joined = np.zeros(len(start), bool)
        self.joined[1:] = (row[1:] == row[:-1]) & (broken[start[1:]] == broken[end[:-1]])
        data = raw[solid[1:-1]]
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        cuts = np.concatenate([[0], np.cumsum(end - start)])
        cells = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = cells.dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_string())
        names = groups.combine_chunks().dictionary_encode()
        self.groups = names.dictionary
        group = names.indices.to_numpy()[row].astype(np.int64)
        key = group * max(len(self.words), 1) + coded.indices.to_numpy()
        kinds, self.kind = np.unique(key, return_inverse=True)
        self.kind_group, self.kind_word = np.divmod(kinds, max(len(self.words), 1))

    def group_of(self, kinds: np.ndarray) -> pa.Array:
        return self.groups.take(pa.array(self.kind_group[kinds])).cast(pa.string())

    def word_of(self, kinds: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(self.kind_word[kinds])).cast(pa.string())

    def kind_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the group and of the word of every kind."""
        return string_hashes(self.groups)[self.kind_group], string_hashes(self.words)[self.kind_word]


def count_chunks(df: DataFrame, text: int, count: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``count`` to every chunk of texts; it returns partial counts, summed up afterwards by the caller."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, text):
            out = count(chunk)
            for start in range(0, out.num_rows, OUTPUT_ROWS):
                yield out.slice(start, OUTPUT_ROWS)
    return df.mapInArrow(run, schema)
