"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of ``n`` tokens is estimated to cost ``linear * n + quadratic * n * n``
(dense layers plus attention inside the piece). Documents are packed in groups
of consecutive documents of one task, each group about ``GROUP_TOKENS`` long:
whole sequences are cut off documents longer than a sequence, and what is left,
longest first, goes to the sequence of lowest cost that still has room for it.
What fits nowhere is cut at the room of the cheapest open sequence. The open
sequences of a group have exactly as many places as tokens are left, the last
ones of power-of-two lengths, which need no padding; so a group pads nothing.

Nothing is shuffled: a task reads its split once, holds one group, and a group
never depends on keys, so a key that fills the table changes nothing. A lost
task packs its split again in the same order (give a table whose partitions are
reproducible: files or a checkpoint) and gets the same sequences.

Token ids come from ``tokenizers``. The text is cut where the pre-tokeniser of
the byte-level vocabulary always cuts, each distinct segment is encoded once a
chunk, and known segments are kept per worker. Segments of ASCII and Latin-1
text may be encoded by ``tiktoken`` from the same vocabulary (several times
faster, equal ids); without its rank file all go through ``tokenizers``.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import small_batches
from quarry.llm.textkit import utf8_rows

CAPACITY = 2048
END_ID = 1
#: Cost of a token, and of a token pair inside a piece (dense to attention work at width 1,024).
LINEAR, QUADRATIC = 1.0, 1.0 / 6144
#: Tokens packed together; bounds the memory of a task and the length of one search.
GROUP_TOKENS = 1 << 20
#: Bytes of text encoded at once, and segments a worker remembers.
CHUNK_BYTES = 4 << 20
KNOWN_SEGMENTS = 400_000

_LATIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\xbf])*")


def segment_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pre-tokeniser cuts whatever surrounds them, text ends included.

    These are: before a single space between visible characters, around a
    single line feed between visible characters, and before ASCII punctuation
    after a Latin letter. Fewer cuts would be right too, only slower.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n:
        low = raw | 0x20
        ascii_letter = (low >= 97) & (low <= 122) & (raw < 128)
        visible = (raw > 0x20) & (raw < 0x7F)
        latin = np.zeros(n, bool)  # last byte of U+00C0..U+00FF
        latin[1:] = raw[:-1] == 0xC3
        last, first = visible | latin, visible | (raw == 0xC3)
        alone = np.zeros(n, bool)
        alone[1:-1] = last[:-2] & first[2:]
        feed = (raw == 0x0A) & alone
        cut[:-1] = ((raw == 0x20) & alone) | feed
        cut[1:] |= feed
        letter = ascii_letter | (latin & (raw != 0x97) & (raw != 0xB7))
        punctuation = visible & ~ascii_letter & ~((raw >= 48) & (raw <= 57))
        cut[1:-1] |= punctuation[1:] & letter[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut)


def _chunks(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that end where a segment does (none inside: the range grows)."""
    n, start = len(raw), 0
    while start < n:
        stop = start + limit
        while stop < n:
            at = max(start, stop - 65536)
            window = raw[at:stop]
            inner = segment_starts(window, np.array([0, len(window)]))[1:-1]
            inner = inner[(inner < len(window) - 2) & (window[inner] == 0x20)]
            if len(inner):
                stop = at + int(inner[-1])
                break
            stop += limit
        stop = min(stop, n)
        yield start, stop
        start = stop


class Encoder:
    """Token ids of whole texts, segment by segment."""

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(tokenizer)
        # special strings (without spaces) are matched before the pre-tokeniser: no cut falls inside one
        self._special = re.compile(b"|".join(
            re.escape(t.content.encode()) for t in self._slow.get_added_tokens_decoder().values()) or b"(?!)")
        self._fast = None
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._known: dict[bytes, list[int]] = {}

    def _segments(self, wanted: list[bytes]) -> list[list[int]]:
        known = self._known
        if len(known) > KNOWN_SEGMENTS:
            known.clear()
        slow = []
        for s in wanted:
            if s not in known:
                if self._fast and _LATIN.fullmatch(s) and not self._special.search(s):
                    known[s] = self._fast.encode_ordinary(s.decode())
                else:
                    slow.append(s)
        if slow:
            for s, e in zip(slow, self._slow.encode_batch([s.decode() for s in slow], add_special_tokens=False)):
                known[s] = e.ids
        return [known[s] for s in wanted]

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each ended by ``end_id``, side by side, and the row offsets."""
        parts, counts, ends = [], [], []
        for a, b in _chunks(raw, CHUNK_BYTES):
            inside = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b, "right")] - a
            starts = segment_starts(raw[a:b], np.concatenate([[0], inside, [b - a]]))
            for m in self._special.finditer(raw[a:b]):
                ends_inside = np.isin(inside, range(m.start() + 1, m.end())).any()
                if not ends_inside:
                    starts = starts[(starts <= m.start()) | (starts >= m.end())]
            cells = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw[a:b])])
            coded = cells.dictionary_encode()
            ids = self._segments(coded.dictionary.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for s in ids for i in s), np.uint32, int(size.sum()))
            at = np.cumsum(size) - size
            index = coded.indices.to_numpy()
            here = size[index]
            first = np.cumsum(here) - here
            parts.append(flat[np.repeat(at[index] - first, here) + np.arange(int(here.sum()))])
            counts.append(here)
            ends.append(starts[1:] + a)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        bounds = before[np.searchsorted(ends, offsets, "right")]
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """Pieces ``(document, start, length, sequence, offset)`` of one group, ordered by document and start."""
    out: list[tuple[int, int, int, int, int]] = []
    for d, n in enumerate(lengths.tolist()):
        out += [(d, k * capacity, capacity, -1, 0) for k in range(n // capacity)]
    out = [(d, s, n, i, o) for i, (d, s, n, _, o) in enumerate(out)]
    rest = lengths % capacity
    total = int(rest.sum())
    tail = total % capacity
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    room = np.array(rooms, np.int64)
    used, cost, base = np.zeros(len(room), np.int64), np.zeros(len(room)), len(out)
    # longest first; ties by place in the group
    queue = sorted((-int(n), d, int(lengths[d] - n)) for d, n in enumerate(rest) if n)
    at = 0
    while at < len(queue):
        left, d, start = queue[at]
        n, at = -left, at + 1
        fits = room >= n
        whole = bool(fits.any())
        k = int(np.argmin(np.where(fits if whole else room > 0, cost, np.inf)))
        take = n if whole else int(room[k])
        out.append((d, start, take, base + k, int(used[k])))
        room[k] -= take
        used[k] += take
        cost[k] += linear * take + quadratic * take * take
        if take < n:
            bisect.insort(queue, (take - n, d, start + take), lo=at)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                   linear: float = LINEAR, quadratic: float = QUADRATIC, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset, cost, ids``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit
    numbers, ``cost`` the estimated cost of the whole sequence. A null or empty
    text is its end id alone; null and repeated ids and rows are packed like
    any others; an empty table gives no rows. Other columns of ``docs`` are not
    read. ``tokenizer`` is a byte-level BPE file of ``tokenizers``; ``ranks``
    and ``pattern`` the same vocabulary for ``tiktoken``.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks, pattern)
        place = TaskContext.get().partitionId() << 40
        held_ids, held, sizes, tokens = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal place, held_ids, held, sizes, tokens
            names = pa.concat_arrays(held_ids)
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            doc, start, n, sequence, offset = assign(lengths, capacity, linear, quadratic).T
            piece_cost = linear * n + quadratic * n.astype(float) ** 2
            totals = np.bincount(sequence, piece_cost)
            cuts = np.concatenate([[0], np.cumsum(n)]) * 4
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype("<u4"))])
            out = pa.RecordBatch.from_arrays(
                [names.take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(lengths[doc]),
                 pa.array(place + sequence), pa.array(offset), pa.array(totals[sequence]), data.cast(pa.binary())],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "ids"])
            place += len(totals)
            held_ids, held, sizes, tokens = [], [], [], 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = encoder.encode(*utf8_rows(batch.column(1)), end_id)
            for a, b in _row_groups(bounds, group_tokens):
                held_ids.append(batch.column(0).slice(a, b - a))
                held.append(ids[bounds[a]:bounds[b]])
                sizes.append(np.diff(bounds[a:b + 1]))
                tokens += int(bounds[b] - bounds[a])
                if tokens >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    schema = (f"id {id_type.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, "
              "cost double, ids binary")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _row_groups(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` tokens (one row at least)."""
    start, n = 0, len(bounds) - 1
    while start < n:
        stop = min(max(int(np.searchsorted(bounds, bounds[start] + limit, "left")), start + 1), n)
        yield start, stop
        start = stop
