"""Piece encoding with spans in the original bytes, and decoding.

Ids come from the installed sentencepiece library with an existing model. The
normaliser is rebuilt here with its alignment: longest-prefix replacement
through the model's compiled character map, one source position per
normalised byte. Piece lengths then project every piece to the bytes of the
original text it came from.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches

_SPACE = "▁".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 and the strings it points to."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``text[at:]``."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start:self.strings.index(b"\0", start)]
        return found


def normalise(text: bytes, chars: CharacterMap, dummy_prefix: bool, squeeze: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes (spaces as U+2581) and, per byte and for the end, the source position."""
    out, source = bytearray(), []

    def put(piece: bytes, at: int) -> None:
        out.extend(piece)
        source.extend([at] * len(piece))
    at, space = 0, squeeze
    if not text:
        return b"", np.zeros(1, np.int64)
    if dummy_prefix:
        put(_SPACE, 0)
    while at < len(text):
        hit = chars.longest(text, at)
        if hit:
            used, new = hit
        else:
            lead = text[at]
            used = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            new = text[at:at + used]
        for i in range(len(new)):
            if new[i] == 0x20:
                if not space:
                    put(_SPACE, at)
                space = squeeze
            else:
                put(new[i:i + 1], at)
                space = False
        at += used
    if squeeze:
        while out.endswith(_SPACE):
            del out[-3:], source[-3:]
    # positions of the end: of the text, or where trailing spaces began
    return bytes(out), np.array([*source, len(text)], np.int64)


@dataclass
class Encoded:
    ids: list[int]
    start: np.ndarray
    end: np.ndarray


class PieceCodec:
    """One model: ``encode`` gives ids and byte spans, ``decode`` the text of ids."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(open(model_file, "rb").read())
        if not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("needs a model with byte fallback and spaces as prefixes")
        self.chars = CharacterMap(spec.normalizer_spec.precompiled_charsmap)
        self.dummy = spec.normalizer_spec.add_dummy_prefix
        self.squeeze = spec.normalizer_spec.remove_extra_whitespaces
        self.plain = not self.chars.units and not self.squeeze and self.dummy
        texts = [p.piece.encode() for p in spec.pieces]
        byte_kind = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        self.length = np.array([1 if p.type == byte_kind else len(t) for p, t in zip(spec.pieces, texts)], np.int64)
        self.spaces = np.array([t.count(_SPACE) for t in texts], np.int64)
        self.names = [str(i) for i in range(len(texts))]

    def encode(self, texts: list[str]) -> list[Encoded]:
        return [Encoded(ids, *self.spans(text, ids))
                for text, ids in zip(texts, self.library.encode(texts, num_threads=1))]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Byte start and end of every piece in ``text``; a piece of a replaced character covers all of it."""
        raw = text.encode()
        index = np.array(ids, np.int64)
        upto = np.cumsum(self.length[index])
        if self.plain and _SPACE not in raw:
            # every U+2581 stands for one space byte, the first for nothing
            end = upto - 2 * np.cumsum(self.spaces[index]) - 1
            start = np.concatenate(([0], end[:-1])) if len(end) else end
        else:
            normal, source = normalise(raw, self.chars, self.dummy, self.squeeze)
            if len(ids) and upto[-1] != len(normal):
                raise ValueError("pieces do not cover the normalised text")
            start, end = source[upto - self.length[index]], source[upto]
            end = np.maximum.accumulate(end) if len(end) else end
        if len(end) and not self.squeeze and end[-1] != len(raw):
            raise ValueError("spans do not cover the text")
        return start, end

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def _map_texts(docs: DataFrame, model_file: str, id_col: str, text_col: str, schema: str,
               emit: Callable[[PieceCodec, list[str], list[Encoded]], list[pa.Array]]) -> DataFrame:
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        names = ["doc_id", *[f.split()[0] for f in schema.split(", ")]]
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *emit(tool, texts, tool.encode(texts))], names)
    return kept.mapInArrow(run, f"doc_id {id_type}, {schema}")


def encode_documents(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, span_start, span_end, decoded`` of every whole text.

    Ids carry no begin or end marks. Spans are byte offsets into the UTF-8
    text; consecutive spans touch and cover it. Null and empty texts give
    empty lists; rows of equal id stay separate; an empty table gives no rows;
    other columns are ignored. ``model_file`` must be readable on every node.
    """
    def emit(tool: PieceCodec, texts: list[str], done: list[Encoded]) -> list[pa.Array]:
        return [pa.array([e.ids for e in done], pa.list_(pa.int32())), pa.array([e.start for e in done], pa.list_(pa.int64())),
                pa.array([e.end for e in done], pa.list_(pa.int64())), pa.array([tool.decode(e.ids) for e in done], pa.string())]
    return _map_texts(docs, model_file or default_model(), id_col, text_col,
                      "ids array<int>, span_start array<bigint>, span_end array<bigint>, decoded string", emit)


def encoding_digests(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256``: digests of what ``encode_documents`` gives.

    Digests are taken beside the encoder, so id lists of whole corpora never
    travel. ``ids_sha256`` is over decimal ids joined by commas,
    ``spans_sha256`` over the little-endian 64-bit span ends.
    """
    def emit(tool: PieceCodec, texts: list[str], done: list[Encoded]) -> list[pa.Array]:
        names = tool.names

        def digest(data: bytes) -> str:
            return hashlib.sha256(data).hexdigest()
        return [pa.array([len(e.ids) for e in done], pa.int64()),
                pa.array([digest(",".join([names[i] for i in e.ids]).encode()) for e in done], pa.string()),
                pa.array([digest(tool.decode(e.ids).encode()) for e in done], pa.string()),
                pa.array([digest(e.end.astype("<i8").tobytes()) for e in done], pa.string())]
    return _map_texts(docs, model_file or default_model(), id_col, text_col,
                      "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string", emit)


def token_ids(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of ``encode_documents`` alone, for training files.

    Null and empty texts give empty lists, rows of equal id stay separate, an
    empty table gives no rows, other columns are ignored.
    """
    def emit(tool: PieceCodec, texts: list[str], done: list[Encoded]) -> list[pa.Array]:
        return [pa.array([len(e.ids) for e in done], pa.int64()), pa.array([e.ids for e in done], pa.list_(pa.int32()))]
    return _map_texts(docs, model_file or default_model(), id_col, text_col, "n_tokens bigint, ids array<int>", emit)
