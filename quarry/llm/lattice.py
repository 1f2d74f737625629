"""Language-model scores: word frequencies and the marginal likelihood over all subword segmentations.

The vocabulary is an existing piece model. Its piece probabilities are learned
from the training documents (piece counts over a prior from the model's own
ranking); the probability of a word is the sum over all its segmentations, by
a forward recursion in log space. A text is its words and one end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, stored
from quarry.llm.pieces import codec, default_model
from quarry.llm.textkit import list_column, slices, utf8_rows, words_of

#: Words held by every scoring task; the others meet their counts in a join.
FREQUENT_WORDS = 500_000
#: Distinct words a counting task holds before it passes them on.
COUNT_BUFFER = 400_000
LN10 = math.log(10.0)


def piece_probabilities(model_file: str, counts: np.ndarray, strength: float = 32_000.0) -> dict[str, float]:
    """Natural log probability per piece; byte pieces are keyed by ``<0xNN>``.

    The prior falls with the rank that the model's own scores give; training
    counts are added to ``strength`` prior observations.
    """
    library = codec(model_file).library
    n = library.get_piece_size()
    ids = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    scores = np.array([library.get_score(i) for i in ids])
    rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    prior = 1.0 / (rank + 10.0)
    p = counts[ids] + strength * prior / prior.sum()
    logs = np.log(p / p.sum())
    return {library.id_to_piece(i): float(x) for i, x in zip(ids, logs)}


class Lattice:
    """Marginal log10 probability of words over all segmentations into pieces."""

    def __init__(self, logs: dict[str, float]):
        self.bytes = [logs.get(f"<0x{b:02X}>", -30.0) for b in range(256)]
        self.pieces = {p: x for p, x in logs.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.heads = {p[:i] for p in self.pieces for i in range(1, len(p))}

    def word(self, word: str) -> float:
        """A character without a piece of its own is spelled by its byte pieces."""
        s = "▁" + word
        n, pieces, heads = len(s), self.pieces, self.heads
        forward: list[float | None] = [None] * (n + 1)
        forward[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            base = forward[i]
            if base is None:
                continue
            if s[i] not in pieces:
                edges = [(i + 1, sum(self.bytes[b] for b in s[i].encode()))]
            else:
                edges = []
            for j in range(i + 1, n + 1):
                part = s[i:j]
                x = pieces.get(part)
                if x is not None:
                    edges.append((j, x))
                if part not in heads:
                    break
            for j, x in edges:
                x += base
                old = forward[j]
                if old is None:
                    forward[j] = x
                elif x > old:
                    forward[j] = x + log1p(exp(old - x))
                else:
                    forward[j] = old + log1p(exp(x - old))
        return forward[n] / LN10


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the task's texts with all and training counts."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def merged() -> pa.RecordBatch:
        h = np.concatenate([p[0] for p in parts])
        ids, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(ids)).astype(np.int64) for i in (1, 2)]
        text = pa.concat_arrays([p[3] for p in parts]).take(pa.array(first))
        return ids, *sums, text

    def flush(ids, every, train, text) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), 20_000):
            cut = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[cut].view(np.int64)), text[cut], pa.array(every[cut]), pa.array(train[cut])],
                                             ["hash", "word", "every", "train"])
    for batch in batches:
        raw, offsets = utf8_rows(batch.column("text"))
        learn = batch.column("held_out").to_numpy(zero_copy_only=False) == False  # noqa: E712
        for a, b in slices(offsets):
            w = words_of(raw, offsets, a, b)
            if not len(w.start):
                continue
            ids, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
            every = np.bincount(inverse, minlength=len(ids))
            train = np.bincount(inverse, learn[a:b][w.row], len(ids)).astype(np.int64)
            low = w.raw.copy()
            low[(low >= 65) & (low <= 90)] += 32
            data = low.tobytes()
            s, e = w.start[first], w.end[first]
            parts.append((ids, every, train, pa.array([data[i:j] for i, j in zip(s, e)], pa.binary()).cast(pa.string())))
            if sum(len(p[0]) for p in parts) > COUNT_BUFFER:
                parts[:] = [merged()]
                if len(parts[0][0]) > COUNT_BUFFER // 2:
                    yield from flush(*parts.pop())
    if parts:
        yield from flush(*merged())


def score_documents(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 10, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """Score every whole text with what the training rows teach.

    Training rows are those whose crc32 of the id (as text) modulo ``folds``
    is not 0. Returns ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``: ``base_score`` sums log10 of smoothed token
    frequencies, ``score`` is the log10 marginal lattice probability of the
    text, with an end probability per token. Words are compared after
    lower-casing A-Z.

    Word counts cover all documents. At most ``frequent_words`` words (those
    at or above a power-of-two count) go to every task; all others are joined
    to their counts by a shuffle, so nothing unbounded is broadcast. Null
    text is empty (one token, the end), a null id counts as an empty text id,
    rows of equal id are scored one by one, an empty table gives no rows, and
    other columns are ignored.
    """
    model_file = model_file or default_model()
    small_batches(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    texts = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary = stored(texts.select("held_out", "text").mapInArrow(_word_counts, "hash bigint, word string, every bigint, train bigint")
                        .groupBy("hash", "word").agg(F.sum("every").alias("every"), F.sum("train").alias("train")))
    ends = texts.where(~F.col("held_out")).count()
    row = vocabulary.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    tokens, kinds = row[0] + ends, row[1] + (ends > 0)

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = codec(model_file).library
        total = np.zeros(library.get_piece_size())
        for batch in batches:
            weight = batch.column("train").to_numpy()
            ids = library.encode(batch.column("word").to_pylist(), num_threads=1)
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            total += np.bincount(flat, np.repeat(weight, [len(x) for x in ids]), len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])
    counted = (vocabulary.where("train > 0").select("word", "train").mapInArrow(count_pieces, "piece bigint, n double")
               .groupBy("piece").agg(F.sum("n").alias("n")).collect())  # one row per piece of the model
    counts = np.zeros(codec(model_file).library.get_piece_size())
    for r in counted:
        counts[r["piece"]] = r["n"]
    logs = docs.sparkSession.sparkContext.broadcast(piece_probabilities(model_file, counts))
    whole = tokens + 0.1 * (kinds + 1)
    p_end = (ends + 1) / (tokens + 2)
    stay, stop = math.log10(1 - p_end), math.log10(p_end)

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Lattice(logs.value)
        for batch in batches:
            train = batch.column("train").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), batch.column("every"), pa.array((train > 0).astype(np.int64)),
                 pa.array(np.log10((train + 0.1) / whole)), pa.array([one.word(w) + stay for w in batch.column("word").to_pylist()], pa.float64())],
                ["hash", "every", "known", "base", "mark"])
    lexicon = stored(vocabulary.mapInArrow(word_scores, "hash bigint, every bigint, known bigint, base double, mark double"))
    # the smallest power of two that at most `frequent_words` words reach
    level = F.floor(F.log2(F.col("every").cast("double"))).cast("int")
    steps = {r["l"]: r["n"] for r in lexicon.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = 63, frequent_words
    while least > 0 and steps.get(least - 1, 0) <= room:
        least -= 1
        room -= steps.get(least, 0)
    common = lexicon.where(F.col("every") >= 2 ** least).select("hash", "known", "base", "mark").toPandas()
    common = common.assign(hash=common["hash"].to_numpy().view(np.uint64)).sort_values("hash")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("hash", "known", "base", "mark")))
    end_base = math.log10(((ends if tokens else 0) + 0.1) / whole)
    end_known = int(ends > 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, *values = shared.value
        for batch in batches:
            raw, offsets = utf8_rows(batch.column("text"))
            totals, tails, lengths = [], [], []
            for a, b in slices(offsets):
                w = words_of(raw, offsets, a, b)
                h = w.hashes()
                found = np.zeros(len(h), bool)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    found = hashes[at] == h
                    totals.append([np.bincount(w.row[found], v[at[found]], b - a) for v in values])
                else:
                    totals.append([np.zeros(b - a) for _ in values])
                rest, rows = h[~found], w.row[~found]
                edges = np.searchsorted(rows, np.arange(b - a + 1))
                tails += [rest[edges[i]:edges[i + 1]] for i in range(b - a)]
                lengths.append(np.diff(w.bounds))
            known, base, mark = (np.concatenate([t[i] for t in totals]) if totals else np.zeros(0) for i in range(3))
            n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64) + 1),
                 pa.array(known.astype(np.int64) + end_known), pa.array(base + end_base), pa.array(mark + stop), list_column(tails)],
                ["doc_id", "held_out", "n_tokens", "known", "base", "mark", "tail"])
    id_type = texts.schema["doc_id"].dataType.simpleString()
    partial = stored(texts.mapInArrow(sums, f"doc_id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, mark double, tail array<bigint>")
                     .withColumn("row", F.monotonically_increasing_id()))
    rest = partial.select("row", F.explode("tail").alias("hash"))
    tail = rest.join(lexicon, "hash").groupBy("row").agg(F.sum("known").alias("t_known"), F.sum("base").alias("t_base"), F.sum("mark").alias("t_mark"))

    def plus(a: str, b: str):
        return F.col(a) + F.coalesce(b, F.lit(0))
    return partial.drop("tail").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "t_known").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        plus("base", "t_base").alias("base_score"), plus("mark", "t_mark").alias("score"))
