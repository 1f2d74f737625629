"""Spelling variants: words one edit apart, found by a trie over letter-group counts.

Every word has a vector of counts, one per group of letters (``LETTER_GROUPS``).
One inserted, deleted or replaced letter changes the vector by at most one
surplus (a group counted once more) and one deficit (a group counted once
less). The trie arranges the words by successive counts; the search for a
word's neighbours follows the branches whose counts differ from its own as far
as a budget of one surplus and one deficit lasts, and verifies the words at the
leaves it reaches letter by letter.

The trie is shared out: a *subtree* is a path of the first counts that holds at
most ``SUBTREE_WORDS`` words (longer paths where more share one). Paths and
their sizes are a Spark table; words travel down it as searches, a few levels
at a time, by joins that spend the budget, until they reach their subtrees.
Each subtree is then built and searched in a task (a subtree wanted by many
words in several), depth first over blocks of searches. A task returns one row
per searching word, its number of neighbours and the best one, never pairs, so
a word with very many variants costs no more than another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sized_bytes, small_batches, solve_runs, stored
from quarry.llm.textkit import mix, utf8_rows
from quarry.llm.wordcounts import HashFilter, count_chunks, hash_filter

#: Letters counted together, one trie level each: frequent letters alone, the most telling first.
LETTER_GROUPS = ("e", "t", "a", "n", "i", "o", "r", "s", "h", "l", "d", "u", "c", "m", "g", "p",
                 "bvw", "fjkqxyz", "àáâãäåæèéêë")  # all other letters make up the last level
#: Levels that routing descends at once.
STRIDE = 5
#: Words of one subtree, and searches of one subtree worked on by one task.
SUBTREE_WORDS, SUBTREE_SEARCHES = 4096, 16384
#: Searches that go down a subtree together, and word pairs verified at once.
BLOCK, PAIRS = 1024, 1 << 18

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, SLIP = 6, 5, 5, 199


def run_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               slip: int = SLIP) -> DataFrame:
    """``(word, n)`` of the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z as a-z.

    Where ``slip`` divides the crc32 of ``<id>:<run>`` (a null id is empty) the
    run loses its code point at ``crc32 % length``. Words shorter than
    ``least_length`` are left out. Null texts have none.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].alias("text"))

    def count(chunk: pa.Table) -> pa.RecordBatch:
        words, n = _count_runs(chunk, least_length, slip)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return count_chunks(source, 1, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count_runs(chunk: pa.Table, least: int, slip: int) -> tuple[list[str], list[int]]:
    raw, offsets = utf8_rows(chunk.column("text"))
    n = len(raw)
    low = raw | 0x20
    lead = raw == 0xC3
    inside = ((low >= 97) & (low <= 122) & (raw < 128)) | lead
    inside[1:] |= lead[:-1]
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = inside
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = end - start - (leads[end] - leads[start])
    keep = points >= least
    start, end, points = start[keep], end[keep], points[keep]
    row = np.searchsorted(offsets, start, "right") - 1
    # bytes of the kept runs side by side, lower-cased
    size = end - start
    cuts = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    cells = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    coded = cells.dictionary_encode()
    runs, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    # crc32 of "<id>:<run>": the head's crc carried over the run's length, combined with the run's own
    tails = np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in chunk.column("id").to_pylist()], np.uint32)
    crc = _carried(heads, row, size) ^ tails[index]
    hit = np.flatnonzero(crc % np.uint32(slip) == 0)
    counts = np.bincount(index, minlength=len(runs))
    np.subtract.at(counts, index[hit], 1)
    out = {r.decode(): c for r, c in zip(runs, counts.tolist()) if c}
    for k, c, p in zip(index[hit].tolist(), crc[hit].tolist(), points[hit].tolist()):
        if p > least:
            word = runs[k].decode()
            word = word[:c % p] + word[c % p + 1:]
            out[word] = out.get(word, 0) + 1
    return list(out), list(out.values())


_CRC_TABLE = np.array([0] * 256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC_TABLE[_i] = _c


def _carried(heads: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``crc32(head + run) ^ crc32(run)``: the crc of each run's head moved on by the run's length."""
    out = np.zeros(len(row), np.uint32)
    order = np.argsort(size, kind="stable")
    now, at = heads.copy(), 0
    bounds = np.searchsorted(size[order], np.arange(int(size.max()) + 2)) if len(size) else []
    for length in range(len(bounds) - 1):
        if at < bounds[length + 1]:
            here = order[bounds[length]:bounds[length + 1]]
            out[here] = now[row[here]]
            at = bounds[length + 1]
        now = _CRC_TABLE[now & np.uint32(255)] ^ (now >> np.uint32(8))
    return out


def _vector(word: Column, groups: Sequence[str]) -> Column:
    """A word's counts as its path in the trie: one character per group, "0" for none (74 stands for more)."""
    counts = [F.length(word) - F.length(F.translate(word, g, "")) for g in groups]
    counts.append(F.length(F.translate(word, "".join(groups), "")))
    return F.concat(*[F.char((F.least(c, F.lit(74)) + 48).cast("long")) for c in counts])


def trie_nodes(words: DataFrame, steps: Sequence[int], most: int) -> dict[int, DataFrame]:
    """Per depth in ``steps`` the existing paths ``(path, wide)`` below wide ones; wide: more than ``most`` words."""
    out, now = {}, words.select("vector")
    for depth in steps:
        size = now.groupBy(F.substring("vector", 1, depth).alias("path")).agg(F.count(F.lit(1)).alias("n"))
        out[depth] = stored(size.select("path", ((F.col("n") > most) & F.lit(depth < steps[-1])).alias("wide")))
        wide = out[depth].where("wide").select("path")
        if wide.isEmpty():
            break
        now = now.join(sized_bytes(wide), F.substring("vector", 1, depth) == F.col("path"), "left_semi")
    return out


_LEVEL_KEYS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _path_sums(column: pa.Array, depth: int) -> np.ndarray:
    raw, _ = utf8_rows(column)
    return (raw.reshape(len(column), -1)[:, :depth].astype(np.uint64) * _LEVEL_KEYS[:depth]).sum(axis=1, dtype=np.uint64)


def _descend(frontier: DataFrame, nodes: DataFrame, low: int, high: int) -> DataFrame:
    """Searches one stride further: to every existing path of ``high`` levels their budget reaches."""
    keep = sum_filter(nodes, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw, _ = utf8_rows(b.column("vector"))
            vector = raw.reshape(b.num_rows, -1)
            path = np.zeros((b.num_rows, 0), np.uint8)
            if low:
                path = utf8_rows(b.column("path"))[0].reshape(b.num_rows, -1)
            surplus, deficit = b.column("surplus").to_numpy(), b.column("deficit").to_numpy()
            goal = np.concatenate([path, vector[:, low:high]], axis=1)
            base = (goal.astype(np.uint64) * _LEVEL_KEYS[:high]).sum(axis=1, dtype=np.uint64)
            for up in (-1, *range(low, high)):
                for down in (-1, *range(low, high)):
                    if up == down >= 0:
                        continue
                    at, sums = np.arange(b.num_rows), base
                    if up >= 0:
                        at = at[surplus[at] > 0]
                    if down >= 0:
                        at = at[(deficit[at] > 0) & (goal[at, down] > 48)]
                    sums = base[at]
                    if up >= 0:
                        sums = sums + _LEVEL_KEYS[up]
                    if down >= 0:
                        sums = sums - _LEVEL_KEYS[down]
                    at = at[keep.passes(mix(sums))]
                    if not len(at):
                        continue
                    to = goal[at]
                    if up >= 0:
                        to[:, up] += 1
                    if down >= 0:
                        to[:, down] -= 1
                    cuts = pa.py_buffer(np.arange(0, (len(at) + 1) * high, high, dtype=np.int32))
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("word").take(rows), b.column("n").take(rows), b.column("vector").take(rows),
                         pa.StringArray.from_buffers(len(at), cuts, pa.py_buffer(to.tobytes())),
                         pa.array((surplus[at] - (up >= 0)).astype(np.int32)),
                         pa.array((deficit[at] - (down >= 0)).astype(np.int32))],
                        names=["word", "n", "vector", "path", "surplus", "deficit"])

    moved = frontier.mapInArrow(run, "word string, n long, vector string, path string, surplus int, deficit int")
    return moved.join(sized_bytes(nodes), "path")


def sum_filter(nodes: DataFrame, depth: int) -> HashFilter:
    """Bounded filter of the existing paths, by the sums that one changed count moves by one level key."""
    return hash_filter(nodes, ["path"], nodes.count(), lambda columns: mix(_path_sums(columns[0], depth)))


def _one_edit(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Rows of ``a`` and ``b`` (zero-padded letters, lengths) that differ by one inserted, deleted or replaced letter."""
    out = (la == lb) & ((a != b).sum(axis=1) == 1)
    for short, ls, long, ll in ((a, la, b, lb), (b, lb, a, la)):
        at = np.flatnonzero(ll == ls + 1)
        if len(at):
            s, n = short[at, :-1], ls[at]
            ahead = (s != long[at, :-1])
            first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), n)  # letters equal from the front
            moved = (s != long[at, 1:]) & (np.arange(s.shape[1]) < n[:, None])
            last = np.where(moved.any(axis=1), s.shape[1] - moved[:, ::-1].argmax(axis=1), 0)
            out[at] = last <= np.minimum(first, n)
    return out


def _one_edit_text(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:] and a != b


#: Letters up to which words are compared as matrix rows; longer ones one by one.
MATRIX_LETTERS = 48


class Trie:
    """Words arranged by their counts, level by level; a leaf holds the words of one vector."""

    def __init__(self, words: list[str], vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1])
        self.words = [words[i] for i in order]
        vectors = vectors[order]
        node = np.zeros(len(words), np.int64)
        self.children: list[np.ndarray] = []
        for level in range(vectors.shape[1]):
            keys, node = np.unique(node * 256 + vectors[:, level], return_inverse=True)
            self.children.append(keys)
        self.leaf = np.searchsorted(node, np.arange(len(self.children[-1]) + 1))
        self.order = order

    def search(self, vectors: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (search, word) whose counts differ by at most one surplus and one deficit, block by block."""
        levels = vectors.shape[1]
        n = len(vectors)
        todo = [(0, np.arange(i, min(i + block, n)), None, None, None) for i in range(0, n, block)]
        while todo:
            level, q, node, surplus, deficit = todo.pop()
            if node is None:
                node, surplus, deficit = np.zeros(len(q), np.int64), np.ones(len(q), bool), np.ones(len(q), bool)
            while level < levels and len(q):
                if len(q) > 32 * block:  # go down with one half first
                    half = len(q) // 2
                    todo.append((level, q[half:], node[half:], surplus[half:], deficit[half:]))
                    q, node, surplus, deficit = q[:half], node[:half], surplus[:half], deficit[:half]
                keys = self.children[level]
                parts = []
                for change, able in ((0, None), (1, surplus), (-1, deficit)):
                    at = np.arange(len(q)) if able is None else np.flatnonzero(able)
                    want = node[at] * 256 + vectors[q[at], level] + change
                    found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    hit = keys[found] == want
                    at, found = at[hit], found[hit]
                    parts.append((q[at], found, surplus[at] & (change <= 0), deficit[at] & (change >= 0)))
                q, node, surplus, deficit = (np.concatenate(p) for p in zip(*parts))
                level += 1
            size = self.leaf[node + 1] - self.leaf[node] if len(q) else np.zeros(0, np.int64)
            ends = np.cumsum(size)
            start = 0
            while start < len(q):
                done = ends[start - 1] if start else 0
                stop = max(int(np.searchsorted(ends, done + PAIRS, "right")), start + 1)
                s = size[start:stop]
                first = np.cumsum(s) - s
                yield (np.repeat(q[start:stop], s),
                       np.repeat(self.leaf[node[start:stop]] - first, s) + np.arange(int(s.sum())))
                start = stop


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = min(int(size.max(initial=0)), MATRIX_LETTERS) + 1
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        if len(w) < width:
            out[i, :len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)
    return out, size


def search_subtree(rows: pa.Table) -> pa.RecordBatch | None:
    """All searches of one subtree: ``(word, n_near, best, best_n)`` of those that find a neighbour."""
    stored_here = rows.column("stored").to_numpy()
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    raw, _ = utf8_rows(rows.column("vector"))
    vectors = raw.reshape(rows.num_rows, -1).astype(np.int64)
    held = np.flatnonzero(stored_here)
    seen: dict[str, int] = {}
    for i in np.flatnonzero(~stored_here).tolist():
        seen.setdefault(words[i], i)
    ask = np.fromiter(seen.values(), np.int64, len(seen))
    if not len(held) or not len(ask):
        return None
    trie = Trie([words[i] for i in held], vectors[held])
    here = held[trie.order]
    rank = np.empty(len(here), np.int64)
    by_worth = sorted(range(len(here)), key=lambda i: (-int(counts[here[i]]), trie.words[i]))
    rank[by_worth] = np.arange(len(here))
    asked = [words[i] for i in ask]
    width = MATRIX_LETTERS + 1
    (a, la), (b, lb) = _letters(asked), _letters(trie.words)
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    near, best = np.zeros(len(ask), np.int64), np.full(len(ask), len(here))
    for q, w in trie.search(vectors[ask]):
        short = (la[q] < width) & (lb[w] < width)
        ok = np.zeros(len(q), bool)
        ok[short] = _one_edit(a[q[short]], la[q[short]], b[w[short]], lb[w[short]])
        for i in np.flatnonzero(~short).tolist():
            ok[i] = _one_edit_text(asked[q[i]], trie.words[w[i]])
        near += np.bincount(q[ok], minlength=len(near))
        np.minimum.at(best, q[ok], rank[w[ok]])
    hit = np.flatnonzero(near)
    if not len(hit):
        return None
    top = [by_worth[i] for i in best[hit]]
    return pa.RecordBatch.from_arrays(
        [pa.array([asked[i] for i in hit], pa.string()), pa.array(near[hit]),
         pa.array([trie.words[i] for i in top], pa.string()), pa.array(counts[here[top]].astype(np.int64))],
        names=["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame, groups: Sequence[str] = LETTER_GROUPS, stride: int = STRIDE,
               most: int = SUBTREE_WORDS, searches: int = SUBTREE_SEARCHES) -> DataFrame:
    """Per word of ``words (word, n)`` with a word one edit apart: ``word, n_near, best, best_n``.

    Words are distinct, of code points below 256. ``best`` is the near word of
    largest ``n`` (ties: smallest in code-point order).
    """
    small_batches(words.sparkSession)
    levels = len(groups) + 1
    steps = [*range(stride, levels, stride), levels]
    listed = stored(words.select("word", "n", _vector(F.col("word"), groups).alias("vector")))
    nodes = trie_nodes(listed, steps, most)
    frontier = listed.withColumns({"path": F.lit(""), "surplus": F.lit(1), "deficit": F.lit(1)})
    arrived, low = None, 0
    for high in nodes:
        moved = stored(_descend(frontier, nodes[high], low, high))
        here = moved.where("not wide").drop("wide")
        arrived = here if arrived is None else arrived.unionByName(here)
        frontier, low = moved.where("wide").drop("wide"), high

    crowded = stored(arrived.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > searches))
    spread = arrived.join(sized_bytes(crowded), "path", "left").select(
        F.xxhash64("path").alias("tree"), "word", "n", "vector",
        ((F.col("surplus") == 1) & (F.col("deficit") == 1)).alias("home"),
        F.coalesce(F.ceil(F.col("size") / searches), F.lit(1)).cast("long").alias("parts"))
    ask = spread.select("tree", F.pmod(F.xxhash64("word"), F.col("parts")).alias("part"), "word", "n", "vector",
                        F.lit(False).alias("stored"))
    hold = spread.where("home").select(
        "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "word", "n", "vector",
        F.lit(True).alias("stored"))
    found = hold.unionByName(ask).repartition("tree", "part").sortWithinPartitions("tree", "part").mapInArrow(
        solve_runs(["tree", "part"], search_subtree), "word string, n_near long, best string, best_n long")
    worth = F.struct((-F.col("best_n")).alias("less"), "best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(worth).alias("top")).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, slip: int = SLIP,
                      **search) -> DataFrame:
    """Words of the corpus and the form each is a variant of: ``word, form, root, n, n_near, form_n``.

    A word's form is its near word (one code point inserted, deleted or
    replaced) of largest count, if that count is ``ratio`` times its own or
    more; ``root`` follows forms to the last. Null and empty texts have no
    words; a null id counts as empty; repeated rows count again; an empty table
    gives no rows. Other columns are not read. Further arguments go to
    ``near_words``.
    """
    counted = stored(run_counts(docs, id_col, text_col, least_length, slip).where(F.col("n") >= least_count))
    near = near_words(counted, **search)
    good = F.col("best_n") >= ratio * F.col("n")
    linked = stored(counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    roots = _roots(linked.where("form is not null").select("word", "form"))
    return linked.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)``: pointers doubled until none moves; counts grow along forms, so chains end."""
    now = stored(links.toDF("word", "root"))
    while True:
        onward = sized_bytes(now.toDF("root", "further"))
        step = stored(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                              F.col("further").isNotNull().alias("moved")))
        now, moved = step.select("word", "root"), step.where("moved")
        if moved.isEmpty():
            return now
