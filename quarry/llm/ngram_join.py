"""Exact Jaccard join of word shingle sets through a token-group matrix.

1. Equal sets collapse to one node.
2. Nodes that share a minimum hash with a leader and agree with it in enough
   of 16 minimum hashes are put into its group; each group is compared inside,
   exactly, by one matrix product of its sets.
3. The matrix holds, per group, the union of its members' prefix tokens. In a
   common order of all tokens (rare first), two sets of Jaccard >= t share at
   least k tokens among their first ``n - ceil(t n) + k``; so the overlap of a
   set with a group's union bounds its overlap with every member, and a group
   with fewer than k common tokens holds no partner.
4. Only qualifying groups are opened: their members of fitting size are
   verified exactly against the query set.
5. All links are joined to components.

Only the grouping is heuristic; steps 3 and 4 find every link between
different groups whatever the groups are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import (
    block_pairs, connected_components, forest, plain_name, plain_names, sized, small_batches, solve_runs, stored,
)
from quarry.llm.textkit import list_column, shingle_sets, slices, utf8_rows, words_of

#: Tokens in more than so many prefixes go to the end of the common order ...
COMMON_DOCS = 48
#: ... the most frequent so many of them; the order only steers cost, never results.
COMMON_TOKENS = 1_000_000
#: Tokens are counted by their upper 40 bits; the order stays total, ties go by the whole token.
TOKEN_SHIFT = np.uint64(24)
#: Shared prefix tokens that a group needs to be opened.
SHARED = 3
#: Node ids up to which a list of wanted documents is broadcast.
WANTED_ROWS = 2_000_000

#: Minimum hashes per set, how many of them name buckets, and how many must agree with a leader's.
SIGNATURE, KEYS, AGREE = 16, 6, 6
#: Sets of a group that one task compares with as many others.
BLOCK = 512
_MULTIPLIERS = np.random.default_rng(99).integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _needed(n: np.ndarray | int, percent: int):
    """ceil(t n): common tokens that any partner of a set of n must share."""
    return -(-n * percent // 100)


def _shingles(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    raw, offsets = utf8_rows(batch.column("text"))
    for a, b in slices(offsets):
        yield from shingle_sets(words_of(raw, offsets, a, b), k)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _arrow_sets(docs: DataFrame, k: int, schema: str, emit) -> DataFrame:
    """Map ``docs (doc_id, text)`` to ``doc_id, d1, d2`` and what ``emit`` makes of the non-empty shingle sets."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column("doc_id"), list(_shingles(batch, k))
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), *emit(sets)],
                ["doc_id", "d1", "d2", *names])
    return docs.mapInArrow(run, f"doc_id {id_type}, d1 bigint, d2 bigint, {schema}")


def _with_digests(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """``docs`` with ``_n, _d1, _d2``: size and digest of every row's shingle set."""
    added = [T.StructField(c, T.LongType()) for c in ("_n", "_d1", "_d2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"])
            found = [(len(s), *_digest(s)) for s in _shingles(texts, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]],
                                             [*batch.schema.names, "_n", "_d1", "_d2"])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _signatures(sets: list[np.ndarray]) -> list[pa.Array]:
    mins = [np.array([(s * m).min() for m in _MULTIPLIERS]) if len(s) else s for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), list_column(mins)]


def _prefix_length(n: int, percent: int, shared: int) -> int:
    return min(n, n - _needed(n, percent) + shared)


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.k, self.percent, self.repeated = k, percent, True
        small_batches(docs.sparkSession)

    def sets(self, nodes: DataFrame, *more: str) -> DataFrame:
        """``(node, h, more...)``: the full shingle sets of ``nodes (node, doc, d1, d2, more...)``, from their documents' texts."""
        wanted = stored(nodes)
        ids = wanted.select("doc").distinct()
        ids = F.broadcast(ids) if wanted.count() <= WANTED_ROWS else ids
        docs = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
        full = _arrow_sets(docs, self.k, "h array<bigint>", lambda sets: [list_column(sets)])
        same = (full["d1"] == wanted["d1"]) & (full["d2"] == wanted["d2"]) & full["doc_id"].eqNullSafe(wanted["doc"])
        sets = full.join(sized(wanted, WANTED_ROWS), same).select("node", "h", *more)
        return sets.dropDuplicates(["node"]) if self.repeated else sets


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Two rows link when their sets of distinct ``k``-word shingles (A-Z
    lower-cased words; fewer words form one shingle) have
    ``100 * common >= percent * union``; ``component_id`` is the smallest id
    reachable by links. All links count, found exactly (shingles are compared
    by 64-bit, equal sets by 128-bit hashes). Rows without words, or with null
    text, link with nothing. Rows of equal id are compared each by its text;
    null ids are linked but never name a component, unless all its ids are
    null. An empty table gives no rows; other columns are ignored.
    """
    return _labelled(docs, k, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _labelled(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, d1, d2, n, component_id, keep`` for every row.

    ``keep`` holds for rows without words and for the rows of one id and one
    set per component: the smallest id (nulls last), then the smallest digest.
    """
    job = _Join(docs, k, percent, id_col, text_col)
    found = stored(_arrow_sets(job.docs, k, "n bigint, sig array<bigint>", _signatures))
    # only rows that repeat an id can repeat a set's document
    job.repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    nodes = stored(found.where("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()))
    members = _groups(nodes)
    edges = _within_groups(job, members).union(_between_groups(job, nodes, members))
    components = stored(connected_components(edges).withColumnRenamed("node", "n_node"))
    named = nodes.join(components, F.col("node") == F.col("n_node"), "left").select(
        "d1", "d2", "doc", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "d1", "d2")).alias("first"))
    chosen = (F.col("d1") == F.col("first.d1")) & (F.col("d2") == F.col("first.d2"))
    labels = stored(named.join(names, "component").select(
        F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("first.doc").alias("component_id"), chosen.alias("chosen")))
    some = F.col("n") > 0
    return found.join(labels, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & some, "left").select(
        "doc_id", "d1", "d2", "n", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id"))).otherwise(True).alias("keep"))


def _least_common(percent: int) -> Column:
    """Prefix tokens that a set of ``na`` must share with a group of sizes ``n_lo`` to ``n_hi`` that holds a partner.

    Of all common tokens of two similar sets, those not in both prefixes lie
    behind one of them, so they are at most ``n - prefix`` of that set. The
    bound is concave in the partner's size: its least is at an end.
    """
    def needed(n: Column) -> Column:
        return F.ceil(n * percent / 100)

    def bound(nb: Column) -> Column:
        overlap = F.ceil((F.col("na") + nb) * percent / (100 + percent) - 1e-6)
        return overlap - F.greatest(needed(F.col("na")), needed(nb)) + SHARED - 1
    lo = F.greatest(F.col("n_lo"), needed(F.col("na")))
    hi = F.least(F.col("n_hi"), F.floor(F.col("na") * 100 / percent))
    return F.least(bound(lo), bound(hi))


def _groups(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``grp``: nodes of one minimum-hash bucket join the bucket's leaders they agree with.

    Leaders are the set of most copies and the set of smallest node, so the
    original of many altered copies gathers them.
    """
    keys = nodes.select("node", "copies", "sig", F.posexplode(F.slice("sig", 1, KEYS)).alias("i", "m"))
    one = F.struct("node", "sig")
    leaders = keys.groupBy("i", "m").agg(
        F.count(F.lit(1)).alias("size"), F.max_by(one, F.struct("copies", "node")).alias("l1"), F.min_by(one, "node").alias("l2")
    ).where("size > 1")
    agree = F.size(F.filter(F.zip_with("sig", F.col("l.sig"), lambda a, b: a == b), lambda x: x))
    edges = (keys.join(leaders, ["i", "m"]).select("node", "sig", F.explode(F.array("l1", "l2")).alias("l"))
             .where((F.col("node") != F.col("l.node")) & (agree >= AGREE))
             .select(F.col("node").alias("a"), F.col("l.node").alias("b")).distinct())
    components = connected_components(edges).withColumnRenamed("node", "_node")
    return stored(nodes.join(components, F.col("node") == F.col("_node"), "left").select(
        "node", "doc", "d1", "d2", "n", F.coalesce("component", "node").alias("grp")))


def _solve_group(percent: int):
    """Exact links inside one block, or between two, of a group; a spanning forest of them is returned."""
    def solve(t: pa.Table) -> pa.RecordBatch | None:
        rows, lo, hi = t.num_rows, t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        if rows < 2:
            return None
        column = t.column("h").combine_chunks()
        n = np.diff(column.offsets.to_numpy())
        tokens, inverse, seen = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(rows), n)
        several = seen > 1
        rank = np.cumsum(several) - 1
        keep = several[inverse]
        owner, place = owner[keep], rank[inverse[keep]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        width = max(1024, (1 << 23) // rows)
        common = np.zeros((rows, rows), np.float32)
        for first in range(0, int(several.sum()), width):
            a, b = np.searchsorted(place, (first, first + width))
            m = np.zeros((rows, width), np.float32)
            m[owner[a:b], place[a:b] - first] = 1
            common += m @ m.T
        links = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        if lo != hi:
            side = t.column("side").to_numpy()
            links &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(links, 1))
        if not len(i):
            return None
        ids, inverse = np.unique(t.column("node").to_numpy()[np.concatenate([i, j])], return_inverse=True)
        label = forest(inverse[:len(i)], inverse[len(i):], ids)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], ["a", "b"])
    return solve


def _within_groups(job: _Join, members: DataFrame) -> DataFrame:
    """Links between sets of one group: every set is sent once per block of its group."""
    sizes = stored(members.groupBy("grp").agg(F.count(F.lit(1)).alias("fill")).where("fill > 1"))
    inside = members.join(sized(sizes), "grp")
    sets = job.sets(inside.select("node", "doc", "d1", "d2", "grp", "fill"), "grp", "fill")
    return stored(block_pairs(sets, ["grp"], "node", "fill", BLOCK).mapInArrow(
        solve_runs(("grp", "lo", "hi"), _solve_group(job.percent)), "a bigint, b bigint"))


def _between_groups(job: _Join, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Links between sets of different groups, by the token-group matrix."""
    k, percent = job.k, job.percent
    spark = job.docs.sparkSession

    def first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [s[:_prefix_length(len(s), percent, SHARED)] for s in _shingles(batch, k)]
            if sum(map(len, parts)):
                t, c = np.unique(np.concatenate(parts) >> TOKEN_SHIFT, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], ["token", "c"])
    counts = (job.docs.select("text").mapInArrow(first_tokens, "token bigint, c bigint")
              .groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") > COMMON_DOCS))
    # at most COMMON_TOKENS narrow rows, whatever the corpus
    common = counts.orderBy(F.desc("c"), "token").limit(COMMON_TOKENS).toPandas()
    tokens = common["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[order], common["c"].to_numpy(np.int64)[order]))

    def prefixes(sets: list[np.ndarray]) -> list[pa.Array]:
        known, weight = shared.value
        out = []
        for s in sets:
            n = _prefix_length(len(s), percent, SHARED) if len(s) > 3 else 0  # sets up to 3 match equal ones only
            if n and len(known):
                short = s >> TOKEN_SHIFT
                at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                cost = np.where(known[at] == short, weight[at], 0)
                s = s[np.argsort(cost, kind="stable")]
            out.append(s[:n])
        return [list_column(out)]
    rows = _arrow_sets(job.docs, k, "p array<bigint>", prefixes)
    keyed = members.select("node", "grp", "doc", F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    same = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("doc_id").eqNullSafe(F.col("doc"))
    postings = rows.join(keyed, same).select("node", "grp", F.explode("p").alias("token"))
    across = Window.partitionBy("token")
    # the matrix without tokens of one group only
    matrix = stored(postings.withColumn("lo", F.min("grp").over(across)).withColumn("hi", F.max("grp").over(across))
                    .where("lo < hi").select("token", "node", "grp").distinct())
    sizes = stored(members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi")))
    # most groups have one member; the sizes of the others come without a shuffle on the group, which can be hot
    crowds = sizes.where("size > 1").select("grp", "size")
    ranked = matrix.join(sized(crowds), "grp", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("bigint")))
    query = ranked.select("token", F.col("node").alias("q"), F.struct("size", "grp").alias("qg"))
    union = ranked.select("token", F.struct("size", "grp").alias("ug")).distinct()
    asking = members.select(F.col("node").alias("q"), F.col("n").alias("na"))
    # the smaller group asks
    opened = (query.join(union, "token").where("qg < ug").groupBy("q", F.col("ug.grp").alias("grp"))
              .agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= SHARED)
              .join(asking, "q").join(sizes.drop("size"), "grp")
              .where((F.col("n_lo") * percent <= F.col("na") * 100) & (F.col("na") * percent <= F.col("n_hi") * 100))
              .where(F.col("common") >= _least_common(percent)))
    return _open(job, members, stored(opened.select("q", "grp")))


def _open(job: _Join, members: DataFrame, opened: DataFrame) -> DataFrame:
    """Exact links between asking sets and all members of the groups ``opened (q, grp)``.

    Members and askers of a group are cut into blocks; every pair of blocks is
    one matrix product, so no pairs are written out and no task holds more.
    """
    groups = stored(opened.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("askers")).join(
        members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("hosts")), "grp"))
    groups = sized(groups)

    def block(parts: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(parts)).cast("bigint")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    hosts = members.select("node", "grp").join(groups, "grp").select(
        "node", "grp", F.lit(0).alias("side"), block("hosts").alias("host"), every("askers").alias("asker"))
    askers = opened.select(F.col("q").alias("node"), "grp").join(groups, "grp").select(
        "node", "grp", F.lit(1).alias("side"), every("hosts").alias("host"), block("askers").alias("asker"))
    roles = stored(hosts.union(askers).withColumns({"lo": F.lit(0), "hi": F.lit(1)}))
    sets = job.sets(members.join(roles.select("node").distinct(), "node").select("node", "doc", "d1", "d2"))
    order = ["grp", "host", "asker"]
    rows = roles.join(sets, "node").repartition(*order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(solve_runs(order, _solve_group(job.percent)), "a bigint, b bigint"))


def keep_one_per_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, the one of smallest id; all columns unchanged.

    A row is known by its id and text: of rows that share an id, or have none,
    each stays or goes by its own component. Null ids come last. Where several
    sets of a component share the smallest id, the smallest digest is kept, and
    of rows with equal id and set the smallest text. Rows without words all
    stay, but those that repeat one id and text leave one.
    """
    found = stored(_labelled(docs, k, percent, id_col, text_col))
    names, id_col, text_col, docs = docs.columns, plain_name(docs, id_col), plain_name(docs, text_col), plain_names(docs)
    # a row whose id occurs once is known by it; the others are told apart by their sets
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("c"), F.bool_and("keep").alias("keep"))
    apart = stored(ids.where("c > 1 or not keep"))
    again = stored(apart.where("c > 1").select("_id"))
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    rest = docs.join(sized(apart.select("_id"), WANTED_ROWS), same, "left_anti")
    if not again.count():
        return rest.toDF(*names)
    kept = stored(found.where("keep and n > 0").join(sized(again, WANTED_ROWS), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
                  .select(F.col("doc_id").alias("_id"), F.col("d1").alias("_k1"), F.col("d2").alias("_k2"), F.lit(True).alias("_kept")).distinct())
    rows = _with_digests(docs.join(sized(again, WANTED_ROWS), same, "left_semi"), k, text_col)
    rows = rows.join(sized(kept), same & (F.col("_d1") == F.col("_k1")) & (F.col("_d2") == F.col("_k2")), "left")
    text = F.col(text_col)
    once = (rows.where("_n = 0 or _kept").groupBy(
        F.col(id_col).alias("_i"), "_d1", "_d2", F.when(F.col("_n") == 0, text).alias("_t"))
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(text, F.lit(""))).alias("_row")).select("_row.*"))
    return rest.unionByName(once).toDF(*names)
