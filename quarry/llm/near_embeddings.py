"""Near-duplicate embeddings by binary codes of random rotations with correction factors.

A unit vector ``o`` is rotated and kept as signs ``b`` (one bit per dimension)
with the factor ``f = <b / sqrt(d), rotated o>``. For any unit ``q``,
``<b / sqrt(d), rotated q> / f`` is an unbiased estimate of ``<o, q>`` whose
error is below ``eps * sqrt((1 - f^2) / f^2 / (d - 1))`` with a probability
that tends to 1 exponentially in ``eps^2``. Pairs whose upper bound reaches
the threshold are recomputed exactly; the others are done with.

Candidate pairs share a band: some bits of one of several rotations. Band
width follows the size of the label's group, the number of bands follows the
recall wanted for a pair right at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import block_pairs, connected_components, forest, sized, small_batches, solve_runs, stored

#: Vectors expected in a band's bucket, and compared at once in a task.
BUCKET, BLOCK = 64, 1_024
#: Rows of crowded buckets up to which their list is broadcast.
CROWDED_ROWS = 200_000


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A uniformly random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([20240717, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per band and number of bands for a group of ``rows`` vectors."""
    bits = max(0, math.ceil(math.log2(max(rows, 1) / BUCKET)))
    if bits == 0:
        return 0, 1
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(threshold: float, recall: float):
    """Bands, signs and factors of every vector of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rows = batch.column("vector").to_pylist(), batch.column("rows").to_numpy()
            dims = np.array([len(v) for v in vectors])
            bands, codes, factors = [None] * len(vectors), [None] * len(vectors), [0.0] * len(vectors)
            for dim, n in {(int(d), int(r)) for d, r in zip(dims, rows)}:
                at = np.flatnonzero((dims == dim) & (rows == n))
                unit = _unit_rows(np.array([vectors[i] for i in at]), dim)
                bits, count = band_plan(n, threshold, recall)
                turned = unit @ rotation(dim, 0).T
                signs = turned > 0
                packed = np.packbits(signs, axis=1)
                factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                keys = np.zeros((len(at), count), np.int64)
                for band in range(count):
                    # bits of consecutive dimensions; every rotation serves dim // bits bands
                    per = max(1, dim // bits) if bits else 1
                    spin = unit @ rotation(dim, 1 + band // per).T[:, (band % per) * bits:(band % per) * bits + bits]
                    keys[:, band] = (spin > 0) @ (1 << np.arange(spin.shape[1], dtype=np.int64)) if bits else 0
                for j, i in enumerate(at):
                    bands[i], codes[i], factors[i] = keys[j], packed[j].tobytes(), factor[j]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("node", "copies", "grp", "vector")], pa.array(bands, pa.list_(pa.int64())),
                 pa.array(codes, pa.binary()), pa.array(factors, pa.float64())],
                ["node", "copies", "grp", "vector", "bands", "code", "factor"])
    return run


def _linked(a: dict, b: dict, band: int, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of blocks ``a`` and ``b`` that link and share no earlier band."""
    dim = a["vector"].shape[1]
    turn = rotation(dim, 0)
    signs = np.unpackbits(b["code"], axis=1)[:, :dim].astype(np.float32) * 2 - 1
    guess = ((a["vector"] @ turn.T).astype(np.float32) @ signs.T) / math.sqrt(dim) / b["factor"]
    slack = eps * np.sqrt(np.maximum(1 - b["factor"] ** 2, 0) / b["factor"] ** 2 / max(dim - 1, 1)) + 1e-4
    i, j = np.nonzero(guess + slack >= threshold)
    fresh = np.ones(len(i), bool)
    if band:
        fresh = ~(a["bands"][i, :band] == b["bands"][j, :band]).any(axis=1)
    i, j = i[fresh], j[fresh]
    exact = np.einsum("ij,ij->i", a["vector"][i], b["vector"][j])
    hit = exact >= threshold
    return i[hit], j[hit]


def _bucket_rows(threshold: float, eps: float):
    """Links inside each run of rows of one (band, bucket, block pair); runs follow each other in the input."""
    def block(t: pa.Table) -> dict:
        vectors = t.column("vector").combine_chunks()
        dim = len(vectors[0])
        return {"node": t.column("node").to_numpy(), "copies": t.column("copies").to_numpy(),
                "vector": _unit_rows(vectors.flatten().to_numpy(zero_copy_only=False), dim),
                "bands": np.array(t.column("bands").to_pylist()), "factor": t.column("factor").to_numpy(),
                "code": np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)}

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        band, side = t.column("band")[0].as_py(), t.column("side").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        if lo == hi:
            a = block(t)
            i, j = _linked(a, a, band, threshold, eps)
            # both bounds may find a pair; each unordered pair counts once
            x, y = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
            found = np.unique(x * t.num_rows + y)
            x, y, b = found // t.num_rows, found % t.num_rows, a
        else:
            parts = [t.filter(pa.array(side == s)) for s in (lo, hi)]
            if not all(p.num_rows for p in parts):
                return None
            a, b = map(block, parts)
            x, y = _linked(a, b, band, threshold, eps)
            y2, x2 = _linked(b, a, band, threshold, eps)
            found = np.unique(np.concatenate([x * b["node"].size + y, x2 * b["node"].size + y2]))
            x, y = found // b["node"].size, found % b["node"].size
        if not len(x):
            return None
        left, right = a["node"][x], b["node"][y]
        node = np.concatenate([left, right])
        links = np.concatenate([b["copies"][y], a["copies"][x]])
        ids, inverse = np.unique(node, return_inverse=True)
        peer = forest(inverse[:len(left)], inverse[len(left):], ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(np.bincount(inverse, links).astype(np.int64)), pa.array(peer)], ["node", "links", "peer"])

    return solve_runs(("grp", "band", "bucket", "lo", "hi"), solve)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, eps: float = 4.5,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows with equal non-null labels and equally long vectors link when their
    cosine (double precision) is at least ``threshold``; every link reported
    is exact, a pair right at the threshold is found with probability
    ``recall``, closer pairs more surely. Vectors that are null, empty, zero
    or hold null or non-finite values link with nothing. Equal vectors of a
    label are compared once and counted by their number. ``n_links`` counts
    linked other rows, ``component_id`` is the smallest id reachable.

    Groups of up to 64 different vectors are compared whole. Crowded buckets
    are cut into blocks, each pair of blocks being a group of its own, so no
    task holds more than two blocks; this work grows with the square of a
    crowd of mutually near vectors, as the count of links itself does. Rows of
    equal id stay separate rows; a null id links but never names a component
    unless all its ids are null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col)
    good = v.isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          v.cast("array<double>").alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    print_of = F.sha2(F.to_json(F.struct("label", "vector")), 256)
    rows = rows.withColumn("print", F.when(F.col("good"), print_of))
    nodes = stored(rows.where("good").groupBy("print").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id()))
    sizes = stored(nodes.groupBy(F.col("label").alias("_label"), F.size("vector").alias("_dim")).agg(F.count(F.lit(1)).alias("rows"))
                   .withColumn("grp", F.monotonically_increasing_id()))
    grouped = nodes.join(sized(sizes), (F.col("label") == F.col("_label")) & (F.size("vector") == F.col("_dim"))).select(
        "node", "copies", "grp", "rows", "vector")
    coded = stored(grouped.mapInArrow(_encode(threshold, recall), (
        "node bigint, copies bigint, grp bigint, vector array<double>, bands array<bigint>, code binary, factor double")))
    keys = ["grp", "band", "bucket"]
    every = coded.select("*", F.posexplode("bands").alias("band", "bucket"))
    fill = stored(every.groupBy(*keys).agg(F.count(F.lit(1)).alias("fill")).where("fill > 1"))
    crowded = stored(fill.where(F.col("fill") > BLOCK))
    spread = every.join(sized(crowded, CROWDED_ROWS), keys, "left").withColumn("fill", F.coalesce("fill", F.lit(1)))
    found = stored(block_pairs(spread, keys, "node", "fill", BLOCK)
                   .mapInArrow(_bucket_rows(threshold, eps), "node bigint, links bigint, peer bigint"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")).distinct())
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = stored(nodes.select("node", "print", "first", "copies").join(links, "node", "left").join(components, "node", "left").select(
        "print", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component")))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = stored(named.join(names, "component").select("print", "n_links", "component_id"))
    own = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", "good", "print").join(labels, "print", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
