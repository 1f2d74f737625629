"""Helpers shared by the operators: shared storage, size-checked broadcasts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_root, ship_package

#: Rows up to which a small keyed table is broadcast (its row width is fixed by the caller).
BROADCAST_ROWS = 1_000_000

WORD_BREAK = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table of at most ``limit`` narrow rows; leave a larger one to a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def sized_bytes(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Broadcast a stored table of at most ``limit`` bytes (strings and lists counted in full); leave a larger one to a
    shuffle join."""
    width = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "string":
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind in ("array", "struct", "map"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= limit else df


def plain_names(df: DataFrame) -> DataFrame:
    """The same columns as ``c0, c1 ..``: names of the caller's cannot meet those an operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def plain_name(df: DataFrame, name: str) -> str:
    """What ``plain_names`` calls the column ``name``."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [
        i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    return f"c{found[0]}"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def unit_random(*key: Column | str | int) -> Column:
    """A reproducible number in [0, 1) from a key (53 bits of its hash)."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0 ** -53)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges (a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps. Every round is a pair of
    aggregations and joins over the edges, stored in the shared folder; only
    one scalar (rows changed) reaches the driver. Depth shrinks
    geometrically, so few rounds are needed even for long chains.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo")
    now = stored(pairs.distinct())
    nodes = now.select(F.col("hi").alias("node")).union(now.select(F.col("lo").alias("node"))).distinct()
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select("lo", "hi")).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(low.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct())
        now = stored(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component"))


def small_batches(spark: SparkSession) -> None:
    """Ship the package to the workers and bound what one gets at once: 1,000 rows or 16 MB per Arrow batch."""
    ship_package(spark)
    conf = spark.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch",
             str(min(1000, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")))))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def solve_runs(keys: Sequence[str], solve: Callable[[pa.Table], pa.RecordBatch | None]):
    """For ``mapInArrow`` on input sorted by the long columns ``keys``: apply ``solve`` to every run of equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            key = np.stack([t.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), t.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(key[:, a])
                if now != last and held:
                    out = solve(pa.concat_tables(held))
                    held = []
                    if out:
                        yield out
                last = now
                held.append(t.slice(a, b - a))
        if held:
            out = solve(pa.concat_tables(held))
            if out:
                yield out
    return run


def block_pairs(rows: DataFrame, keys: Sequence[str], node: str, fill: str, block: int) -> DataFrame:
    """Cut groups of more than ``block`` rows (size in ``fill``) into blocks and give every pair of blocks its rows.

    Adds ``side`` (the row's block) and the pair ``lo <= hi`` of blocks.
    """
    spread = rows.withColumn("parts", F.ceil(F.col(fill) / block)).withColumn(
        "side", F.pmod(F.xxhash64(node), F.col("parts")))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")).withColumns(
        {"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("parts", "other", fill)
    order = [*keys, "lo", "hi"]
    return spread.repartition(*order).sortWithinPartitions(*order)


def forest(left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name reachable from every position of ``names`` over index pairs ``left, right``."""
    label = names.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        if (new == label).all():
            return label
        label = new
