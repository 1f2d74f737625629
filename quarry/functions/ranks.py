"""Distributed prefix counts, average ranks (AR) and exact quantiles.

No global unpartitioned window and no per-group value map: values are first
collapsed to ``(group, value, count)`` (partial aggregation absorbs hot
values), then range-partitioned on ``(group, value)`` so a group with billions
of distinct values spreads over many tasks. The ranged table is checkpointed
(reliable storage), each task computes running counts inside its own range,
and partition offsets come from a table with at most ``partitions + groups``
rows, broadcast back. Ranks and quantile positions
follow from ``before`` (rows strictly smaller in the same group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.frames import field_types, is_numeric, q
from quarry.session import checkpoint_root


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_counts(d: DataFrame, group_cols: Sequence[str], order_col: str, weight_col: str | Sequence[str] = "cnt",
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``before`` (or ``before_<w>`` for several weights): total weight of rows in the
    same group with a smaller ``order_col``.

    ``d`` must hold one row per (group, order value).
    """
    group_cols = list(group_cols)
    weights = [weight_col] if isinstance(weight_col, str) else list(weight_col)
    names = ["before"] if isinstance(weight_col, str) else [f"before_{w}" for w in weights]
    parts = _partitions(d, num_partitions)
    # The partition id is read by two branches (running sums and partition
    # offsets). Range bounds are sampled per exchange, so the ranged table is
    # checkpointed once to the shared checkpoint folder: both branches read the
    # same rows with the same ids, and a lost executor cannot re-sample them.
    checkpoint_root(d.sparkSession)
    r = (
        d.repartitionByRange(parts, *[F.col(c) for c in group_cols], F.col(order_col))
        .withColumn("_pid", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    w_local = (
        Window.partitionBy("_pid", *group_cols)
        .orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for w, nm in zip(weights, names):
        r = r.withColumn(f"_local_{nm}", F.coalesce(F.sum(w).over(w_local), F.lit(0)))
    # one row per (partition, group): at most partitions + groups rows
    totals = r.groupBy("_pid", *group_cols).agg(*[F.sum(w).alias(f"_pt_{nm}") for w, nm in zip(weights, names)])
    w_off = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *group_cols,
        *[F.coalesce(F.sum(f"_pt_{nm}").over(w_off), F.lit(0)).alias(f"_off_{nm}") for nm in names],
    )
    out = r.join(F.broadcast(offsets), ["_pid", *group_cols])
    for nm in names:
        out = out.withColumn(nm, F.col(f"_local_{nm}") + F.col(f"_off_{nm}")).drop(f"_local_{nm}", f"_off_{nm}")
    return out.drop("_pid")


def average_ranks(long_df: DataFrame, group_cols: Sequence[str], value_col: str,
                  weight_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Average (tie-averaged, 1-based) rank of each distinct value within its group.

    Returns ``(group..., value_col, cnt, before, avg_rank)``.
    """
    group_cols = list(group_cols)
    weight = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    d = long_df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col).agg(weight.alias("cnt"))
    d = prefix_counts(d, group_cols, value_col, "cnt", num_partitions)
    return d.withColumn("avg_rank", F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))


def _quantiles_from_counts(d: DataFrame, n: DataFrame, group_cols: Sequence[str], value_col: str,
                           probs: Sequence[float]) -> DataFrame:
    group_cols = list(group_cols)
    targets = (
        n.select(*group_cols, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
        .withColumn("_h", (F.col("_n") - 1) * F.col("p"))
        .withColumn("_lo", F.floor("_h"))
        .withColumn("_hi", F.ceil("_h"))
        .withColumn("_frac", F.col("_h") - F.col("_lo"))
    )
    # targets has (#groups x #probs) rows: bounded by the caller's column list
    j = d.join(F.broadcast(targets), group_cols)
    covers_lo = (F.col("before") <= F.col("_lo")) & (F.col("_lo") < F.col("before") + F.col("cnt"))
    covers_hi = (F.col("before") <= F.col("_hi")) & (F.col("_hi") < F.col("before") + F.col("cnt"))
    picked = (
        j.where(covers_lo | covers_hi)
        .groupBy(*group_cols, "p")
        .agg(
            F.max(F.when(covers_lo, F.col(value_col))).alias("_vlo"),
            F.max(F.when(covers_hi, F.col(value_col))).alias("_vhi"),
            F.first("_frac").alias("_frac"),
        )
    )
    return picked.select(
        *group_cols, "p",
        (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("q"),
    )


def exact_quantiles_long(long_df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float],
                         num_partitions: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (pandas / ``quantile_cont``) per group, exactly.

    Returns ``(group..., p, q)``.
    """
    group_cols = list(group_cols)
    d = long_df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("cnt"))
    n = d.groupBy(*group_cols).agg(F.sum("cnt").alias("_n"))
    d = prefix_counts(d, group_cols, value_col, "cnt", num_partitions)
    return _quantiles_from_counts(d, n, group_cols, value_col, probs)


def numeric_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, v double)`` for the non-null cells of numeric columns."""
    cells = [F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("v")) for c in cols]
    return df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())


def column_quantiles(df: DataFrame, cols: Sequence[str] | None = None, probs: Sequence[float] = (0.25, 0.5, 0.75),
                     approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per column quantiles as a long table ``(column, p, q)``.

    ``approx=True`` uses ``percentile_approx`` (bounded memory, rank error 1/accuracy).
    """
    types = field_types(df)
    cols = [c for c in (cols or df.columns) if is_numeric(types[c])]
    if approx:
        aggs = [F.percentile_approx(q(c).cast("double"), list(probs), accuracy).alias(f"_q{i}") for i, c in enumerate(cols)]
        row = df.agg(*aggs)
        cells = [
            F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("qs"))
            for i, c in enumerate(cols)
        ]
        long = row.select(F.inline(F.array(*cells)))
        return long.select(
            "column",
            F.posexplode("qs").alias("i", "q"),
        ).select("column", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("p"), "q")
    return exact_quantiles_long(numeric_long(df, cols), ["column"], "v", probs)


def quantile_wide(qlong: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Pivot ``(column, p, q)`` to one row per column with one field per probability."""
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(nm) for p, nm in zip(probs, names)]
    return qlong.groupBy("column").agg(*aggs)
