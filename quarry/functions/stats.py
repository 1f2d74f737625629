"""Per-column numeric summaries shared by profiling, cleaning and EDA.

All moments for all columns come from one ``agg`` (fixed-size buffers, partial
aggregation). Quantiles are exact and distributed (see ``ranks``) unless
``approx=True``. Skewness and kurtosis are the bias-adjusted forms used by
pandas and DuckDB, derived from Spark's population moments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.frames import field_types, is_numeric, q
from quarry.functions.ranks import _quantiles_from_counts, prefix_counts, quantile_wide

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("q1", "median", "q3")


def adjusted_skew(n: Column, g1: Column, var_pop: Column) -> Column:
    """G1 = g1 * sqrt(n(n-1)) / (n-2); 0 for a constant column; null below 3 values."""
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(var_pop == 0, F.lit(0.0))
        .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2))
    )


def adjusted_kurtosis(n: Column, g2: Column, var_pop: Column) -> Column:
    """G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); 0 for a constant column; null below 4 values."""
    return (
        F.when(n < 4, F.lit(None).cast("double"))
        .when(var_pop == 0, F.lit(0.0))
        .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    )


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: ``column, position, n, mean, std, var, var_pop, min, max, total, skew, kurt``."""
    aggs = []
    for i, c in enumerate(cols):
        v = q(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
            F.var_samp(v).alias(f"v{i}"), F.var_pop(v).alias(f"vp{i}"), F.min(v).alias(f"mi{i}"),
            F.max(v).alias(f"ma{i}"), F.sum(v).alias(f"t{i}"), F.skewness(v).alias(f"g{i}"),
            F.kurtosis(v).alias(f"k{i}"),
        ]
    row = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"n{i}").alias("n"),
            F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"v{i}").alias("var"),
            F.col(f"vp{i}").alias("var_pop"), F.col(f"mi{i}").alias("min"), F.col(f"ma{i}").alias("max"),
            F.col(f"t{i}").alias("total"), F.col(f"g{i}").alias("g1"), F.col(f"k{i}").alias("g2"),
        )
        for i, c in enumerate(cols)
    ]
    out = row.select(F.inline(F.array(*cells)))
    n = F.col("n").cast("double")
    return (
        out.withColumn("skew", adjusted_skew(n, F.col("g1"), F.col("var_pop")))
        .withColumn("kurt", adjusted_kurtosis(n, F.col("g2"), F.col("var_pop")))
        .drop("g1", "g2")
    )


def distinct_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, v, cnt)``: distinct non-null values per numeric column with their counts."""
    cells = [F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("v")) for c in cols]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("v").isNotNull())
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def quartiles(df: DataFrame, cols: Sequence[str], approx: bool = False,
              probs: Sequence[float] = QUARTILES, names: Sequence[str] = QUARTILE_NAMES) -> DataFrame:
    """One row per column with the requested quantiles (exact by default)."""
    if approx:
        from quarry.functions.ranks import column_quantiles

        return quantile_wide(column_quantiles(df, cols, probs, approx=True), probs, names)
    d = distinct_numeric(df, cols)
    n = d.groupBy("column").agg(F.sum("cnt").alias("_n"))
    ranked = prefix_counts(d, ["column"], "v", "cnt")
    return quantile_wide(_quantiles_from_counts(ranked, n, ["column"], "v", probs), probs, names)


def with_fences(qw: DataFrame, factor: float = 1.5, zero_iqr: str = "none") -> DataFrame:
    """Add ``iqr, lower, upper``. ``zero_iqr``: ``none`` (no guard), ``collapse`` (fences q1,q3), ``skip`` (drop)."""
    out = qw.withColumn("iqr", F.col("q3") - F.col("q1"))
    lower = F.col("q1") - F.lit(factor) * F.col("iqr")
    upper = F.col("q3") + F.lit(factor) * F.col("iqr")
    if zero_iqr == "collapse":
        lower = F.when(F.col("iqr") == 0, F.col("q1")).otherwise(lower)
        upper = F.when(F.col("iqr") == 0, F.col("q3")).otherwise(upper)
    out = out.withColumn("lower", lower).withColumn("upper", upper)
    if zero_iqr == "skip":
        out = out.where(F.col("iqr") != 0)
    return out


def outlier_counts(df: DataFrame, fences: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, outliers)``: values strictly outside each column's fences.

    Counted over distinct values weighted by their counts; the fence table has
    one row per column and is broadcast.
    """
    d = distinct_numeric(df, cols)
    j = d.join(F.broadcast(fences.select("column", "lower", "upper")), "column")
    out = (F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))
    return j.groupBy("column").agg(F.sum(F.when(out, F.col("cnt")).otherwise(0)).alias("outliers"))


def numeric_summary(df: DataFrame, cols: Sequence[str], approx: bool = False, cache: bool = True) -> DataFrame:
    """One row per numeric column: moments, exact quartiles, 1.5 IQR fences (no zero-IQR guard) and
    the count of values outside them.

    Every profile, cleaning and EDA step that needs these numbers derives them
    from this table; it has one row per column, so it is cached.
    """
    m = moments(df, cols)
    qw = with_fences(quartiles(df, cols, approx=approx), zero_iqr="none")
    oc = outlier_counts(df, qw, cols)
    out = (m.join(qw, "column", "left").join(oc, "column", "left")
           .withColumn("outliers", F.coalesce(F.col("outliers"), F.lit(0)).cast("bigint")))
    return out.cache() if cache else out


def numeric_cols_of(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    types = field_types(df)
    return [c for c in (cols or df.columns) if is_numeric(types[c])]
