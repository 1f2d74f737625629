"""Everything the profile needs from one value-frequency pass.

``table_stats`` runs the VF shuffle once (nulls as their own group) and keeps
it persisted (memory, spilling to disk; lost blocks are recomputed from the
scan). From it, without touching the table again:

* per column: missing count, distinct non-null count;
* per numeric column: count, mean, min, max, sum, sample / population
  variance, adjusted skewness and kurtosis -- count-weighted central moments
  over the distinct values (two small passes, the second centred on the
  mean), exact quartiles via distributed prefix counts, IQR fences and the
  number of values outside them;
* per text column: the class sample (the first 50 non-null rows ordered by
  md5 of the value, duplicates included) as running counts over at most 50
  distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.frames import nan_to_null, top_k, value_counts
from quarry.functions.ranks import _quantiles_from_counts, prefix_counts, quantile_wide
from quarry.functions.stats import QUARTILE_NAMES, QUARTILES, adjusted_kurtosis, adjusted_skew, with_fences


@dataclass
class TableStats:
    df: DataFrame
    vf: DataFrame          # (column, position, kind, num, str, is_null, cnt), persisted
    n_rows: int
    columns: DataFrame     # (column, position, missing_count, n_unique), cached
    numeric: DataFrame     # one row per numeric column (see numeric_from_vf), cached

    def unpersist(self) -> None:
        for d in (self.vf, self.columns, self.numeric):
            d.unpersist()


def numeric_from_vf(vf: DataFrame, approx_df: DataFrame | None = None) -> DataFrame:
    """Moments, quartiles, fences and outlier counts from the numeric rows of a VF table."""
    d = vf.where(F.col("kind").isin("int", "float") & ~F.col("is_null")).select(
        "column", "position", F.col("num").alias("v"), "cnt")
    first = d.groupBy("column", "position").agg(
        F.sum("cnt").alias("n"), F.sum(F.col("v") * F.col("cnt")).alias("total"), F.min("v").alias("min"),
        F.max("v").alias("max"))
    first = first.withColumn("mean", F.col("total") / F.col("n"))
    # second pass centred on the mean: stable central moments (one row per column is broadcast)
    c = d.join(F.broadcast(first.select("column", "mean")), "column").withColumn("_d", F.col("v") - F.col("mean"))
    central = c.groupBy("column").agg(
        F.sum(F.col("cnt") * F.col("_d") ** 2).alias("m2"), F.sum(F.col("cnt") * F.col("_d") ** 3).alias("m3"),
        F.sum(F.col("cnt") * F.col("_d") ** 4).alias("m4"))
    mom = first.join(central, "column")
    n = F.col("n").cast("double")
    var_pop = F.col("m2") / n
    g1 = F.when(F.col("m2") > 0, F.sqrt(n) * F.col("m3") / F.pow(F.col("m2"), 1.5))
    g2 = F.when(F.col("m2") > 0, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3)
    mom = mom.select(
        "column", "position", F.col("n").cast("bigint").alias("n"), "mean", "min", "max", "total",
        var_pop.alias("var_pop"), F.when(n > 1, F.col("m2") / (n - 1)).alias("var"),
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"),
        adjusted_skew(n, g1, var_pop).alias("skew"), adjusted_kurtosis(n, g2, var_pop).alias("kurt"))
    if approx_df is not None:
        from quarry.functions.ranks import column_quantiles

        cols = [r["column"] for r in first.select("column").collect()]
        qw = quantile_wide(column_quantiles(approx_df, cols, QUARTILES, approx=True), QUARTILES, QUARTILE_NAMES)
    else:
        dn = d.select("column", "v", "cnt")
        ranked = prefix_counts(dn, ["column"], "v", "cnt")
        sizes = first.select("column", F.col("n").alias("_n"))
        qw = quantile_wide(_quantiles_from_counts(ranked, sizes, ["column"], "v", QUARTILES), QUARTILES,
                           QUARTILE_NAMES)
    fences = with_fences(qw, zero_iqr="none")
    out_cnt = d.join(F.broadcast(fences.select("column", "lower", "upper")), "column").groupBy("column").agg(
        F.sum(F.when((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper")), F.col("cnt"))
              .otherwise(0)).cast("bigint").alias("outliers"))
    return mom.join(fences, "column", "left").join(out_cnt, "column", "left").withColumn(
        "outliers", F.coalesce("outliers", F.lit(0)).cast("bigint"))


def table_stats(df: DataFrame, approx: bool = False) -> TableStats:
    """One persisted VF pass over every column, and the per-column tables derived from it."""
    df = nan_to_null(df)
    vf = value_counts(df, include_nulls=True).persist(StorageLevel.MEMORY_AND_DISK)
    cols = vf.groupBy("column", "position").agg(
        F.sum("cnt").alias("_n"),
        F.sum(F.when(F.col("is_null"), F.col("cnt")).otherwise(0)).cast("bigint").alias("missing_count"),
        F.count_if(~F.col("is_null")).cast("bigint").alias("n_unique"),
    ).cache()
    first = cols.select("_n").first()
    n_rows = int(first["_n"]) if first is not None else df.count()
    numeric = numeric_from_vf(vf, df if approx else None).cache()
    return TableStats(df, vf, n_rows, cols.drop("_n"), numeric)


def text_sample(stats: TableStats, sample_rows: int) -> DataFrame:
    """Per text column: the first ``sample_rows`` non-null rows ordered by (md5(value), value).

    Returns ``(column, value, taken)``: at most ``sample_rows`` distinct values
    per column with how many of their rows fall inside the sample.
    """
    s = stats.vf.where((F.col("kind") == "str") & ~F.col("is_null"))
    firsts = top_k(s, ["column"], [F.md5(F.col("str")), F.col("str")], sample_rows)
    # at most sample_rows rows per column: a small window
    w = Window.partitionBy("column").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cnt").over(w), F.lit(0))
    taken = F.least(F.col("cnt"), F.lit(sample_rows) - before)
    return firsts.select("column", F.col("str").alias("value"), taken.alias("taken")).where(F.col("taken") > 0)
