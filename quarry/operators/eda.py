"""Exploratory analysis: statistics, outliers, correlation, distributions, periods, insights.

Every section is one tidy DataFrame. Correlations of null-free columns come
from one aggregate of the products of mean-centred values (many columns: MLlib's
Gram matrix); pairs touching a column with nulls use masked per-pair moments. Ranks
for Spearman come from the distributed average-rank helper, never a global
window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.dates import parse_ts
from quarry.functions.frames import (
    field_types, is_numeric, is_temporal, nan_to_null, one_row_join, q, render_value, top_k, value_counts,
)
from quarry.functions.ranks import average_ranks
from quarry.functions.stats import distinct_numeric, moments, quartiles, with_fences
from quarry.operators.profile import classify_columns, profile_columns, profile_overview

# Thresholds and sizes used by the EDA sections.
MIN_OUTLIER_VALUES = 4
OUTLIER_SAMPLES = 10
TOP_PAIRS = 10
STRONG, MODERATE = 0.7, 0.4
#: Columns whose products one aggregate sums; a standard deviation up to ``TINY_STD`` counts as none.
SQL_COLUMNS, TINY_STD = 12, 1e-12
MIN_BINS, MAX_BINS = 10, 50
CATEGORY_TOP = 15
MOVING_WINDOW = 3
WEEKS_SHOWN = 52
MISSING_LABEL = "(missing)"


def _num_cols(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    types = field_types(df)
    return [c for c in (cols or df.columns) if is_numeric(types[c])]


def eda_overview(df: DataFrame) -> DataFrame:
    """Per column dtype, class, missing and %, with table shape, duplicates and total missing."""
    df = nan_to_null(df)
    pc = profile_columns(df).select("column", "position", "dtype", F.col("missing_count").alias("missing"), "missing_pct")
    cl = classify_columns(df).select("column", "class")
    ov = profile_overview(df).select(
        "n_rows", "n_cols",
        F.col("dup_rows").alias("duplicate_rows"),
        F.when(F.col("n_rows") > 0, F.round(F.col("dup_rows") / F.col("n_rows") * 100, 2)).otherwise(0.0)
        .alias("duplicate_rows_pct"),
        F.col("missing_cells").alias("total_missing"),
        F.col("missing_pct").alias("total_missing_pct"),
    )
    return one_row_join(pc.join(cl, "column"), ov)


def descriptive_stats(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, digits: int = 6) -> DataFrame:
    """count, mean, median, mode, std, variance, min, max, range, q1, q3, iqr, skewness, kurtosis, cv."""
    df = nan_to_null(df)
    cols = _num_cols(df, cols)
    m = moments(df, cols).where(F.col("n") > 0)
    qw = quartiles(df, cols, approx=approx)
    vf = value_counts(df, cols)
    mode = top_k(vf, ["column"], [F.col("cnt").desc(), F.col("num")], 1).select("column", F.col("num").alias("mode"))
    j = m.join(qw, "column").join(mode, "column", "left")
    r = lambda c: F.round(c, digits)
    return j.select(
        "column", "position", F.col("n").cast("bigint").alias("count"),
        r(F.col("mean")).alias("mean"), r(F.col("median")).alias("median"), r(F.col("mode")).alias("mode"),
        r(F.col("std")).alias("std"), r(F.col("var")).alias("variance"), r(F.col("min")).alias("min"),
        r(F.col("max")).alias("max"), r(F.col("max") - F.col("min")).alias("range"), r(F.col("q1")).alias("q1"),
        r(F.col("q3")).alias("q3"), r(F.col("q3") - F.col("q1")).alias("iqr"), r(F.col("skew")).alias("skewness"),
        r(F.col("kurt")).alias("kurtosis"),
        r(F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100)).alias("cv"),
    )


def shape_labels(stats: DataFrame) -> DataFrame:
    """Skew and kurtosis labels from ``descriptive_stats`` output."""
    s, k = F.col("skewness"), F.col("kurtosis")
    skew_label = (F.when(s.isNull(), "unknown").when(F.abs(s) < 0.5, "symmetric")
                  .when(F.abs(s) < 1.0, "moderately skewed").otherwise("highly skewed"))
    kurt_label = (F.when(k.isNull(), "unknown").when(k > 1, "heavy-tailed").when(k < -1, "light-tailed")
                  .otherwise("normal-tailed"))
    return stats.select("column", "skewness", "kurtosis", skew_label.alias("skew_label"), kurt_label.alias("kurt_label"))


def _eda_fences(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Fences with zero IQR collapsed to (q1, q3), for columns with at least 4 values."""
    n = moments(df, cols).select("column", "n").where(F.col("n") >= MIN_OUTLIER_VALUES)
    return with_fences(quartiles(df, cols, approx=approx), zero_iqr="collapse").join(n, "column")


def eda_outliers(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``(column, count, pct, lower_bound, upper_bound)`` per numeric column with >= 4 values."""
    df = nan_to_null(df)
    cols = _num_cols(df, cols)
    fences = _eda_fences(df, cols, approx)
    d = distinct_numeric(df, cols).join(F.broadcast(fences.select("column", "lower", "upper")), "column")
    out = (F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))
    cnt = d.groupBy("column").agg(F.sum(F.when(out, F.col("cnt")).otherwise(0)).alias("count"))
    return fences.join(cnt, "column").select(
        "column", F.col("count").cast("bigint").alias("count"),
        F.round(F.col("count") / F.col("n") * 100, 2).alias("pct"),
        F.round("lower", 6).alias("lower_bound"), F.round("upper", 6).alias("upper_bound"),
    )


def outlier_samples(df: DataFrame, key: str, cols: Sequence[str] | None = None, k: int = OUTLIER_SAMPLES,
                    approx: bool = False) -> DataFrame:
    """``(column, rank, key, value)``: first ``k`` outlying rows per column, ordered by ``key``."""
    df = nan_to_null(df)
    cols = [c for c in _num_cols(df, cols) if c != key]
    fences = _eda_fences(df, cols, approx).select("column", "lower", "upper")
    cells = [F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("value")) for c in cols]
    long = df.select(q(key).alias("key"), F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    j = long.join(F.broadcast(fences), "column").where(
        (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    )
    return top_k(j, ["column"], [F.col("key")], k).select("column", "rank", "key", F.round("value", 6).alias("value"))


def outlier_rows(df: DataFrame, key: str, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Full rows of the flagged sample outliers, tagged with the flagging column."""
    samples = outlier_samples(df, key, cols, approx=approx).select(F.col("column").alias("flag_column"),
                                                                  F.col("key").alias(key))
    # at most 10 rows per numeric column: a bounded broadcast
    return nan_to_null(df).join(F.broadcast(samples), key)


def _pair_exprs(a: Column, b: Column):
    both = a.isNotNull() & b.isNotNull()
    am, bm = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(am, bm), F.stddev_pop(am) * F.stddev_pop(bm))


def _corr_long(row: DataFrame, cols: Sequence[str], pairs: list[tuple[int, int]], prefix: str = "r") -> DataFrame:
    cells = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), F.lit(i).alias("i"),
                      F.lit(j).alias("j"), F.col(f"{prefix}{i}_{j}").alias("r")) for i, j in pairs]
    return row.select(F.inline(F.array(*cells)))


def _full_matrix(upper: DataFrame, cols: Sequence[str], diag: DataFrame) -> DataFrame:
    lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("j").alias("i"),
                         F.col("i").alias("j"), "r")
    return upper.unionByName(lower).unionByName(diag)


def _diag(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[e for i, c in enumerate(cols) for e in (F.count(q(c)).alias(f"n{i}"), F.var_pop(q(c).cast("double")).alias(f"v{i}"))])
    cells = [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(i).alias("i"), F.lit(i).alias("j"),
                      F.when((F.col(f"n{i}") > 1) & (F.col(f"v{i}") > 0), F.lit(1.0)).alias("r")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells)))


def _centred_pearson(sub: DataFrame, full: Sequence[int], means) -> dict:
    """``{(i, j): r}`` of null-free columns from one aggregate of the products of mean-centred values."""
    d = {i: F.col(f"c{i}") - F.lit(float(means[f"m{i}"] or 0.0)) for i in full}
    pairs = [(i, j) for a, i in enumerate(full) for j in full[a:]]
    row = sub.agg(F.count(F.lit(1)).alias("n"), *[F.sum(d[i]).alias(f"s{i}") for i in full],
                  *[F.sum(d[i] * d[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = row["n"]
    if n < 2:
        return {(i, j): None for i, j in pairs if i < j}
    # what rounding left of the means is taken out again
    cov = {(i, j): (row[f"p{i}_{j}"] - row[f"s{i}"] * row[f"s{j}"] / n) / (n - 1) for i, j in pairs}
    std = {i: math.sqrt(cov[i, i]) if cov[i, i] > 0 else 0.0 if cov[i, i] <= 0 else math.nan for i in full}
    out = {}
    for i, j in pairs:
        if i < j:
            r = cov[i, j] / (std[i] * std[j]) if min(std[i], std[j]) > TINY_STD else math.nan
            out[i, j] = None if r != r else r
    return out


def pairwise_pearson(df: DataFrame, exprs: Sequence[Column], null_free: Sequence[bool] | None = None,
                     means: Sequence[float] | None = None) -> dict:
    """``{(i, j): r}`` for i < j, pairwise-complete Pearson of the given numeric expressions.

    Up to ``SQL_COLUMNS`` columns without nulls take one aggregate of the
    products of mean-centred values (centring keeps it accurate for large
    offsets); more of them go through one MLlib ``Correlation`` job, a tree
    aggregate of the Gram matrix. Pairs touching a column with nulls use
    masked per-pair moments over the rows where both are present. A constant
    column gives null. ``means`` are those of the expressions, where known.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    k = len(exprs)
    sub = df.select(*[e.cast("double").alias(f"c{i}") for i, e in enumerate(exprs)])
    known = {f"m{i}": m for i, m in enumerate(means)} if means is not None else {}
    if null_free is None or not known:
        row = sub.agg(*[F.count_if(F.col(f"c{i}").isNull()).alias(f"z{i}") for i in range(k)],
                      *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
        null_free = [row[f"z{i}"] == 0 for i in range(k)] if null_free is None else null_free
        known = known or row.asDict()
    full = [i for i in range(k) if null_free[i]]
    out: dict = {}
    if 2 <= len(full) <= SQL_COLUMNS:
        out = _centred_pearson(sub, full, known)
    elif full[1:]:
        means = known
        centred = sub.select(*[(F.col(f"c{i}") - F.lit(means[f"m{i}"] or 0.0)).alias(f"c{i}") for i in full])
        vec = VectorAssembler(inputCols=[f"c{i}" for i in full], outputCol="_v").transform(centred).select("_v")
        mat = Correlation.corr(vec, "_v").first()[0].toArray()
        for a, i in enumerate(full):
            for b, j in enumerate(full):
                if i < j:
                    v = float(mat[a][b])
                    out[(i, j)] = None if v != v else v
    rest = [(i, j) for i in range(k) for j in range(i + 1, k) if (i, j) not in out]
    if rest:
        row = sub.agg(*[_pair_exprs(F.col(f"c{i}"), F.col(f"c{j}")).alias(f"r{i}_{j}") for i, j in rest]).first()
        out.update({(i, j): row[f"r{i}_{j}"] for i, j in rest})
    return out


def _pairs_to_frame(spark, cols: Sequence[str], rs: dict) -> DataFrame:
    rows = [(cols[i], cols[j], i, j, r) for (i, j), r in rs.items()]
    return spark.createDataFrame(rows, "col_a string, col_b string, i int, j int, r double")


def pearson_matrix(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Long ``(col_a, col_b, i, j, r)`` pairwise-complete Pearson over numeric columns (needs >= 2)."""
    df = nan_to_null(df)
    cols = _num_cols(df, cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, i int, j int, r double")
    rs = pairwise_pearson(df, [q(c) for c in cols])
    upper = _pairs_to_frame(df.sparkSession, cols, rs)
    full = _full_matrix(upper, cols, _diag(df.select(*[q(c).cast("double").alias(c) for c in cols]), cols))
    return full.select("col_a", "col_b", "i", "j", F.round("r", digits).alias("r"))


def spearman_matrix(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Long ``(col_a, col_b, i, j, r)``: Pearson on average ranks, re-ranked on each pair's complete rows.

    Columns without nulls share one rank per value (one distributed rank job,
    joined back per column). Pairs touching a column with nulls are ranked on
    their own complete rows, in one long ``(pair, a, b)`` table.
    """
    df = nan_to_null(df)
    cols = _num_cols(df, cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, i int, j int, r double")
    sub = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    nulls = sub.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"c{i}").isNull()).alias(f"c{i}")
                                                    for i in range(len(cols))]).first().asDict()
    full_cols = [i for i in range(len(cols)) if nulls[f"c{i}"] == 0]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    shared = [(i, j) for i, j in pairs if i in full_cols and j in full_cols]
    own = [(i, j) for i, j in pairs if (i, j) not in shared]
    parts = []
    if shared:
        cells = [F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in full_cols]
        ranks = average_ranks(sub.select(F.inline(F.array(*cells))), ["c"], "v").select("c", "v", "avg_rank")
        ranked = sub
        for i in full_cols:
            ri = ranks.where(F.col("c") == i).select(F.col("v").alias(f"c{i}"), F.col("avg_rank").alias(f"rk{i}"))
            ranked = ranked.join(ri, f"c{i}", "left")
        # the ranks of n rows average (n + 1) / 2, so the joined table is read once
        middle = (nulls["n"] + 1) / 2
        rs = pairwise_pearson(ranked, [F.col(f"rk{i}") for i in full_cols], [True] * len(full_cols),
                              [middle] * len(full_cols))
        mapped = {(full_cols[a], full_cols[b]): r for (a, b), r in rs.items()}
        parts.append(_pairs_to_frame(df.sparkSession, cols, {p: mapped[p] for p in shared}))
    if own:
        cells = [F.struct(F.lit(p).alias("pair"), F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b"))
                 for p, (i, j) in enumerate(own)]
        pl = sub.select(F.inline(F.array(*cells))).where(F.col("a").isNotNull() & F.col("b").isNotNull())
        ra = average_ranks(pl, ["pair"], "a").select("pair", "a", F.col("avg_rank").alias("ra"))
        rb = average_ranks(pl, ["pair"], "b").select("pair", "b", F.col("avg_rank").alias("rb"))
        j = pl.join(ra, ["pair", "a"]).join(rb, ["pair", "b"])
        agg = j.groupBy("pair").agg(_pair_exprs(F.col("ra"), F.col("rb")).alias("r"))
        meta = df.sparkSession.createDataFrame(
            [(p, cols[i], cols[k], i, k) for p, (i, k) in enumerate(own)], "pair int, col_a string, col_b string, i int, j int"
        )
        parts.append(meta.join(agg, "pair", "left").select("col_a", "col_b", "i", "j", "r"))
    upper = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    full = _full_matrix(upper, cols, _diag(sub.toDF(*cols), cols))
    return full.select("col_a", "col_b", "i", "j", F.round("r", digits).alias("r"))


def top_correlations(matrix: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    """Upper-triangle pairs by |r| (4 dp), top ``k``, with strength and direction."""
    up = matrix.where((F.col("i") < F.col("j")) & F.col("r").isNotNull())
    r4 = F.round("r", 4)
    w = Window.orderBy(F.abs(r4).desc(), F.col("i"), F.col("j"))
    # the matrix has one row per column pair: a small, aggregated input
    ranked = up.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(
        "rank", "col_a", "col_b", r4.alias("pearson"),
        F.when(F.abs("r") > STRONG, "strong").when(F.abs("r") > MODERATE, "moderate").otherwise("weak").alias("strength"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
    )


def histograms(df: DataFrame, cols: Sequence[str] | None = None, bins: int | None = None, digits: int = 6) -> DataFrame:
    """Equal-width histogram per numeric column with >= 2 values.

    ``bins`` default: min(50, max(10, floor(sqrt(n)))). Edges follow NumPy:
    ``lo + i * (hi - lo) / bins`` with the last edge exactly ``hi``; the last bin
    is closed; a constant column spans value +- 0.5. Empty bins are kept.
    Output ``(column, bin, lower_edge, upper_edge, center, count)``.
    """
    df = nan_to_null(df)
    cols = _num_cols(df, cols)
    m = moments(df, cols).where(F.col("n") >= 2)
    nb = F.lit(bins) if bins else F.least(F.lit(MAX_BINS), F.greatest(F.lit(MIN_BINS), F.floor(F.sqrt("n"))))
    spec = m.select(
        "column", nb.cast("int").alias("nb"),
        F.when(F.col("min") == F.col("max"), F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"),
        F.when(F.col("min") == F.col("max"), F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"),
    ).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("nb"))
    # spec has one row per column: broadcast
    d = distinct_numeric(df, cols).join(F.broadcast(spec), "column")
    edge = lambda i: F.when(i >= F.col("nb"), F.col("hi")).otherwise(F.col("lo") + i * F.col("step"))
    raw = F.floor((F.col("v") - F.col("lo")) * F.col("nb") / (F.col("hi") - F.col("lo"))).cast("int")
    idx0 = F.least(F.greatest(raw, F.lit(0)), F.col("nb") - 1)
    d = d.withColumn("_i", idx0)
    d = d.withColumn("_i", F.when(F.col("v") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    d = d.withColumn("_i", F.when((F.col("_i") < F.col("nb") - 1) & (F.col("v") >= edge(F.col("_i") + 1)),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = d.groupBy("column", F.col("_i").alias("bin")).agg(F.sum("cnt").alias("count"))
    grid = spec.select("column", "nb", "lo", "hi", "step", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bin"))
    out = grid.join(counts, ["column", "bin"], "left")
    lo_e, hi_e = edge(F.col("bin")), edge(F.col("bin") + 1)
    return out.select(
        "column", "bin", F.round(lo_e, digits).alias("lower_edge"), F.round(hi_e, digits).alias("upper_edge"),
        F.round((lo_e + hi_e) / 2, digits).alias("center"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )


def breakdown_columns(df: DataFrame) -> list[str]:
    """Columns classed categorical; if none, every non-numeric, non-date column."""
    cl = classify_columns(df).orderBy("position").collect()
    cats = [r["column"] for r in cl if r["class"] == "categorical"]
    if cats:
        return cats
    return [r["column"] for r in cl if r["class"] not in ("numeric", "datetime")]


def categorical_breakdown(df: DataFrame, cols: Sequence[str] | None = None, k: int = CATEGORY_TOP) -> DataFrame:
    """Top ``k`` values per column counting missing as a value: ``(column, rank, label, count, pct, n_unique)``."""
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else breakdown_columns(df)
    vf = value_counts(df, cols, include_nulls=True)
    stats = vf.groupBy("column").agg(F.sum("cnt").alias("n"), F.count_if(~F.col("is_null")).alias("n_unique"))
    ranked = top_k(vf, ["column"], [F.col("cnt").desc(), F.col("is_null"), F.col("num"), F.col("str")], k)
    return ranked.join(stats, "column").select(
        "column", "rank",
        F.when(F.col("is_null"), F.lit(MISSING_LABEL)).otherwise(render_value(F.col("kind"), F.col("num"), F.col("str")))
        .alias("label"),
        F.col("cnt").cast("bigint").alias("count"),
        F.round(F.col("cnt") / F.col("n") * 100, 2).alias("pct"),
        F.col("n_unique").cast("bigint").alias("n_unique"),
    )


def pick_value_column(df: DataFrame, target: str | None = None, roles: dict[str, str] | None = None) -> str | None:
    """Declared target if numeric; else a column flagged target/measure; else the first numeric column."""
    nums = _num_cols(df)
    if target and target in nums:
        return target
    for name, role in (roles or {}).items():
        if role in ("target", "measure") and name in nums:
            return name
    return nums[0] if nums else None


def _date_columns(df: DataFrame) -> list[str]:
    cl = classify_columns(df).orderBy("position").collect()
    types = field_types(df)
    return [r["column"] for r in cl if r["class"] == "datetime" or is_temporal(types[r["column"]])]


def _dated(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    types = field_types(df)
    ts = q(date_col) if is_temporal(types[date_col]) else parse_ts(q(date_col))
    return df.select(ts.alias("_ts"), q(value_col).cast("double").alias("_v"))


def _usable_dates(df: DataFrame, date_cols: Sequence[str]) -> list[str]:
    """Date columns with at most 50 % unparsable values (one job for all)."""
    types = field_types(df)
    if not date_cols:
        return []
    aggs = [F.avg(F.when((q(c) if is_temporal(types[c]) else parse_ts(q(c))).isNull(), 1.0).otherwise(0.0)).alias(c)
            for c in date_cols]
    bad = df.agg(*aggs).first().asDict()
    return [c for c in date_cols if bad[c] is not None and bad[c] <= 0.5]


def monthly_totals(df: DataFrame, value_col: str | None = None, date_cols: Sequence[str] | None = None,
                   target: str | None = None) -> DataFrame:
    """``(date_column, value_column, period, value)``: value summed per ``yyyy-MM`` month."""
    df = nan_to_null(df)
    value_col = value_col or pick_value_column(df, target)
    date_cols = _usable_dates(df, list(date_cols) if date_cols is not None else _date_columns(df))
    if value_col is None or not date_cols:
        return df.sparkSession.createDataFrame([], "date_column string, value_column string, period string, value double")
    parts = []
    for c in date_cols:
        d = _dated(df, c, value_col).where(F.col("_ts").isNotNull())
        parts.append(
            d.groupBy(F.date_format("_ts", "yyyy-MM").alias("period"))
            .agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))
            .select(F.lit(c).alias("date_column"), F.lit(value_col).alias("value_column"), "period", "value")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def monthly_moving_avg(monthly: DataFrame, window: int = MOVING_WINDOW, digits: int = 6) -> DataFrame:
    """Mean of the current and previous ``window - 1`` present months (fewer at the start)."""
    # input is one row per month and date column: an aggregated, small table
    w = Window.partitionBy("date_column").orderBy("period").rowsBetween(-(window - 1), 0)
    return monthly.select("date_column", "value_column", "period", F.round("value", digits).alias("value"),
                          F.round(F.avg("value").over(w), digits).alias("moving_avg"))


def weekly_totals(df: DataFrame, value_col: str | None = None, date_cols: Sequence[str] | None = None,
                  target: str | None = None, weeks: int = WEEKS_SHOWN, digits: int = 6) -> DataFrame:
    """Value summed per Monday-Sunday week labelled ``start/end``; first ``weeks`` weeks."""
    df = nan_to_null(df)
    value_col = value_col or pick_value_column(df, target)
    date_cols = _usable_dates(df, list(date_cols) if date_cols is not None else _date_columns(df))
    if value_col is None or not date_cols:
        return df.sparkSession.createDataFrame([], "date_column string, value_column string, period string, value double")
    parts = []
    for c in date_cols:
        d = _dated(df, c, value_col).where(F.col("_ts").isNotNull())
        start = F.to_date(F.date_trunc("week", "_ts"))
        agg = d.groupBy(start.alias("_wk")).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))
        label = F.concat_ws("/", F.date_format("_wk", "yyyy-MM-dd"), F.date_format(F.date_add("_wk", 6), "yyyy-MM-dd"))
        first = top_k(agg.withColumn("_g", F.lit(0)), ["_g"], [F.col("_wk")], weeks)
        parts.append(first.select(F.lit(c).alias("date_column"), F.lit(value_col).alias("value_column"),
                                  label.alias("period"), F.round("value", digits).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_ranking(df: DataFrame) -> DataFrame:
    """Columns with nulls ordered by missing % (then position)."""
    pc = profile_columns(df).where(F.col("missing_count") > 0)
    # one row per column: small
    w = Window.orderBy(F.col("missing_pct").desc(), F.col("position"))
    return pc.select("column", F.col("missing_count").alias("missing"), "missing_pct",
                     F.row_number().over(w).alias("rank"))


def box_plot_stats(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, digits: int = 6) -> DataFrame:
    """Quartiles, whiskers (extreme values inside 1.5 IQR fences) and the count of points beyond."""
    df = nan_to_null(df)
    cols = _num_cols(df, cols)
    qw = with_fences(quartiles(df, cols, approx=approx), zero_iqr="none")
    d = distinct_numeric(df, cols).join(F.broadcast(qw.select("column", "lower", "upper")), "column")
    inside = (F.col("v") >= F.col("lower")) & (F.col("v") <= F.col("upper"))
    agg = d.groupBy("column").agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.sum(F.when(~inside, F.col("cnt")).otherwise(0)).alias("n_outliers"),
    )
    j = qw.join(agg, "column")
    return j.select("column", *[F.round(c, digits).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker")],
                    F.col("n_outliers").cast("bigint").alias("n_outliers"))


def ols_trend(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` over rows where both are present."""
    xs, ys = q(x).cast("double"), q(y).cast("double")
    return nan_to_null(df).agg(
        F.lit(x).alias("x"), F.lit(y).alias("y"),
        F.round(F.regr_slope(ys, xs), digits).alias("slope"),
        F.round(F.regr_intercept(ys, xs), digits).alias("intercept"),
        F.round(F.regr_r2(ys, xs), digits).alias("r2"),
        F.regr_count(ys, xs).alias("n"),
    )


def insights(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rule hits as rows ``(rule, column, value)``.

    Rules: duplicates / no duplicates, missing / complete, IQR outliers per
    column, |skew| > 1, top-3 pairs with |r| > 0.7, > 50 categories, top value
    over 70 % of rows.
    """
    df = nan_to_null(df)
    spark = df.sparkSession
    ov = profile_overview(df)
    dup = ov.select(F.when(F.col("dup_rows") == 0, "no_duplicates").otherwise("duplicates").alias("rule"),
                    F.lit(None).cast("string").alias("column"), F.col("dup_rows").cast("double").alias("value"))
    miss = ov.select(F.when(F.col("missing_cells") == 0, "complete").otherwise("missing").alias("rule"),
                     F.lit(None).cast("string").alias("column"), F.col("missing_cells").cast("double").alias("value"))
    outl = eda_outliers(df, approx=approx).where(F.col("count") > 0).select(
        F.lit("outliers").alias("rule"), "column", F.col("count").cast("double").alias("value"))
    stats = descriptive_stats(df, approx=approx)
    skew = stats.where(F.abs(F.col("skewness")) > 1).select(
        F.when(F.col("skewness") > 0, "skewed_right").otherwise("skewed_left").alias("rule"), "column",
        F.col("skewness").alias("value"))
    parts = [dup, miss, outl, skew]
    if len(_num_cols(df)) >= 2:
        top3 = top_correlations(pearson_matrix(df)).where((F.col("rank") <= 3) & (F.abs("pearson") > STRONG))
        parts.append(top3.select(F.concat(F.lit("strong_"), F.col("direction")).alias("rule"),
                                 F.concat_ws("|", "col_a", "col_b").alias("column"), F.col("pearson").alias("value")))
    cats = categorical_breakdown(df)
    parts.append(cats.where((F.col("rank") == 1) & (F.col("n_unique") > 50)).select(
        F.lit("high_cardinality").alias("rule"), "column", F.col("n_unique").cast("double").alias("value")))
    parts.append(cats.where((F.col("rank") == 1) & (F.col("pct") > 70)).select(
        F.lit("dominant_value").alias("rule"), "column", F.col("pct").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    _ = spark
    return out


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: row count, xor and exact sum of per-row 64-bit hashes."""
    h = F.xxhash64(*[q(c) for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )
