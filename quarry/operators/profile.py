"""Profiling and data-quality scoring (overview, column classes, stats, score).

Outputs are tidy tables: ``profile_overview`` (1 row), ``profile_columns`` (one
row per column), ``top_values`` (long), ``quality_score`` (1 row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.dates import parse_ts
from quarry.functions.frames import (
    field_types, is_bool, is_numeric, is_string, is_temporal, nan_to_null, one_row_join, q, render_value,
    top_k,
)
from quarry.functions.table_stats import TableStats, table_stats, text_sample

# Thresholds of the column classifier and the score.
SAMPLE_ROWS = 50
TEXT_MEAN_LENGTH = 40
TEXT_UNIQUE_RATIO = 0.85
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]


def _rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def profile_overview(df: DataFrame) -> DataFrame:
    """rows, cols, duplicate rows (beyond first copy, nulls equal), missing cells and % of all cells.

    One shuffle: grouping on every column gives distinct rows; each group's
    null pattern is shared by its copies, so missing cells = sum(cnt * nulls).
    """
    df = nan_to_null(df)
    n_cols = len(df.columns)
    nulls = sum((F.when(q(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_cnt")).select(
        "_cnt", nulls.alias("_nulls")
    )
    agg = g.agg(
        F.coalesce(F.sum("_cnt"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("_distinct"),
        F.coalesce(F.sum(F.col("_cnt") * F.col("_nulls")), F.lit(0)).cast("bigint").alias("missing_cells"),
    )
    cells = F.col("n_rows") * F.lit(n_cols)
    return agg.select(
        "n_rows",
        F.lit(n_cols).cast("bigint").alias("n_cols"),
        (F.col("n_rows") - F.col("_distinct")).alias("dup_rows"),
        "missing_cells",
        F.when(cells > 0, F.round(F.col("missing_cells") / cells * 100, 2)).otherwise(F.lit(0.0)).alias("missing_pct"),
    )


def _dtype_class(dt: T.DataType) -> str | None:
    if is_numeric(dt):
        return "numeric"
    if is_bool(dt):
        return "categorical"
    if is_temporal(dt):
        return "datetime"
    if is_string(dt):
        return None  # decided by content
    return "categorical"


def classify_columns(df: DataFrame, stats: TableStats | None = None) -> DataFrame:
    """``(column, position, dtype, class)``; class in numeric / categorical / datetime / text.

    Strings: a deterministic 50-row sample (non-null rows ordered by md5 of
    the value, then the value) all parsing as timestamps -> datetime; else
    sample mean length > 40 or distinct/rows > 0.85 -> text; else categorical.
    Built from the table's VF pass (``table_stats``).
    """
    df = nan_to_null(df)
    types = field_types(df)
    spark = df.sparkSession
    fixed = [
        (c, i, types[c].simpleString(), _dtype_class(types[c]))
        for i, c in enumerate(df.columns)
        if _dtype_class(types[c]) is not None
    ]
    schema = "column string, position int, dtype string, class string"
    fixed_df = spark.createDataFrame(fixed, schema)
    str_cols = [c for c in df.columns if is_string(types[c])]
    if not str_cols:
        return fixed_df
    st = stats if stats is not None else table_stats(df)
    sample = text_sample(st, SAMPLE_ROWS).groupBy("column").agg(
        F.sum(F.when(parse_ts(F.col("value")).isNull(), F.col("taken")).otherwise(0)).alias("bad"),
        (F.sum(F.length("value") * F.col("taken")) / F.sum("taken")).alias("avg_len"),
    )
    base = st.columns.where(F.col("column").isin(str_cols)).select("column", "position", "n_unique")
    s_ = base.join(sample, "column", "left")
    ratio = F.col("n_unique") / F.lit(max(st.n_rows, 1))
    cls = (
        F.when(F.coalesce(F.col("bad"), F.lit(0)) == 0, "datetime")
        .when((F.col("avg_len") > TEXT_MEAN_LENGTH) | (ratio > TEXT_UNIQUE_RATIO), "text")
        .otherwise("categorical")
    )
    strings = s_.select("column", "position", F.lit("string").alias("dtype"), cls.alias("class"))
    return fixed_df.unionByName(strings)


def sample_values(df: DataFrame, k: int = 4, stats: TableStats | None = None) -> DataFrame:
    """``(column, rank, value)``: the k smallest distinct non-null values per column; floats at 4 dp."""
    st = stats if stats is not None else table_stats(df)
    ranked = top_k(st.vf.where(~F.col("is_null")), ["column"], [F.col("num"), F.col("str")], k)
    return ranked.select("column", "rank", render_value(F.col("kind"), F.col("num"), F.col("str")).alias("value"))


def _summary(df: DataFrame, cols: Sequence[str] | None, approx: bool) -> DataFrame:
    """Numeric summary from a VF pass over the numeric columns only (the scan reads nothing else)."""
    types = field_types(df)
    wanted = [c for c in (cols or df.columns) if is_numeric(types[c])]
    st = table_stats(df.select(*[q(c) for c in wanted]), approx=approx)
    st.numeric.count()  # materialise the small cached summary, then release the VF table
    st.vf.unpersist()
    return st.numeric


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                    summary: DataFrame | None = None) -> DataFrame:
    """Per numeric column: mean, median, std, min, max, q1, q3, skewness (4 dp) and IQR outlier count."""
    s = summary if summary is not None else _summary(nan_to_null(df), cols, approx)
    return s.where(F.col("n") > 0).select(
        "column", "position",
        *[F.round(F.col(c), 4).alias(c) for c in ("mean", "median", "std", "min", "max", "q1", "q3")],
        F.round(F.col("skew"), 4).alias("skewness"), "outliers",
    )


def iqr_outlier_count(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                      summary: DataFrame | None = None) -> DataFrame:
    """``(column, q1, q3, lower, upper, outliers)`` with 1.5 IQR fences and no zero-IQR guard."""
    s = summary if summary is not None else _summary(nan_to_null(df), cols, approx)
    return s.where(F.col("q1").isNotNull()).select(
        "column", *[F.round(F.col(c), 4).alias(c) for c in ("q1", "q3", "lower", "upper")], "outliers")


def categorical_columns(df: DataFrame, stats: TableStats | None = None) -> list[str]:
    classes = classify_columns(df, stats).where(F.col("class") == "categorical").orderBy("position").collect()
    return [r["column"] for r in classes]


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5,
               stats: TableStats | None = None) -> DataFrame:
    """``(column, rank, value, count, pct, n_unique)``: top k non-null values, % of all rows (1 dp).

    Default columns are those classed categorical. Ties break on the value.
    """
    df = nan_to_null(df)
    st = stats if stats is not None else table_stats(df)
    cols = list(cols) if cols is not None else categorical_columns(df, st)
    vf = st.vf.where(~F.col("is_null") & F.col("column").isin(cols))
    ranked = top_k(vf, ["column"], [F.col("cnt").desc(), F.col("num"), F.col("str")], k)
    return ranked.join(st.columns.select("column", "n_unique"), "column").select(
        "column", "rank",
        render_value(F.col("kind"), F.col("num"), F.col("str")).alias("value"),
        F.col("cnt").cast("bigint").alias("count"),
        F.round(F.col("cnt") / F.lit(max(st.n_rows, 1)) * 100, 1).alias("pct"),
        F.col("n_unique").cast("bigint").alias("n_unique"),
    )


def profile_columns(df: DataFrame, approx: bool = False, stats: TableStats | None = None) -> DataFrame:
    """``(column, position, dtype, missing_count, missing_pct, n_unique)``.

    Exact counts come from the table's single VF pass; ``approx=True`` uses
    one aggregate with ``approx_count_distinct`` instead.
    """
    df = nan_to_null(df)
    types = field_types(df)
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(c, i, types[c].simpleString()) for i, c in enumerate(df.columns)],
        "column string, position int, dtype string",
    )
    if approx and stats is None:
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(df.columns):
            aggs += [F.count_if(q(c).isNull()).alias(f"m{i}"), F.approx_count_distinct(q(c)).alias(f"u{i}")]
        row = df.agg(*aggs).first()
        n = row["_n"]
        counts = spark.createDataFrame([(c, row[f"m{i}"], row[f"u{i}"]) for i, c in enumerate(df.columns)],
                                       "column string, missing_count long, n_unique long")
    else:
        st = stats if stats is not None else table_stats(df)
        n = st.n_rows
        counts = st.columns.select("column", "missing_count", "n_unique")
    out = meta.join(counts, "column", "left")
    miss = F.coalesce(F.col("missing_count"), F.lit(0)).cast("bigint")
    return out.select(
        "column", "position", "dtype",
        miss.alias("missing_count"),
        (F.round(miss / F.lit(n) * 100, 2) if n else F.lit(0.0)).alias("missing_pct"),
        F.coalesce(F.col("n_unique"), F.lit(0)).cast("bigint").alias("n_unique"),
    )


def column_facts(df: DataFrame, approx: bool = False, summary: DataFrame | None = None,
                 stats: TableStats | None = None) -> DataFrame:
    """Everything the rule-based steps need, one row per column (small; cached).

    ``column, position, dtype, class, missing_count, missing_pct, n_unique,
    n_rows, outliers, skewness, median`` (numeric stats null elsewhere).
    """
    df = nan_to_null(df)
    own = stats is None
    st = table_stats(df, approx=approx) if own else stats
    s_ = summary if summary is not None else st.numeric
    pc = profile_columns(df, stats=st)
    cl = classify_columns(df, st).select("column", "class")
    pn = profile_numeric(df, summary=s_).select("column", "outliers", "skewness").join(
        s_.select("column", "median"), "column")
    facts = (
        pc.join(cl, "column")
        .join(pn, "column", "left")
        .withColumn("n_rows", F.lit(st.n_rows).cast("bigint"))
    ).cache()
    if own:
        facts.count()  # one row per column; once materialised the VF table is no longer needed
        st.vf.unpersist()
    return facts


def column_recommendation(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``(column, position, rule)``: first matching rule of the recommendation ladder."""
    f = facts if facts is not None else column_facts(df)
    mp, cls = F.col("missing_pct"), F.col("class")
    outl = F.coalesce(F.col("outliers"), F.lit(0))
    skew = F.abs(F.coalesce(F.col("skewness"), F.lit(0.0)))
    rule = (
        F.when(mp > 50, "drop_column")
        .when((mp > 10) & (cls == "numeric"), "fill_median")
        .when((mp > 10) & (cls == "categorical"), "fill_mode")
        .when((mp > 0) & (cls == "numeric"), "fill_mean_or_median")
        .when((cls == "numeric") & (outl > 0), "review_outliers")
        .when((cls == "numeric") & (skew > 1), "log_transform")
        .when(cls == "numeric", "clean")
        .when((cls == "categorical") & (F.col("n_unique") == F.col("n_rows")), "id_like")
        .when((cls == "categorical") & (F.col("n_unique") <= 2), "binary")
        .when((cls == "categorical") & (F.col("n_unique") > 50), "high_cardinality")
        .when(cls == "categorical", "ok_cardinality")
        .when(cls == "datetime", "extract_datetime_parts")
        .when(cls == "text", "text_features")
        .otherwise("no_issues")
    )
    return f.select("column", "position", rule.alias("rule"))


def quality_score(df: DataFrame, facts: DataFrame | None = None, overview: DataFrame | None = None) -> DataFrame:
    """Penalties (missing, duplicates, outliers, datatype, constant), score (1 dp) and grade."""
    f = facts if facts is not None else column_facts(df)
    ov = overview if overview is not None else profile_overview(df)
    is_num = F.col("class") == "numeric"
    affected = is_num & (F.coalesce(F.col("outliers"), F.lit(0)) > 0)
    per_col = f.agg(
        F.count_if(is_num).alias("numeric_cols"),
        F.count_if(affected).alias("affected_cols"),
        F.sum(F.when(affected, F.col("outliers") / F.col("n_rows")).otherwise(0.0)).alias("severity"),
        F.count_if((F.col("dtype") == "string") & (F.col("class") == "text")).alias("text_cols"),
        F.count_if(F.col("n_unique") <= 1).alias("constant_cols"),
    )
    j = one_row_join(ov, per_col)
    ratio = F.when(F.col("numeric_cols") > 0, F.col("affected_cols") / F.col("numeric_cols")).otherwise(0.0)
    avg_sev = F.when(
        (F.col("numeric_cols") > 0) & (F.col("affected_cols") > 0), F.col("severity") / F.col("affected_cols")
    ).otherwise(0.0)
    pen = j.select(
        F.least(F.col("missing_pct") * 1.5, F.lit(40.0)).alias("missing_penalty"),
        F.least(F.col("dup_rows") / F.greatest(F.col("n_rows"), F.lit(1)) * 100 * 0.5, F.lit(20.0)).alias("duplicate_penalty"),
        F.least(ratio * 10 + avg_sev * 10, F.lit(20.0)).alias("outlier_penalty"),
        F.least(F.col("text_cols") * 2.0, F.lit(10.0)).alias("datatype_penalty"),
        F.least(F.col("constant_cols") * 2.0, F.lit(10.0)).alias("constant_penalty"),
    )
    total = sum(F.col(c) for c in pen.columns)
    score = F.greatest(F.lit(0.0), F.round(F.lit(100.0) - total, 1))
    out = pen.select(*[F.round(F.col(c), 2).alias(c) for c in pen.columns], score.alias("score"))
    grade = F.lit("F")
    for threshold, letter in reversed(GRADES):
        grade = F.when(F.col("score") >= threshold, letter).otherwise(grade)
    return out.withColumn("grade", grade)


def class_counts(df: DataFrame, stats: TableStats | None = None) -> DataFrame:
    """``(class, n_columns)``."""
    return classify_columns(df, stats).groupBy("class").agg(F.count(F.lit(1)).alias("n_columns"))


def target_candidates(df: DataFrame, facts: DataFrame | None = None, limit: int = 6) -> DataFrame:
    """First ``limit`` columns in column order that could be a target, with the reason."""
    f = facts if facts is not None else column_facts(df)
    reason = (
        F.when((F.col("class") == "numeric") & (F.col("n_unique") > 10), F.lit("regression"))
        .when((F.col("class") == "categorical") & F.col("n_unique").between(2, 20), F.lit("classification"))
    )
    c = f.select("column", "position", reason.alias("reason"), "n_unique").where(F.col("reason").isNotNull())
    return c.orderBy("position").limit(limit)


def _names_in_order(cond) -> F.Column:
    return F.concat_ws(
        ",",
        F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("position", "column")))), lambda s: s["column"]),
    )


def quality_issues(df: DataFrame, facts: DataFrame | None = None, overview: DataFrame | None = None) -> DataFrame:
    """One row: high-missing columns (> 30 %), categorical ID-like columns, outlier column count and total."""
    f = facts if facts is not None else column_facts(df)
    ov = overview if overview is not None else profile_overview(df)
    per = f.agg(
        _names_in_order(F.col("missing_pct") > 30).alias("high_missing_cols"),
        _names_in_order((F.col("n_unique") == F.col("n_rows")) & (F.col("class") == "categorical")).alias("id_like_cols"),
        F.count_if(F.coalesce(F.col("outliers"), F.lit(0)) > 0).alias("outlier_columns"),
        F.coalesce(F.sum(F.coalesce(F.col("outliers"), F.lit(0))), F.lit(0)).cast("bigint").alias("total_outliers"),
    )
    return one_row_join(ov.select("missing_cells", F.col("dup_rows").alias("duplicate_rows")), per)


def issue_columns(df: DataFrame, search: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Columns with any missing value, any IQR outlier, or categorical and unique on every row."""
    f = facts if facts is not None else column_facts(df)
    id_like = (F.col("class") == "categorical") & (F.col("n_unique") == F.col("n_rows"))
    outl = F.coalesce(F.col("outliers"), F.lit(0)).cast("bigint")
    out = f.where((F.col("missing_count") > 0) | (outl > 0) | id_like).select(
        "column", "position", "missing_count", outl.alias("outliers"), id_like.alias("id_like")
    )
    if search:
        out = out.where(F.lower(F.col("column")).contains(search.lower()))
    return out


# Bytes per value of fixed-width types in the size estimate.
FIXED_WIDTH = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "date": 4, "float": 4,
               "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def size_estimate(df: DataFrame) -> DataFrame:
    """``(column, bytes)``: logical bytes held (UTF-8 bytes for strings, fixed width otherwise; nulls 0)."""
    types = field_types(df)
    aggs = []
    for i, c in enumerate(df.columns):
        name = types[c].simpleString()
        if is_string(types[c]):
            aggs.append(F.coalesce(F.sum(F.octet_length(q(c))), F.lit(0)).cast("bigint").alias(f"b{i}"))
        else:
            width = FIXED_WIDTH.get(name, 16 if name.startswith("decimal") else 8)
            aggs.append((F.count(q(c)) * width).cast("bigint").alias(f"b{i}"))
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("bytes")) for i, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*cells)))


__all__ = [
    "profile_overview", "classify_columns", "sample_values", "profile_numeric", "iqr_outlier_count", "top_values",
    "profile_columns", "column_facts", "column_recommendation", "quality_score", "class_counts",
    "target_candidates", "quality_issues", "issue_columns", "size_estimate", "categorical_columns",
]
