"""Feature engineering: shape which features exist before the model pipeline.

Each step is a DataFrame -> DataFrame function; decisions (which columns to
drop, which values are frequent) come from one aggregate or VF job and are
folded back as literals. ``engineer_features`` chains them and returns the
data plus a column ledger (removed / generated / selected).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import parse_ts
from quarry.functions.frames import (
    field_types, is_bool, is_integral, is_numeric, is_string, nan_to_null, q, value_counts,
)
from quarry.functions.ranks import average_ranks
from quarry.functions.stats import quartiles, with_fences

# Default thresholds and name hints of the feature steps.
ID_NAME_HINTS = ("id", "_id", "index", "unnamed")
DATE_PARSE_SUCCESS_RATIO = 0.9
RARE_CATEGORY_THRESHOLD = 0.01
LOW_VARIANCE_THRESHOLD = 0.01
CORRELATION_THRESHOLD = 0.95
OTHER = "Other"
MI_BINS = 10


def _distinct_counts(df: DataFrame, cols: Sequence[str], include_nulls: bool = False) -> dict[str, int]:
    if not cols:
        return {}
    vf = value_counts(df, cols, include_nulls=include_nulls)
    return {r["column"]: r["n"] for r in vf.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def id_feature_columns(df: DataFrame, name_hints=ID_NAME_HINTS, match: str = "substring",
                       cols: Sequence[str] | None = None) -> list[str]:
    """Name contains a hint (or equals one with ``match="token"`` on ``_``-separated parts),
    or a string / integer column whose values are all distinct (floats exempt)."""
    def hinted(col: str) -> bool:
        name = col.strip().lower()
        if match == "token":
            return any(h.strip("_") in name.split("_") for h in name_hints)
        return any(h in name for h in name_hints)

    types = field_types(df)
    cols = list(cols or df.columns)
    named = [c for c in cols if hinted(c)]
    discrete = [c for c in cols if c not in named and (is_string(types[c]) or is_integral(types[c]))]
    n = df.count()
    counts = _distinct_counts(df, discrete)
    return [c for c in cols if c in named or (c in discrete and counts.get(c, 0) == n)]


def remove_id_features(df: DataFrame, name_hints=ID_NAME_HINTS, match: str = "substring",
                       cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*id_feature_columns(df, name_hints, match, cols))


def _date_parts(ts, prefix: str, cyclic: bool) -> dict:
    wd = F.weekday(ts)
    mon = F.month(ts)
    parts = {
        f"{prefix}_year": F.year(ts), f"{prefix}_month": mon, f"{prefix}_day": F.dayofmonth(ts),
        f"{prefix}_weekday": wd, f"{prefix}_quarter": F.quarter(ts), f"{prefix}_week_of_year": F.weekofyear(ts),
        f"{prefix}_is_weekend": F.coalesce((wd >= 5).cast("int"), F.lit(0)),
        f"{prefix}_is_month_start": F.coalesce((F.dayofmonth(ts) == 1).cast("int"), F.lit(0)),
        f"{prefix}_is_month_end": F.coalesce((F.to_date(ts) == F.last_day(ts)).cast("int"), F.lit(0)),
    }
    if cyclic:
        parts.update(cyclic_parts(mon, wd, prefix))
    return parts


def cyclic_parts(month, weekday, prefix: str) -> dict:
    """sin / cos of month (period 12) and weekday (period 7)."""
    two_pi = 2 * math.pi
    return {
        f"{prefix}_month_sin": F.sin(F.lit(two_pi) * month / 12), f"{prefix}_month_cos": F.cos(F.lit(two_pi) * month / 12),
        f"{prefix}_weekday_sin": F.sin(F.lit(two_pi) * weekday / 7),
        f"{prefix}_weekday_cos": F.cos(F.lit(two_pi) * weekday / 7),
    }


def datetime_feature_columns(df: DataFrame, ratio: float = DATE_PARSE_SUCCESS_RATIO,
                             cols: Sequence[str] | None = None) -> list[str]:
    """String columns whose parsed share of all rows exceeds ``ratio`` (one agg)."""
    types = field_types(df)
    cols = [c for c in (cols or df.columns) if is_string(types[c])]
    if not cols:
        return []
    row = df.agg(*[F.avg(F.when(parse_ts(q(c)).isNotNull(), 1.0).otherwise(0.0)).alias(f"s{i}")
                   for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"s{i}"] is not None and row[f"s{i}"] > ratio]


def datetime_features(df: DataFrame, ratio: float = DATE_PARSE_SUCCESS_RATIO, cyclic: bool = True,
                      cols: Sequence[str] | None = None) -> DataFrame:
    """Expand date-like string columns (among ``cols``) into calendar parts and cyclic encodings; drop the source."""
    cols = datetime_feature_columns(df, ratio, cols)
    out = df
    for c in cols:
        out = out.withColumns(_date_parts(parse_ts(q(c)), c, cyclic)).drop(c)
    return out


def cyclic_features(df: DataFrame, col: str) -> DataFrame:
    """Cyclic month / weekday encodings of a timestamp (or date-like string) column."""
    types = field_types(df)
    ts = q(col) if not is_string(types[col]) else parse_ts(q(col))
    return df.withColumns(cyclic_parts(F.month(ts), F.weekday(ts), col))


def bool_to_int(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    types = field_types(df)
    conv = {c: q(c).cast("int") for c in (cols or df.columns) if is_bool(types[c])}
    return df.withColumns(conv) if conv else df


def frequent_values(df: DataFrame, threshold: float = RARE_CATEGORY_THRESHOLD,
                    cols: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Per string column, values whose share of non-null values is at least ``threshold``.

    At most 1/threshold values per column can qualify, so the result has a
    proven size bound however many distinct values the column holds.
    """
    types = field_types(df)
    cols = [c for c in (cols or df.columns) if is_string(types[c])]
    if not cols:
        return {}
    vf = value_counts(df, cols)
    tot = vf.groupBy("column").agg(F.sum("cnt").alias("n"))
    freq = vf.join(F.broadcast(tot), "column").where(F.col("cnt") / F.col("n") >= threshold)
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in freq.select("column", "str").collect():
        out[r["column"]].append(r["str"])
    return out


def rare_categories(df: DataFrame, threshold: float = RARE_CATEGORY_THRESHOLD,
                    cols: Sequence[str] | None = None) -> DataFrame:
    """String values with share of non-null values below ``threshold`` -> "Other"; nulls kept."""
    freq = frequent_values(df, threshold, cols)
    exprs = {c: F.when(q(c).isNull() | q(c).isin(vals), q(c)).otherwise(F.lit(OTHER)) for c, vals in freq.items()}
    return df.withColumns(exprs) if exprs else df


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct value, null counted as a value."""
    cols = list(cols or df.columns)
    counts = _distinct_counts(df, cols, include_nulls=True)
    return [c for c in cols if counts.get(c, 0) <= 1]


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, cols))


def drop_low_variance(df: DataFrame, threshold: float = LOW_VARIANCE_THRESHOLD,
                      cols: Sequence[str] | None = None) -> DataFrame:
    """Drop numeric columns whose population variance after mean-filling is <= threshold.

    Variance after filling nulls with the mean equals var_pop * count / rows.
    Unchanged when no column would survive or a numeric column is all null.
    Output: non-numeric columns sorted by name, then the kept numeric ones
    (columns outside ``cols`` follow, untouched).
    """
    types = field_types(df)
    cols = list(cols or df.columns)
    nums = [c for c in cols if is_numeric(types[c])]
    if not nums:
        return df
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[(F.var_pop(q(c).cast("double")) * F.count(q(c)) / F.count(F.lit(1))).alias(f"v{i}")
                   for i, c in enumerate(nums)]).first()
    variances = [row[f"v{i}"] for i in range(len(nums))]
    if any(v is None for v in variances):
        return df
    kept = [c for c, v in zip(nums, variances) if v > threshold]
    if not kept:
        return df
    others = sorted(c for c in cols if c not in nums)
    rest = [c for c in df.columns if c not in cols]
    return df.select(*[q(c) for c in others + kept + rest])


def correlated_columns(df: DataFrame, threshold: float = CORRELATION_THRESHOLD,
                       cols: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with |r| > threshold against any earlier numeric column (dropped or not)."""
    from quarry.operators.eda import pairwise_pearson

    types = field_types(df)
    nums = [c for c in (cols or df.columns) if is_numeric(types[c])]
    if len(nums) < 2:
        return []
    rs = pairwise_pearson(df, [q(c) for c in nums])
    hit = {nums[j] for (i, j), r in rs.items() if r is not None and abs(r) > threshold}
    return [c for c in nums if c in hit]


def drop_correlated(df: DataFrame, threshold: float = CORRELATION_THRESHOLD,
                    cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*correlated_columns(df, threshold, cols))


def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """For numeric pairs present in the table: ``a_x_b`` and ``a_div_b`` (null when b is 0)."""
    if not pairs:
        return df
    types = field_types(df)
    exprs = {}
    for a, b in pairs:
        if a not in types or b not in types or not (is_numeric(types[a]) and is_numeric(types[b])):
            continue
        exprs[f"{a}_x_{b}"] = q(a) * q(b)
        exprs[f"{a}_div_{b}"] = F.try_divide(q(a).cast("double"), F.when(q(b) != 0, q(b).cast("double")))
    return df.withColumns(exprs) if exprs else df


def cap_outliers(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """Clip numeric columns to [q1 - f*IQR, q3 + f*IQR] (quartiles of each column as it stands; nulls kept)."""
    from quarry.operators.clean import clip_expr

    types = field_types(df)
    cols = [c for c in (cols or df.columns) if is_numeric(types[c])]
    if not cols:
        return df
    fences = {r["column"]: r for r in with_fences(quartiles(df, cols, approx=approx), factor=factor).collect()}
    exprs = {c: clip_expr(q(c), fences[c]["lower"], fences[c]["upper"]) for c in cols
             if c in fences and fences[c]["lower"] is not None}
    return df.withColumns(exprs) if exprs else df


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Remaining nulls -> 0 (numbers) or '0' (strings); other types are left as they are."""
    types = field_types(df)
    nums = [c for c in (cols or df.columns) if is_numeric(types[c])]
    strs = [c for c in (cols or df.columns) if is_string(types[c])]
    out = df.fillna(0, subset=nums) if nums else df
    return out.fillna("0", subset=strs) if strs else out


def _equal_frequency_bins(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Long ``(column, value, bin)``: bin = floor((average rank - 1) * bins / n), ties share a bin."""
    cells = [F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("v")) for c in cols]
    long = df.select(F.inline(F.array(*cells)))
    ranks = average_ranks(long, ["column"], "v")
    n = ranks.groupBy("column").agg(F.sum("cnt").alias("_n"))
    return ranks.join(F.broadcast(n), "column").select(
        "column", "v", F.floor((F.col("avg_rank") - 1) * bins / F.col("_n")).cast("int").alias("bin"))


def mutual_information(df: DataFrame, target: str, problem_type: str, cols: Sequence[str] | None = None,
                       bins: int = MI_BINS) -> DataFrame:
    """Binned mutual information (nats) of each numeric feature with the target.

    Features (nulls as 0) go to ``bins`` equal-frequency bins by average rank;
    a regression target is binned the same way, a class label is used as is.
    MI = sum p(x,y) ln(p(x,y) / (p(x) p(y))) over one long count table.
    Returns ``(column, mi)``.
    """
    types = field_types(df)
    cols = [c for c in (cols or df.columns) if c != target and is_numeric(types[c])]
    filled = df.select(*[F.coalesce(q(c).cast("double"), F.lit(0.0)).alias(c) for c in cols], q(target).alias("_y"))
    filled = filled.where(F.col("_y").isNotNull())
    if problem_type == "regression":
        yb = _equal_frequency_bins(filled.select(F.col("_y").alias("_yv")), ["_yv"], bins).select(
            F.col("v").alias("_yk"), F.col("bin").cast("string").alias("_ylab"))
        filled = filled.join(yb, filled["_y"].cast("double") == yb["_yk"]).drop("_yk", "_y").withColumnRenamed("_ylab", "_y")
    else:
        filled = filled.withColumn("_y", F.col("_y").cast("string"))
    xb = _equal_frequency_bins(filled, cols, bins)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in cols]
    long = filled.select("_y", F.inline(F.array(*cells)))
    joint = long.join(xb, ["column", "v"]).groupBy("column", "bin", "_y").agg(F.count(F.lit(1)).alias("nxy"))
    px = joint.groupBy("column", "bin").agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy("column", "_y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("column").agg(F.sum("nxy").alias("n"))
    j = joint.join(px, ["column", "bin"]).join(py, ["column", "_y"]).join(n, "column")
    term = (F.col("nxy") / F.col("n")) * F.ln(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy("column").agg(F.sum(term).alias("mi"))


def select_k_best(df: DataFrame, target: str, problem_type: str, k: int = 20) -> DataFrame:
    """Keep the ``k`` numeric features with the highest binned MI; non-numeric features kept (sorted by name first)."""
    features = [c for c in df.columns if c != target]
    if len(features) <= k:
        return df
    types = field_types(df)
    nums = [c for c in features if is_numeric(types[c])]
    if not nums:
        return df
    mi = {r["column"]: r["mi"] for r in mutual_information(df, target, problem_type, nums).collect()}
    ranked = sorted(nums, key=lambda c: (-(mi.get(c) or 0.0), nums.index(c)))[: min(k, len(nums))]
    selected = [c for c in nums if c in ranked]
    others = sorted(c for c in features if c not in nums)
    return df.select(*[q(c) for c in others + selected], q(target))


@dataclass
class Engineered:
    data: DataFrame
    ledger: DataFrame
    removed: list[str]
    generated: list[str]
    selected: list[str] | None


def engineer_features(df: DataFrame, target: str, *, correlation_threshold: float = CORRELATION_THRESHOLD,
                      low_variance_threshold: float = LOW_VARIANCE_THRESHOLD,
                      rare_category_threshold: float = RARE_CATEGORY_THRESHOLD,
                      interaction_pairs: Sequence[tuple[str, str]] | None = None, select_k: int | None = None,
                      problem_type: str | None = None, keep_target: bool = False,
                      name_hints=ID_NAME_HINTS) -> Engineered:
    """dates -> IDs -> booleans -> rare categories -> constants -> low variance -> correlated
    -> interactions -> fill zero -> optional top-k by mutual information.

    Same decisions as chaining the single steps, taken from two passes over
    one checkpointed working table: a value-frequency pass (IDs, frequent
    values, constants after the rare-value merge) and one aggregate of
    variances and pairwise correlations. The target rides along untouched and
    is dropped at the end unless ``keep_target``. Returns the data and a
    ledger ``(column, status)`` of removed / generated / selected columns.
    """
    from quarry.operators.eda import pairwise_pearson
    from quarry.session import stored

    df = stored(nan_to_null(df))
    original = [c for c in df.columns if c != target]
    out = datetime_features(df, cols=original).checkpoint(eager=True)
    feats = [c for c in out.columns if c != target]
    types = field_types(out)

    # pass 1: one VF over every feature column, nulls as their own group
    vf = value_counts(out, feats, include_nulls=True).checkpoint(eager=True)
    per = vf.groupBy("column").agg(
        F.sum("cnt").alias("n"), F.sum(F.when(~F.col("is_null"), F.col("cnt")).otherwise(0)).alias("n_present"),
        F.count_if(~F.col("is_null")).alias("n_distinct"), F.max(F.col("is_null").cast("int")).alias("has_null"),
    )
    stats = {r["column"]: r for r in per.collect()}
    n_rows = max((r["n"] for r in stats.values()), default=0)
    strings = [c for c in feats if is_string(types[c])]
    share = F.col("cnt") / F.col("n_present")
    freq_rows = (vf.where(~F.col("is_null") & F.col("column").isin(strings)).join(F.broadcast(per), "column")
                 .select("column", "str", (share >= rare_category_threshold).alias("frequent")).where(
                     F.col("frequent") | F.lit(False)).collect()) if strings else []
    frequent: dict[str, list[str]] = {c: [] for c in strings}
    for r in freq_rows:
        frequent[r["column"]].append(r["str"])

    def hinted(col: str) -> bool:
        return any(h in col.strip().lower() for h in name_hints)

    ids = [c for c in feats if hinted(c) or ((is_string(types[c]) or is_integral(types[c]))
                                             and stats[c]["n_distinct"] == n_rows)]
    kept = [c for c in feats if c not in ids]
    # distinct values after the rare-value merge, null counted as a value
    def distinct_after(c: str) -> int:
        st = stats[c]
        if c in frequent:
            rare = st["n_distinct"] > len(frequent[c])
            # a frequent value that is called like the merged ones is one value with them
            return len({*frequent[c], OTHER} if rare else set(frequent[c])) + int(st["has_null"] or 0)
        return st["n_distinct"] + int(st["has_null"] or 0)
    constants = [c for c in kept if distinct_after(c) <= 1]
    kept = [c for c in kept if c not in constants]

    # pass 2: variances (after mean filling) and pairwise correlations of the numeric survivors
    def num_expr(c):
        return q(c).cast("double") if not is_bool(types[c]) else q(c).cast("int").cast("double")
    nums = [c for c in kept if is_numeric(types[c]) or is_bool(types[c])]
    low_var, correlated, order = [], [], kept
    if nums:
        row = out.agg(*[(F.var_pop(num_expr(c)) * F.count(q(c)) / F.count(F.lit(1))).alias(f"v{i}")
                        for i, c in enumerate(nums)],
                      *[F.count_if(q(c).isNull()).alias(f"z{i}") for i, c in enumerate(nums)]).first()
        variances = [row[f"v{i}"] for i in range(len(nums))]
        if not any(v is None for v in variances):
            surviving = [c for c, v in zip(nums, variances) if v > low_variance_threshold]
            if surviving:
                low_var = [c for c in nums if c not in surviving]
                others = sorted(c for c in kept if c not in nums)
                order = others + surviving
                idx = {c: i for i, c in enumerate(surviving)}
                rs = pairwise_pearson(out, [num_expr(c) for c in surviving],
                                      [row[f"z{nums.index(c)}"] == 0 for c in surviving])
                for b in surviving:
                    if any(rs.get((idx[a], idx[b])) is not None and abs(rs[(idx[a], idx[b])]) > correlation_threshold
                           for a in surviving[: idx[b]]):
                        correlated.append(b)
    final = [c for c in order if c not in low_var and c not in correlated]

    exprs = []
    for c in final:
        e = q(c).cast("int") if is_bool(types[c]) else q(c)
        if c in frequent:
            e = F.when(q(c).isNull() | q(c).isin(frequent[c]), q(c)).otherwise(F.lit(OTHER))
        exprs.append(e.alias(c))
    shaped = out.select(*exprs, q(target))
    shaped = interaction_features(shaped, interaction_pairs)
    shaped = fill_zero(shaped, cols=[c for c in shaped.columns if c != target])
    selected = None
    if select_k is not None and problem_type is not None:
        shaped = select_k_best(shaped, target, problem_type, select_k)
        selected = [c for c in shaped.columns if c != target]
    data = shaped if keep_target else shaped.drop(target)
    generated = [c for c in shaped.columns if c != target and c not in original]
    removed = [c for c in original if c not in shaped.columns]
    rows = ([(c, "removed") for c in removed] + [(c, "generated") for c in generated]
            + [(c, "selected") for c in (selected or [])])
    ledger = df.sparkSession.createDataFrame(rows, "column string, status string")
    return Engineered(data, ledger, removed, generated, selected)
