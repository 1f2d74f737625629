"""Column typing, NaN handling, unpivot and the value-frequency (VF) table.

VF is the one shuffle that serves distinct counts, modes, top-k, constant
flags, rare values and ID-likeness for all columns of a table at once: every
row is unpivoted to ``(column, num, str)`` and grouped with map-side partial
aggregation, so a value repeated on a third of all rows collapses to one
partial row per task before the exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def q(name: str) -> Column:
    """Column reference that survives spaces and dots in names."""
    return F.col(f"`{name}`")


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_bool(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, TEMPORAL_TYPES)


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    types = field_types(df)
    return [c for c in (cols or df.columns) if is_numeric(types[c])]


def string_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    types = field_types(df)
    return [c for c in (cols or df.columns) if is_string(types[c])]


def value_kind(dt: T.DataType) -> str:
    """How a value of this type is grouped and rendered in long tables."""
    if is_integral(dt):
        return "int"
    if is_numeric(dt):
        return "float"
    if is_bool(dt):
        return "bool"
    if is_temporal(dt):
        return "time"
    return "str"


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas counts NaN as missing; Spark counts it as a value. Normalise on entry."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(F.isnan(q(f.name)), F.lit(None)).otherwise(q(f.name)).alias(f.name))
        else:
            exprs.append(q(f.name))
    return df.select(*exprs)


def num_expr(name: str, dt: T.DataType) -> Column:
    if is_numeric(dt):
        return q(name).cast("double")
    return F.lit(None).cast("double")


def str_expr(name: str, dt: T.DataType) -> Column:
    """Grouping key for non-float values (exact, injective per type)."""
    kind = value_kind(dt)
    if kind == "float":
        return F.lit(None).cast("string")
    if kind == "time":
        if isinstance(dt, T.DateType):
            return F.date_format(q(name), "yyyy-MM-dd HH:mm:ss")
        # whole seconds as such, others with all six digits
        whole = F.date_format(q(name), "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(q(name), "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return q(name).cast("string")


def render_value(kind: Column, num: Column, txt: Column) -> Column:
    """Display form of a VF value: floats fixed at 4 dp, everything else as grouped."""
    return F.when(kind == "float", F.format_string("%.4f", num)).otherwise(txt)


def long_values(df: DataFrame, cols: Sequence[str] | None = None, include_nulls: bool = False) -> DataFrame:
    """Unpivot to ``(column, position, kind, num, str)``; one row per non-null cell.

    Numbers keep their double in ``num`` (the order key); floats group on it,
    all other types group on the exact ``str`` form.
    """
    types = field_types(df)
    cols = list(cols or df.columns)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("position"),
            F.lit(value_kind(types[c])).alias("kind"),
            num_expr(c, types[c]).alias("num"),
            str_expr(c, types[c]).alias("str"),
            q(c).isNull().alias("is_null"),
        )
        for i, c in enumerate(cols)
    ]
    out = df.select(F.inline(F.array(*cells)))
    if not include_nulls:
        out = out.where(~F.col("is_null"))
    return out


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, include_nulls: bool = False) -> DataFrame:
    """VF: ``(column, position, kind, num, str, is_null, cnt)``, one row per distinct value."""
    return (
        long_values(df, cols, include_nulls)
        .groupBy("column", "position", "kind", "num", "str", "is_null")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def top_k(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per group via ``row_number() <= k``.

    Spark turns the filtered row_number into a partial WindowGroupLimit before
    the exchange, so each task ships at most k rows per group: a group with
    billions of rows never lands whole on one task.
    """
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two single-row aggregates (sizes are 1 by construction)."""
    return left.withColumn("_one", F.lit(1)).join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one")


def round_cols(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(q(c), digits[c]).alias(c) if c in digits else q(c) for c in df.columns])


def as_list(x: str | Iterable[str] | None) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)
