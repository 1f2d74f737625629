"""CSV / JSON sources and sinks.

``scan_csv`` reads every field as text, turns pandas' missing-value tokens
into nulls, then infers each column's type from its non-null values in one
aggregate (integer, float, boolean, else text) -- the order pandas uses --
instead of Spark's single ``nullValue`` and sampling-based inference.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.frames import q
from quarry.sources.csv_split import read_split

# The strings pandas reads as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOL_TOKENS = ["True", "False", "true", "false", "TRUE", "FALSE"]
# Doubled quotes and kept outer spaces, on both ways.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


class EmptyInputError(ValueError):
    pass


def _infer(df: DataFrame) -> DataFrame:
    """Cast each text column to long, double or boolean when all its non-null values fit (one agg)."""
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = q(c)
        aggs += [F.count(v).alias(f"n{i}"), F.count(v.try_cast("long")).alias(f"l{i}"),
                 F.count(v.try_cast("double")).alias(f"d{i}"), F.count_if(v.isin(BOOL_TOKENS)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    exprs = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if n and row[f"l{i}"] == n:
            exprs.append(q(c).try_cast("long").alias(c))
        elif n and row[f"d{i}"] == n:
            exprs.append(q(c).try_cast("double").alias(c))
        elif n and row[f"b{i}"] == n:
            exprs.append((F.lower(q(c)) == "true").alias(c))
        else:
            exprs.append(q(c))
    return df.select(*exprs)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = True,
             na_tokens=NA_TOKENS, training: bool = False, multi_line: bool | None = None) -> DataFrame:
    """Read a comma CSV with a header; refuse non-``.csv`` paths and (for training) empty input.

    Quotes inside quoted fields are doubled, and fields may hold line breaks.
    Files are read by as many tasks as they have splits: where a field holds a
    line break, records are put together across splits (``csv_split``), else
    Spark's split reader is right. ``multi_line=True`` reads each file in one
    task (needed only for files whose records end in a lone carriage return);
    ``multi_line=False`` skips the look for line breaks.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError(f"not a .csv path: {path}")
    reader = spark.read.options(**CSV_OPTIONS).option("mode", "FAILFAST").option("multiLine", multi_line is not False)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", False).csv(path)
    if multi_line is None:
        fields = df.schema.fields
        split = read_split(spark, path, [f.dataType.simpleString() for f in fields], CSV_OPTIONS)
        plain = reader.option("multiLine", False)
        df = split.toDF(*df.columns) if split is not None else plain.schema(df.schema).csv(path)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.select(*[F.when(q(c).isin(list(na_tokens)), None).otherwise(q(c)).alias(c) if c in strings else q(c)
                     for c in df.columns])
    if schema is None and infer:
        df = _infer(df)
    if training and df.limit(1).count() == 0:
        raise EmptyInputError(f"no rows in {path}")
    return df


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write with a header and no index column; ``scan_csv`` reads every text back (Spark writes one file per partition)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def sink_eda_json(sections: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> str:
    """Export EDA sections as JSON lines ``{"section": ..., "row": {...}}``."""
    parts = [d.select(F.lit(name).alias("section"), F.to_json(F.struct(*[q(c) for c in d.columns])).alias("row"))
             for name, d in sections.items()]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    out.write.mode(mode).json(path)
    return path


def read_eda_json(spark: SparkSession, path: str, section: str, schema: T.StructType | str) -> DataFrame:
    """One exported section back as a typed table."""
    raw = spark.read.schema("section string, row string").json(path).where(F.col("section") == section)
    return raw.select(F.from_json("row", schema).alias("r")).select("r.*")


def table_summary(df: DataFrame) -> DataFrame:
    """``(column, dtype, nulls, rows)`` in one aggregate."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(q(c).isNull()).alias(f"z{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"z{i}").alias("nulls"),
                      F.col("_n").alias("rows")) for i, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*cells)))


def preview(df: DataFrame, key: str | list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by ``key`` (Spark plans TakeOrderedAndProject: a per-task top-n, then a merge)."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*[q(k) for k in keys]).limit(n)
