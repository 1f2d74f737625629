"""Exactness and recovery: CSV round trips, date formats, typed modes, board safety, repeated keys."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quarry.functions.dates import parse_ts
from quarry.functions.frames import value_counts
from quarry.operators import clean
from quarry.operators.features import engineer_features
from quarry.sources import files as io
from quarry.sources import registry as reg


def test_csv_quotes_breaks_and_spaces_come_back(spark, tmp_path):
    texts = ['he said "hi", ok', "two\nlines", " lead and trail ", 'a\\', '"', "tab\there", "win\r\nbreak", "x,y"]
    path = str(tmp_path / "t.csv")
    io.sink_csv(spark.createDataFrame(list(enumerate(texts)), "i long, s string").repartition(3), path)
    assert [r["s"] for r in io.scan_csv(spark, path).orderBy("i").collect()] == texts
    plain = tmp_path / "p.csv"
    plain.write_text('i,s\n1,"he said ""hi"", ok"\n2,"a\nb"\n')
    assert [tuple(r) for r in io.scan_csv(spark, str(plain)).orderBy("i").collect()] == [(1, 'he said "hi", ok'), (2, "a\nb")]


def test_documents_survive_csv(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text <> ''")
    path = str(tmp_path / "d.csv")
    io.sink_csv(docs, path)
    back = io.scan_csv(spark, path, schema=docs.schema, na_tokens=[""])
    assert docs.exceptAll(back).count() == 0 and back.exceptAll(docs).count() == 0


@pytest.mark.parametrize("text, want", [
    ("2024-01-01 00:00:00.123", dt.datetime(2024, 1, 1, 0, 0, 0, 123000)), ("2024-01-15T10:00:00Z", dt.datetime(2024, 1, 15, 10)),
    ("2024-01-15T10:00:00+02:00", dt.datetime(2024, 1, 15, 8)), ("15 Jan 2024", dt.datetime(2024, 1, 15)),
    ("15-01-2024", dt.datetime(2024, 1, 15)), ("2024-01", dt.datetime(2024, 1, 1)), ("Jan 15, 2024", dt.datetime(2024, 1, 15)),
    ("2024-01-15", dt.datetime(2024, 1, 15)), ("nothing", None), ("x" * 100, None), (None, None)])
def test_date_formats(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(parse_ts(F.col("s")).cast("timestamp_ntz").alias("t")).first()["t"]
    assert got == want


def test_mode_fill_keeps_all_digits(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big,), (big,), (1,), (None,)], "v long")
    assert clean.fill_mode(df, "v").where(F.col("v") == big).count() == 3
    out = clean.apply_cleaning(df, {"missing": {"v": {"action": "fill_mode"}}}).data
    assert out.where(F.col("v") == big).count() == 3


def test_fractions_of_seconds_are_distinct_values(spark):
    df = spark.range(40).select((F.timestamp_seconds(F.col("id") / 10)).alias("t"))
    assert value_counts(df).count() == 40


def test_frequent_other_and_merged_rare_values_are_one(spark):
    rows = [(i, "Other" if i else "rare", i % 7 + 0.5, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, x double, y int")
    assert "c" in engineer_features(df, "y").removed


def test_damaged_board_is_an_error_and_stays(spark, tmp_path):
    path = str(tmp_path / "board")
    reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "a", {"model": "m"}, {"r2": 0.5}, "t"))
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")]
    for f in files:
        with open(f, "wb") as out:
            out.write(b"damaged")
    for f in os.listdir(path):
        if f.endswith(".crc"):
            os.remove(os.path.join(path, f))
    with pytest.raises(Exception):
        reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "b", {"model": "m"}, {"r2": 0.6}, "t")).count()
    assert all(open(f, "rb").read() == b"damaged" for f in files)


def test_board_set_aside_is_read(spark, tmp_path):
    path = str(tmp_path / "board")
    reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "a", {"model": "m"}, {"r2": 0.5}, "t"))
    os.rename(path, path + ".previous")
    board = reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "b", {"model": "m"}, {"r2": 0.6}, "t"))
    assert {r["run_name"] for r in board.collect()} == {"a", "b"}
