"""Sources and sinks: CSV tokens and inference, line breaks across splits, path checks, leaderboard upsert."""

import csv
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from quarry.sources import csv_split

from quarry.sources import files as io
from quarry.sources import registry as reg


def test_scan_csv_tokens_and_types(spark, tmp_path):
    rows = [("1", "2.5", "n/a", "true", "x"), ("2", "NA", "7", "False", ""), ("3", "4", "8", "TRUE", "null")]
    path = str(tmp_path / "t.csv")
    spark.createDataFrame(rows, "a string, b string, c string, d string, e string").coalesce(1) \
        .write.option("header", True).csv(path)
    df = io.scan_csv(spark, path)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "bigint", "d": "boolean", "e": "string"}
    got = {r["a"]: r for r in df.collect()}
    assert got[2]["b"] is None and got[1]["c"] is None and got[3]["e"] is None and got[2]["d"] is False


def test_line_quoting_states():
    for line in ['a,b', '', '"a","b"', '5" pipe,x', '"a""b",c', 'x"y"z,"q"', ',,', '"",""', '"a"b,c']:
        assert not csv_split.opens(line), line
    for line in ['a,"b', '"a', '"a"",b', '5" pipe,"x', '"a","b""', ',"']:
        assert csv_split.opens(line), line
    for line in ['a,b', '', 'x""y', '","a', 'end",5" pipe,"more']:
        assert csv_split.stays(line), line
    for line in ['"', 'end"', 'x""y",b', '","a"', '",5" pipe', 'a"b,c']:
        assert not csv_split.stays(line), line


def test_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    parts = ["x", "line\nbreak", 'a "quoted" word', ",", "\r\n", "\n\n", 'tail"', '"', "é", "long " * 40]
    rows = [(str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))), rng.choice(["5 pipe", "", "p\nq" * 30, "z"]))
            for i in range(400)]
    rows.append(("400", "huge\n" * 900, "end"))
    folder = tmp_path / "files.csv"
    folder.mkdir()
    for k in range(2):
        with open(folder / f"f{k}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n" if k else "\r\n")
            out.writerow(["key", "text", "more"])
            out.writerows(rows[k::2])
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in kept:
            spark.conf.set(c, "1500")
        df = io.scan_csv(spark, str(folder), na_tokens=[""])
        assert csv_split.physical_lines(spark, str(folder)).rdd.getNumPartitions() > 20
        got = sorted(((str(r.key), r.text, r.more or "") for r in df.collect()), key=lambda r: int(r[0]))
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert got == rows and dict(df.dtypes)["key"] == "bigint"


def test_csv_reader_stays_strict(spark, tmp_path):
    for name, body in (("plain", "a,b\n1,2\n1,2,3\n"), ("breaks", 'a,b\n1,"x\ny"\n1,2,3\n')):
        (tmp_path / f"{name}.csv").write_text(body)
        with pytest.raises((PySparkException, Py4JJavaError)):
            io.scan_csv(spark, str(tmp_path / f"{name}.csv"), infer=False).collect()
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(io.EmptyInputError):
        io.scan_csv(spark, str(tmp_path / "none.csv"), training=True)


def test_scan_csv_refuses_other_paths(spark, tmp_path):
    with pytest.raises(ValueError):
        io.scan_csv(spark, str(tmp_path / "t.parquet"))


def test_leaderboard_upsert_replaces_run_and_unions_columns(spark, tmp_path):
    path = str(tmp_path / "board")
    assert reg.leaderboard_load(spark, path).count() == 0
    reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "a", {"model": "m1"}, {"r2": 0.5}, "t"))
    reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "b", {"model": "m2"}, {"accuracy": 90.0}, "t"))
    board = reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "a", {"model": "m3"}, {"r2": 0.7}, "t"))
    rows = {r["run_name"]: r for r in board.collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["meta_model"] == "m3" and rows["a"]["r2"] == 0.7
    assert rows["b"]["r2"] is None and rows["b"]["accuracy"] == 90.0


def test_table_summary_and_preview(spark):
    df = spark.createDataFrame([(3, None), (1, "x"), (2, "y")], "k int, s string")
    summ = {r["column"]: r for r in io.table_summary(df).collect()}
    assert summ["s"]["nulls"] == 1 and summ["k"]["rows"] == 3 and summ["k"]["dtype"] == "int"
    assert [r["k"] for r in io.preview(df, "k", 2).collect()] == [1, 2]
