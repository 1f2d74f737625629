"""CSV files whose quoted fields hold line breaks, read by many tasks.

A task that starts in the middle of a file cannot tell whether it starts inside
a quoted field. So the lines are read twice. First every split works out how
its lines leave the quoting state, for both states it may be entered in; the
states of a file's splits are then chained in order (one pair of flags per
split). The second pass starts each split in its true state and puts physical
lines together into records. A record that crosses splits leaves one fragment
in each, and the fragments are joined by file and place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import ship_package

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
#: A line, entered at the start of a record, that ends inside a quoted field; and one entered inside a quoted field.
#: Quotes after the first sign of an unquoted field are ordinary signs.
_FIELD = rf'(?:{_QUOTED}"[^,]*+|[^",][^,]*+|)'
OPENS = re.compile(rf'(?:{_FIELD},)*+{_QUOTED}')
STAYS = re.compile(rf'[^"]*+(?:""[^"]*+)*+(?:"[^,]*+,(?:{_FIELD},)*+{_QUOTED})?+')


def opens(line: str) -> bool:
    """Whether a line entered outside quotes ends inside them."""
    return '"' in line and OPENS.fullmatch(line) is not None


def stays(line: str) -> bool:
    """Whether a line entered inside quotes ends inside them."""
    return '"' not in line or STAYS.fullmatch(line) is not None


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line)``: lines as cut at line feeds, with the split they start in."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Consecutive lines of one split, batch by batch."""
    for b in batches:
        files, blocks, lines = (c.to_pylist() for c in b.columns)
        start = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or blocks[i] != blocks[start] or files[i] != files[start]:
                yield (files[start], blocks[start]), lines[start:i]
                start = i


def split_states(lines: DataFrame) -> DataFrame:
    """Per split ``file, block, from_outside, from_inside`` (inside quotes at its end, by entry) and ``breaks`` (a line
    entered outside ends inside)."""
    def run(batches):
        now, state, broken = None, None, False

        def row():
            return pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "from_outside": [state[0]],
                                               "from_inside": [state[1]], "breaks": [broken]})
        for key, part in _runs(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, state, broken = key, [False, True], False
            for line in part:
                o, s = (opens(line), stays(line)) if '"' in line else (False, True)
                broken |= o
                state = [s if inside else o for inside in state]
        if now is not None:
            yield row()
    ship_package(lines.sparkSession)
    return lines.mapInArrow(run, "file string, block long, from_outside boolean, from_inside boolean, breaks boolean")


def inside_starts(states: list) -> set[tuple[str, int]]:
    """Splits that start inside quotes: the states of each file's splits, chained in order."""
    out, last, inside = set(), None, False
    for r in sorted(states, key=lambda r: (r["file"], r["block"])):
        if r["file"] != last:
            last, inside = r["file"], False
        if inside:
            out.add((r["file"], r["block"]))
        inside = r["from_inside"] if inside else r["from_outside"]
    return out


def records(lines: DataFrame, starts: set[tuple[str, int]]) -> DataFrame:
    """``(text, first)``: whole records; ``first`` marks the first record of a file."""
    def run(batches):
        now, inside, held, lead, first = None, False, [], False, False

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], names=["file", "block", "kind", "text", "first"])
        for key, part in _runs(batches):
            rows = []
            if key != now:
                if held:
                    rows.append((*now, 1 if lead else 2, "\n".join(held), first))
                now, inside, held = key, key in starts, []
                lead, first = inside, key[1] == 0 and not inside
            for line in part:
                held.append(line)
                inside = stays(line) if inside else opens(line)
                if not inside:
                    rows.append((*now, 1 if lead else 0, "\n".join(held), first))
                    held, lead, first = [], False, False
            if rows:
                yield batch(rows)
        if held:
            yield batch([(*now, 1 if lead else 2, "\n".join(held), first)])

    ship_package(lines.sparkSession)
    parts = lines.mapInArrow(run, "file string, block long, kind int, text string, first boolean")
    # kinds: 0 whole record, 1 continues a record of an earlier split, 2 opens one
    w = Window.partitionBy("file").orderBy("block", "kind")
    torn = parts.where("kind > 0").withColumn("record", F.sum((F.col("kind") == 2).cast("int")).over(w))
    joined = torn.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"), F.bool_or("first").alias("first"))
    joined = joined.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "first")
    return parts.where("kind = 0").select("text", "first").unionByName(joined)


def read_split(spark: SparkSession, path: str, types: list[str], options: dict) -> DataFrame | None:
    """Columns ``c0..`` of the given types, or None if no record holds a line break (a plain split read is right then).

    The state of every split (two flags) passes through the driver, as the
    list of splits itself does; only splits that start inside quotes go back.
    """
    lines = physical_lines(spark, path)
    if lines.where(F.col("line").contains('"')).isEmpty():
        return None
    states = split_states(lines).collect()
    if not any(r["breaks"] for r in states):
        return None
    every = records(lines, inside_starts(states))
    text = F.regexp_replace("text", "\r$", "")
    ddl = ", ".join(f"c{i} {t}" for i, t in enumerate(types))
    rows = every.where(~F.col("first")).select(text.alias("text")).where("text <> ''")
    keep = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    return rows.select(F.from_csv("text", ddl, {**keep, "mode": "FAILFAST", "multiLine": "true"}).alias("r")).select("r.*")
