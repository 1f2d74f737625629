"""Parsing strings as timestamps against a declared list of formats.

pandas guesses formats row by row; Spark needs them declared. This list is
our documented deviation; it is mirrored (as strftime patterns) by the DuckDB
oracle so both engines parse exactly the same strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted timestamp formats, Spark pattern and the equivalent strftime pattern.
DATE_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f"),
    ("dd-MM-yyyy", "%d-%m-%Y"),
    ("d MMM yyyy", "%d %b %Y"),
    ("MMM d, yyyy", "%b %d, %Y"),
    ("yyyy-MM", "%Y-%m"),
]
# With a zone: turned to the session's time zone. The oracle's tables hold none of these.
ZONED_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX"]
#: No accepted text is longer.
LONGEST = 40


def parse_ts(c: Column) -> Column:
    """First format that parses the trimmed string, else null; longer texts are not tried."""
    s = F.trim(c.cast("string"))
    s = F.when(F.length(s) <= LONGEST, s)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in [f for f, _ in DATE_FORMATS] + ZONED_FORMATS])
