"""Risk-controlled quality rules (DataFrame operations only).

Cutoffs of a few text statistics are chosen per stratum from a labelled
holdout: a cutoff is used only if an exact binomial test shows that it rejects
at most ``alpha`` of the good documents, all tests sharing ``delta`` by
Bonferroni.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, sized, stored, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Reject where ``score`` (SQL over the base columns) exceeds a cutoff of ``grid``."""

    name: str
    score: str
    grid: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)),
    Rule("dup_lines", "n_dup_lines / greatest(n_words, 1)", (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0)),
    Rule("short_words", "- word_chars / greatest(n_words, 1)", (-5.0, -4.5, -4.0, -3.5, -3.0, -2.0)),
)


def _repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window occurring twice or more.

    Each window is its 64-bit hash and position; sorting brings equal windows
    together without strings.
    """
    n = F.size(w)
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("bigint").alias("i"))))

    def covered(p: Column) -> Column:
        twice = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.lit(0).cast("bigint")
        return F.aggregate(at, F.struct(zero.alias("sum"), zero.alias("end")), lambda s, i: F.struct(
            (s["sum"] + i + 3 - F.greatest(s["end"], i)).alias("sum"), (i + 3).alias("end")))["sum"]
    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(let(windows, covered))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of whole texts.

    A null text counts as empty; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated_words(w).alias("r")))
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), counted.alias("_w"),
        (F.length(text) - F.regexp_count(text, F.lit("[ \\t-\\r]"))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    n, r = F.col("_w.n"), F.col("_w.r")
    return out.select("doc_id", "stratum", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                      r.alias("n_repeat_words"),
                      ((n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).alias("base_failed"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), by exact ratios of neighbouring weights around the mean."""
    mean, spread = n * p, F.sqrt(n * (p * (1 - p)))
    low = F.greatest(F.floor(mean - 12 * spread - 20), F.lit(0).cast("bigint"))
    high = F.least(F.ceil(mean + 12 * spread + 20), n)
    odds = p / (1 - p)
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("all"), F.lit(0.0).alias("le"))
    end = F.aggregate(F.sequence(low, high), start, lambda s, i: F.struct(
        (s["w"] * ((n - i).cast("double") / (i + 1).cast("double") * odds)).alias("w"),
        (s["all"] + s["w"]).alias("all"), (s["le"] + F.when(i <= k, s["w"]).otherwise(0.0)).alias("le")))
    return let(end, lambda e: e["le"] / e["all"])


def controlled_cutoffs(scored: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = 0.05,
                       delta: float = 0.05) -> DataFrame:
    """``(stratum, cut_<rule>...)``: the certified cutoffs, null where none is.

    ``labels (doc_id, quality)`` is split by md5 of the id: one half ranks
    cutoffs (bad documents caught against ten times the good ones lost), the
    other half certifies them. Each rule may lose ``alpha / rules`` of a
    stratum's good documents; a cutoff is certified when the binomial test of
    a higher risk is rejected at ``delta / tests``, tests being all strata,
    rules and grid points.
    """
    risk = alpha / len(rules)
    cells = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(c).alias("cutoff"), (F.expr(r.score) > c).alias("out"))
                      for r in rules for c in r.grid])
    half = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 2
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    seen = (scored.where("not base_failed")
            .join(labels.select("doc_id", "quality").where("doc_id is not null and quality is not null"), "doc_id")
            .select("stratum", "quality", half.alias("half"), F.inline(cells)))

    def count(*conditions: Column) -> Column:
        every = conditions[0]
        for c in conditions[1:]:
            every = every & c
        return F.count_if(every)
    rank, test = F.col("half") == 0, F.col("half") == 1
    table = stored(seen.groupBy("stratum", "rule", "cutoff").agg(
        count(test, good).alias("n"), count(test, good, F.col("out")).alias("k"),
        count(rank, good).alias("rank_good"), count(rank, good, F.col("out")).alias("lost"),
        count(rank, bad).alias("rank_bad"), count(rank, bad, F.col("out")).alias("caught")))
    tests = max(table.count(), 1)
    certified = (table.where((F.col("k") <= F.col("n") * risk) & (F.col("n") > 0))
                 .where(binomial_cdf(F.col("k"), F.col("n"), risk) <= delta / tests)
                 .where("caught > 0 and caught * rank_good > 5 * lost * rank_bad"))
    best = certified.groupBy("stratum", "rule").agg(
        F.max_by("cutoff", F.struct(F.col("caught") - 10 * F.col("lost"), "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}")
                                         for r in rules])


def quality_verdicts(docs: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = 0.05,
                     delta: float = 0.05, **columns: str) -> DataFrame:
    """Base statistics, ``base_failed`` and ``kept`` per row.

    Kept are rows that pass the base rules and exceed no certified cutoff of
    their stratum (null is a stratum). Without labels nothing is certified and
    only the base rules reject. Rows of equal id are judged one by one; an
    empty table gives no rows.
    """
    scored = stored(base_statistics(docs, **columns))
    cutoffs = stored(controlled_cutoffs(scored, labels, rules, alpha, delta)).withColumnRenamed("stratum", "_stratum")
    over = F.lit(False)
    for r in rules:
        over = over | F.coalesce(F.expr(r.score) > F.col(f"cut_{r.name}"), F.lit(False))
    joined = scored.join(sized(cutoffs), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~over).alias("kept"))
