"""Multivariate-hypergeometric draws and splitting trees as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, unit_random

_L = "bigint"


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``total`` without replacement, by inverse CDF at ``u``.

    Weights run over the support within 12 standard deviations (plus 20), by
    the exact ratio of neighbouring probabilities; what lies outside is below
    double precision. Integer results always respect the support, so margins
    stay exact.
    """
    def draw(p: Column) -> Column:
        n, k, d, x = p["n"], p["k"], p["d"], p["u"]
        size = F.greatest(n, F.lit(1).cast(_L)).cast("double")
        mean = d * k / size
        spread = F.sqrt(F.greatest(mean * (1 - k / size) * (n - d) / F.greatest(size - 1, F.lit(1.0)), F.lit(0.0)))
        low = F.greatest(d + k - n, F.floor(mean - 12 * spread - 20), F.lit(0).cast(_L))
        high = F.greatest(F.least(k, d, F.ceil(mean + 12 * spread + 20)), low)

        def ratio(i: Column) -> Column:
            return ((k - i).cast("double") * (d - i).cast("double")
                    / ((i + 1).cast("double") * F.greatest(n - k - d + i + 1, F.lit(1).cast(_L)).cast("double")))

        def pick(b: Column) -> Column:
            steps = F.sequence(b["low"], b["high"])
            mass = F.aggregate(
                steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
                lambda s, i: F.struct((s["w"] * ratio(i)).alias("w"), (s["sum"] + s["w"]).alias("sum")))["sum"]
            return let(mass * x, lambda goal: F.aggregate(
                steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), b["low"].alias("at")),
                lambda s, i: F.struct((s["w"] * ratio(i)).alias("w"), (s["sum"] + s["w"]).alias("sum"),
                                      F.when(s["sum"] < goal, i).otherwise(s["at"]).alias("at")))["at"])
        return let(F.struct(low.alias("low"), high.alias("high")), pick)

    return let(F.struct(total.cast(_L).alias("n"), marked.cast(_L).alias("k"), drawn.cast(_L).alias("d"), u.alias("u")),
               draw)


def multivariate(counts: Column, drawn: Column, *seed) -> Column:
    """How many of each kind (``counts``) are among ``drawn`` items: a chain of conditional draws."""
    zero = F.lit(0).cast(_L)
    start = F.struct(F.array().cast("array<bigint>").alias("out"),
                     F.aggregate(counts, zero, lambda a, b: a + b).alias("left"), drawn.cast(_L).alias("d"))

    def step(s: Column, i: Column) -> Column:
        kind = F.get(counts, i)
        return let(hypergeometric(s["left"], kind, s["d"], unit_random(*seed, i)), lambda x: F.struct(
            F.concat(s["out"], F.array(x)).alias("out"), (s["left"] - kind).alias("left"), (s["d"] - x).alias("d")))
    n = F.size(counts)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step)["out"])


def splitting_tree(root: DataFrame, leaves: int, seed: int) -> DataFrame:
    """Split ``root (caps array, counts array)`` down to ``(leaf, counts)``, one row per leaf.

    ``caps`` holds the exact total of every leaf, ``counts`` the exact total
    of every kind (equal sums). Each level halves the leaves of a node and
    draws the left half's kinds, so all margins hold exactly.
    """
    node = root.select(F.lit(0).cast(_L).alias("leaf"), F.col("caps").cast("array<bigint>"),
                       F.col("counts").cast("array<bigint>"))
    levels = max(leaves - 1, 0).bit_length()
    for level in range(levels):
        if level and level % 6 == 0:
            node = node.repartition("leaf")
        n = F.size("caps")
        half = F.ceil(n / 2).cast("int")
        left_caps = F.slice("caps", F.lit(1), half)
        drawn = multivariate(F.col("counts"), F.aggregate(left_caps, F.lit(0).cast(_L), lambda a, b: a + b),
                             seed, F.col("leaf"), n)
        children = let(drawn, lambda x: F.array(
            F.struct(F.col("leaf").alias("leaf"), left_caps.alias("caps"), x.alias("counts")),
            F.struct((F.col("leaf") + half).alias("leaf"),
                     F.slice("caps", half + 1, F.greatest(n - half, F.lit(0))).alias("caps"),
                     F.zip_with("counts", x, lambda a, b: a - b).alias("counts"))))
        same = F.array(F.struct("leaf", "caps", "counts"))
        node = node.select(F.inline(F.when(n > 1, children).otherwise(same)))
    return node.select("leaf", "counts")


def running_totals(values: Column) -> Column:
    """Cumulative sums of a bigint array."""
    return F.aggregate(values, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast(_L).alias("sum")),
                       lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"] + x)).alias("out"),
                                             (s["sum"] + x).alias("sum")))["out"]
