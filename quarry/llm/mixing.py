"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import sized, stored
from quarry.llm.hypergeometric import running_totals, splitting_tree

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Rows that one permuted block aims at.
BLOCK_ROWS = 2_048


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("bigint")


def permuted_key(doc_id: Column, size: Column, text: Column, seed: int) -> Column:
    """Position of a row in its source's random order: an md5 of id, size and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"),
                             F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``rank, weight, target`` to ``sizes (source, source_size, n)``, one row per source.

    Weights repeat along the sources in code point order, null last. A target
    stops at ``max_repeats`` times its source; what is left is shared again by
    weight until none is above. Filling sources by ascending room per weight
    gives that fixed point in one pass.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ranked = ranked.withColumn("pos", F.row_number().over(order))
    everything = Window.partitionBy()
    prior = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything)
                                         - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("full", F.col("weight") * F.col("level") >= F.col("cap"))
    ranked = ranked.withColumn("open_pos", F.min(F.when(~F.col("full"), F.col("pos"))).over(everything))
    ranked = ranked.withColumn("open_level", F.max(F.when(F.col("pos") == F.col("open_pos"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", "n", "rank", "weight",
                         F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("open_level")).alias("target"))


def plan_mix(light: DataFrame, weights: Sequence[float], max_repeats: int, n_shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """What every source gives and where its blocks go, from ``light (source, perm, size)``.

    A source's quota is counted in blocks: all of them in every whole pass, and
    in the last pass the first blocks of a random order, of which the last is
    given in part. Returns ``sources`` (target, whole passes, block count and,
    of the block given in part, ``last``: its last unit given whole, and
    ``torn, torn_rows``: the unit of equal rows of which only some are given)
    and ``blocks (rank, block, edge, places)``, ``places`` being the pass and
    output shard of every draw of the block.
    """
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = source_targets(sizes, weights, max_repeats)
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    plan = (plan.withColumn("passes", F.least(F.floor(ratio), F.lit(max_repeats).cast("bigint")))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
            .withColumn("n_blocks", F.ceil(F.col("n") / F.lit(float(BLOCK_ROWS)))))
    plan = stored(plan)
    keyed = with_source(light, plan).withColumn("block", block_of("perm", "n_blocks"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed + 1)), F.col("rank").cast("string"), F.col("block").cast("string")).cast("binary"))
    before = Window.partitionBy("rank").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = keyed.groupBy("rank", "block", "passes", "rest").agg(F.sum("size").alias("words")).withColumn(
        "first", F.coalesce(F.sum("words").over(before), F.lit(0)))
    whole = (F.col("rest") > 0) & (F.col("first") + F.col("words") <= F.col("rest"))
    edge = (F.col("rest") > 0) & (F.col("first") <= F.col("rest")) & ~whole
    blocks = stored(blocks.withColumns({"whole": whole, "edge": edge}))

    # the block a source's rest ends in: units of equal rows in permuted order, each given in the number nearest to the rest
    ends = blocks.where("edge").select("rank", "block", "first")
    inside = Window.partitionBy("rank").orderBy("perm").rowsBetween(Window.unboundedPreceding, -1)
    units = (keyed.join(sized(stored(ends), 10_000), ["rank", "block"])
             .groupBy("rank", "perm", "first", "rest", "size").agg(F.count(F.lit(1)).alias("m"))
             .withColumn("before", F.col("first") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0))))
    given = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("rest"), F.col("m")).otherwise(0)).otherwise(
        F.greatest(F.lit(0), F.least(F.col("m"), F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5))))
    units = units.withColumn("given", given.cast("bigint"))
    part = F.when((F.col("given") > 0) & (F.col("given") < F.col("m")), F.struct("perm", "given"))
    bound = units.groupBy("rank").agg(F.max(F.when(F.col("given") == F.col("m"), F.col("perm"))).alias("last"),
                                      F.max(part).alias("torn"), F.sum("given").alias("edge_rows"))
    sources = stored(plan.join(bound, "rank", "left").select(
        *plan.columns, "last", F.col("torn.perm").alias("torn"), F.col("torn.given").alias("torn_rows"),
        F.coalesce("edge_rows", F.lit(0)).alias("edge_rows")))

    passes = F.transform(F.sequence(F.lit(1), F.lit(max_repeats)), lambda p: p.cast("bigint"))
    last_pass = F.col("whole") | (F.col("edge") & (F.col("edge_rows") > 0))
    drawn = blocks.join(sized(sources.select("rank", "edge_rows"), 10_000), "rank").select(
        "rank", "block", "edge", F.explode(F.filter(
            passes, lambda p: (p <= F.col("passes")) | ((p == F.col("passes") + 1) & last_pass))).alias("pass"))
    turn = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block", "pass"), "block", "pass")
    drawn = stored(drawn.withColumn("turn", F.row_number().over(turn)))
    quota = plan.select("rank").join(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("q")), "rank", "left")
    root = quota.agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("q", F.lit(0)).alias("q")))).alias("s")).select(
        F.transform("s", lambda x: x["q"]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    caps = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)),
                       lambda s: F.floor(total / n_shards) + F.when(s < total % n_shards, 1).otherwise(0))
    tree = splitting_tree(root.select(caps.alias("caps"), "counts"), n_shards, seed)
    cells = tree.select("leaf", F.posexplode("counts").alias("rank", "c"))
    upto = cells.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("leaf", "c"))).alias("s")).select(
        "rank", running_totals(F.transform("s", lambda x: x["c"])).alias("upto"))
    # a shard draws the next blocks of the source's random order, as many as the tree gave it
    placed = drawn.join(upto, "rank").select(
        "rank", "block", "edge", "pass", F.size(F.filter("upto", lambda c: c < F.col("turn"))).alias("shard")).where(
        F.col("shard") < n_shards)
    places = placed.groupBy("rank", "block", "edge").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("places"))
    return sources, stored(places)


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join the per-source columns; the null source meets its own row."""
    plain = sources.withColumnRenamed("source", "_source")
    return rows.join(sized(plain, 10_000), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def block_of(perm: str, n_blocks: str) -> Column:
    """Blocks are equal ranges of the permuted order."""
    return F.shiftright(F.conv(F.substring(perm, 1, 8), 16, 10).cast("bigint") * F.col(n_blocks), 32)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, n_shards: int = 16,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5,
        keep_row: bool = False) -> DataFrame:
    """Mix sources to target weights; one row per input row.

    Returns ``doc_id, source, size`` (words), ``source_size, target, copies``
    (how often the mix takes the row, 0 to ``max_repeats``) and ``places``, an
    array of ``(pass, shard, order)`` for those copies; with ``keep_row`` also
    the whole input row as struct ``row``. Each source is permuted (md5) and
    cut into blocks; its quota of blocks is split among the shards by a
    hypergeometric tree, each shard draws its part as the next blocks of the
    source's random order and sorts its rows by ``order``. A row is taken where
    its block was drawn; the one block a source gives in part gives the first
    rows of its permuted order, nearest to the target. Texts are never
    shuffled; plans and blocks are keyed tables, broadcast only after a size
    check.

    Null text has size 0, null source is a source of its own (last), null ids
    count as equal. Rows of equal id and text are given one by one: which of
    them is told by their partition and place there, so ``docs`` should be
    read again alike (files or a checkpoint). Source without words: target 0,
    nothing taken. An empty table gives no rows. Other columns may have any
    names.
    """
    text, row = F.col(text_col), [F.struct("*").alias("row")] if keep_row else []
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size")]
    perm = permuted_key(F.col("doc_id"), F.col("size"), F.col("body"), seed)
    light = stored(docs.select(*cols, text.alias("body")).withColumn("perm", perm).drop("body"))
    sources, places = plan_mix(light, weights, max_repeats, n_shards, seed)
    if keep_row:
        rows = docs.select(*cols, text.alias("body"), *row).withColumn("perm", perm).drop("body")
    else:
        rows = light
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    rows = with_source(rows, sources).withColumn("block", block_of("perm", "n_blocks"))
    rows = rows.join(sized(places), ["rank", "block"], "left")
    rows = _number_torn(rows, sources)
    part = ~F.col("edge") | F.coalesce(F.col("perm") <= F.col("last"), F.lit(False)) | F.coalesce(
        (F.col("perm") == F.col("torn")) & (F.col("torn_place") <= F.col("torn_rows")), F.lit(False))
    given = F.filter(F.coalesce("places", F.array().cast("array<struct<pass:bigint,shard:int>>")),
                     lambda p: (p["pass"] <= F.col("passes")) | part)
    order = F.transform(given, lambda p: F.struct(
        p["pass"].alias("pass"), p["shard"].alias("shard"),
        F.xxhash64(F.lit(seed + 2), p["shard"], p["pass"], F.col("perm"), F.col("torn_place")).alias("order")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.size(given).alias("copies"),
                       order.alias("places"), *(["row"] if keep_row else []))


def _number_torn(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``torn_place``: rows of a source's torn unit counted from 1, other rows null.

    Counted per partition first (``at`` holds partition and place), so a unit
    that fills the table never lies in one task.
    """
    if sources.where("torn is not null").isEmpty():
        return rows.withColumn("torn_place", F.lit(None).cast("bigint"))
    mine = F.coalesce(F.col("perm") == F.col("torn"), F.lit(False))
    spot = F.shiftrightunsigned("at", 33)
    per = stored(rows.where(mine).groupBy("rank", spot.alias("spot")).agg(
        F.count(F.lit(1)).alias("here"), F.min("at").alias("lowest")))
    ahead = Window.partitionBy("rank").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("ahead", F.coalesce(F.sum("here").over(ahead), F.lit(0)))
    torn = rows.where(mine).withColumn("spot", spot)
    local = torn.withColumn("place", F.row_number().over(Window.partitionBy("rank", "spot").orderBy("at")))
    local = local.join(sized(stored(per.select("rank", "spot", "ahead")), 100_000), ["rank", "spot"]).withColumn(
        "torn_place", F.col("ahead") + F.col("place")).drop("spot", "place", "ahead")
    return rows.where(~mine).withColumn("torn_place", F.lit(None).cast("bigint")).unionByName(local)
