"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import sized, stored
from quarry.llm.hypergeometric import running_totals, splitting_tree

#: Rows that one permuting task aims at.
BLOCK_ROWS = 8_192


def _blocks(rows: int) -> int:
    return 1 << max(0, -(-rows // BLOCK_ROWS) - 1).bit_length()


def communication_matrix(blocks: DataFrame, n_blocks: int, n_shards: int, seed: int) -> DataFrame:
    """``(block, upto)`` from ``blocks (block, n)``: running row counts of the block towards each shard.

    The counts are one draw of the matrix that a uniform permutation of all
    rows would give: rows sum to block sizes, columns to shard sizes that
    differ by one at most.
    """
    spark = blocks.sparkSession
    caps = (spark.range(n_blocks).withColumnRenamed("id", "block").join(blocks, "block", "left")
            .agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).alias("n")))).alias("b"))
            .select(F.transform("b", lambda x: x["n"]).alias("caps")))
    total = F.aggregate("caps", F.lit(0).cast("bigint"), lambda a, b: a + b)
    share = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)),
                        lambda s: F.floor(total / n_shards) + F.when(s < total % n_shards, 1).otherwise(0))
    tree = splitting_tree(caps.select("caps", share.alias("counts")), n_blocks, seed)
    return tree.select(F.col("leaf").alias("block"), running_totals(F.col("counts")).alias("upto"))


def shard_rows(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
               seed: int = 11) -> DataFrame:
    """Deal all rows into ``n_shards`` shards whose row counts differ by one at most, uniformly at random.

    Returns ``(doc_id, size, text_crc32, shard, slot)``: one row per input row,
    slots gapless from 0 in each shard; ``size`` is UTF-8 bytes plus 16.
    Rows fall into blocks by a hash, are permuted there, sent out in the exact
    counts of the communication matrix, then permuted within the shard. Only
    ids, sizes and checksums are shuffled, never texts.

    Null text counts as empty, a null id is an id like others. Equal rows are
    separate rows; which of them gets which slot is immaterial. An empty
    table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = stored(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"),
                               F.crc32(text.cast("binary")).alias("text_crc32")))
    rows = light.count()
    n_blocks, n_parts = _blocks(rows), _blocks(-(-rows // n_shards))
    what = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"), F.col("size")]

    def key(i: int):
        return F.xxhash64(F.lit(seed * 8 + i), *what)
    light = light.withColumn("block", F.pmod(key(0), F.lit(n_blocks)))
    matrix = stored(communication_matrix(light.groupBy("block").agg(F.count(F.lit(1)).alias("n")), n_blocks, n_shards, seed))
    first = Window.partitionBy("block").orderBy(key(1), *what)
    sent = (light.withColumn("rank", F.row_number().over(first)).join(matrix, "block")
            .select("doc_id", "size", "text_crc32",
                    F.size(F.filter("upto", lambda c: c < F.col("rank"))).alias("shard"),
                    F.pmod(key(2), F.lit(n_parts)).alias("part")))
    sent = stored(sent)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sent.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
                     .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    second = Window.partitionBy("shard", "part").orderBy(key(3), *what)
    return (sent.withColumn("rank", F.row_number().over(second)).join(sized(offsets), ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("first") + F.col("rank") - 1).cast("bigint").alias("slot")))
