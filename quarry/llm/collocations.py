"""Phrase collocations of two and three words by best-first branch and bound.

A phrase grows from its prefix, and its score ``min over cuts a*a / (l*r)``
cannot exceed ``f(prefix) / f(first word)``: the phrase occurs at most as often
as its prefix, and the cut after the first word alone has a right part at least
as frequent as the phrase. So

1. words are counted; a word below the least count grows no phrase;
2. pairs of the words left are counted (both words pass a hash filter); a pair
   below the least count is no prefix;
3. per language a score floor is set, best pairs first, and only pairs whose
   bound reaches it are opened: the texts are read once more and the three-word
   extensions of opened pairs, on either side, are counted.

Every candidate at or above the floor is then known with all its extensions,
so it is known whether it survives. A language is settled when at least
``limit`` survivors reach its floor (ties at the floor are among them) or the
floor is zero; while one is not, its floor goes down and step 3 repeats.

Counts are exact: words are compared as strings, and filters can only open too
much. Partial counts are summed per chunk of text before the shuffle, so a word
or language that fills the corpus arrives as few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, sized_bytes, stored
from quarry.llm.wordcounts import HashFilter, Tokens, combined, count_chunks, hash_filter

SEPARATORS, BREAKS = b" \t.,;:!?\n\x0b\x0c\r", b".,;:!?\n\x0b\x0c\r"
LIMIT, MIN_COUNT, COVERED_PERCENT, SCALE = 2000, 10, 50, 1_000_000
#: Language of documents without one.
NO_LANG = "und"


def _quotient(a: Column, left: Column, right: Column) -> Column:
    """``floor(SCALE * a * a / (left * right))`` in exact decimals (38 digits: counts up to 10^15)."""
    big = a.cast("decimal(18,0)")
    over, under = F.lit(SCALE) * (big * big), left.cast("decimal(18,0)") * right.cast("decimal(18,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), under.cast("decimal(38,0)")).cast("long")


def _count_words(docs: DataFrame) -> DataFrame:
    """``(lang, w1, f)``; the row without a word holds the language's number of words."""
    def count(chunk: pa.Table) -> pa.RecordBatch:
        t = Tokens(chunk.column("text"), chunk.column("lang"), SEPARATORS, BREAKS)
        kinds = np.arange(len(t.kind_word))
        n = np.bincount(t.kind, minlength=len(kinds))
        totals = np.bincount(t.kind_group[t.kind], minlength=len(t.groups))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([t.group_of(kinds), t.groups.cast(pa.string())]),
             pa.concat_arrays([t.word_of(kinds), pa.nulls(len(totals), pa.string())]),
             pa.array(np.concatenate([n, totals]).astype(np.int64))], names=["lang", "w1", "n"])
    return count_chunks(docs, 1, count, "lang string, w1 string, n long").groupBy("lang", "w1").agg(
        F.sum("n").alias("f"))


def _pair_kinds(t: Tokens, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the second words of allowed pairs, the distinct pairs and each position's pair."""
    at = np.flatnonzero(t.joined)
    at = at[allowed[t.kind[at]] & allowed[t.kind[at - 1]]]
    keys, pair = np.unique(t.kind[at - 1] * max(len(allowed), 1) + t.kind[at], return_inverse=True)
    return at, keys, pair


def _count_pairs(docs: DataFrame, words: HashFilter) -> DataFrame:
    def count(chunk: pa.Table) -> pa.RecordBatch:
        t = Tokens(chunk.column("text"), chunk.column("lang"), SEPARATORS, BREAKS)
        lang, word = t.kind_hashes()
        allowed = words.passes(combined([lang, word]))
        _, keys, pair = _pair_kinds(t, allowed)
        first, second = np.divmod(keys, max(len(allowed), 1))
        n = np.bincount(pair, minlength=len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([t.group_of(first), t.word_of(first), t.word_of(second), pa.array(n)],
                                          names=["lang", "w1", "w2", "n"])
    return count_chunks(docs, 1, count, "lang string, w1 string, w2 string, n long").groupBy("lang", "w1", "w2").agg(
        F.sum("n").alias("f"))


def _count_triples(docs: DataFrame, words: HashFilter, pairs: HashFilter, opened: HashFilter) -> DataFrame:
    """Counts of three-word phrases with an opened pair at either end (both pairs frequent)."""
    def count(chunk: pa.Table) -> pa.RecordBatch:
        t = Tokens(chunk.column("text"), chunk.column("lang"), SEPARATORS, BREAKS)
        lang, word = t.kind_hashes()
        allowed = words.passes(combined([lang, word]))
        at, keys, pair = _pair_kinds(t, allowed)
        first, second = np.divmod(keys, max(len(allowed), 1))
        hashes = combined([lang[first], word[first], word[second]])
        frequent, wanted = pairs.passes(hashes), opened.passes(hashes)
        # entry i of ``at`` ends one pair; entry i + 1 ends the next when their positions are adjacent
        i = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else np.zeros(0, np.int64)
        left, right = pair[i], pair[i + 1]
        keep = frequent[left] & frequent[right] & (wanted[left] | wanted[right])
        triple, n = np.unique(left[keep] * max(len(allowed), 1) + second[right[keep]], return_counts=True)
        left, last = np.divmod(triple, max(len(allowed), 1))
        return pa.RecordBatch.from_arrays(
            [t.group_of(last), t.word_of(first[left]), t.word_of(second[left]), t.word_of(last),
             pa.array(n.astype(np.int64))], names=["lang", "w1", "w2", "w3", "n"])
    return count_chunks(docs, 1, count, "lang string, w1 string, w2 string, w3 string, n long").groupBy(
        "lang", "w1", "w2", "w3").agg(F.sum("n").alias("f"))


def _boundary(counts: DataFrame, value: str, rank: int) -> DataFrame:
    """Per language the largest ``value`` with ``rank`` rows or more at or above it, and the rows above it.

    ``counts (lang, value, n)`` holds at most about 1,000 rows a language.
    """
    w = Window.partitionBy("lang").orderBy(F.col(value).desc())
    upto = counts.withColumn("upto", F.sum("n").over(w))
    return upto.where(F.col("upto") >= rank).groupBy("lang").agg(
        F.max_by(F.struct(F.col(value).alias("edge"), (F.col("upto") - F.col("n")).alias("above")), value).alias("e")).select(
        "lang", "e.edge", "e.above")


def _floors(pairs: DataFrame, rank: int) -> DataFrame:
    """Per language the score of its ``rank``-th best pair; 0 if it has fewer.

    Scores are counted, first by thousands, then one by one in the thousand
    where the rank falls: no task holds a language's pairs.
    """
    coarse = F.floor(F.col("score") / 1000)
    thousand = _boundary(pairs.groupBy("lang", coarse.alias("k")).agg(F.count(F.lit(1)).alias("n")), "k", rank)
    inside = pairs.join(F.broadcast(thousand), "lang").where(coarse == F.col("edge"))
    exact = inside.groupBy("lang", "above", "score").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("score").desc())
    exact = exact.withColumn("upto", F.col("above") + F.sum("n").over(w)).where(F.col("upto") >= rank).groupBy("lang").agg(
        F.max("score").alias("floor"))
    return pairs.select("lang").distinct().join(F.broadcast(exact), "lang", "left").select(
        "lang", F.coalesce("floor", F.lit(0)).alias("floor"))


#: Parts of a language that are ranked on their own before the language is.
RANK_PARTS = 32


def _best(known: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best phrases per language, in two steps: no task ranks more than ``RANK_PARTS * limit`` of them."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = known.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= limit)


def mine_collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", limit: int = LIMIT,
                      min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT,
                      first_rank: int | None = None) -> DataFrame:
    """The ``limit`` best phrases of two or three words per language: ``lang, rank, phrase, a, l, r, n, score``.

    Text is lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces,
    pieces at spaces and tabs into words; phrases lie within pieces. ``a`` is a
    phrase's count, ``l`` and ``r`` the counts of the parts of its lowest-scoring
    cut, ``n`` the language's words. A phrase is dropped if a longer candidate
    around it has ``100 * f >= covered_percent * a``. Null texts have no words,
    a null language is ``und``; repeated rows count again; ties in score go by
    ``a``, then by phrase in byte order. Empty tables and languages without a
    candidate give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"),
                       docs[text_col].alias("text"))
    counted = stored(_count_words(docs).where(F.col("w1").isNull() | (F.col("f") >= min_count)))
    words, totals = counted.where("w1 is not null"), counted.where("w1 is null").select("lang", F.col("f").alias("n"))
    word_filter = hash_filter(words, ["lang", "w1"], words.count())

    single = sized_bytes(words)
    pairs = _count_pairs(docs, word_filter).where(F.col("f") >= min_count)
    pairs = pairs.join(single.select("lang", "w1", F.col("f").alias("f1")), ["lang", "w1"]).join(
        single.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f2")), ["lang", "w2"])
    pairs = stored(pairs.withColumns({"score": _quotient(F.col("f"), F.col("f1"), F.col("f2")),
                                      "bound": _quotient(F.col("f"), F.col("f"), F.col("f1"))}))
    n_pairs = pairs.count()
    pair_filter = hash_filter(pairs, ["lang", "w1", "w2"], n_pairs)

    rank = first_rank or 2 * limit
    while True:
        floors = stored(_floors(pairs, rank))
        frontier = pairs.join(sized_bytes(floors), "lang").where(F.col("bound") >= F.col("floor"))
        opened = hash_filter(frontier, ["lang", "w1", "w2"], frontier.count())
        triples = stored(_count_triples(docs, word_filter, pair_filter, opened).where(F.col("f") >= min_count))
        known = stored(_survivors(pairs, triples, floors, covered_percent))
        short = floors.where("floor > 0").join(
            known.groupBy("lang").agg(F.count(F.lit(1)).alias("m")), "lang", "left").where(
            F.coalesce("m", F.lit(0)) < limit)
        if short.isEmpty():
            break
        rank *= 4

    top = _best(known, limit)
    return top.join(sized_bytes(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
                                                        "l", "r", "n", "score")


def _survivors(pairs: DataFrame, triples: DataFrame, floors: DataFrame, covered_percent: int) -> DataFrame:
    """Candidates at or above their language's floor that no longer candidate covers."""
    ends = triples.select("lang", "w1", "w2", "f").union(triples.select("lang", "w2", "w3", "f"))
    around = ends.groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
    two = pairs.join(sized_bytes(floors), "lang").where(F.col("score") >= F.col("floor")).join(
        around, ["lang", "w1", "w2"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("f")))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"),
                     F.col("f1").alias("l"), F.col("f2").alias("r"), "score")

    head = pairs.select("lang", "w1", "w2", F.col("f").alias("head"), "f1")
    rest = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("rest"),
                        F.col("f2").alias("f3"))
    three = triples.join(head, ["lang", "w1", "w2"]).join(rest, ["lang", "w2", "w3"])
    three = three.withColumns({"s1": _quotient(F.col("f"), F.col("f1"), F.col("rest")),
                               "s2": _quotient(F.col("f"), F.col("head"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
                         F.when(early, F.col("f1")).otherwise(F.col("head")).alias("l"),
                         F.when(early, F.col("rest")).otherwise(F.col("f3")).alias("r"),
                         F.least("s1", "s2").alias("score"))
    return two.union(three.join(sized_bytes(floors), "lang").where(F.col("score") >= F.col("floor")).drop("floor"))
