"""Secret scanning with corpus-wide ownership frequency (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, plain_name, plain_names, sized_bytes, stored

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Long unbroken tokens, the candidates of the ownership method.
LONG = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Span kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "live")
MASK = "[SECRET]"

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _spans(text: Column, pattern: str, kind: int, value_group: int, shortest: int) -> Column:
    """Leftmost matches with code point positions, from the lengths of matches and of what lies between.

    Only matches whose ``value_group`` has ``shortest`` characters stay.
    """
    def located(s: Column) -> Column:
        start = F.struct(_none().alias("out"), F.length(F.get(s["gaps"], F.lit(0))).cast("bigint").alias("at"))

        def step(acc: Column, i: Column) -> Column:
            end = acc["at"] + F.length(F.get(s["hits"], i))
            value = F.get(s["values"], i)
            span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
            return F.struct(F.when(F.length(value) >= shortest, F.concat(acc["out"], F.array(span)))
                            .otherwise(acc["out"]).alias("out"),
                            (end + F.length(F.get(s["gaps"], i + 1))).alias("at"))
        n = F.size(s["hits"])
        return F.when(n == 0, _none()).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step)["out"])
    return let(F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("values")), located)


def base_spans(text: Column) -> Column:
    """All assign, access and hex spans, sorted by start, then kind."""
    lower = F.lower(text)
    named = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(lower, F.lit(word))
    found = F.concat(
        F.when(named, _spans(text, ASSIGN, 0, 2, 8)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, 0, 16)).otherwise(_none()),
        F.when(text.rlike(HEX), _spans(text, HEX, 2, 0, 32)).otherwise(_none()))
    return F.sort_array(found)


def long_tokens(text: Column) -> Column:
    """Candidate spans: long tokens with letters, digits and at least ten different characters."""
    found = F.when(text.rlike(LONG), _spans(text, LONG, 3, 0, 20)).otherwise(_none())
    return F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
                    & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 10))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, repositories, owners)`` from ``candidates (hash, repository, owner)``.

    Repeats of one hash in a repository collapse map-side before any shuffle,
    so a widely copied example costs one row per repository.
    """
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    per_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1,
                 max_repositories: int = 2) -> DataFrame:
    """``doc_id, text_md5, base, live``: base spans and owner-specific long tokens of every row.

    A long token is *live* when at most ``max_owners`` owners and
    ``max_repositories`` repositories hold it and no base span covers it; a
    token spread wider is taken as a copied example. Base spans always stay.
    Null text counts as empty, a null owner as an owner. Equal rows give equal
    results, one row each; an empty table gives no rows; other columns are
    ignored. Only documents with candidates take part in the shuffles, with
    their spans, not their texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("text_md5"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"),
        F.to_json(F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(repository_cols)])).alias("repository"),
        base_spans(text).alias("base"), long_tokens(text).alias("long")))
    free = F.filter("long", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    some = found.where(F.size("long") > 0)
    every = some.select("owner", "repository", F.explode("long").alias("s")).select(
        F.sha2("s.value", 256).alias("hash"), "owner", "repository")
    live = ownership(every).where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    spread = (some.select("doc_id", "text_md5", F.explode(free).alias("s")).distinct()
              .withColumn("hash", F.sha2("s.value", 256)).join(live.select("hash"), "hash"))
    lists = stored(spread.groupBy("doc_id", "text_md5").agg(F.sort_array(F.collect_list("s")).alias("live")))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "live")
    return (found.select("doc_id", "text_md5", "base")
            .join(sized_bytes(lists), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")), "left")
            .select("doc_id", "text_md5", "base", F.coalesce("live", _none()).alias("live")))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span that ``find_secrets`` reports replaced by ``[SECRET]``; all rows and columns stay.

    Null and empty texts stay as they are, rows of equal id and text change
    alike, an empty table gives no rows; columns may have any names.
    """
    found = find_secrets(docs, id_col, text_col, **options)
    spans = F.transform(F.sort_array(F.concat("base", "live")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    hit = stored(found.where((F.size("base") > 0) | (F.size("live") > 0))
                 .select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), spans.alias("_spans")).distinct())
    names, id_col, text_col, docs = docs.columns, plain_name(docs, id_col), plain_name(docs, text_col), plain_names(docs)
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.concat(
            s["out"], text.substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(MASK))).otherwise(s["out"])
        return F.struct(piece.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))
    clean = F.aggregate("_spans", start, step, lambda s: F.concat(
        s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text))))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.md5(F.coalesce(text, F.lit("")).cast("binary")) == F.col("_md5"))
    return docs.join(sized_bytes(hit), same, "left").select(
        *[F.when(F.col("_spans").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(c)
          for c in docs.columns]).toDF(*names)
