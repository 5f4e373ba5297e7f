"""Mixing sources to target weights (native).

Every document gets a hash-random key. Within its source the documents are ordered by
that key, a distributed prefix sum of word counts says what lies before each of them,
and the mix takes each source's words up to its exact budget: whole epochs first, then
a last partial one that ends inside one document.

The prefix sum never gathers a source: keys are uniform, so equal key ranges ("buckets"
of about ``BUCKET_ROWS`` documents) are the range partitions. Sums run inside buckets,
then over the totals of buckets in two levels.

Defined cases: null or blank texts have size 0 and are never taken; a null source is a
source of its own, the last in order; rows with equal key, id and size are
interchangeable; an empty table gives an empty result; all input columns are handed on
in the struct ``row``, whatever their names.
"""

from __future__ import annotations

from math import lcm

from framesift.llm.common import text_of
from framesift.session import small_side
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of source, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds 3/2 of all words, and a source at most twice its own.
SHARE = (3, 2)
EPOCHS = 2
SEED = "mix"
BUCKET_ROWS = 512
_GROUP = 4096
_KEY_BITS = 60
_KEY_HIGH_BITS = 30


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 random-looking bits of an id, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source of ``sized(source, size)``: rows, source_size, target, budget.

    ``share`` of all words is spread by weight; what a source's limit of ``epochs`` times
    its size leaves over is spread again until none is above. With the sources in order
    of limit per weight, those at their limit come first, so one running sum finds them.
    All comparisons are between integers. The windows see one row per source.
    """
    up, down = share
    common = lcm(*weights)
    per_source = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = per_source.select(
        "*",
        F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long").alias("weight"),
        (F.col("source_size") * epochs).alias("limit"),
        (F.sum("source_size").over(everything) * up).alias("wanted"),
    )
    by_limit = Window.orderBy(F.expr(f"limit * ({common} div weight)"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    capped = ranked.withColumn("full", (F.col("wanted") - down * before) * F.col("weight") >= down * F.col("limit") * onward)
    left = F.col("wanted") - down * F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))
    weight_left = down * F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    shared = capped.withColumns({"part": F.col("weight") * left, "of": weight_left})
    return shared.select(
        "source", "rows", "source_size",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("part").cast("double") / F.col("of").cast("double")).alias("target"),
        F.when(F.col("full"), F.col("limit")).otherwise(F.expr("part div of")).alias("budget"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: ``row`` (all its columns), ``size, source_size, target, taken``."""
    rows = docs.select(
        F.struct("*").alias("row"), "doc_id", "source",
        word_count(text_of()).alias("size"), random_key(F.col("doc_id"), seed).alias("key"),
    )
    sources = source_targets(rows.select("source", "size"), weights, share, epochs)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = small_side(sources.select("*", F.row_number().over(by_name).alias("source_num"), F.expr(f"1 + rows div {BUCKET_ROWS}").alias("buckets")), "sources")

    placed = rows.join(sources.drop("rows").withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "bucket", F.shiftright(F.shiftright("key", _KEY_BITS - _KEY_HIGH_BITS) * F.col("buckets"), _KEY_HIGH_BITS)
    )
    before = Window.unboundedPreceding, -1
    totals = placed.groupBy("source_num", "bucket").agg(F.sum("size").alias("words")).withColumn("high", F.expr(f"bucket div {_GROUP}"))
    in_group = Window.partitionBy("source_num", "high").orderBy("bucket").rowsBetween(*before)
    groups = totals.groupBy("source_num", "high").agg(F.sum("words").alias("words"))
    over_groups = Window.partitionBy("source_num").orderBy("high").rowsBetween(*before)
    starts = totals.select("source_num", "bucket", "high", F.coalesce(F.sum("words").over(in_group), F.lit(0)).alias("low_start")).join(
        groups.select("source_num", "high", F.coalesce(F.sum("words").over(over_groups), F.lit(0)).alias("high_start")), ["source_num", "high"]
    ).select("source_num", "bucket", (F.col("low_start") + F.col("high_start")).alias("bucket_start"))

    in_bucket = Window.partitionBy("source_num", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(*before)
    prefixed = placed.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(starts, ["source_num", "bucket"])
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - whole * F.col("source_size") - F.col("bucket_start") - F.col("before")
    taken = whole * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return prefixed.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its given word, blanks as they stand."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each copy taken.

    The document in which a budget ends is cut after its last word taken.
    """
    copies = F.expr("concat(array_repeat(size, cast(taken div size as int)), if(taken % size > 0, array(taken % size), array()))")
    taken = mix(docs, **options).filter("taken > 0").select("row", "size", F.explode(copies).alias("words"))
    whole = F.col("words") == F.col("size")
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    text = F.when(whole, columns["text"]).otherwise(first_words(columns["text"], F.col("words")))
    out = columns | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return taken.select(*(c.alias(name) for name, c in out.items()))
