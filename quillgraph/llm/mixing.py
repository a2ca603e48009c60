"""Mixing sources to target weights by distributed prefix sums, in DataFrame functions.

Sources in code-point order (null last) get the weights 5, 2, 1, repeating, and share 150 %
of all words. A target stops at twice its source's words; what is above is shared anew by
weight, until none is above. That fixed point is found in one pass: in ascending order of
limit per weight, a source is at its limit as long as the level of those not yet at theirs
reaches it.

Documents get a random key (MD5 of seed and id) and are range-sorted by it within their
source: ranges of equal hash space are equal in size, so the bounds need no sample. Sums
of ranges, running over a source's at most ``16 ** DIGITS`` ranges, and running sums inside
each range give every document the words before it. A source takes whole epochs and then
the documents up to its exact budget; the one at the cut is taken in part.

A source of any share of the rows spreads over all ranges. What is shuffled is a few
numbers a document, never a text. Edge cases: null and empty texts have size 0 and nothing
is taken of them; a null source is a source; an empty source or table has target 0; equal
ids tie by size, and rows that tie in both are alike; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import written
from .text import blank_words, text_of

WEIGHTS, PERCENT, LIMIT, DIGITS, SEED = (5, 2, 1), 150, 2, 3, "mix-1"


def sized(docs: DataFrame, *keep) -> DataFrame:
    """``doc_id, source, size`` and the sort key, a row a row of ``docs``."""
    n = F.when(text_of("text") == "", 0).otherwise(F.size(blank_words(text_of("text"))))
    return docs.select(
        "doc_id", "source", n.cast("long").alias("size"),
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().cast("int").alias("_none"),
        F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"))).alias("_sort"), *keep,
    )


def targets(sizes: DataFrame) -> DataFrame:
    """``_none, _source, source_size, target``: a row a source."""
    by = sizes.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy("_none", "_source")
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).cast("double"))
    by = by.withColumn("cap", F.col("source_size").cast("double") * LIMIT)
    every = W.partitionBy()
    rising = W.orderBy(F.col("cap") / F.col("w"), "_none", "_source").rowsBetween(W.unboundedPreceding, -1)
    by = (
        by.withColumn("pool", F.sum("source_size").over(every) * (PERCENT / 100))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("w_before", F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
    )
    full = F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("pool") - F.col("cap_before"))
    by = by.withColumn("full", full)
    left_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    full_cap = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    share = F.col("w") * (F.col("pool") - full_cap) / left_w
    return by.select(
        "_none", "_source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(share).alias("target")
    )


def mix(sizes: DataFrame, *keep: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``keep``, for what ``sized`` wrote."""
    own = ["_none", "_source", "_range"]
    sizes = sizes.withColumn("_range", F.substring("_sort", 1, DIGITS))
    ranges = sizes.groupBy(*own).agg(F.sum("size").alias("in_range"))
    before = W.partitionBy("_none", "_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    goals = targets(sizes)  # a row a source
    ranges = ranges.join(goals, ["_none", "_source"]).drop("in_range")
    inside = W.partitionBy(*own).orderBy("_sort", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.join(ranges, own).withColumn(
        "prior", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.least(rest - F.col("prior"), F.col("size")), F.lit(0))
    return rows.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (epochs * F.col("size") + cut).cast("long").alias("taken"), *keep,
    )


def judge(docs: DataFrame) -> DataFrame:
    return mix(written(sized(docs), "sizes"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of which the mix takes words, with the columns they came with and size,
    source_size, target, taken (which replace columns of those names). Rows of one id and
    text share one verdict."""
    made = ["size", "source_size", "target", "taken"]
    text_key = F.xxhash64(text_of("text"))
    found = mix(written(sized(docs, text_key.alias("_key")), "sizes"), "_key").where("taken > 0")
    found = found.dropDuplicates(["doc_id", "_key"]).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_text"), *made)
    own = [c for c in docs.columns if c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    rows = docs.select(row, F.col("doc_id").alias("_doc"), text_key.alias("_here"))
    rows = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_here") == F.col("_text")))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], *made)
