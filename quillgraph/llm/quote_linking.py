"""Quotation linking: conversations in reply order, without their quotes.

1. Lines are cut off their nested quote marks (``>``, ``> >``, ...), whose number is the level;
   a line that only announces the quote below it is part of the quote.
2. Lines are normalised (lower case, runs of anything but letters and digits become one
   space) and hashed. A message's own lines are originals, its quoted ones look for them.
3. A quoted line is linked to the last earlier turn of its conversation that has it as an own
   line, by one running window over the lines of equal hash. Those not found there, if of
   ``MIN_WORDS`` words or more, are linked to the first conversation that has them (one row a
   hash, so nothing multiplies).
4. A message replies to the turn most of its quoted lines come from (the later one, if tied),
   or, quoting none, to the turn before it. Sorting by (turn replied to, turn) puts every
   message after the one it replies to, and replies to one message together.

Column functions only. Windows stream and nothing is gathered but a message's own lines.
Edge cases: a null or empty text has no lines and comes back empty; rows that repeat a
turn are linked alike and numbered one after the other; a null turn comes first; the
first turn replies to none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import text_of

MIN_WORDS = 5
MARKS = r"^(?:[ \t]*>)+"
# How a line announces the quote below it.
INTRO = r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def quote_lines(text: Column) -> Column:
    """Structs (level, body) of the text's lines; level 1 at least for announcing lines."""
    lines = F.split(text, "\n", -1)
    parsed = F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.translate(F.regexp_extract(x, MARKS, 0), " \t", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("body"),
        ),
    )
    n = F.size(lines)
    after = F.concat(F.slice(parsed, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(parsed, n, F.lit(1)))
    return F.zip_with(
        parsed,
        after,
        lambda x, y: F.struct(
            F.when((x["level"] == 0) & (y["level"] > 0) & x["body"].rlike(INTRO), 1).otherwise(x["level"]).alias("level"),
            x["body"].alias("body"),
        ),
    )


def _normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), SEPARATORS, " "))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, reply_turn, quote_depth, n_quoted (lines), n_linked,
    source_conv (the first conversation that lines not found in their own come from),
    clean_text: a row a row of ``messages``."""
    rows = messages.select("conv_id", "turn", "role", quote_lines(text_of("text")).alias("_lines"))
    lines = rows.select("conv_id", "turn", F.inline("_lines")).withColumn("norm", _normal(F.col("body")))
    lines = lines.where("norm != ''").select(
        "conv_id", "turn", (F.col("level") > 0).cast("int").alias("quoted"), F.md5("norm").alias("h"),
        (F.size(F.split("norm", " ")) >= MIN_WORDS).alias("long"),
    )
    # own lines once a turn; quotes stay as they are
    own = lines.where("quoted = 0").distinct()
    quotes = lines.where("quoted = 1")
    earlier = W.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("quoted") == 0, F.col("turn"))).over(earlier)
    found = own.unionByName(quotes).withColumn("source", seen).where("quoted = 1")
    votes = (
        found.where("source is not null").groupBy("conv_id", "turn", "source").agg(F.count("*").alias("n"))
        .groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source"))["source"].alias("_reply"), F.sum("n").alias("n_linked"))
    )
    first = own.where("long").groupBy("h").agg(F.min("conv_id").alias("origin"))
    afar = (
        found.where("source is null and long").join(first, "h").where("origin != conv_id")
        .groupBy("conv_id", "turn").agg(F.min("origin").alias("source_conv"))
    )
    level = F.transform("_lines", lambda x: x["level"])
    mine = F.filter("_lines", lambda x: x["level"] == 0)
    out = rows.select(
        "conv_id", "turn", "role",
        F.coalesce(F.array_max(level), F.lit(0)).cast("long").alias("quote_depth"),
        F.size(F.filter(level, lambda x: x > 0)).cast("long").alias("n_quoted"),
        F.trim(F.array_join(F.transform(mine, lambda x: x["body"]), "\n")).alias("clean_text"),
    )
    for side in (votes, afar):
        side = side.withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
        out = out.join(side, same, "left").drop("_conv", "_turn")
    by_turn = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    out = out.withColumn("reply_turn", F.coalesce("_reply", F.max("turn").over(by_turn)))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("reply_turn"), F.asc_nulls_first("turn"), "clean_text")
    return out.select(
        "conv_id", "turn", "role", (F.row_number().over(order) - 1).cast("long").alias("position"), "reply_turn",
        "quote_depth", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "source_conv", "clean_text",
    )


def conversations(messages: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of (role, text) in reply order. A conversation is one
    row here, so use ``link`` where one may outgrow a task."""
    turns = F.array_sort(F.collect_list(F.struct("position", "role", F.col("clean_text").alias("text"))))
    return link(messages).groupBy("conv_id").agg(
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )
