"""Benchmark decontamination by winnowing, in DataFrame functions only.

Benchmark items are cut into windows of ``WINDOW`` consecutive words (an item of fewer is
one window). A document word inside any occurrence of a window is hit.

1. Winnowing: of the hashes of all ``GRAM``-word runs, each ``SPAN`` consecutive ones keep
   their smallest. As GRAM + SPAN - 1 = WINDOW, texts that share a window share a kept
   hash. Benchmark fingerprints are joined with the documents' distinct ones.
2. Extension: in the documents hit, every run whose hash was hit marks the windows around
   it; these are compared with the benchmark's, word by word, and the matched windows'
   spans are united in one pass over the document.

Items of fewer than WINDOW words get runs of exactly their length (at most WINDOW - 1
lengths), not winnowed, so nothing short is missed either.

The benchmark side of both joins is broadcast while its counted rows are at most
``BROADCAST_ROWS``, and shuffled (adaptive execution splits skewed partitions) beyond it.

Edge cases: null and empty texts have no words and are clean; repeated rows give repeated
results; a document id that is null is a document like any other; with an empty benchmark
nothing is hit; equal items all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text import ascii_lower, gram_hashes, plain_words, text_of, word_hashes

WINDOW, GRAM, SPAN = 13, 5, 9
BROADCAST_ROWS = 200_000
SHARE = 20  # contaminated: SHARE * n_hit >= n_words


def _words(df: DataFrame, *keep: Column) -> DataFrame:
    df = df.select(*keep, plain_words(ascii_lower(text_of("text"))).alias("_words"))
    return df.withColumn("_hashes", word_hashes(F.col("_words"))).withColumn(
        "_n", F.size("_words")
    )


def winnowed(grams: Column, span: int) -> Column:
    """Distinct smallest hashes of each ``span`` consecutive ones (of all, if fewer)."""
    n = F.size(grams)
    mins = F.transform(
        F.sequence(F.lit(1), F.greatest(n - F.lit(span - 1), F.lit(1))),
        lambda i: F.array_min(F.slice(grams, i, F.lit(span))),
    )
    return F.when(n > 0, F.array_distinct(mins)).otherwise(F.array().cast("array<bigint>"))


#: The kind of a winnowed run; a run of a short item's length has that length as its kind.
WINNOWED = 0


def _prints(df: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """``keep, kind, h``: winnowed GRAM-word runs, and all runs of each of ``lengths``."""
    tagged = lambda a, k: F.transform(a, lambda h: F.struct(F.lit(k).alias("kind"), h.alias("h")))
    df = df.withColumn("_grams", gram_hashes(F.col("_hashes"), GRAM))
    sets = [tagged(winnowed(F.col("_grams"), SPAN), WINNOWED)]
    sets += [tagged(F.array_distinct(gram_hashes(F.col("_hashes"), n)), n) for n in lengths]
    return df.select(*keep, F.concat(*sets).alias("_prints"))


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _windows(items: DataFrame) -> DataFrame:
    """``item_id, size, window``: every window of every item, as its joined words."""
    n = F.least(F.col("_n"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.col("_n") - n + 1)
    return (
        items.where(F.col("_n") > 0)
        .select("item_id", n.alias("size"), "_words", F.explode(starts).alias("at"))
        .select("item_id", "size", F.array_join(F.slice("_words", F.col("at"), F.col("size")), " ").alias("window"))
        .distinct()
    )


def _sized_starts(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda a: F.struct(a.alias("at"), F.lit(size).alias("size")))


def _spans(starts: Column) -> Column:
    """Words covered by the union of (start, size) spans, ascending."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["size"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            (acc["total"] + F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("total"),
        )

    return F.aggregate(starts, zero, step, lambda acc: acc["total"])


#: What tells documents apart: their id and two hashes of their text.
KEYS = ("_id", "_k1", "_k2")


def _keyed(docs: DataFrame, *keep) -> DataFrame:
    t = text_of("text")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        F.xxhash64(t).alias("_k1"),
        F.hash(t).alias("_k2"),
        *keep,
    )


def hits(docs: DataFrame, benchmark: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, found)``. A row a document: its keys, ``keep`` and n_words. A row a distinct
    document with a hit: its keys, n_words, n_hit, items (distinct item ids) and full (a
    window of WINDOW words is among the hits).

    Documents are cut into words once; their fingerprints, about a fifth of their words,
    are written to the shared folder.
    """
    items = written(_words(benchmark, F.col("item_id")), "benchmark")
    lengths = sorted(
        r["_n"] for r in items.where((F.col("_n") > 0) & (F.col("_n") < WINDOW)).select("_n").distinct().collect()
    )  # WINDOW - 1 numbers at most
    long = _prints(items.where(F.col("_n") >= WINDOW), []).select(F.inline("_prints"))
    short = _prints(items.where(F.col("_n") < WINDOW), lengths, "_n").select("_n", F.inline("_prints"))
    short = short.where(F.col("kind") == F.col("_n"))
    prints = _sized(written(long.unionByName(short.drop("_n")).distinct(), "prints"))
    keyed = _keyed(docs, "text")
    own = _words(_keyed(docs, "text", *keep), *map(F.col, [*KEYS, *keep]))
    own = written(_prints(own, lengths, *KEYS, *keep, "_n"), "fingerprints")
    hit = own.select(*KEYS, F.inline("_prints")).join(prints, ["kind", "h"]).groupBy(*KEYS)
    hit = hit.agg(F.collect_set(F.struct("kind", "h")).alias("_hit"))
    near = _words(keyed.join(hit, [*KEYS]), *map(F.col, KEYS), F.col("_hit"))
    of = lambda g: F.transform(F.filter("_hit", lambda x: x["kind"] == g), lambda x: x["h"])
    spots = lambda hs, g: F.filter(
        F.transform(gram_hashes(F.col("_hashes"), g), lambda h, i: F.when(F.array_contains(hs, h), i + 1)),
        lambda x: x.isNotNull(),
    )
    near = near.withColumn("_main", of(WINNOWED))
    around = F.flatten(
        F.transform(
            spots(F.col("_main"), GRAM),
            lambda p: F.sequence(
                F.greatest(p - (WINDOW - GRAM), F.lit(1)), F.least(p, F.col("_n") - (WINDOW - 1))
            ),
        )
    )
    starts = F.when(
        (F.col("_n") >= WINDOW) & (F.size("_main") > 0), F.array_distinct(around)
    ).otherwise(F.array().cast("array<int>"))
    sets = [_sized_starts(starts, WINDOW)]
    for n in lengths:
        near = near.withColumn(f"_short{n}", of(n))
        found_at = F.when(F.size(f"_short{n}") > 0, spots(F.col(f"_short{n}"), n))
        found_at = found_at.otherwise(F.array().cast("array<int>"))
        sets.append(_sized_starts(found_at, n))
    cut = near.select(*KEYS, "_n", "_words", F.explode(F.concat(*sets)).alias("s")).select(
        *KEYS, "_n", F.col("s.at").alias("at"), F.col("s.size").alias("size"),
        F.array_join(F.slice("_words", F.col("s.at"), F.col("s.size")), " ").alias("window"),
    )
    windows = _sized(written(_windows(items), "windows"))
    found = (
        cut.join(windows, ["size", "window"])
        .groupBy(*KEYS)
        .agg(
            F.first("_n").cast("long").alias("n_words"),
            F.collect_set(F.struct("at", "size")).alias("_spans"),
            F.collect_set(F.col("item_id").cast("string")).alias("items"),
            F.max(F.col("size") == WINDOW).alias("full"),
        )
        .select(*KEYS, "n_words", _spans(F.array_sort("_spans")).alias("n_hit"), "items", "full")
    )
    return own.select(*KEYS, *keep, F.col("_n").cast("long").alias("n_words")), found


def _contaminated(hit: Column, words: Column) -> Column:
    return (hit > 0) & (hit * SHARE >= words)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row a row of ``docs``."""
    rows, found = hits(docs, benchmark, "doc_id")
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found.drop("n_words", "full"), [*KEYS], "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        _contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak nothing, with the columns they came with.

    One window of WINDOW words is proof of a leak, whatever its share of the text, so no kept
    text holds one. Items of fewer words are phrases that texts may share by chance: their
    hits count by share, as in ``judge``.
    """
    _, found = hits(docs, benchmark)
    leaks = found.where(F.col("full") | _contaminated(F.col("n_hit"), F.col("n_words"))).select(*KEYS)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = _keyed(docs, row).join(leaks, [*KEYS], "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
