"""License scan: an exact containment join of text blocks with license templates, natively.

Base: every place where a phrase's words stand consecutively. Beside it, a text block that
holds at least ``THRESHOLD`` of a template's distinct words, those that tell it from its kin
among them, gets its label. A template's blocks are all runs of consecutive words, over line
breaks, of ``SLACK`` times its length.

* tokens of the templates are ordered by how many documents hold them, rarest first (one
  counting pass over all documents; ties by the token itself);
* prefix filter: a block that reaches ``need`` of a template's ``n`` tokens holds one of its
  ``n - need + 1`` rarest. Pieces of documents that hold such a token are joined with the
  templates' inverted index, a row a prefix token and template;
* length filter: the piece holds ``need`` of the template's tokens at all;
* positional filter: those behind the first common token, in the template and in the
  piece, suffice with it;
* what passes is verified block by block, so no block is missed and none added.

Documents are measured where they stand; only the words of those with a prefix token are
written on, in pieces of ``PIECE`` words that reach over their end by one block, so a
document of any length makes rows of bounded size. Nothing is shuffled but token counts
and labels; the index is as long as a fifth of the templates and is broadcast. Edge cases: null and empty texts have no words, no
labels and score 0; rows are told apart by a number, so repeated rows are scanned one by
one; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .text import ascii_lower, plain_words, text_of

# Phrases of the base rule.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
# Label, the words that set it apart from its kin (-word: that it must not have),
# and the notice or license text as it is commonly written, in lower case and without marks.
TEMPLATES = [
    ("gpl-2.0", "general 2 -lesser -library -affero", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "general 3 -lesser -affero", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "general 2 -lesser -library -affero", """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 2 of the license or at your option any later version"""),
    ("gpl-3.0", "general 3 -lesser -affero", """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 3 of the license or at your option any later version"""),
    ("gpl-no-warranty", "general", """this program is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""),
    ("lgpl-2.1", "lesser 2 1", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3.0", "lesser 3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3.0", "affero 3", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache 2 compliance", """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www apache org licenses license 2 0"""),
    ("mit", "mit", "released under the mit license"),
    ("mit", "mit", "licensed under the mit license"),
    ("mit", "granted charge sublicense", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"""),
    ("bsd", "bsd", "released under the bsd license"),
    ("bsd", "redistribution binary", """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer"""),
    ("isc", "granted fee", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies"""),
    ("mpl-2.0", "mozilla 2", "subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "eclipse 2", "made available under the terms of the eclipse public license 2 0"),
    ("boost-1.0", "boost 1", "distributed under the boost software license version 1 0"),
    ("cc-by-4.0", "cc by 4 -nc -sa -nd", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 -sa -nd", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 -nc", "licensed under cc by sa 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 -nc", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "commons attribution 4 -noncommercial -sharealike -noderivatives", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0-1.0", "cc0", "released into the public domain under cc0 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("warranty-disclaimer", "warranty merchantability", """the software is provided as is without warranty of any kind express or implied including but not limited
        to the warranties of merchantability fitness for a particular purpose and noninfringement"""),
    ("reserved", "all rights reserved", "all rights reserved"),
]
THRESHOLD, SLACK, PIECE = 0.8, 1.25, 512


def need_of(size: int) -> int:
    """Fewest of ``size`` distinct tokens that reach the threshold."""
    return math.ceil(size * THRESHOLD - 1e-9)


def templates() -> list[dict]:
    """Of each template its number, label, distinct tokens, the tokens it must and must not have,
    how many are needed, and the length of its blocks."""
    out = []
    for i, (label, must, text) in enumerate(TEMPLATES):
        words = text.split()
        own = sorted(set(words))
        out.append({"t": i, "label": label, "own": own, "must": [w for w in must.split() if w[0] != "-"], "bars": [w[1:] for w in must.split() if w[0] == "-"], "need": need_of(len(own)), "span": math.ceil(len(words) * SLACK)})
    return out


def token_ranks(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template token, rarest first, by how many of all documents hold it.

    What comes to the driver has a row a template token at most.
    """
    words = plain_words(ascii_lower(text_of("text")))
    held = F.array_distinct(F.filter(words, lambda w: w.isin(vocabulary)))
    found = docs.select(F.explode(held).alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}


def inverted_index(spark: SparkSession, ranks: dict[str, int]) -> DataFrame:
    """``token, at, t, label, own, must, bars, need, span``: a row a prefix token and template; ``own`` is
    in order of rank and ``at`` is the token's place in it, from 0."""
    rows = []
    for x in templates():
        own = sorted(x["own"], key=ranks.get)
        rows += [(own[i], i, x["t"], x["label"], own, x["must"], x["bars"], x["need"], x["span"]) for i in range(len(own) - x["need"] + 1)]
    # a fifth of the templates' words, all spelt out above: small enough to broadcast
    return F.broadcast(spark.createDataFrame(rows, "token string, at int, t int, label string, own array<string>, must array<string>, bars array<string>, need int, span int"))


def _phrase_columns(norm: Column, words_in) -> dict[str, tuple[Column, Column, Column]]:
    """For each label: places, first start and last start. ``norm`` has each word between
    two spaces of its own, so that neighbouring places share nothing."""
    out = {}
    for label, phrase in PHRASES.items():
        parts = phrase.split(" ")
        pieces = F.split(norm, " " + "  ".join(parts) + " ", -1)
        hit = F.contains(norm, F.lit(" " + "  ".join(parts) + " "))
        places = F.when(hit, F.size(pieces) - 1).otherwise(0)
        first = F.when(hit, words_in(F.element_at(pieces, 1)))
        last = F.when(hit, F.col("_n") - words_in(F.element_at(pieces, -1)) - len(parts))
        out[label] = places, first, last
    return out


def pieces(words: DataFrame, rare: list[str]) -> DataFrame:
    """``row, part``: of ``words (row, words)``, the pieces of ``PIECE`` words, each with what a block
    that starts in it may reach into the next, that hold a prefix token."""
    reach = max(x["span"] for x in templates()) - 1
    cut = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(PIECE)), lambda s: F.slice("words", s, F.lit(PIECE + reach)))
    return words.select("row", F.explode(F.filter(cut, lambda x: F.arrays_overlap(x, F.array(*map(F.lit, rare))))).alias("part"))


def matches(parts: DataFrame, index: DataFrame, rare: list[str]) -> DataFrame:
    """``row, labels, share`` for ``parts (row, part)``: the labels of all blocks that start in one, and
    the largest share of a template. A piece makes a row a prefix token it holds."""
    held = F.array_distinct(F.filter("part", lambda w: w.isin(rare)))
    near = parts.select("row", "part", F.explode(held).alias("token")).join(index, "token")
    # each word's place in the template: from 1, 0 for none, -1 for a barred word. What is exploded is
    # worked out once; a plain column would be worked out anew wherever a filter below reads it
    place = F.transform("part", lambda w: F.when(F.array_contains("bars", w), -1).otherwise(F.array_position("own", w)))
    near = near.select("row", "label", "own", "must", "need", "span", "at", F.explode(F.array(place)).alias("marks"))
    held = F.array_distinct(F.filter("marks", lambda m: m > 0))
    first = F.col("at") == F.array_min(held) - 1  # a piece and template meet once, at their first common token
    near = near.where(first).withColumn("held", F.size(held)).where("held >= need")
    behind = F.size(F.filter(held, lambda m: m > F.col("at") + 1))
    near = near.where(F.least(F.size("own") - F.col("at") - 1, behind) + 1 >= F.col("need"))
    needed = F.transform("must", lambda w: F.array_position("own", w))
    starts = F.filter(F.sequence(F.lit(1), F.least(F.size("marks"), F.lit(PIECE))), lambda s: F.element_at("marks", s) > 0)
    blocks = F.transform(starts, lambda s: F.array_distinct(F.filter(F.slice("marks", s, F.col("span")), lambda m: m != 0)))
    good = F.filter(blocks, lambda b: ~F.array_contains(b, F.lit(-1).cast("long")) & (F.size(b) >= F.col("need")) & (F.size(F.array_except(needed, b)) == 0))
    most = F.array_max(F.transform(good, lambda b: F.size(b)))
    share = F.filter(F.array(most / F.size("own")), lambda x: x.isNotNull())
    found = near.select("row", "label", F.explode(share).alias("share"))
    return found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and n_words, n_base, first_word, last_word,
    base_labels, labels, score (the largest share of a template, 1 for a phrase, else 0)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = [c for c in keep if c not in made]
    vocabulary = sorted({w for x in templates() for w in x["own"]})
    index = inverted_index(spark, token_ranks(docs, vocabulary))
    rare = sorted({r["token"] for r in index.select("token").collect()})  # template tokens at most
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    marks = "|".join(p.replace(" ", gap) for p in PHRASES.values())
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_row"),
        ascii_lower(text_of("text")).alias("_low"),
    )
    low = F.col("_low")
    df = df.withColumn("_words", plain_words(low)).withColumn("_n", F.size("_words"))
    padded = F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))
    df = df.withColumn("_norm", F.when(low.rlike(marks), padded).otherwise(F.lit("")))
    words_in = lambda piece: F.size(F.regexp_extract_all(piece, F.lit("[^ ]+"), F.lit(0)))
    found = _phrase_columns(F.col("_norm"), words_in)
    labels = F.array_sort(
        F.filter(
            F.array(*[F.when(n > 0, F.lit(label)) for label, (n, _, _) in found.items()]),
            lambda x: x.isNotNull(),
        )
    )
    hit = F.arrays_overlap("_words", F.array(*map(F.lit, rare)))
    measured = df.select(
        F.monotonically_increasing_id().alias("row"), "_row",
        F.col("_n").cast("long").alias("n_words"),
        sum((n for n, _, _ in found.values()), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[f for _, f, _ in found.values()]).cast("long").alias("first_word"),
        F.greatest(*[x for _, _, x in found.values()]).cast("long").alias("last_word"),
        labels.alias("base"), F.when(hit, F.col("_words")).alias("words"),
    )
    measured = written(measured, "licenses")
    more = matches(pieces(measured.where("words is not null").select("row", "words"), rare), index, rare)
    return measured.drop("words").join(more, "row", "left").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in keep],
        "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
