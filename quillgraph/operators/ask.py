"""Answering questions: exact ids, fused retrievers, seating, one hop of expansion.

Everything is keyed by the question ``q``, so many are answered by one plan. Every order
ends in the id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stem import stem

SEEDS, DEPTH, POOL, DUMP = 5, 20, 200, 300
#: Characters that wrap a word and are no part of an id.
WRAPPING = "\"'`()[]{}<>,.;:!?*"
HOP_KINDS = ["References", "Implements", "Declares", "Links", "Legacy"]
TEST_MARKS = [r"/test/", r"/e2e/", r":test/", r":e2e/", r"\.spec\.", r"\.test\.", r"\.stories\."]


def is_test(id_: Column) -> Column:
    return id_.rlike("|".join(TEST_MARKS))


def words(spark: SparkSession, questions: dict[str, str]) -> DataFrame:
    """``q, pos, word, bare, plain`` (a bare word that cannot name a symbol alone)."""
    rows = []
    for q, text in questions.items():
        parts = text.split()
        for pos, w in enumerate(parts):
            bare = w.strip(WRAPPING)
            plain = len(parts) > 1 and not (any(c.isupper() for c in bare) or "_" in bare)
            rows.append((q, pos, w, bare, plain, any(c.isupper() for c in bare)))
    return spark.createDataFrame(rows, "q string, pos int, word string, bare string, plain boolean, upper boolean")


def exact(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``q, id, pos, whole``: nodes a word names: as typed, trimmed, by case folding (smallest
    id), else symbols of that label or tail, production before tests. ``whole``: every word
    that names no id named a symbol, and has an upper-case letter."""
    n = nodes.select("id", "kind", "label", F.lower("id").alias("folded"), F.regexp_extract("id", "::([^:]+)$", 1).alias("tail"))
    by = lambda left, right, stage: asked.join(n, asked[left] == n[right]).select("q", "pos", "id", F.lit(stage).alias("stage"))
    folded = asked.withColumn("low", F.lower("bare"))
    fold = folded.join(n, folded["low"] == n["folded"]).groupBy("q", "pos").agg(F.min("id").alias("id")).withColumn("stage", F.lit(2))
    ids = by("word", "id", 0).unionByName(by("bare", "id", 1)).unionByName(fold.select("q", "pos", "id", "stage"))
    best = ids.groupBy("q", "pos").agg(F.min(F.struct("stage", "id")).alias("b")).select("q", "pos", F.col("b.id").alias("id"))
    rest = asked.join(best.select("q", "pos"), ["q", "pos"], "left_anti")
    sym = n.where("kind = 'Symbol'")
    open_ = rest.where(~F.col("plain") & (F.col("bare") != ""))
    hit = open_.join(sym, open_["bare"] == sym["label"]).select("q", "pos", "id")
    hit = hit.unionByName(open_.join(sym, open_["bare"] == sym["tail"]).select("q", "pos", "id")).distinct()
    both = best.unionByName(hit).withColumn("test", is_test(F.col("id")))
    first = both.groupBy("q", "id").agg(F.min(F.struct("pos", "test")).alias("b"))
    order = W.partitionBy("q").orderBy("b.pos", "b.test", "id")
    named = rest.join(hit.select("q", "pos").distinct().withColumn("named", F.lit(True)), ["q", "pos"], "left")
    whole = named.groupBy("q").agg(F.bool_and(F.coalesce("named", F.lit(False)) & F.col("upper")).alias("whole"))
    out = first.select("q", "id", (F.row_number().over(order) - 1).alias("pos"))
    return out.join(whole, "q", "left").withColumn("whole", F.coalesce("whole", F.lit(True)))


def interleave(lists: DataFrame) -> DataFrame:
    """``q, id, place, score`` of ``lists (q, list_no, rank, id)`` with ranks from 0: round-robin by
    rank, each id at its first place; the score is 1 / (rank + 1)."""
    first = lists.groupBy("q", "id").agg(F.min(F.struct("rank", "list_no")).alias("b"))
    order = W.partitionBy("q").orderBy("b.rank", "b.list_no", "id")
    place = (F.row_number().over(order) - 1).alias("place")
    return first.select("q", "id", place, (1.0 / (F.col("b.rank") + 1)).alias("score"))


def fused(dense: DataFrame | None, lexical: DataFrame, texts: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """Fusion of ranked lists (``q, id, rank`` from 1): dense passages, BM25 passages, texts."""
    lists = [(0, dense), (1, lexical), (2, texts)]
    rows = [
        d.where(F.col("rank") <= depth).select("q", F.lit(no).alias("list_no"), (F.col("rank") - 1).alias("rank"), "id")
        for no, d in lists
        if d is not None
    ]
    return interleave(reduce(DataFrame.unionByName, rows))


def seat(named: DataFrame, found: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``q, id, pos, score, via``: exact ones first, then fused ones until ``seeds``; nothing fused
    for a question that its exact ids answer whole."""
    a = named.select("q", "id", F.lit(0).alias("turn"), "pos", F.lit(1.0).alias("score"))
    full = named.where("whole").select("q").distinct()
    b = found.join(named.select("q", "id"), ["q", "id"], "left_anti").join(full, "q", "left_anti")
    b = b.select("q", "id", F.lit(1).alias("turn"), F.col("place").alias("pos"), "score")
    order = W.partitionBy("q").orderBy("turn", "pos", "id")
    out = a.unionByName(b).withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < seeds)
    return out.select("q", "id", "pos", "score", F.lit(None).cast("string").alias("via"))


def candidates(nodes: DataFrame, edges: DataFrame, seats: DataFrame, found: DataFrame) -> DataFrame:
    """``q, id, via, score, order``: one hop from the seats, both ways, best first."""
    hop = edges.where(F.col("kind").isin(HOP_KINDS))
    out = hop.select(F.col("source").alias("via"), F.col("target").alias("id"))
    both = out.unionByName(hop.select(F.col("target").alias("via"), F.col("source").alias("id"))).distinct()
    at = seats.select("q", F.col("id").alias("via"), "pos", "score")
    hit = both.join(at, "via").where(~F.col("id").startswith("file:") & ~F.col("id").startswith("deco:"))
    hit = hit.join(nodes.select("id"), "id", "left_semi").join(seats.select("q", "id"), ["q", "id"], "left_anti")
    first = hit.groupBy("q", "id").agg(F.min(F.struct("pos", "via", "score")).alias("b"))
    first = first.join(found.select("q", "id", "place"), ["q", "id"], "left")
    half = F.col("b.score") / 2
    order = W.partitionBy("q").orderBy(F.col("place").isNull(), "place", F.desc(half), "id")
    return first.select("q", "id", "b.via", half.alias("score"), F.row_number().over(order).alias("order"))


def expand(nodes: DataFrame, edges: DataFrame, seats: DataFrame, found: DataFrame, take: int = 1) -> DataFrame:
    """The first ``take`` candidates, and, if no hit shown is a symbol, the first symbol among
    them, production first."""
    cand = candidates(nodes, edges, seats, found).persist()
    shown = cand.where(F.col("order") <= take)
    code = seats.where(F.col("id").startswith("sym:")).select("q").unionByName(shown.where(F.col("id").startswith("sym:")).select("q"))
    more = cand.where(F.col("id").startswith("sym:") & (F.col("order") > take)).join(code.distinct(), "q", "left_anti")
    order = W.partitionBy("q").orderBy(is_test(F.col("id")), "order")
    line = more.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return shown.unionByName(line)


def answer(nodes: DataFrame, edges: DataFrame, named: DataFrame, found: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``q, role, pos, id, file, line, label, score, via``: seats, then what expands them."""
    seats = seat(named, found, seeds).persist()
    a = seats.select("q", F.lit("seed").alias("role"), "pos", "id", "score", "via")
    b = expand(nodes, edges, seats, found).select("q", F.lit("expanded").alias("role"), F.col("order").alias("pos"), "id", "score", "via")
    out = a.unionByName(b).join(nodes.select("id", "file", "line", "label"), "id", "left")
    return out.select("q", "role", "pos", "id", "file", "line", headline("label").alias("label"), "score", "via")


def headline(column: str, most: int = 80) -> Column:
    text = F.col(column)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def text_lines(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """``q, id, line``: of each text (``q, id, body``), the first line with the most distinct
    five-character prefixes of the question's words (``q, prefix``); 1 if none has any."""
    lines = texts.select("q", "id", F.posexplode(F.split(F.lower("body"), "\n", -1)).alias("pos", "text"))
    said = F.array_distinct(F.transform(
        F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) >= 3) | w.rlike(r"^[\p{IsHangul}\p{IsHan}]{2,}$")),
        lambda w: F.substring(w, 1, 5),
    ))
    hit = lines.select("q", "id", "pos", F.explode(said).alias("prefix")).join(questions.distinct(), ["q", "prefix"])
    n = hit.groupBy("q", "id", "pos").agg(F.count("*").alias("n"))
    best = n.groupBy("q", "id").agg(F.max(F.struct("n", -F.col("pos"))).alias("b")).select("q", "id", (1 - F.col("b")["col2"]).alias("line"))
    return texts.select("q", "id").distinct().join(best, ["q", "id"], "left").withColumn("line", F.coalesce("line", F.lit(1)))


def best_sentence(question: str, most: int = 120) -> Callable:
    """A vectorised function: the sentence of a body that shares most stemmed words with the
    question, the first of equals."""
    import re

    asked = {stem(w) for w in re.findall(r"\w+", question.lower())}

    @F.pandas_udf("string")
    def pick(bodies: pd.Series) -> pd.Series:
        def one(body: str | None) -> str:
            parts = re.split(r"(?<=[.!?;])\s+", (body or "").strip())
            return max(parts, key=lambda s: len({stem(w) for w in re.findall(r"\w+", s.lower())} & asked))[:most]

        return bodies.map(one)

    return pick


def rerank(pool: DataFrame, order: list[str] | None) -> DataFrame:
    """``pool (q, id, place, score)`` in the order a model gave (ids it was not shown, and repeats,
    are passed over); the fused order after it, and alone if the model failed."""
    if not order:
        return pool
    rows = [(i, n) for n, i in enumerate(dict.fromkeys(order))]
    said = pool.sparkSession.createDataFrame(rows, "id string, said int")
    out = pool.join(F.broadcast(said), "id", "left")  # as long as the model's answer
    place = F.row_number().over(W.partitionBy("q").orderBy(F.col("said").isNull(), "said", "place")) - 1
    return out.select("q", "id", place.alias("place"), "score")


def rerank_local(pool: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], take: int = SEEDS) -> DataFrame:
    """The ``take`` best of ``pool (q, id, place, question, passage)`` by a cross-encoder's score;
    ties keep their fused order."""

    @F.pandas_udf("double")
    def score(question: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(scorer(question.tolist(), passage.tolist()), dtype="float64")

    scored = pool.withColumn("logit", score("question", "passage"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("logit"), "place"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= take)
