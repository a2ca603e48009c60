"""Evaluation: hits, ranks, percentiles, floors, run history, medians and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import written

# The least hits a run must reach, by retrievers, and its largest 90th percentile.
FLOORS = {"dense": (40, 18), "dense-small": (40, 9), "lexical": (39, 7)}
CODE_FLOOR, P90_CEILING = 12, 250


def found(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """``q, anchor, hit`` for ``cases (q, expect array)`` and ``answers (q, id, file, role)``: an id
    anywhere in the answer, a path among the seeds' files alone."""
    anchors = cases.select("q", F.explode("expect").alias("anchor")).distinct()
    ids = answers.select("q", F.col("id").alias("anchor"))
    files = answers.where("role = 'seed'").select("q", F.col("file").alias("anchor"))
    there = ids.unionByName(files).distinct().withColumn("hit", F.lit(True))
    return anchors.join(there, ["q", "anchor"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def summary(cases: DataFrame, anchors: DataFrame) -> DataFrame:
    """``kind, cases, hits, anchors, reached`` in order of first appearance (``cases.pos``)."""
    per = anchors.groupBy("q").agg(F.max("hit").alias("hit"), F.count("*").alias("anchors"), F.count_if("hit").alias("reached"))
    out = cases.join(per, "q").groupBy("kind").agg(
        F.count("*").alias("cases"), F.count_if("hit").alias("hits"), F.sum("anchors").alias("anchors"),
        F.sum("reached").alias("reached"), F.min("pos").alias("first"),
    )
    return out.orderBy("first").drop("first")


def tokens_of(text: Column) -> Column:
    """UTF-8 bytes by four, whole."""
    return F.floor(F.octet_length(text) / 4)


def at_index(df: DataFrame, value: str, index: Column, *by: str) -> DataFrame:
    """The ``value`` at the 0-based ``index`` (of the count ``n``) in ascending order, a row a group.

    Values are counted, range-partitioned and summed by range; ranges before one make its
    offset, and running counts are inside a range. So no task gets more of a group, or of
    a table without groups, than a range of its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(counts.repartitionByRange(parts, *by, value).withColumn("_range", F.spark_partition_id()), "counts")
    sums = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_sum"))
    w = W.partitionBy(*by)  # a row a range
    sums = sums.withColumn("n", F.sum("_sum").over(w)).withColumn("_before", F.sum("_sum").over(w.orderBy("_range")) - F.col("_sum"))
    inside = W.partitionBy(*by, "_range").orderBy(value)
    sums = sums.select(F.col("_range").alias("_of"), "n", "_before", *[F.col(c).alias(f"_by_{c}") for c in by])
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = counts.join(sums, same).select(*by, value, "_c", "n", "_before", "_range")
    rows = rows.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    hit = rows.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_c") <= index))
    return hit.select(*by, value, "n")


def p90(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``sorted[floor(0.9 n)]``."""
    return at_index(df, value, F.floor(F.col("n") * 0.9), *by)


def median_upper(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``sorted[n div 2]``."""
    return at_index(df, value, F.floor(F.col("n") / 2), *by)


def verdict(keyword: int, paraphrase: int, code: int, p90_tokens: int, retrievers: str) -> int:
    """0 if every floor holds, 3 if one is missed, 1 for retrievers that have none."""
    if retrievers not in FLOORS:
        return 1
    a, b = FLOORS[retrievers]
    return 0 if keyword >= a and paraphrase >= b and code >= CODE_FLOOR and p90_tokens <= P90_CEILING else 3


def relocate(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """``q, anchor, at``: a code anchor ``sym:…::name`` where exactly one file defines the name now."""
    name = F.regexp_extract("anchor", "::(.+)$", 1)
    own = nodes.where("kind = 'Symbol'").select(F.col("id").alias("at"), F.regexp_extract("id", "::(.+)$", 1).alias("name"))
    one = own.groupBy("name").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n = 1")
    out = cases.select("q", F.explode("expect").alias("anchor")).where(F.col("anchor").startswith("sym:")).withColumn("name", name)
    return out.join(one, "name").select("q", "anchor", "at")


def unknown_anchors(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors that are neither a node nor a declared file; should be empty."""
    known = nodes.select(F.col("id").alias("anchor")).unionByName(nodes.select(F.explode("files").alias("anchor"))).distinct()
    return cases.select("q", F.explode("expect").alias("anchor")).join(known, "anchor", "left_anti")


def pool_rank(cases: DataFrame, pool: DataFrame) -> DataFrame:
    """``q, rank``: 1-based rank of the first anchor in ``pool (q, id, file, rank)``; null if none."""
    anchors = cases.select("q", F.explode("expect").alias("anchor"))
    own = pool.select("q", F.col("id").alias("anchor"), "rank").unionByName(pool.select("q", F.col("file").alias("anchor"), "rank"))
    best = anchors.join(own, ["q", "anchor"]).groupBy("q").agg(F.min("rank").alias("rank"))
    return cases.select("q").join(best, "q", "left")


def dump(lists: DataFrame) -> DataFrame:
    """``q, lists``: every retriever's ranked list of a question (``q, list, rank, id, score``)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    return lists.groupBy("q", "list").agg(rows.alias("hits")).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("list", "hits"))).alias("lists")
    )


def scores(ranks: DataFrame, *by: str) -> DataFrame:
    """``cases, found, mrr`` of ``ranks (rank)``; a missing rank counts as 0."""
    return ranks.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count("rank").alias("found"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def recall(wanted: DataFrame, got: DataFrame, *by: str) -> DataFrame:
    """``want, found, recall`` of the items both tables hold, by group."""
    key = [*by, "item"]
    hit = wanted.select(*key).distinct().join(got.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    out = hit.groupBy(*by).agg(F.count("*").alias("want"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("want"))


def by_extension(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """``recall`` of files (``item``), split by suffix."""
    ext = F.regexp_extract("item", r"(\.[^./]+)$", 1).alias("ext")
    return recall(wanted.select("item", ext), got.select("item", ext), "ext")


def history(runs: DataFrame, least_miss: float = 0.5) -> DataFrame:
    """``case, seen, miss_rate, flips, weak, flaky`` of ``runs (case, run, hit)`` in order of run."""
    w = W.partitionBy("case").orderBy("run")
    flip = (F.lag("hit").over(w) != F.col("hit")).cast("int")
    out = runs.withColumn("flip", F.coalesce(flip, F.lit(0))).groupBy("case").agg(
        F.count("*").alias("seen"), F.avg((~F.col("hit")).cast("double")).alias("miss_rate"), F.sum("flip").alias("flips")
    )
    weak = (F.col("seen") >= 2) & (F.col("miss_rate") >= least_miss)
    return out.withColumn("weak", weak).withColumn("flaky", F.col("flips") > 1)


def deltas(runs: DataFrame, metric: str) -> DataFrame:
    """Each run's ``metric`` and its move against the arm's run before."""
    w = W.partitionBy("arm").orderBy("run")
    return runs.withColumn("delta", F.col(metric) - F.lag(metric).over(w))


def systemic(runs: DataFrame) -> DataFrame:
    """Cases that every arm misses in its latest run (``arm, case, run, hit``)."""
    last = runs.groupBy("arm", "case").agg(F.max(F.struct("run", "hit"))["hit"].alias("hit"))
    return last.groupBy("case").agg(F.bool_or("hit").alias("any"), F.count("*").alias("arms")).where("not any").drop("any")


def gates(log: DataFrame, spread: float = 0.1) -> DataFrame:
    """``row, metric, median, low, high, steady``: medians of a run log (``row, metric, value``); a
    control that spreads by more than ``spread`` refuses the comparison."""
    mid = median_upper(log, "value", "row", "metric").select("row", "metric", F.col("value").alias("median"))
    ends = log.groupBy("row", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    out = mid.join(ends, ["row", "metric"])
    return out.withColumn("steady", F.col("high") - F.col("low") <= F.col("median") * spread)


def agent_score(results: DataFrame) -> DataFrame:
    """``arm, hits, cases, tokens_per_hit`` of ``results (arm, result, expect array, tokens)``."""
    hit = F.forall("expect", lambda e: F.contains(F.col("result"), e))
    out = results.groupBy("arm").agg(F.count_if(hit).alias("hits"), F.count("*").alias("cases"), F.sum("tokens").alias("tokens"))
    return out.select("arm", "hits", "cases", F.when(F.col("hits") > 0, F.col("tokens") / F.col("hits")).alias("tokens_per_hit"))
