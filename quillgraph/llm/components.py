"""Connected components by alternating stars, on DataFrames.

Every round rewires each node's larger, then its smaller neighbours to its least one, so
a component turns into one star around its least id in a logarithmic number of rounds.
A node's neighbours are only ever aggregated to their minimum, never gathered, so a hub
of any degree costs one partial aggregate a task. Rounds are written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b")))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in ``edges (a, b)`` that is not itself the least of its
    component; ``root`` is that least id. Loops and repeats are allowed; no edge, no row."""
    now = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    seen = _digest(now)
    while True:
        now = written(_small_star(_large_star(now)).where("a != b").distinct(), "edges")
        new = _digest(now)
        if new == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = new
