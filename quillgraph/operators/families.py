"""Families of identifiers: what the graph declares, and what texts mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import family_of, form_of
from ..schema import CODE_KINDS


def of_graph(nodes: DataFrame) -> DataFrame:
    """``form, family, nodes, definitions`` (declaring files) of the document nodes."""
    ids = nodes.where(~F.col("kind").isin(CODE_KINDS)).withColumn("form", form_of(F.col("id")))
    ids = ids.withColumn("family", family_of(F.col("id"))).where("form is not null")
    return ids.groupBy("form", "family").agg(
        F.count("*").alias("nodes"), F.sum(F.size("files")).cast("long").alias("definitions")
    )


def first_sites(nodes: DataFrame) -> DataFrame:
    """``family, file, line``: where each family is first declared."""
    ids = nodes.where(~F.col("kind").isin(CODE_KINDS)).withColumn("family", family_of(F.col("id")))
    first = ids.where("family is not null").groupBy("family").agg(F.min(F.struct("file", "line")).alias("at"))
    return first.select("family", "at.file", "at.line")


def report(nodes: DataFrame) -> DataFrame:
    """Families with their first site, ``once`` (a single definition), fewest definitions first."""
    out = of_graph(nodes).join(first_sites(nodes), "family", "left")
    out = out.withColumn("once", F.col("definitions") == 1)
    return out.orderBy("definitions", "nodes", "family", "form")


def mention_survey(mentions: DataFrame) -> DataFrame:
    """``prefix, mentions, ids, files, file, line`` for ``mentions (id, file, line)``, most ids
    first. One pass: the distinct counts are of the few values a prefix has in a task."""
    rows = mentions.withColumn("prefix", family_of(F.col("id"))).where("prefix is not null")
    out = rows.groupBy("prefix").agg(
        F.count("*").alias("mentions"), F.countDistinct("id").alias("ids"), F.countDistinct("file").alias("files"),
        F.min(F.struct("file", "line")).alias("at"),
    )
    out = out.select("prefix", "mentions", "ids", "files", "at.file", "at.line")
    return out.orderBy(F.desc("ids"), F.desc("mentions"), "prefix")


def mention_only(survey: DataFrame, nodes: DataFrame) -> DataFrame:
    """Surveyed prefixes that no node declares, as an id or a milestone family."""
    known = of_graph(nodes).select(F.col("family").alias("prefix")).distinct()
    return survey.join(known, "prefix", "left_anti")


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """``family, moved``: gained or lost between two readings (``family``)."""
    a, b = old.select("family").distinct(), new.select("family").distinct()
    gained = b.join(a, "family", "left_anti").withColumn("moved", F.lit("gained"))
    return gained.unionByName(a.join(b, "family", "left_anti").withColumn("moved", F.lit("lost")))


def line(names: list[str], most: int = 20) -> str:
    """A list cut to its head, with how many more there are."""
    more = f" … +{len(names) - most}" if len(names) > most else ""
    return ", ".join(names[:most]) + more
