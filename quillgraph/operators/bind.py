"""References of code files, bound to what all files declare.

A reader writes each reference as candidates (rank, package, name). Binding is one equi-join
with the declarations on family, package and name, and one aggregation a reference: the best
rank wins, and a rank with two answers gives none. What an import proves needs the file alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traverse import container, file_of_symbol, name_of_symbol


def family_of(rel: Column) -> Column:
    """The compile family of a path, by its suffix; null for other files."""
    from ..sources.braces import TYPES
    from ..sources.code import SUFFIXES, family

    pairs = [(s, family(lang)) for s, lang in SUFFIXES.items() if lang in TYPES or lang == "vue"]
    known = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.try_element_at(known, F.lower(F.regexp_extract(rel, r"\.([^./]*)$", 1)))


def _plain(rel: Column) -> Column:
    return F.regexp_replace(rel, r"\.[^./]*$", "")


def packages(nodes: DataFrame) -> DataFrame:
    """``family, package, at, prio`` of the files that others name by package. An index file
    also stands for its folder, after a file of that name; TypeScript goes before JavaScript."""
    own = nodes.where("kind = 'File'").select(F.col("file").alias("at"), F.col("body").alias("package"), family_of(F.col("file")).alias("family"))
    own = own.where("family is not null").distinct().withColumn("prio", F.col("at").rlike(r"\.[mc]?jsx?$").cast("int"))
    inner = own.where(F.col("package").rlike("(^|/)index$") & (F.col("family") == "typescript"))
    return own.unionByName(inner.withColumn("package", F.regexp_replace("package", "/?index$", "")).withColumn("prio", F.col("prio") + 2))


def declarations(nodes: DataFrame) -> DataFrame:
    """``family, package, name, id, prio``"""
    own = nodes.where("kind = 'Symbol'").select("id", file_of_symbol(F.col("id")).alias("at"), name_of_symbol(F.col("id")).alias("name")).distinct()
    return own.join(packages(nodes), "at").select("family", "package", "name", "id", "prio")


def retarget(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Imports and re-exports of a path without its suffix, or with a compiled one, lead to the
    source file of that path: TypeScript before JavaScript, a file before a folder's index, a
    ``dist`` folder's source after what is there."""
    moved = F.col("kind").isin("Imports", "ReExports") & (family_of(F.col("file")) == "typescript")
    moved = F.coalesce(moved, F.lit(False))
    stem = _plain(F.regexp_replace("target", "^file:", ""))
    ways = F.array(F.struct(F.lit(0).alias("way"), stem.alias("package")), F.struct(F.lit(1).alias("way"), F.regexp_replace(stem, "(^|/)dist/", "$1src/").alias("package")))
    asked = edges.where(moved).select("target", F.inline(ways)).distinct()
    known = packages(nodes).where("family = 'typescript'").select("package", "at", "prio")
    best = asked.join(known, "package").groupBy("target").agg(F.min(F.struct("way", "prio", "at")).alias("b")).select("target", F.concat(F.lit("file:"), "b.at").alias("_to"))
    led = edges.where(moved).join(best, "target", "left").withColumn("target", F.coalesce("_to", "target")).select(*edges.columns)
    return edges.where(~moved).unionByName(led)


def bind(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of ``refs (rel, n, source, kind, context, rank, package, name, proven)``: one a source
    and target and kind, a call before a hand-over; none to itself or its own container."""
    refs = refs.withColumn("family", family_of(F.col("rel")))
    key = ["rel", "n", "source", "kind", "context", "rank"]
    named = refs.where("not proven").join(declarations(nodes), ["family", "package", "name"]).select(*key, "prio", "id")
    files = packages(nodes)
    sure = refs.where("proven and name != ''").join(files, ["family", "package"])
    sure = sure.select(*key, "prio", F.concat(F.lit("sym:"), "at", F.lit("::"), "name").alias("id"))
    at = reduce(DataFrame.unionByName, [named, sure]).groupBy(*key, "prio").agg(F.min("id").alias("id"), F.max("id").alias("_last"))
    best = at.groupBy("rel", "n", "source", "kind", "context").agg(F.min(F.struct("rank", "prio", "id", "_last")).alias("b"))
    one = best.where("b.id = b._last").select("source", F.col("b.id").alias("target"), "kind", "context", F.col("rel").alias("file"))
    one = one.where(F.col("source") != F.col("target")).where(~F.coalesce(container(F.col("source")) == F.col("target"), F.lit(False)) | (F.col("kind") == "References"))
    return one.groupBy("source", "target", "kind", "file").agg(F.min("context").alias("context")).select("source", "target", "kind", "context", "file")
