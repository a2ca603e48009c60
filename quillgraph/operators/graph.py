"""Set operators of the project graph: upsert, settle, remove, dangling, closures, diffs.

Nodes and edges are two DataFrames; ``edges`` has a ``state`` of settled or pending where a
graph carries both. Every operator is joins and aggregates on ids, so it deals by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ids import family_of
from ..schema import EDGE_KEY
from ..shared import written

_SCALARS = ["kind", "label", "body", "file", "line", "end", "community"]


def upsert(rows: DataFrame, order: list[str]) -> DataFrame:
    """One node an id: the first declaring row (by ``order``) gives all scalar columns, and
    ``files`` is the set of all declaring files. One aggregation, combined map-side."""
    by = [F.col(c).alias(f"_by{n}") for n, c in enumerate(order)]
    first = F.min(F.struct(*by, *[F.col(f"`{c}`") for c in _SCALARS])).alias("_first")
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))).alias("files")
    out = rows.groupBy("id").agg(first, files)
    return out.select("id", *[F.col(f"_first.`{c}`").alias(c) for c in _SCALARS], "files")


def union_edges(*tables: DataFrame) -> DataFrame:
    """Set union on all five columns."""
    out = tables[0].select(*EDGE_KEY)
    for t in tables[1:]:
        out = out.unionByName(t.select(*EDGE_KEY))
    return out.distinct()


def finish(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per file, the first node of each id (by ``seq``) and the distinct edges."""
    w = W.partitionBy("file", "id").orderBy("seq")
    first = nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first, edges.distinct()


def accessors(nodes: DataFrame) -> DataFrame:
    """Ids of accessor symbols: their body starts with a get or set marker."""
    return nodes.where((F.col("kind") == "Symbol") & F.col("body").rlike(r"(?m)^\s*(?:[a-z]+\s+)*(?:get|set)\s+\w+")).select("id")


def settle(nodes: DataFrame, edges: DataFrame, getters: DataFrame | None = None) -> DataFrame:
    """``edges`` with ``state``: pending where the target is an identifier of a family that no
    node declares, settled otherwise. Reads through something that is (no longer) an
    accessor are dropped. Run over both sides again whenever nodes change."""
    getters = accessors(nodes) if getters is None else getters
    reads = (F.col("kind") == "Calls") & (F.col("context") == "get")
    kept = edges.select(*EDGE_KEY).join(
        getters.select(F.col("id").alias("target"), F.lit(True).alias("_getter")).distinct(), "target", "left"
    )
    kept = kept.where(~reads | F.col("_getter").isNotNull()).withColumn("_family", family_of(F.col("target")))
    declared = nodes.select(family_of(F.col("id")).alias("_family")).where("_family is not null").distinct()
    kept = kept.join(declared.withColumn("_known", F.lit(True)), "_family", "left")
    held = F.col("_family").isNotNull() & F.col("_known").isNull()
    return kept.select(*EDGE_KEY, F.when(held, "pending").otherwise("settled").alias("state"))


def remove_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without what the files ``gone (rel)`` said: their edges, their share of each node, and
    nodes left without a file; a node whose primary file went takes its smallest other."""
    gone = gone.select("rel").distinct()
    edges = edges.join(gone, edges["file"] == gone["rel"], "left_anti")
    lost = (
        nodes.select("id", F.explode("files").alias("rel")).join(gone, "rel", "left_semi")
        .groupBy("id").agg(F.collect_set("rel").alias("_lost"))
    )
    out = nodes.join(lost, "id", "left")
    left = F.when(F.col("_lost").isNull(), F.col("files")).otherwise(F.array_sort(F.array_except("files", "_lost")))
    out = out.withColumn("files", left).where(F.col("_lost").isNull() | (F.size("files") > 0))
    moved = F.when(F.array_contains("_lost", F.col("file")), F.array_min("files")).otherwise(F.col("file"))
    return out.withColumn("file", moved).drop("_lost"), edges


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids (id)``: two equi-joins, as an OR would pair all."""
    a = edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    b = edges.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    return a.select(*EDGE_KEY).unionByName(b.select(*EDGE_KEY)).distinct()


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no node. Legal, and never to be joined away by accident."""
    return edges.join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_anti").select(*EDGE_KEY)


def co_declared(nodes: DataFrame, stale: DataFrame) -> DataFrame:
    """``rel``: files to read again, the stale ones and, transitively, those that share a node
    with one of them. Files and ids form a bipartite graph; the frontier is dealt anew
    each round and the loop ends when it is empty."""
    pairs = nodes.where(F.size("files") > 1).select("id", F.explode("files").alias("rel")).persist()
    seen = frontier = stale.select("rel").distinct()
    while not frontier.isEmpty():
        ids = pairs.join(frontier, "rel", "left_semi").select("id").distinct()
        new = pairs.join(ids, "id", "left_semi").select("rel").distinct().join(seen, "rel", "left_anti")
        frontier = cut(new)
        seen = cut(seen.unionByName(frontier))
    pairs.unpersist()
    return seen


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    return written(df, "cut")


def widen_by_header(old: DataFrame, new: DataFrame, exempt: tuple[str, ...] = ("typescript",)) -> DataFrame:
    """``rel``: all files of the families in which a member was added, removed or changed its
    header (``rel, family, header``)."""
    both = old.alias("a").join(new.alias("b"), ["rel", "family"], "full")
    moved = both.where(~F.col("a.header").eqNullSafe(F.col("b.header"))).select("family").distinct()
    moved = moved.where(~F.col("family").isin(list(exempt)))
    return new.join(moved, "family", "left_semi").select("rel")


def widen_by_imports(edges: DataFrame, changed: DataFrame, transitive: bool = True) -> DataFrame:
    """``rel``: files that import or re-export a changed one, transitively if asked."""
    back = edges.where(F.col("kind").isin("Imports", "ReExports")).select(
        F.regexp_replace("target", "^file:", "").alias("rel"), F.col("file").alias("by"),
        (F.col("kind") == "ReExports").alias("onward"),
    ).persist()
    seen = frontier = cut(changed.select("rel").distinct())
    while not frontier.isEmpty():
        hit = back.join(frontier, "rel", "left_semi")
        new = cut(hit.select(F.col("by").alias("rel"), "onward").groupBy("rel").agg(F.max("onward").alias("onward")).join(seen, "rel", "left_anti"))
        seen = cut(seen.unionByName(new.select("rel")))
        frontier = new.select("rel") if transitive else new.where("onward").select("rel")
    back.unpersist()
    return seen.join(changed.select("rel"), "rel", "left_anti")


def diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """``what, id, detail``: nodes lost, added and changed (by field), and the edge multisets'
    differences both ways."""
    fields = ["kind", "label", "body", "file", "line", "end", "files"]
    row = lambda df, c: df.select("id", F.struct(*[F.col(f"`{f}`") for f in fields]).alias(c))
    both = row(old_nodes, "a").join(row(new_nodes, "b"), "id", "full")
    changed = F.array(*[F.when(~F.col(f"a.`{f}`").eqNullSafe(F.col(f"b.`{f}`")), F.lit(f)) for f in fields])
    changed = F.array_join(F.filter(changed, lambda x: x.isNotNull()), ",")
    what = F.when(F.col("b").isNull(), "node lost").when(F.col("a").isNull(), "node added").otherwise("node changed")
    nodes = both.select(what.alias("what"), "id", changed.alias("detail"))
    nodes = nodes.where("what != 'node changed' or detail != ''")
    said = F.concat_ws(" ", "kind", "target", "context", "file").alias("detail")
    lost = old_edges.select(*EDGE_KEY).exceptAll(new_edges.select(*EDGE_KEY))
    added = new_edges.select(*EDGE_KEY).exceptAll(old_edges.select(*EDGE_KEY))
    e = lambda df, what: df.select(F.lit(what).alias("what"), F.col("source").alias("id"), said)
    return nodes.unionByName(e(lost, "edge lost")).unionByName(e(added, "edge added"))


#: Edge kinds that a change in one file may move in others.
BOUNDED = ["References", "Calls", "Extends", "Implements", "DecoratedBy"]


def language_diff(old_edges: DataFrame, new_edges: DataFrame, languages: DataFrame) -> DataFrame:
    """``lang, kind, class, lost, added``: edge movement by language (``rel, lang``), bounded or
    structural by kind."""
    lost = old_edges.select(*EDGE_KEY).exceptAll(new_edges.select(*EDGE_KEY)).withColumn("way", F.lit("lost"))
    added = new_edges.select(*EDGE_KEY).exceptAll(old_edges.select(*EDGE_KEY)).withColumn("way", F.lit("added"))
    both = lost.unionByName(added).join(languages.select(F.col("rel").alias("file"), "lang"), "file", "left")
    kind = F.when(F.col("kind").isin(BOUNDED), "bounded").otherwise("structural")
    return both.groupBy(F.coalesce("lang", F.lit("-")).alias("lang"), "kind", kind.alias("class")).agg(
        F.count_if(F.col("way") == "lost").alias("lost"), F.count_if(F.col("way") == "added").alias("added")
    )
