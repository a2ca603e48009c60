"""Names to nodes, a node explained, and the health of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ids import family_of
from ..schema import CODE_KINDS, EDGE_KEY, edge_rank
from . import traverse
from .ask import WRAPPING, is_test


class Ambiguous(LookupError):
    """More nodes than one, or none; ``found`` are the first twenty."""

    def __init__(self, needle: str, found: list[str]) -> None:
        super().__init__(f"{needle!r} names {len(found) or 'no'} nodes: {', '.join(found[:20])}")
        self.found = found


def candidates(snap: traverse.Snapshot, needles: DataFrame) -> DataFrame:
    """``needle, id`` of the first stage that finds any: the id (as typed, trimmed, folded), ids
    that end in ``::needle``, labels ignoring case, names that only a re-export gives."""
    n = snap.nodes.select("id", F.lower("id").alias("low"), F.lower("label").alias("name"), F.regexp_extract("id", "::(.+)$", 1).alias("tail"))
    asked = needles.select("needle").distinct().withColumn("bare", F.trim(F.col("needle"), F.lit(WRAPPING)))
    asked = asked.withColumn("fold", F.lower("bare"))
    pick = lambda a, b, stage: asked.join(n, asked[a] == n[b]).select("needle", "id", F.lit(stage).alias("stage"))
    fold = pick("fold", "low", 2).groupBy("needle", "stage").agg(F.min("id").alias("id")).select("needle", "id", "stage")
    named = snap.aliases.select("id", F.regexp_extract("alias", "::(.+)$", 1).alias("as"), traverse.name_of_symbol(F.col("id")).alias("own"))
    renamed = asked.join(named.where("as != own"), asked["bare"] == named["as"]).select("needle", "id", F.lit(5).alias("stage"))
    every = pick("needle", "id", 0)
    for part in (pick("bare", "id", 1), fold, pick("bare", "tail", 3), pick("fold", "name", 4), renamed):
        every = every.unionByName(part)
    first = W.partitionBy("needle")
    return every.withColumn("_s", F.min("stage").over(first)).where("stage = _s").select("needle", "id").distinct()


def resolve_one(snap: traverse.Snapshot, needle: str) -> str:
    spark = snap.nodes.sparkSession
    found = candidates(snap, spark.createDataFrame([(needle,)], "needle string")).orderBy("id").limit(21).collect()
    if len(found) != 1:
        raise Ambiguous(needle, [r["id"] for r in found])
    return found[0]["id"]


def resolve_code(snap: traverse.Snapshot, needles: DataFrame) -> DataFrame:
    """``needle, id, ambiguous, passed_over``: the best candidate, code before others and
    production before tests; ambiguous if several rank alike."""
    c = candidates(snap, needles).join(snap.nodes.select("id", "kind"), "id")
    rank = F.rank().over(W.partitionBy("needle").orderBy(~F.col("kind").isin(CODE_KINDS), is_test(F.col("id"))))
    c = c.withColumn("_r", rank)
    out = c.groupBy("needle").agg(
        F.min(F.when(F.col("_r") == 1, F.col("id"))).alias("id"), (F.count_if(F.col("_r") == 1) > 1).alias("ambiguous"),
        F.count_if(F.col("_r") > 1).alias("passed_over"),
    )
    return out


def edges_of(snap: traverse.Snapshot, ids: DataFrame) -> DataFrame:
    """``id`` and its edges: its own, those to its aliases, and for symbols the walked ones that
    reach a member, a contract or an undeclared member from outside."""
    ids = ids.select("id").distinct().persist()
    own = snap.edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").withColumn("id", F.col("source"))
    to = snap.edges.join(ids.select(F.col("id").alias("target")), "target", "left_semi").withColumn("id", F.col("target"))
    named = ids.join(snap.aliases, "id").select("id", F.col("alias").alias("target"))
    via_alias = snap.edges.join(named, "target")
    seed = traverse.seeds(snap, ids.select(F.col("id").alias("root")))
    extra = traverse.undeclared(snap, seed).select(F.col("root").alias("id"), F.col("at").alias("target"))
    behind = seed.join(snap.dispatch, seed["at"] == snap.dispatch["member"]).select(F.col("root").alias("id"), F.col("contract").alias("target"))
    reach = seed.select(F.col("root").alias("id"), F.col("at").alias("target")).unionByName(extra).unionByName(behind).distinct()
    code = traverse.walked(snap.edges).join(reach, "target")
    inside = seed.select(F.col("root").alias("id"), F.col("at").alias("source"))
    code = code.join(inside, ["id", "source"], "left_anti")
    cols = ["id", *EDGE_KEY]
    out = own.select(cols).unionByName(to.select(cols)).unionByName(via_alias.select(cols)).unionByName(code.select(cols))
    return out.distinct()


def explain(snap: traverse.Snapshot, ids: DataFrame) -> DataFrame:
    """``id, kind, dir, other, context, file, line``, legacy edges last: the line is that of the
    target for a declaration, else of the source, where its primary file is the edge's."""
    e = edges_of(snap, ids).withColumn("dir", F.when(F.col("source") == F.col("id"), "out").otherwise("in"))
    e = e.withColumn("other", F.when(F.col("dir") == "out", F.col("target")).otherwise(F.col("source")))
    e = e.withColumn("at", F.when(F.col("kind") == "Declares", F.col("target")).otherwise(F.col("source")))
    n = snap.nodes.where("kind != 'File'").select(F.col("id").alias("at"), F.col("file").alias("file_"), F.col("line").alias("line_"))
    e = e.join(n, "at", "left").withColumn("line", F.when(F.col("file_") == F.col("file"), F.col("line_")))
    order = [F.col("kind") == "Legacy", edge_rank(), F.col("source"), F.col("target")]
    return e.orderBy("id", *order).select("id", "kind", "dir", "other", "context", "file", "line")


def verify(nodes: DataFrame, edges: DataFrame, pending: DataFrame) -> DataFrame:
    """``what, name, n``: counts by kind, dangling ends, prefixes held aside, undeclared ids as
    gaps of a declared family or citations alone. One pass each over what it counts."""
    row = lambda what, name, n: [F.lit(what).alias("what"), name.alias("name"), n.cast("long").alias("n")]
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(*row("node", F.col("kind"), F.col("n")))
    links = edges.groupBy("kind").agg(F.count("*").alias("n")).select(*row("edge", F.col("kind"), F.col("n")))
    loose = edges.join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
    total = loose.agg(F.count("*").alias("n")).select(*row("dangling", F.lit(""), F.col("n")))
    held = pending.agg(F.countDistinct(family_of(F.col("target"))).alias("n")).select(*row("held aside", F.lit(""), F.col("n")))
    own = nodes.where(~F.col("id").contains(":")).select(family_of(F.col("id")).alias("family")).where("family is not null").distinct()
    bare = loose.where(~F.col("target").contains(":")).select("target", family_of(F.col("target")).alias("family")).distinct()
    bare = bare.join(own.withColumn("known", F.lit(True)), "family", "left")
    split = bare.groupBy(F.when(F.col("known"), "gap").otherwise("cited").alias("k")).agg(F.count("*").alias("n"))
    out = kinds.unionByName(links).unionByName(total).unionByName(held)
    return out.unionByName(split.select(*row("undeclared", F.col("k"), F.col("n"))))


def prime(nodes: DataFrame, edges: DataFrame, model: str | None) -> DataFrame:
    """One row: documents, code, edges, id families, and the embedding model."""
    code = F.col("kind").isin(CODE_KINDS)
    a = nodes.agg(
        F.count_if(~code).alias("documents"), F.count_if(code).alias("code"),
        F.countDistinct(F.when(~code & ~F.col("id").rlike("-M[0-9]{2}"), family_of(F.col("id")))).alias("families"),
    )
    return a.crossJoin(edges.agg(F.count("*").alias("edges"))).withColumn("model", F.lit(model))  # one row each


