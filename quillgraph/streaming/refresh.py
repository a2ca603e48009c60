"""Incremental refresh, the watch loop and the reader's budget.

There is no event time here: a refresh is a batch over what differs. The watch loop takes
batches from Structured Streaming, or polls; a batch too small waits, but not for ever.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bind, graph, traverse
from ..shared import folders, fresh_dir, remove
from ..sources.documents import extract

MS_PER_FILE, MS_PER_ROW = 40, 5
DEFERRALS = 3


def merged(nodes: DataFrame, edges: DataFrame, pending: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph and the rows of files just read: ``(nodes, edges, pending)``, settled anew.

    What stands is one declaration a node; declarations are replayed in path order, so the
    primary file does not depend on which files were read this time.
    """
    cols = ["id", "kind", "label", "body", "file", "line", "end", "files", "community"]
    old = nodes.select(*cols, F.lit(-1).alias("seq"))
    rows = old.unionByName(new_nodes.select(*cols, "seq"))
    out = graph.upsert(rows, ["file", "seq"])
    every = graph.union_edges(edges, pending, new_edges)
    settled = graph.settle(out, every)
    at = lambda s: settled.where(F.col("state") == s).drop("state")
    return out, at("settled"), at("pending")


def to_read(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``rel`` of the files to read again: changed ones, those that import them, and those that
    share a node with one that is read again or removed."""
    changed = changes.where("change = 'changed'").select("rel")
    wide = graph.widen_by_imports(edges, changes.select("rel"), transitive=False)
    stale = changes.select("rel").unionByName(wide).distinct()
    return graph.co_declared(nodes, stale).unionByName(changed).distinct().join(
        changes.where("change = 'removed'").select("rel"), "rel", "left_anti"
    )


def _headers(nodes: DataFrame) -> DataFrame:
    """``rel, family, header`` of code files that others name by package: all a file declares."""
    own = nodes.where("kind = 'Symbol'").select(traverse.file_of_symbol(F.col("id")).alias("rel"), F.col("id").alias("said"))
    own = own.unionByName(nodes.where("kind = 'File'").select(F.col("file").alias("rel"), F.concat(F.lit("="), "body").alias("said")))
    own = own.withColumn("family", bind.family_of(F.col("rel"))).where("family is not null")
    return own.groupBy("rel", "family").agg(F.array_sort(F.collect_set("said")).alias("header"))


def _relatives(nodes: DataFrame, changes: DataFrame, texts: DataFrame) -> DataFrame:
    """``rel``: files of the families in which a declaration came or went, for a reference may now
    be bound otherwise. An edit inside bodies widens nothing."""
    old = _headers(nodes)
    fresh, _ = extract(texts.join(changes.where("change = 'changed'"), "rel", "left_semi"))
    new = old.join(changes, "rel", "left_anti").unionByName(_headers(fresh))
    return graph.widen_by_header(old, new, exempt=())


def apply_diff(nodes: DataFrame, edges: DataFrame, pending: DataFrame, changes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph after ``changes (rel, change)``; ``texts (rel, kind, text)`` are the current files.
    Equal to a full rebuild from ``texts``."""
    again = to_read(nodes, edges, changes).unionByName(_relatives(nodes, changes, texts)).distinct().persist()
    gone = again.unionByName(changes.select("rel")).distinct()
    left, kept = graph.remove_files(nodes, edges, gone)
    _, held = graph.remove_files(nodes, pending, gone)
    new_nodes, new_edges = extract(texts.join(again, "rel", "left_semi"), known=left)
    return merged(left, kept, held, new_nodes, new_edges)


@dataclass
class Watch:
    """Decides for each poll whether to refresh: enough pending, or put off often enough."""

    batch: int = 1
    deferred: int = field(default=0)

    def due(self, pending: int) -> bool:
        if pending == 0:
            return False
        if pending >= self.batch or self.deferred >= DEFERRALS:
            self.deferred = 0
            return True
        self.deferred += 1
        return False


def watch_stream(changes: DataFrame, refresh: Callable[[DataFrame, int], None], every: str = "30 seconds", batch: int = 1, checkpoint: str | None = None, once: bool = False):
    """Run ``refresh`` over micro-batches of a streaming DataFrame of changes; small batches are
    gathered until they are due. Returns the query.

    A batch is written beside the checkpoint, by its epoch, before it counts as done, and
    removed once a refresh has read it. So what was put off outlives a restart and the end
    of a ``once`` run, and the next run over the same checkpoint refreshes it; a batch that is
    run again replaces its own rows. Without a checkpoint the folder is as short-lived as the
    query, and what a ``once`` run put off is refreshed by ``flush``."""
    spark, policy = changes.sparkSession, Watch(batch)
    held = f"{checkpoint.rstrip('/')}/held" if checkpoint else fresh_dir(spark, "held")
    schema = changes.schema

    def step(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{held}/{epoch}")
        _refreshed(spark, held, schema, lambda n: policy.due(n), refresh, epoch)

    out = changes.writeStream.foreachBatch(step)
    out = out.trigger(availableNow=True) if once else out.trigger(processingTime=every)
    query = (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
    query.flush = lambda: _refreshed(spark, held, schema, bool, refresh, -1)
    return query


def _refreshed(spark: SparkSession, held: str, schema, due: Callable[[int], bool], refresh: Callable[[DataFrame, int], None], epoch: int) -> None:
    epochs = [e for e in folders(spark, held) if e.isdigit()]
    rows = spark.read.schema(schema).parquet(*[f"{held}/{e}" for e in epochs]) if epochs else spark.createDataFrame([], schema)
    if due(rows.count()):
        refresh(rows, epoch)
        for e in epochs:
            remove(spark, f"{held}/{e}")


@dataclass(frozen=True)
class Budget:
    """How long a reader would wait for a refresh, against what it may."""

    seconds: float = 10.0

    def estimate(self, files: int, rows: int = 0) -> float:
        return (files * MS_PER_FILE + rows * MS_PER_ROW) / 1000

    def stale(self, files: int, rows: int = 0) -> dict | None:
        """What an answer is given without, if refreshing would take too long; else None."""
        return {"files": files, "vectors": rows} if self.estimate(files, rows) > self.seconds else None
