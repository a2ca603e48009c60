"""From a diff to symbols to what they affect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import traverse

_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
# How lines of comment start, by file suffix, and words that make a comment a directive.
HASH = ("py", "rb", "sh", "yaml", "yml", "toml", "tf", "hcl", "ex", "exs")
DASHES = ("sql", "lua")
DIRECTIVES = re.compile(r"eslint|ts-ignore|ts-expect-error|ts-nocheck|noqa|type:\s*ignore|pragma|nolint|noinspection|prettier-ignore|c8 ignore|istanbul|rubocop|shellcheck|go:|@ts-|^#!")


def _comment(line: str, suffix: str) -> bool:
    text = line.strip()
    if not text:
        return True
    if DIRECTIVES.search(text):
        return False
    if suffix in HASH:
        return text.startswith("#")
    if suffix in DASHES:
        return text.startswith("--")
    return text.startswith(("//", "/*", "*/", "* ")) or text == "*"


def parse_diff(diff: str) -> list[tuple[str, int, int, bool]]:
    """``(file, start, end, comment_only)`` of each hunk on the new side of a unified diff. A
    pure deletion is one line; a deleted file has none."""
    out: list[list] = []
    file, header = None, True
    for line in diff.splitlines():
        if line.startswith("diff --git "):
            file, header = None, True
        elif header and line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            file = None if name == "/dev/null" else re.sub(r"^b/", "", name)
        elif (m := _HUNK.match(line)) is not None:
            header = False
            if file is not None:
                start, count = int(m[1]), 1 if m[2] is None else int(m[2])
                start = max(start, 1)
                out.append([file, start, start + max(count, 1) - 1, True])
        elif not header and file is not None and out and line[:1] in "+-" and line:
            out[-1][3] &= _comment(line[1:], file.rpartition(".")[2])
    return [tuple(h) for h in out]


HUNKS = "file string, start int, `end` int, comment_only boolean"


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """Hunks of ``diffs (id, diff)``, with the id."""

    @F.udtf(returnType=f"id string, {HUNKS}")
    class Hunks:
        def eval(self, id_: str, diff: str):
            for h in parse_diff(diff or ""):
                yield id_, *h

    diffs.sparkSession.udtf.register("quillgraph_hunks", Hunks)
    diffs.createOrReplaceTempView("quillgraph_diffs")
    return diffs.sparkSession.sql("select h.* from quillgraph_diffs d, lateral quillgraph_hunks(d.id, d.diff) h")


def overlaps(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Hunk and symbol of one file whose lines overlap: equality on the file first, so the range
    is only compared inside it."""
    sym = nodes.where("kind = 'Symbol' and line > 0").select(
        "id", "file", F.col("line").alias("first"), F.greatest("end", "line").alias("last")
    )
    return hunks.join(sym, "file").where((F.col("first") <= F.col("end")) & (F.col("last") >= F.col("start")))


def touch(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """``id, outside``: touched symbols, or the file of a hunk outside all of them (``outside``:
    by code). A symbol is left out if one of its members is touched."""
    keys = ["file", "start", "end", "comment_only"]
    hit = overlaps(nodes, hunks).persist()
    free = hunks.join(hit.select(*keys).distinct(), keys, "left_anti")
    files = free.groupBy(F.concat(F.lit("file:"), "file").alias("id")).agg(F.max(~F.col("comment_only")).alias("outside"))
    ids = hit.select("id").distinct()
    parts = F.split(traverse.name_of_symbol(F.col("id")), r"\.")
    heads = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.lit("sym:"), traverse.file_of_symbol(F.col("id")), F.lit("::"), F.array_join(F.slice(parts, F.lit(1), i), ".")),
    )
    holders = ids.where(F.size(parts) > 1).select(F.explode(heads).alias("id")).distinct()
    return ids.join(holders, "id", "left_anti").withColumn("outside", F.lit(False)).unionByName(files)


def roots(nodes: DataFrame, touched: DataFrame) -> DataFrame:
    """``root``: touched symbols, and all symbols of a file changed by code outside of them."""
    files = touched.where("outside").select(F.regexp_replace("id", "^file:", "").alias("file"))
    whole = nodes.where("kind = 'Symbol'").join(files, "file", "left_semi").select(F.col("id").alias("root"))
    return touched.where(~F.col("id").startswith("file:")).select(F.col("id").alias("root")).unionByName(whole).distinct()


def report(snap: traverse.Snapshot, hunks: DataFrame, depth: int = 2) -> dict[str, DataFrame]:
    """``touched (id)``, ``affected (id, depth, kind, via, passed)``, ``files (file)`` and ``risk``
    (one row). All roots walk in one plan, and a dependent keeps its shallowest arrival."""
    touched = touch(snap.nodes, hunks).persist()
    start = roots(snap.nodes, touched).persist()
    found = traverse.walk(snap, start, depth)
    own = start.select(F.col("root").alias("id")).unionByName(touched.select("id"))
    rest = found.join(own.distinct(), "id", "left_anti")
    best = F.min(F.struct("depth", "passed", "root", "kind", "via")).alias("b")
    affected = rest.groupBy("id").agg(best).select("id", "b.depth", "b.kind", "b.via", "b.passed").persist()
    root_files = start.join(snap.nodes.select(F.col("id").alias("root"), "file"), "root").select("file").distinct()
    files = traverse.files_touched(snap, affected.withColumn("root", F.lit("")), traverse.importers(snap, start).withColumn("root", F.lit("")))
    files = files.select("file").distinct().join(root_files, "file", "left_anti")
    n = affected.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("affected"))
    risk = n.crossJoin(files.agg(F.count("*").alias("files")))  # one row each
    risk = risk.withColumn("risk", traverse.risk(F.col("direct"), F.col("files")))
    return {"touched": touched.select("id"), "affected": affected, "files": files, "risk": risk}
