"""Other sources: git diffs, earlier graphs, question cases, configuration."""

from __future__ import annotations

import os
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import singles
from ..operators.changes import HUNKS, parse_diff
from .tree import STORE

# The keys a configuration may hold, with what they are if left out.
DEFAULTS = {
    "doc_globs": ["**/*.md"], "code_globs": ["**/*.py", "**/*.ts", "**/*.tsx", "**/*.js", "**/*.sql"], "text_globs": [],
    "skip": [], "include": [], "registries": ["docs/constitution.yaml"], "embed_model": "hashing-64", "rerank_command": "",
    "rerank_model": "", "resources": "balanced", "reader_budget": 10, "mcp_reranks": 25,
}
COMMANDS = {"rerank_command"}
PREFIX = "QUILLGRAPH_"


def load_config(project: str | None = None, machine: str | None = None, env: dict[str, str] | None = None) -> dict:
    """Project file, then machine file, then environment; unknown keys are errors, and commands
    are not taken from a project's file."""
    out = dict(DEFAULTS)
    for path, trusted in ((project, False), (machine, True)):
        if path and Path(path).exists():
            data = tomllib.loads(Path(path).read_text())
            if unknown := set(data) - set(DEFAULTS):
                raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
            if not trusted and (bad := COMMANDS & set(data)):
                raise ValueError(f"{path}: {sorted(bad)} may only be set for the machine")
            out |= data
    for key, value in (os.environ if env is None else env).items():
        name = key.removeprefix(PREFIX).lower()
        if key.startswith(PREFIX) and name in DEFAULTS:
            kind = type(DEFAULTS[name])
            out[name] = value.split(",") if kind is list else kind(value)
    return out


def git_hunks(spark: SparkSession, repo: str, base: str = "HEAD") -> DataFrame:
    """Hunks of the working tree against ``base``, and untracked files whole."""
    if base.startswith("-"):
        raise ValueError("a base does not start with a dash")
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    git = ["git", "-C", repo, "-c", "core.quotepath=false"]
    run = lambda *a: subprocess.run([*git, *a], capture_output=True, env=env, check=True).stdout.decode(errors="replace")
    rows = parse_diff(run("diff", "-U0", "--no-color", "--no-ext-diff", base))
    for rel in run("ls-files", "-o", "--exclude-standard", "-z").split("\0"):
        if rel:
            n = Path(repo, rel).read_bytes().count(b"\n")
            rows.append((rel, 1, max(n, 1), False))
    return spark.createDataFrame([r for r in rows if not r[0].startswith(f"{STORE}/")], HUNKS)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """``pos, q, kind, expect array`` of a JSONL file: blank lines are skipped, a malformed one is
    an error, a single anchor becomes an array of one."""
    lines = spark.read.text(path).where("trim(value) != ''").select(F.monotonically_increasing_id().alias("pos"), "value")
    got = F.from_json("value", "kind string, q string, expect string", {"mode": "FAILFAST"})
    rows = lines.select("pos", got.alias("c"))
    many = F.from_json("c.expect", "array<string>")
    one = F.when(F.col("c.expect").startswith("["), many).otherwise(F.array("c.expect"))
    return rows.select("pos", "c.q", "c.kind", one.alias("expect"))


def import_graph(nodes: DataFrame, graph: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, concepts, counts)`` of an earlier tool's graph (``nodes``, ``links`` arrays) laid
    over ``nodes``: an end is resolved by an identifier in its label, then by file name and
    label, or becomes a concept; ends of syntax trees and self-loops are dropped."""
    old = graph.select(F.inline("nodes")).select(
        F.col("id").alias("gid"), "label", F.element_at(F.split("source_file", "/"), -1).alias("leaf"),
        F.col("_origin").alias("origin"), F.col("community_name").alias("community"),
    ).where("origin is null or origin != 'ast'")
    cited = F.try_element_at(singles(F.col("label")), F.lit(1))
    by_id = nodes.select(F.col("id").alias("named"))
    old = old.withColumn("cited", cited).join(by_id, F.col("cited") == F.col("named"), "left")
    place = nodes.select(F.element_at(F.split("file", "/"), -1).alias("leaf"), F.lower("label").alias("low"), F.col("id").alias("placed"))
    place = place.groupBy("leaf", "low").agg(F.min("placed").alias("placed"))
    old = old.withColumn("low", F.lower("label")).join(place, ["leaf", "low"], "left")
    found = F.coalesce("named", "placed")
    old = old.withColumn("id", F.coalesce(found, F.concat(F.lit("legacy:"), "gid"))).withColumn("resolved", found.isNotNull()).persist()
    links = graph.select(F.inline("links"))
    end = lambda c, side: old.select(F.col("gid").alias(c), F.col("id").alias(side), F.col("resolved").alias(f"{side}_ok"))
    both = links.join(end("source", "a"), "source").join(end("target", "b"), "target").persist()
    edges = both.where("a != b").select(
        F.col("a").alias("source"), F.col("b").alias("target"), F.lit("Legacy").alias("kind"),
        F.coalesce("relation", F.lit("")).alias("context"), F.lit("").alias("file"),
    ).distinct()
    used = both.where("a != b").select(F.col("a").alias("id")).unionByName(both.where("a != b").select(F.col("b").alias("id"))).distinct()
    concepts = old.where("not resolved").join(used, "id", "left_semi").select("id", F.lit("LegacyConcept").alias("kind"), "label", "community").distinct()
    counts = both.agg(
        F.count("*").alias("edges_seen"), F.count_if(F.col("a_ok") & F.col("b_ok")).alias("resolved_both"),
        F.count_if(F.col("a_ok") != F.col("b_ok")).alias("resolved_one"), F.count_if(F.col("a") == F.col("b")).alias("self_loops"),
    ).crossJoin(concepts.agg(F.count("*").alias("concepts_created")))  # one row each
    return edges, concepts, counts
