"""The tree scan: listing, classification, pruning by recorded stamps, hashing and diffs.

Listings are DataFrames; on a cluster they come from ``binary_files``, which Spark lists and
reads in parallel, with path filters pushed to the listing.
"""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MANIFEST

HEAD, LARGEST = 8_000, 1 << 20
STORE = ".quillgraph"
# What is never read, unless it is a template, and texts that are refused.
SECRETS = [".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa*", "id_ed25519*", "*.keystore", ".npmrc", ".netrc", "credentials*"]
TEMPLATES = ["*.example", "*.sample", "*.template"]
REFUSED = ["*.lock", "package-lock.json", "*.min.js", "*.min.css", "*.map", "*.svg"]


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**/`` any folders, ``*`` within one."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def matches(rel: Column, globs: list[str]) -> Column:
    """Whether a path, or its last part for globs without a slash, matches any glob."""
    if not globs:
        return F.lit(False)
    leaf = F.element_at(F.split(rel, "/"), -1)
    tests = [(rel if "/" in g else leaf).rlike(glob_regex(g)) for g in globs]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def included(rel: Column, include: list[str]) -> Column:
    """Under a plain folder or matching a glob of ``include``; nothing or ``.`` means all."""
    clean = [re.sub(r"^\./|/$", "", i.strip()).strip("/") for i in include]
    if not clean or any(c in ("", ".") for c in clean):
        return F.lit(True)
    out = F.lit(False)
    for c in clean:
        out = out | (rel.rlike(glob_regex(c)) if any(x in c for x in "*?") else (rel == c) | rel.startswith(c + "/"))
    return out


def classify(rel: Column, config: dict) -> Column:
    """Registry, Doc, Code, Text or null, in that precedence; secrets and skipped paths are null."""
    low = F.lower(rel)
    secret = matches(low, SECRETS) & ~matches(low, TEMPLATES)
    text = matches(rel, config.get("text_globs", [])) & ~matches(rel, REFUSED)
    kind = (
        F.when(matches(rel, config.get("registries", [])), "Registry").when(matches(rel, config.get("doc_globs", [])), "Doc")
        .when(matches(rel, config.get("code_globs", [])), "Code").when(text, "Text")
    )
    return F.when(~secret & ~matches(rel, config.get("skip", [])) & included(rel, config.get("include", [])), kind)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``rel, mtime_ns, len`` of a local working tree, git's ignore rules observed where there is
    a repository; the git folder and the store are left out."""
    run = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True)
    if run.returncode == 0:
        names = [n for n in run.stdout.decode(errors="surrogateescape").split("\0") if n]
    else:
        names = [str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file()]
    rows = []
    for rel in sorted(set(names)):
        if rel.startswith((".git/", f"{STORE}/")) or not os.path.isfile(f"{root}/{rel}"):
            continue
        s = os.stat(f"{root}/{rel}")
        rows.append((rel, s.st_mtime_ns, s.st_size))
    return spark.createDataFrame(rows, "rel string, mtime_ns long, len long")


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """``rel, mtime_ns, len, content`` of any tree Spark can reach; ``len`` prunes before reading."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(base), "")
    stamp = (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")
    return df.select(rel.alias("rel"), stamp, F.col("length").alias("len"), "content")


def prune(listed: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(known, unread)``: entries whose recorded stamp still holds, with the recorded hash, and
    those to open. No file of the first is read."""
    m = manifest.select("rel", F.col("mtime_ns").alias("_m"), F.col("len").alias("_l"), "hash")
    both = listed.join(m, "rel", "left")
    same = (F.col("_m") == F.col("mtime_ns")) & (F.col("_l") == F.col("len")) & F.col("hash").isNotNull()
    both = both.withColumn("_same", F.coalesce(same, F.lit(False)))
    return both.where("_same").drop("_m", "_l", "_same"), both.where("not _same").drop("_m", "_l", "_same", "hash")


def readable(files: DataFrame) -> DataFrame:
    """Without binary files (a NUL in the head), oversized ones and invalid UTF-8."""
    head = F.substring("content", 1, HEAD)
    binary = F.locate("00", F.regexp_replace(F.hex(head), "(..)", "$1 ")) > 0
    return files.where((F.col("len") <= LARGEST) & F.expr("is_valid_utf8(cast(content as string))") & ~binary)


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.sha2("content", 256))


def entries(spark: SparkSession, root: str, config: dict, manifest: DataFrame | None = None) -> DataFrame:
    """``rel, kind, hash, mtime_ns, len`` of all that is to be read."""
    listed = listing(spark, root).withColumn("kind", classify(F.col("rel"), config)).where("kind is not null")
    manifest = spark.createDataFrame([], MANIFEST) if manifest is None else manifest
    known, unread = prune(listed, manifest)
    content = binary_files(spark, root).select("rel", "content")
    opened = hashed(readable(unread.where(F.col("len") <= LARGEST).join(content, "rel")))
    cols = ["rel", "kind", "hash", "mtime_ns", "len"]
    return known.select(cols).unionByName(opened.select(cols))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``rel, change``: changed (new, another hash or kind) or removed."""
    both = old.select("rel", F.col("hash").alias("h0"), F.col("kind").alias("k0")).join(
        new.select("rel", F.col("hash").alias("h1"), F.col("kind").alias("k1")), "rel", "full"
    )
    change = F.when(F.col("h1").isNull(), "removed").when(
        F.col("h0").isNull() | (F.col("h0") != F.col("h1")) | (F.col("k0") != F.col("k1")), "changed"
    )
    return both.select("rel", change.alias("change")).where("change is not null")


def plain_match(rel: str, globs: list[str]) -> bool:
    """The driver's form of ``matches``."""
    leaf = rel.rpartition("/")[2]
    return any(re.match(glob_regex(g), rel) if "/" in g else fnmatch.fnmatchcase(leaf, g) for g in globs)
