"""Markdown documents, registries and plain texts to nodes and edges, a file at a time.

A file is parsed where it lies (``mapInPandas``), so extraction is one narrow stage; sets
are made afterwards by the graph operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import find_ids, node_kind
from ..functions.paths import folder, normalise

LONGEST_BODY = 40
_ID = r"[A-Z][A-Z0-9]*(?:-[A-Z][A-Z0-9]*)*-M?\d{1,4}"
_HEAD = re.compile(
    rf"^\s*(?:#{{1,6}}\s+|[-*]\s+\*\*|\*\*)({_ID})\s*(?:·\s*(?:(?:MUST|SHOULD|LATER)\s*·?\s*)?|[—–-]\s+|[:.]\s+)?(.*?)(?:\s+[—–-]\s*(?:MUST|SHOULD|LATER))?(?:\*\*(.*))?$"
)
_TASK = re.compile(r"^\s*[-*]\s+\[[ xX]\]\s+\*\*(T\d{1,4})\*\*\s*(.*)$")
_OWNER = re.compile(r"^(?:([A-Z]+-M\d\d).*|(ADR-\d{3,4}).*)\.md$")
_LINK = re.compile(r"\[[^\]]*\]\(([^)\s]+)\)")
_TICKS = re.compile(r"`([^`]+)`")


def lines_of(text: str) -> list[str]:
    """Lines without their ends; one trailing line end makes no empty line."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


class Extraction:
    """Rows of one file, in order of appearance."""

    def __init__(self, rel: str) -> None:
        self.rel, self.nodes, self.edges = rel, [], []
        self.package: str | None = None  # of code that other files name by package
        self.refs: list[tuple] = []  # candidates, bound once all files are read

    def node(self, id_: str, kind: str, label: str, body: str = "", line: int = 0, end: int = 0) -> None:
        self.nodes.append((id_, kind, label, body, self.rel, line, end, [self.rel], None))

    def edge(self, source: str, target: str, kind: str, context: str) -> None:
        self.edges.append((source, target, kind, context, self.rel))


def _fenced(lines: list[str]) -> list[bool]:
    out, inside = [], False
    for line in lines:
        mark = line.lstrip().startswith("```")
        out.append(inside or mark)
        inside ^= mark
    return out


def document(rel: str, text: str) -> Extraction:
    """Requirement heads with their bodies and entities, tasks, prose citations and links."""
    ex = Extraction(rel)
    lines = lines_of(text.removeprefix("﻿"))
    fenced = _fenced(lines)
    file_id = f"file:{rel}"
    ex.node(file_id, "File", rel)
    own = _OWNER.match(rel.rpartition("/")[2])
    owner = own and (own[1] or own[2])
    if owner:
        title = next((x[2:].strip() for x in lines if x.startswith("# ")), owner)
        ex.node(owner, node_kind(owner), title, "", 1, len(lines))
        ex.edge(file_id, owner, "Declares", "file")
    heads = []
    for i, line in enumerate(lines):
        m = None if fenced[i] else _HEAD.match(line)
        if m is not None and not (owner and m[1] == owner):
            heads.append((i, m[1], m[2].strip(" *"), (m[3] or "").strip()))
    covered = set()
    for n, (i, id_, title, tail) in enumerate(heads):
        stop = min(heads[n + 1][0] if n + 1 < len(heads) else len(lines), i + 1 + LONGEST_BODY)
        end = next((j for j in range(i + 1, stop) if lines[j].startswith("#") and not fenced[j]), stop)
        covered.update(range(i, end))
        body = "\n".join(([tail] if tail else []) + lines[i + 1 : end]).strip()
        ex.node(id_, node_kind(id_), title.rstrip(". "), body, i + 1, end)
        ex.edge(owner or file_id, id_, "Declares", "title")
        for name in _TICKS.findall(lines[i]):
            if not find_ids(name):
                ex.node(f"entity:{name}", "Entity", name, "", i + 1, i + 1)
                ex.edge(id_, f"entity:{name}", "References", "title")
        for cited in dict.fromkeys(c for c, _ in find_ids("\n".join(lines[i:end]))):
            if cited != id_:
                ex.edge(id_, cited, "References", "body")
    for i, line in enumerate(lines):
        t = _TASK.match(line) if owner and not fenced[i] else None
        if t is not None:
            task = f"{owner}/{t[1]}"
            ex.node(task, "Task", t[2].strip(), "", i + 1, i + 1)
            ex.edge(owner, task, "Declares", "task")
            for cited, _ in find_ids(t[2]):
                ex.edge(task, cited, "Implements", "task")
        elif i not in covered:
            for cited, _ in find_ids(line):
                if cited != owner:
                    ex.edge(owner or file_id, cited, "References", "prose")
    for i, line in enumerate(lines):
        if fenced[i]:
            continue
        for target in _LINK.findall(line):
            bare = target.partition("#")[0]
            if bare and "://" not in bare and not bare.startswith("mailto:"):
                ex.edge(file_id, f"file:{normalise(folder(rel), bare)}", "Links", "link")
    return ex


def registry(rel: str, text: str) -> Extraction:
    """Invariants of a YAML registry. One malformed row leaves the file without rows."""
    ex = Extraction(rel)
    ex.node(f"file:{rel}", "File", rel)
    try:
        rows = (yaml.safe_load(text) or {}).get("invariants") or []
        for r in rows:
            if not isinstance(r, dict) or not isinstance(r["id"], str):
                raise ValueError("a row without an id")
    except (yaml.YAMLError, ValueError, KeyError, AttributeError, TypeError):
        return ex
    for n, r in enumerate(rows, 1):
        said = str(r.get("statement") or "")
        bold = re.search(r"\*\*(.+?)\*\*", said, re.S)
        label = bold[1] if bold else (said.splitlines() or [""])[0]
        rest = said.replace(bold[0], "", 1).strip() if bold else "\n".join(said.splitlines()[1:])
        ex.node(r["id"], "Invariant", label, f"{rest}\n{r.get('mechanism') or ''}", n, n)
        ex.edge(f"file:{rel}", r["id"], "Declares", "title")
        if r.get("test_ref"):
            ref = str(r["test_ref"])
            ex.edge(r["id"], ("file:" if "/" in ref else "gate:") + ref, "Implements", "test_ref")
        for cited, _ in find_ids(str(r.get("basis") or "")):
            ex.edge(r["id"], cited, "References", "basis")
    return ex


def plain(rel: str, text: str) -> Extraction:
    """One node, no edges."""
    ex = Extraction(rel)
    ex.node(f"file:{rel}", "Text", rel.rpartition("/")[2], text, 1, len(lines_of(text)))
    return ex


ROWS = "nodes array<struct<id:string,kind:string,label:string,body:string,file:string,line:int,`end`:int,files:array<string>,community:string>>, edges array<struct<source:string,target:string,kind:string,context:string,file:string>>, rel string, refs array<struct<n:int,source:string,kind:string,context:string,rank:int,package:string,name:string,proven:boolean>>"


def extract_one(rel: str, kind: str, text: str) -> Extraction:
    from .code import code

    return {"Doc": document, "Registry": registry, "Text": plain, "Code": code}[kind](rel, text)


def extract(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` rows, with repeats, of ``files (rel, kind, text)``. Nodes carry ``seq``.
    References are bound to what ``files`` and the ``known`` nodes of other files declare."""
    from ..operators import bind

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [extract_one(*r) for r in pdf[["rel", "kind", "text"]].itertuples(index=False)]
            yield pd.DataFrame({"nodes": [e.nodes for e in out], "edges": [e.edges for e in out], "rel": pdf["rel"].to_list(), "refs": [e.refs for e in out]})

    rows = files.select("rel", "kind", "text").mapInPandas(run, ROWS).persist()
    nodes = rows.select(F.posexplode("nodes").alias("seq", "n")).select("n.*", "seq")
    every = nodes.drop("seq") if known is None else nodes.drop("seq").unionByName(known.select(*nodes.drop("seq").columns))
    edges = bind.retarget(rows.select(F.inline("edges")), every)
    return nodes, edges.unionByName(bind.bind(rows.select("rel", F.inline("refs")), every))
