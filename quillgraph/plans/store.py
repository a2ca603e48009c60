"""Snapshots: each version a folder of Parquet tables, and a pointer that is swapped at once.

A writer that dies leaves an unreferenced folder and the old pointer; readers see whole
versions only. The pointer and the lock are small driver-side files beside the tables.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import EDGES, GRAMMAR, MANIFEST, NODES, VECTORS

TABLES = {"nodes": NODES, "edges": EDGES, "pending": EDGES, "manifest": MANIFEST, "vectors": VECTORS}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @property
    def _pointer(self) -> Path:
        return self.root / "CURRENT"

    def state(self) -> dict:
        """``version``, ``grammar`` and ``model``; an empty store has version None and grammar 0."""
        if not self._pointer.exists():
            return {"version": None, "grammar": 0, "model": None}
        return json.loads(self._pointer.read_text())

    def table(self, name: str) -> DataFrame:
        version = self.state()["version"]
        if version is None or not (self.root / version / name).exists():
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(self.root / version / name))

    def save(self, tables: dict[str, DataFrame], grammar: int = GRAMMAR, model: str | None = None) -> str:
        """Write a new version (tables not given are carried over) and point to it."""
        version = f"v={uuid.uuid4().hex}"
        now = self.state()
        for name in TABLES:
            df = tables.get(name)
            df = self.table(name) if df is None else df
            df.select(TABLES[name].fieldNames()).write.parquet(str(self.root / version / name))
        temp = self.root / f".{uuid.uuid4().hex}"
        temp.write_text(json.dumps({"version": version, "grammar": grammar, "model": model or now["model"]}))
        os.replace(temp, self._pointer)
        return version

    @contextlib.contextmanager
    def writer(self, wait: bool = True) -> Iterator[bool]:
        """The writers' lock; gives False if another holds it and ``wait`` is off."""
        with (self.root / "LOCK").open("w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | (0 if wait else fcntl.LOCK_NB))
            except BlockingIOError:
                yield False
                return
            yield True
