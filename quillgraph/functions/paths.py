"""Repository-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(base: str, target: str) -> str:
    """``target`` seen from the folder ``base``: ``.`` and ``..`` are folded, a leading slash
    is the root, and ``..`` above the root is dropped."""
    parts: list[str] = []
    whole = target if target.startswith("/") else f"{base}/{target}"
    for part in whole.split("/"):
        if part == "..":
            if parts:
                parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def normalise_column(path: Column) -> Column:
    """The same natively, for whole paths: one fold over the parts, as a stack."""
    step = lambda acc, p: (
        F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "") | (p == "."), acc)
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(rel: str) -> str:
    return rel.rpartition("/")[0]
