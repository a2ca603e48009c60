"""Identifiers of requirements, milestones and tasks: finding them in text, and classifying.

The finder is a per-row function for extraction and mentions; ``singles`` is its native
form where ranges and slash lists need not be spelt out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to four hyphen-joined parts, each an upper-case letter and up to eleven more letters or digits.
FAMILY = r"[A-Z][A-Z0-9]{0,11}(?:-[A-Z][A-Z0-9]{0,11}){0,3}"
MILESTONE = r"^([A-Z]+)-M[0-9]{2}(?:/T[0-9]{1,4})?$"
NUMBERED = rf"^({FAMILY})-[0-9]{{1,4}}$"
#: A range wider than this keeps its first id only.
WIDEST = 50

_ID = rf"(?:[A-Z]+-M[0-9]{{2}}(?:/T[0-9]{{1,4}})?|{FAMILY}-[0-9]{{1,4}})"
_SCAN = re.compile(
    rf"(?<![A-Za-z0-9-])(?:(?P<alone>[A-Z]+-M[0-9]{{2}}(?:/T[0-9]{{1,4}})?)|(?P<family>{FAMILY})-(?P<first>[0-9]{{1,4}})"
    rf"(?:(?P<list>(?:/[0-9]{{1,4}})+)|\s*(?:…|\.\.|—|–)\s*(?P<end>(?:{FAMILY}-)?(?P<last>[0-9]{{1,4}})))?)(?![A-Za-z0-9-])"
)
_MORE = re.compile(r"/[0-9]")


def _spelt(m: re.Match) -> list[str]:
    """The identifiers that one find stands for."""
    if m["alone"]:
        return [m["alone"]]
    one, family, first = f"{m['family']}-{m['first']}", m["family"], m["first"]
    if m["list"]:
        return [f"{family}-{n}" for n in (first + m["list"]).split("/")]
    if not m["last"]:
        return [one]
    lo, hi = int(first), int(m["last"])
    if lo <= hi <= lo + WIDEST:
        return [f"{family}-{n:0{len(first)}d}" for n in range(lo, hi + 1)]
    return [one]  # too wide or downwards: no range, and its end is found on its own


def find_ids(text: str | None) -> list[tuple[str, int]]:
    """``(id, offset)`` of every identifier, ascending by offset and id, without repeats.

    One scan. A range takes its first id's family and the width of its first number, and
    spans at most ``WIDEST``; a list takes its numbers as they are written.
    """
    found: set[tuple[int, str]] = set()
    pos, text = 0, text or ""
    while (m := _SCAN.search(text, pos)) is not None:
        ids, pos = _spelt(m), m.end()
        found.update((m.start(), i) for i in ids)
        if m["last"] and m["end"] != m["last"]:
            if _MORE.match(text, pos):  # the end of a range may open a list
                pos = m.start("end")
            elif len(ids) == 1 and ids[0] != m["end"]:
                found.add((m.start("end"), m["end"]))
    return [(i, start) for start, i in sorted(found)]


def singles(text: Column) -> Column:
    """Identifiers standing alone in a text, natively."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9-])({_ID})(?![A-Za-z0-9-])"), F.lit(1))


def form_of(id_: Column) -> Column:
    """``milestone``, ``id`` or null; the milestone shape is tried first."""
    return F.when(id_.rlike(MILESTONE), "milestone").when(id_.rlike(NUMBERED), "id")


def family_of(id_: Column) -> Column:
    """The family of an identifier, null for anything else."""
    return F.when(id_.rlike(MILESTONE), F.regexp_extract(id_, MILESTONE, 1)).when(
        id_.rlike(NUMBERED), F.regexp_extract(id_, NUMBERED, 1)
    )


def family_of_text(id_: str) -> str | None:
    m = re.match(MILESTONE, id_) or re.match(NUMBERED, id_)
    return m[1] if m else None


def node_kind(id_: str) -> str:
    """The node kind an identifier declares."""
    if id_.startswith("INV-"):
        return "Invariant"
    if id_.startswith("ADR-"):
        return "Adr"
    return "Milestone" if re.fullmatch(r"[A-Z]+-M[0-9]{2}", id_) else "Requirement"


def node_kind_column(id_: Column) -> Column:
    return (
        F.when(id_.startswith("INV-"), "Invariant").when(id_.startswith("ADR-"), "Adr")
        .when(id_.rlike("^[A-Z]+-M[0-9]{2}$"), "Milestone").otherwise("Requirement")
    )
