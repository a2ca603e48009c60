"""Tokens of the lexical index."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stem


def raw_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and hyphens, without outer hyphens, of two
    characters or more. Native."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}-]+"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.trim(t, F.lit("-"))), lambda t: F.length(t) >= 2)


def stemmer():
    """A vectorised function from arrays of tokens to arrays of stems; each distinct token of a
    batch is made a Python string and stemmed once, the others are its places."""

    @F.arrow_udf("array<string>")
    def stems(tokens: pa.Array) -> pa.Array:
        coded = tokens.flatten().dictionary_encode()
        known = pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(starts, known.take(coded.indices), mask=tokens.is_null())

    return stems


def tokens(text: Column, stemmed: bool = True) -> Column:
    raw = raw_tokens(text)
    return stemmer()(raw) if stemmed else raw


def query_tokens(text: str, stemmed: bool = True) -> list[str]:
    """The same for a question, on the driver."""
    found = re.findall(r"[^\W_-]+(?:-+[^\W_-]+)*", text.lower())
    out = [t for t in found if len(t) >= 2]
    return [stem(t) for t in out] if stemmed else out
