"""Native column expressions for the word rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word between blanks: what is neither a space nor one of the controls 9 to 13.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters, digits and everything outside ASCII, once A-Z are lower-cased.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_of(col: str | Column) -> Column:
    """The text, or an empty one where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; all-ASCII texts take the faster built-in."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


def blank_words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(BLANK_WORD), F.lit(0))


def plain_words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(PLAIN_WORD), F.lit(0))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, k: int) -> Column:
    """64-bit hashes of every run of ``k`` consecutive word hashes; empty when there is none."""
    n = F.size(hashes)
    starts = F.sequence(F.lit(1), n - F.lit(k - 1))
    return F.when(
        n >= k, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(k))))
    ).otherwise(F.array().cast("array<bigint>"))
