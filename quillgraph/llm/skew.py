"""Joins of many rows with one row a key, where a key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are salted at most, and rows of a key from which it is; a salt gets as many.
HOT_KEYS, HOT_ROWS = 20_000, 1_000


def salts_of(weight: Column) -> Column:
    """Into how many parts a key of so many rows is dealt."""
    return (F.floor(weight / HOT_ROWS) + 1).cast("int")


def join_by_key(rows: DataFrame, by: DataFrame, keys: list[str], weight: str, spread: Column, values: list[str] | None = None) -> DataFrame:
    """``rows`` without ``keys``, joined (inner) with the columns ``values`` of ``by``, which has one
    row a key and the key's number of rows in ``weight``. ``by`` is read twice: write it first.

    Rows of the ``HOT_KEYS`` heaviest keys (a broadcast of a key and a number each) are dealt
    by key and salt, and ``by`` has a copy of such a key for each salt: one more row for
    ``HOT_ROWS`` of ``rows``. So no task gets more rows of one key than the next heaviest has, one
    in ``HOT_KEYS`` of all at most. Nothing is left out, and what is shuffled is no wider.
    """
    first, rest = keys[0], keys[1:]
    kind = dict(rows.dtypes)[first]
    hot = by.where(F.col(weight) > HOT_ROWS).orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(*keys, salts_of(F.col(weight)).alias("_salts")))

    def dealt(salt: Column) -> Column:
        own = F.col(first).cast("binary") if kind != "bigint" else F.col(first)
        both = F.xxhash64(own, salt) if kind == "bigint" else F.md5(F.concat(own, salt.cast("string").cast("binary"))).cast(kind)
        return F.when(F.col("_salts").isNull(), F.col(first)).otherwise(both).alias("_deal")

    others = [c for c in rows.columns if c not in keys]
    values = [c for c in by.columns if c not in keys] if values is None else values
    left = rows.join(hot, keys, "left").select(dealt(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")), *rest, *others)
    right = by.select(*keys, *{weight: 0, **dict.fromkeys(values)}).join(hot, keys, "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
    right = right.select(dealt(F.col("_salt")), *rest, *values)
    return left.join(right, ["_deal", *rest]).select(*others, *values)
