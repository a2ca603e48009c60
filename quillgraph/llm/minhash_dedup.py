"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set: its distinct ``shingle``-word runs (64-bit hashes). Two permutations of
the 32-bit universe make all ``COORDS`` coordinates: sigma scatters the set once, and
coordinate k is the least value of pi over the set shifted circularly by k. ``BANDS`` bands
of ``ROWS`` coordinates propose pairs: of a pair at the threshold of 0.8,
(1 - 0.8 ** 4) ** 32 = 5e-8 go unproposed. Every proposed pair is verified on full sets.

Rows are told apart by a number they get when they are signed, never by id: ids may repeat
or be null. A row's text is found again by its id and a 64-bit hash of the text.

Copies and skew: equal sets (by size and 128-bit digest) are one class with its first row
(least id, null last) as its representative, and only representatives are banded. A bucket is never paired with
itself. Its members are verified against its hub, the member with the most company in all
its buckets (of a text and its edited copies, the text). Members of one component need no
more verification; what is left are buckets that still hold several components, mostly of
texts that share a passage. Their members (``open``) are compared by an exact prefix join,
which loses no pair at the threshold: elements are ordered rarest first by a sketch of
``SKETCH`` counters over all open sets (any order is right, a good one is fast), pairs must
share an element of both prefixes, be of the same or neighbouring class of sizes (which
blocks the join), pass the length and positional filters, and lie in different components, whose largest is never paired with itself. They too are verified.
All links stay in Spark, and components are found by alternating stars.

Edge cases: a null or empty text and one without words has an empty set and is linked
with nothing; a text of fewer words than ``shingle`` has one element, the whole sequence;
rows with a null id are linked as all others; of repeated rows, and of one id's texts, one
row a group is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prints
from .components import components
from .scratch import written
from .skew import join_by_key

ROWS, BANDS, SKETCH = 4, 32, 1 << 19
COORDS = ROWS * BANDS
#: Elements hashed at once: COORDS * CHUNK 32-bit numbers fit a core's cache.
CHUNK = 1024
_SHIFTS = (np.arange(COORDS, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_BANDS = prints.mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of the text, A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = prints.word_hashes(words)
    return np.unique(prints.mixed(prints.rolling(hashes, min(size, len(hashes)))))


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(elements: np.ndarray) -> np.ndarray:
    """The COORDS coordinates of a set: pi over sigma's values, shifted by each k."""
    scattered = (prints.mixed(elements + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(scattered), CHUNK):
        part = _pi(_SHIFTS[:, None] + scattered[None, i : i + CHUNK])
        np.minimum(least, part.min(axis=1), out=least)
    return least


def bands(coords: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of ROWS coordinates; which band is hashed in."""
    pairs = coords.view(np.uint64).reshape(BANDS, ROWS // 2)
    out = _BANDS.copy()
    for i in range(ROWS // 2):
        out = prints.mixed(out ^ pairs[:, i])
    return out


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, found = [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                found.append(bands(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["_key"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "_key", "n", "digest", "bands"],
            )

    return sign


def _setter(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shingles(t, size).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.binary())], names=["id", "elements"])

    return sets


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            hub, last = None, None
            for x, y in zip(batch["sa"], batch["sb"]):
                x, y = x.as_buffer(), y.as_buffer()
                if last is None or not last.equals(x):
                    hub, last = np.frombuffer(x, np.uint64), x
                other = np.frombuffer(y, np.uint64)
                at = np.searchsorted(hub, other)
                at[at == len(hub)] = 0
                both = int(np.count_nonzero(hub[at] == other))
                keep.append(100 * both >= percent * (len(hub) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("sb")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(_verifier(percent), "a long, b long")


def _fits(a: str, b: str, percent: int):
    """Length filter: sets of such sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _slots(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(44)).astype(np.int64) % SKETCH


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["elements"]]
        if whole:
            counts += np.bincount(_slots(np.concatenate(whole)), minlength=SKETCH)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "times"])


def _prefixer(sketch, percent: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.int64)
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, root, x in zip(batch["id"].to_pylist(), batch["root"].to_pylist(), batch["elements"]):
                e = np.frombuffer(x.as_buffer(), np.uint64)
                times = counts[_slots(e)]
                length = len(e) + (-len(e) * percent // 100) + 1
                first = np.lexsort((e, times))[:length]
                at = np.flatnonzero(times[first] > 1)  # what no other set holds joins nothing
                m = len(at)
                for c, v in zip(cols, (e[first[at]].view(np.int64), np.full(m, i), np.full(m, root), np.full(m, len(e)), at)):
                    c.append(v)
            names = ["h", "id", "root", "n", "at"]
            empty = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *c])) for c in cols], names=names)

    return prefixes


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components of ``open_ (id, root)`` that can reach the threshold."""
    spark = open_.sparkSession
    own = written(sets.join(open_, "id").select("id", "root", "elements"), "open")
    counts = own.select("elements").mapInArrow(_counter, "slot long, times long")
    counts = counts.groupBy("slot").agg(F.sum("times").alias("times")).toArrow()  # SKETCH rows at most
    table = np.zeros(SKETCH, np.int64)
    table[counts["slot"].to_numpy()] = counts["times"].to_numpy()
    sketch = spark.sparkContext.broadcast(table.tobytes())
    rows = written(own.mapInArrow(_prefixer(sketch, percent), "h long, id long, root long, n long, at long"), "prefixes")
    by_root = rows.groupBy("h", "root").agg(F.count("*").alias("k"))
    top = by_root.groupBy("h").agg(F.max(F.struct("k", "root"))["root"].alias("top"), F.count("*").alias("roots"))
    rows = rows.join(top.where("roots > 1").drop("roots"), "h")
    # sets that can reach the threshold are in the same class of sizes or in the next
    rows = rows.withColumn("class", F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int"))
    near = F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])).alias("class_x")
    x = rows.where("root != top").select("h", near, *[F.col(c).alias(f"{c}_x") for c in ("id", "root", "n", "at")])
    both = F.col("n") + F.col("n_x")
    reach = 1 + F.least(F.col("n") - F.col("at"), F.col("n_x") - F.col("at_x")) - 1
    likely = (
        (F.col("root") != F.col("root_x"))
        & ((F.col("root") == F.col("top")) | (F.col("id") > F.col("id_x")))
        & _fits("n", "n_x", percent)
        & (reach * (100 + percent) >= both * percent)
    )
    pairs = rows.join(x, (rows["h"] == x["h"]) & (rows["class"] == x["class_x"]) & likely)
    return pairs.select(F.least("id", "id_x").alias("a"), F.greatest("id", "id_x").alias("b")).distinct()


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))


def _key() -> Column:
    """With ``_id``, what tells apart the texts of one id, and null from the id -1."""
    return F.xxhash64(F.col("text").cast("binary"), F.col("doc_id").isNull())


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, _key, n, row`` (a number), and ``first`` (the first row of its group, null where
    the set is empty): a row a row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _id().alias("_id"), _key().alias("_key"), F.col("text").cast("binary").alias("text"))
    signed = texts.select("doc_id", "_key", "text").mapInArrow(
        _signer(shingle), "doc_id long, _key long, n long, digest binary, bands array<long>"
    )
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "row")
    classes = written(signed.where("n > 0").groupBy("n", "digest").agg(F.min(order).alias("least"), F.count("*").alias("rows")), "classes")
    reps = signed.join(classes.select(F.col("least.row").alias("row")), "row", "left_semi")
    members = reps.select(F.col("row").alias("id"), "n", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(full, "bucket"), "buckets")
    company = shared.groupBy("id").agg(F.sum("size").alias("company"))
    shared = written(shared.join(company, "id").select("bucket", "id", "n", "company"), "buckets")
    hubs = shared.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"), "n")).alias("hub"))
    star = shared.join(hubs, "bucket").withColumn("to", -F.col("hub.minus"))
    star = star.where((F.col("to") != F.col("id")) & _fits("n", "hub.n", percent))
    pairs = written(star.select(F.col("to").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    places = classes.select(F.col("least.row").alias("id"), F.coalesce("least.doc_id", F.lit(-1)).alias("_id"), F.col("least._key").alias("_key"))
    places = places.join(shared.select("id").distinct(), "id", "left_semi")
    sets = texts.select("_id", "_key", "text").join(places, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    sets = written(sets.select("id", "text").mapInArrow(_setter(shingle), "id long, elements binary"), "sets")
    found = written(links(pairs, sets, percent), "links")
    roots = components(found)
    at = shared.select("bucket", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = at.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    open_ = at.join(several.select("bucket"), "bucket", "left_semi").select("id", "root").distinct()
    more = written(_prefix_pairs(written(open_, "open"), sets, percent), "pairs")
    new = written(links(more, sets, percent), "links")
    if not new.isEmpty():
        roots = components(found.unionByName(new))
    rooted = classes.withColumn("id", F.col("least.row")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    rooted = rooted.join(first, "root").select("digest", "n", "first", "rows")
    own = signed.select("doc_id", "_key", "n", "row", "digest")
    own = own.withColumn("size", F.col("n"))
    some = join_by_key(own.where("n > 0"), rooted, ["digest", "n"], "rows", F.col("row"), ["first"])
    none = own.where("n = 0").drop("digest", "n").withColumn("first", F.lit(None).cast(rooted.schema["first"].dataType))
    return some.unionByName(none).withColumnRenamed("size", "n")


def judge(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the group's least id) and ``kept`` (the row is its
    group's first, or in none): a row a row of ``docs``."""
    kept = F.col("first").isNull() | (F.col("row") == F.col("first.row"))
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return _judged(docs, shingle, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept")
    )


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with the columns it came with."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _id().alias("_id"), _key().alias("_key"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_key") == F.col("first._key"))
    lost = _judged(docs, shingle, percent).where("row != first.row").select(_id().alias("_id"), "_key", own.alias("own"))
    lost = written(lost.distinct(), "lost")
    out = out.join(lost.where("not own"), ["_id", "_key"], "left_anti")
    again = lost.where("own").select("_id", "_key")  # the kept row itself repeats
    if not again.isEmpty():
        once = out.join(again, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
        out = out.join(again, ["_id", "_key"], "left_anti").unionByName(once)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
