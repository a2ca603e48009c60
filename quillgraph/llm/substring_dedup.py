"""Substring dedup: every word of a 35-word window that also starts elsewhere goes.

1. Anchors. Of each window's runs of ``GRAM`` words one is chosen by its hash (content
   alone decides), so equal windows choose equal runs. Anchor hashes are counted in Spark;
   a window whose anchor is unique is unique and goes no further.
2. Windows. All others are hashed by Rabin-Karp (two bases, 96 bits in all) and counted in
   Spark. Windows counted twice or more are joined back to their places and merged into
   maximal runs of removed words.

Documents are told apart by id and, where ids repeat, by 64 bits of the text's hash. Of
equal texts of at least a window, one stands for all and the others inherit its result:
their every word goes, as each window starts elsewhere. All counting is map-side combined.
All joins by content have one row a key on one side; keys of many rows do not meet in a
task (``skew``). No group is collected but a document's own places.

Edge cases: ``doc_id`` is a number, or a text that casts to one (others are an error under
ANSI rules); rows without an id are documents; a null or empty text has no words; a text
of fewer than 35 words keeps all; repeated rows are copies of one another; an empty table gives an empty result; texts of
any length are hashed in O(n).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prints
from .scratch import written
from .skew import join_by_key, salts_of
from .text import text_of

WINDOW, GRAM = 35, 8
SPAN = WINDOW - GRAM + 1


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))


def text_key(docs: DataFrame) -> Column:
    """What tells apart texts that share an id: 0 if no id repeats (every shuffled place carries
    it, and a constant costs nothing there), else 64 bits of the text's hash.

    The 0 is one that the optimizer neither sees through nor takes for nullable: a literal
    would be folded out of the join keys, and a check for null would be added on one side
    of two; either way the dealt texts would be dealt twice.
    """
    if docs.groupBy(_id()).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1).cast("long")), F.lit(0).cast("long"))
    return F.xxhash64(text_of(F.col("text").cast("string")))


def keyed(docs: DataFrame, key: Column, *keep) -> DataFrame:
    """``_id, _key`` and the columns ``keep``."""
    return docs.select(_id().alias("_id"), key.alias("_key"), *keep)


def find_words(text: bytes | None) -> list[bytes]:
    """Of UTF-8: bytes.split() parts at the space and the controls 9 to 13, no others."""
    return text.split() if text else []


def _flush(cols: list[list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)).cast(f.type) for c, f in zip(cols, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class Rows:
    """Gathers column pieces and gives batches of a bounded number of rows."""

    def __init__(self, schema: pa.Schema, most: int = 200_000) -> None:
        self.schema, self.most, self.n = schema, most, 0
        self.cols: list[list[np.ndarray]] = [[] for _ in schema]

    def add(self, n: int, *values) -> Iterator[pa.RecordBatch]:
        for c, v in zip(self.cols, values):
            c.append(v if isinstance(v, np.ndarray) else np.full(n, v, np.int64))
        self.n += n
        if self.n >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield _flush(self.cols, self.schema)
            self.cols, self.n = [[] for _ in self.schema], 0


_ANCHORS = pa.schema([("h", pa.int64()), ("_id", pa.int64()), ("_key", pa.int64()), ("at", pa.int32())])
_WINDOWS = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("salts", pa.int32()), ("_id", pa.int64()), ("_key", pa.int64()), ("at", pa.int32())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(_ANCHORS)
    for batch in batches:
        for i, key, text in zip(*(batch[c].to_pylist() for c in ("_id", "_key", "text"))):
            words = find_words(text)
            if len(words) < WINDOW:
                continue
            grams = prints.mixed(prints.rolling(prints.word_hashes(words), GRAM))
            at, _, _ = prints.anchors(grams, SPAN)
            yield from rows.add(len(at), grams[at].view(np.int64), i, key, at.astype(np.int32))
    yield from rows.rest()


def chosen_by(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose own anchor is one of those at the ascending ``at``, ascending,
    and which of ``at`` that is."""
    places, lo, hi = prints.anchors(prints.mixed(prints.rolling(words, GRAM)), SPAN)
    take = np.isin(places, at)
    lo, size = lo[take], hi[take] - lo[take] + 1
    starts = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    return starts, np.repeat(np.searchsorted(at, places[take]), size)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(_WINDOWS)
    for batch in batches:
        for i, key, text, spots in zip(*(batch[c].to_pylist() for c in ("_id", "_key", "text", "_at"))):
            words = prints.word_hashes(find_words(text))
            spots.sort(key=lambda s: s["at"])
            at, salts = (np.fromiter((s[c] for s in spots), np.int64, len(spots)) for c in ("at", "salts"))
            starts, of = chosen_by(words, at)
            h = prints.rolling(words, WINDOW)[starts].view(np.int64)
            g = (prints.mixed(prints.rolling(words, WINDOW, 1)[starts]) >> np.uint64(32)).astype(np.int64)
            yield from rows.add(len(starts), h, g, salts[of].astype(np.int32), i, key, starts.astype(np.int32))
    yield from rows.rest()


def removed_words(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + WINDOW, -1)
    return np.cumsum(mark[:n]) > 0


def copies_of(docs: DataFrame, key: Column) -> DataFrame:
    """``_id, _key, _rep`` of every text that others equal; ``_rep`` is the least id of them."""
    same = keyed(docs, key, F.md5(text_of("text").cast("binary")).alias("_text"))
    copies = same.groupBy("_text").agg(F.count("*").alias("_copies"), F.min("_id").alias("_rep"))
    copies = written(copies.where("_copies > 1"), "copies")
    return written(join_by_key(same.dropDuplicates(["_id", "_key"]), copies, ["_text"], "_copies", F.col("_id"), ["_rep"]), "groups")


def repeated(docs: DataFrame, *keep) -> DataFrame:
    """``_id, _key, text``, the columns ``keep``, ``_whole`` (equal texts exist) and ``_starts``
    (of repeated windows): a row a row of ``docs``.

    The dealt texts are read twice with the same columns, so their exchange is reused.
    """
    key = text_key(docs)
    texts = keyed(docs, key, F.col("text").cast("binary").alias("text"), *keep).repartition("_id", "_key")
    anchors = keyed(docs, key, F.col("text").cast("binary").alias("text")).mapInArrow(
        _anchors, "h long, _id long, _key long, at int"
    )
    place = F.concat_ws(":", "_id", "_key", "at")
    place = F.concat_ws(":", "_id", "_key", "at")
    twice = written(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    spots = join_by_key(anchors, twice, ["h"], "n", place, ["n"])
    spots = spots.groupBy("_id", "_key").agg(F.collect_set(F.struct("at", salts_of(F.col("n")).alias("salts"))).alias("_at"))
    groups = copies_of(docs, key)
    # of equal texts one goes on; the others' every window starts elsewhere
    told = written(spots.join(groups.where("_rep != _id"), ["_id", "_key"], "left_anti"), "told")
    windows = texts.join(told, ["_id", "_key"]).mapInArrow(
        _windows, "h long, g long, salts int, _id long, _key long, at int"
    )
    # a window has as many rows as its anchor at most, and is dealt into as many parts
    salted = lambda salt: (F.col("g") + F.shiftleft(salt.cast("long"), 32)).alias("gs")  # noqa: E731  g has 32 bits
    again = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("salts").alias("salts")).where("n > 1")
    again = again.select("h", "g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("h", salted(F.col("salt")))
    spread = windows.select("h", salted(F.pmod(F.xxhash64("_id", "_key", "at"), F.col("salts"))), "_id", "_key", "at")
    starts = spread.join(again, ["h", "gs"]).groupBy("_id", "_key").agg(F.collect_set("at").alias("_starts"))
    whole = groups.select("_id", "_key", F.lit(True).alias("_whole"))
    found = starts.join(whole, ["_id", "_key"], "full")
    return texts.join(found, ["_id", "_key"], "left")


def kept_words(text: bytes | None, whole: bool | None, starts: list[int] | None) -> tuple[int, list[bytes]]:
    """The number of words, and the words that stay."""
    words = find_words(text)
    if len(words) < WINDOW:
        return len(words), words
    if whole:
        return len(words), []
    if starts is None:
        return len(words), words
    gone = removed_words(len(words), np.asarray(starts, np.int64))
    return len(words), [w for w, g in zip(words, gone.tolist()) if not g]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for row in zip(*(batch[c].to_pylist() for c in ("text", "_whole", "_starts"))):
            n, kept = kept_words(*row)
            n_words.append(n)
            n_removed.append(n - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeated(docs.select("doc_id", "text"), "doc_id").mapInArrow(
        _digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("text", "_whole", "_starts"))):
            n, kept = kept_words(*row)
            out.append(row[0] if n == len(kept) else b" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(out, pa.binary())], names=["_row", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages: ``text`` loses them (the words that stay are joined
    by one space; a text that loses none stays as it is), ``n_chars`` follows it where there
    is such a column, and documents that lose every word go."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    base = docs.select("doc_id", "text", row)
    kind = base.schema["_row"].dataType.simpleString()
    out = repeated(base, "_row").mapInArrow(_texts, f"_row {kind}, text binary").withColumn("text", F.col("text").cast("string"))
    n = F.length("text")
    cols = {c: F.col(f"_row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return out.where(text_of("text") != "").select(*[cols[c].alias(c) for c in docs.columns])
