"""Suffix-array deduplication of bytes: what a repeated 200-byte string covers goes.

Sorting the suffixes of all bytes would move the corpus some hundred times over, so only
suffixes at anchors are sorted:

1. Anchors. Of each 200-byte string's ``GRAM``-byte runs the one with the smallest hash is its
   anchor; equal strings choose the same one, about every 85th byte. Anchor hashes are
   counted in Spark, and a string whose anchor occurs once is unique.
2. Suffixes. Around every other anchor its context is cut out: the bytes of all strings
   that chose it. Equal contexts of one task are sent once, with their number.
   ``repartitionByRange`` samples splitters and deals the contexts by the bytes that lead
   their suffix (from the anchor on), so buckets are in suffix order.
3. Buckets are sorted by multikey quicksort, once by what follows the anchor and
   once by what precedes it, with the common prefixes of neighbours. The strings that
   start t bytes before their anchors are equal where both orders agree for 200 - t and t
   bytes: runs of neighbours whose common prefix does not fall below that.
4. Contexts led by the same GRAM bytes go to one bucket, and strings of different anchors
   differ, so nothing is left to compare across these buckets.

Anchors that occur more than ``WIDE`` times would make one bucket grow with the corpus. Of
their distinct contexts every string is a suffix of its own: sampled splitters deal the
suffixes by their bytes and then by their place, so equal strings may fill any number of
buckets. Each is sorted (Spark's external sort), neighbours are compared, and last and
first strings of adjacent buckets are compared across the boundary.

Equal texts of at least 200 bytes go whole, and one of them stands for all in steps 2 to 4.
Joins by content have one row a key on one side; keys of many rows do not meet in a task
(``skew``). A context is dealt by its anchor's salts and copied to those that its places
drew, so copies are no more than places. Edge cases: ``doc_id`` is a number, or a text that
casts to one (others are an error under ANSI rules); rows without an id are documents; a
null or empty text has no bytes; a shorter one keeps all; repeated rows are copies of one
another; overlapping repeats inside one text count; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import prints
from .scratch import written
from .skew import join_by_key, salts_of
from .substring_dedup import Rows, copies_of, keyed, text_key

WINDOW, GRAM = 200, 32
#: Rows of one anchor from which its suffixes are sorted one by one: so many contexts, were they all
#: different, take about 200 MB in the task that sorts them.
WIDE = 200_000
SPAN = WINDOW - GRAM + 1
#: Contexts sorted at once, and bytes of contexts gathered before they are sent on.
BUCKET, FLUSH = 40_000, 24 << 20
_TABLE = prints.mixed(np.arange(1, 257, dtype=np.uint64))


def byte_tokens(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


def _chosen(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, at, lo, hi)`` of a text's anchors."""
    grams = prints.mixed(prints.rolling(byte_tokens(text), GRAM))
    at, lo, hi = prints.anchors(grams, SPAN)
    return grams[at].view(np.int64), at, lo, hi


_ANCHORS = pa.schema([("h", pa.int64()), ("_id", pa.int64()), ("_key", pa.int64()), ("at", pa.int32())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(_ANCHORS)
    for batch in batches:
        for i, key, text in zip(*(batch[c].to_pylist() for c in ("_id", "_key", "text"))):
            if text is None or len(text) < WINDOW:
                continue
            h, at, _, _ = _chosen(text)
            yield from rows.add(len(at), h, i, key, at.astype(np.int32))
    yield from rows.rest()


def _contexts_of(text: bytes, i: int, key: int, marked: list[dict]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """``(at, lo, salt, context, digest)`` of the anchors ``marked`` (at, salts) of the text ``i, key``:
    the place's salt is one of its anchor's."""
    salts = {m["at"]: m["salts"] for m in marked}
    _, at, lo, hi = _chosen(text)
    take = np.isin(at, np.fromiter(salts, np.int64, len(salts)))
    for a, x, y in zip(at[take].tolist(), lo[take].tolist(), hi[take].tolist()):
        context = text[x : y + WINDOW]
        salt = xxhash.xxh3_64_intdigest(b"%d:%d:%d" % (i, key, x)) % salts[a] if salts[a] > 1 else 0
        yield a, x, salt, context, xxhash.xxh3_128_digest(context + (a - x).to_bytes(2, "big"))


def _contexts(column: str):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = list(held.items())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in rows], pa.binary()),
                    pa.array([r[0][r[1] : r[1] + GRAM] for _, r in rows], pa.binary()),
                    pa.array([r[0] for _, r in rows], pa.binary()),
                    pa.array([r[1] for _, r in rows], pa.int32()),
                    pa.array([r[2] for _, r in rows], pa.int64()),
                    pa.array([list(r[3]) for _, r in rows], _SALTS),
                ],
                names=["digest", "lead", "context", "d", "n", "salts"],
            )

        for batch in batches:
            for i, key, text, marked in zip(*(batch[c].to_pylist() for c in ("_id", "_key", "text", column))):
                if not marked:
                    continue
                for a, x, salt, context, digest in _contexts_of(text, i, key, marked):
                    if digest not in held:
                        held[digest] = [context, a - x, 0, set()]
                        size += len(context) + 400
                    row = held[digest]
                    row[2] += 1
                    if salt not in row[3]:
                        row[3].add(salt)
                        size += 50
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return contexts


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, digests, parts, los = [], [], [], [], []
        for i, key, text, narrow, wide in zip(*(batch[c].to_pylist() for c in ("_id", "_key", "text", "_narrow", "_wide"))):
            for _, x, salt, _, digest in _contexts_of(text, i, key, (narrow or []) + (wide or [])):
                ids.append(i)
                keys.append(key)
                digests.append(digest)
                parts.append(salt)
                los.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(parts, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(los, pa.int32())],
            names=["digest", "salt", "_id", "_key", "lo"],
        )


#: Segments of no more rows are sorted by all their remaining words at once.
SMALL = 256


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix by multikey quicksort over 8-byte words: a segment is
    parted around a pivot of its current word, and only the middle part goes to the next."""
    m, width = rows.shape
    words = np.zeros((m, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, todo = np.arange(m), [(0, m, 0)]
    while todo:
        lo, hi, c = todo.pop()
        if hi - lo < 2 or c == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort(words[part, c:].T[::-1])]
            continue
        key = words[part, c]
        pivot = np.sort(key[:: max(1, len(key) // 31)])[len(key[:: max(1, len(key) // 31)]) // 2]
        less, same = key < pivot, key == pivot
        order[lo:hi] = np.concatenate([part[less], part[same], part[~(less | same)]])
        a = lo + int(less.sum())
        b = a + int(same.sum())
        todo += [(lo, a, c), (a, b, c + 1), (b, hi, c)]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each sorted row and the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 8192):
        a, b = rows[order[i : i + 8192]], rows[order[i - 1 : i - 1 + len(order[i : i + 8192])]]
        differ = a != b
        out[i : i + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeats_among(contexts: list[bytes], d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Boolean matrix: string t bytes before the anchor of context i occurs more than once."""
    m = len(contexts)
    size = np.fromiter(map(len, contexts), np.int64, m)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.concatenate([[0], np.cumsum(size)[:-1]]) + d
    right, left = np.zeros((m, WINDOW), np.uint8), np.zeros((m, SPAN - 1), np.uint8)
    for matrix, step, have in ((right, 1, size - d), (left, -1, d)):
        at = np.arange(matrix.shape[1])
        where = at[None, :] < have[:, None]
        spots = base[:, None] + (at[None, :] if step > 0 else -1 - at[None, :])
        matrix[where] = flat[spots[where]]
    found = np.zeros((m, SPAN), bool)
    order_r, order_l = multikey_order(right), multikey_order(left)
    near_r, near_l = common_prefixes(right, order_r), common_prefixes(left, order_l)
    run_r, run_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for t in range(SPAN):
        part = np.flatnonzero((t <= d) & (size - d >= WINDOW - t))
        if not len(part):
            continue
        run_r[order_r] = np.cumsum(near_r < WINDOW - t)
        run_l[order_l] = np.cumsum(near_l < t)
        key = run_r[part] * (m + 1) + run_l[part]
        rank = np.argsort(key)
        same = key[rank][1:] == key[rank][:-1]
        again = np.zeros(len(part), bool)
        again[1:] |= same
        again[:-1] |= same
        found[part[rank], t] = again
    found |= (n > 1)[:, None]
    return found


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"s": s, "e": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of their lead; whole groups of one lead are sorted together."""
    rows: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        d = np.array([r[3] for r in rows], np.int64)
        n = np.array([r[4] for r in rows], np.int64)
        salts = pa.array([r[5] for r in rows], _SALTS)
        found = repeats_among([r[2] for r in rows], d, n)
        runs = []
        for i, r in enumerate(rows):  # string starts, from the context's first byte
            starts = len(r[2]) - WINDOW + 1
            runs.append(_runs(found[i, d[i] - np.arange(starts)]))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array(runs, _RUNS), salts], names=["digest", "runs", "salts"]
        )

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("digest", "lead", "context", "d", "n", "salts"))):
            if len(rows) >= BUCKET and row[1] != rows[-1][1]:
                yield solve(rows)
                rows = []
            rows.append(row)
    if rows:
        yield solve(rows)


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_RUNS_SQL = "array<struct<s:int,e:int>>"
_SALTS = pa.list_(pa.int32())


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each context, its strings: what leads the suffix at each start."""
    for batch in batches:
        for digest, context, n in zip(*(batch[c].to_pylist() for c in ("digest", "context", "n"))):
            m = len(context) - WINDOW + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([context[i : i + WINDOW] for i in range(m)], pa.binary()), pa.array([digest] * m, pa.binary()),
                 pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, n, np.int64))],
                names=["suffix", "digest", "s", "n"],
            )


_FOUND = pa.schema([("digest", pa.binary()), ("s", pa.int32()), ("again", pa.bool_()), ("edge", pa.int32()), ("suffix", pa.binary())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes in order, those equal to a neighbour or of a repeated context, and the first
    (edge 0) and last (edge 1) of the bucket with their bytes."""
    held, first = None, True  # the last row so far, and whether it is known to repeat

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    for batch in batches:
        out = []
        for suffix, digest, s, n in zip(*(batch[c].to_pylist() for c in ("suffix", "digest", "s", "n"))):
            again = n > 1
            if held is not None:
                same = held[0] == suffix
                again |= same
                if same or held[3] or first:
                    out.append((held[1], held[2], same or held[3], 0 if first else None, held[0] if first else None))
                first = False
            held = (suffix, digest, s, again)
        if out:
            yield batch_of(out)
    if held is not None:
        yield batch_of([(held[1], held[2], held[3], 0 if first else 1, held[0])])


_CONTEXTS = "digest binary, lead binary, context binary, d int, n long, salts array<int>"


def _wide_runs(joined: DataFrame, n: int) -> DataFrame:
    """``digest, salt, runs`` of the contexts of wide anchors, from their sorted suffixes."""
    contexts = joined.where(F.size("_wide") > 0).mapInArrow(_contexts("_wide"), _CONTEXTS)
    distinct = written(contexts.groupBy("digest").agg(F.first("context").alias("context"), F.sum("n").alias("n")), "contexts")
    order = ["suffix", "digest", "s"]
    rows = distinct.mapInArrow(_suffixes, "suffix binary, digest binary, s int, n long")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(_neighbours, "digest binary, s int, again boolean, edge int, suffix binary")
    rows = written(rows.withColumn("bucket", F.spark_partition_id()), "suffixes")
    at = W.orderBy("bucket", "edge")  # two rows a bucket at most
    near = F.col("suffix").eqNullSafe(F.lag("suffix").over(at)) | F.col("suffix").eqNullSafe(F.lead("suffix").over(at))
    edges = rows.where("edge is not null").withColumn("again", F.col("again") | near)
    found = rows.where("again and edge is null").unionByName(edges.where("again"))
    runs = found.groupBy("digest").agg(F.collect_set(F.struct("s", (F.col("s") + 1).alias("e"))).alias("runs"))
    salts = contexts.select("digest", F.explode("salts").alias("salt")).distinct()
    return salts.join(runs, "digest")


def repeated(docs: DataFrame, *keep) -> DataFrame:
    """``text``, the columns ``keep``, ``_whole`` (equal texts exist) and ``_runs`` (starts of
    repeated strings, as [s, e)): a row a row of ``docs``."""
    raw = F.col("text").cast("binary").alias("text")
    key = text_key(docs)
    texts = keyed(docs, key, raw, *keep).repartition("_id", "_key")
    anchors = keyed(docs, key, raw).mapInArrow(_anchors, "h long, _id long, _key long, at int")
    twice = written(anchors.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "twice")
    spots = join_by_key(anchors, twice, ["h"], "times", F.concat_ws(":", "_id", "_key", "at"), ["times"])
    spot = F.struct("at", salts_of(F.col("times")).alias("salts"))
    spots = spots.groupBy("_id", "_key").agg(
        F.collect_set(F.when(F.col("times") <= WIDE, spot)).alias("_narrow"),
        F.collect_set(F.when(F.col("times") > WIDE, spot)).alias("_wide"),
    )
    groups = copies_of(docs, key)
    told = written(spots.join(groups.where("_rep != _id"), ["_id", "_key"], "left_anti"), "told")
    joined = texts.join(told, ["_id", "_key"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        joined.mapInArrow(_contexts("_narrow"), _CONTEXTS)
        .repartitionByRange(n, "lead")
        .sortWithinPartitions("lead")
        .mapInArrow(_bucket, f"digest binary, runs {_RUNS_SQL}, salts array<int>")
        .where(F.size("runs") > 0)
        .select("digest", F.explode("salts").alias("salt"), "runs")
    )
    if not twice.where(F.col("times") > WIDE).isEmpty():
        runs = runs.unionByName(_wide_runs(joined, n))
    # a context goes to the salts that its places have, not to all of its anchor's: no more rows than places
    runs = runs.groupBy("digest", "salt").agg(F.first("runs").alias("runs"))
    places = joined.mapInArrow(_places, "digest binary, salt int, _id long, _key long, lo int")
    found = places.join(runs, ["digest", "salt"]).groupBy("_id", "_key").agg(
        F.collect_list(F.transform("runs", lambda r: F.struct((r["s"] + F.col("lo")).alias("s"), (r["e"] + F.col("lo")).alias("e")))).alias("_sets")
    )
    found = found.select("_id", "_key", F.flatten("_sets").alias("_runs"))
    whole = groups.select("_id", "_key", F.lit(True).alias("_whole"))
    return texts.join(found.join(whole, ["_id", "_key"], "full"), ["_id", "_key"], "left")


def removed_bytes(text: bytes, whole: bool | None, runs: list[dict] | None) -> np.ndarray:
    """Which bytes of a text go."""
    n = len(text)
    if n < WINDOW or not (whole or runs):
        return np.zeros(n, bool)
    if whole:
        return np.ones(n, bool)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, [r["s"] for r in runs], 1)
    np.add.at(mark, [r["e"] - 1 + WINDOW for r in runs], -1)
    return np.cumsum(mark[:n]) > 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, whole, runs in zip(*(batch[c].to_pylist() for c in ("text", "_whole", "_runs"))):
            text = text or b""
            gone = removed_bytes(text, whole, runs)
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            rest = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            for c, v in zip(out, (len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row a row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeated(docs.select("doc_id", "text"), "doc_id").mapInArrow(
        _digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
