"""Dense retrieval: row texts, chunks, owed rows, sync, and exact cosine top-k.

The embedder is a plug: any function from texts to vectors. ``hashing_embedder`` is a
deterministic one for tests; it claims no understanding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lexical import indexed_body

Embedder = Callable[[list[str]], np.ndarray]
CHUNK, LEAST = 600, 300
#: A vector store with this many dead rows to a live one would be compacted.
HOLES = 4


def chunks(label: str, body: str, size: int = CHUNK, least: int = LEAST) -> list[str]:
    """Greedy runs of whole lines up to ``size`` characters less the label's; a longer line is
    cut; none if all is blank."""
    room, out, now = max(size - len(label), least), [], ""
    for line in body.splitlines(keepends=True):
        while len(line) > room:
            if now:
                out.append(now)
                now = ""
            out.append(line[:room])
            line = line[room:]
        if len(now) + len(line) > room:
            out.append(now)
            now = ""
        now += line
    out.append(now)
    return [c for c in out if c.strip()]


def row_texts(nodes: DataFrame) -> DataFrame:
    """``id, row_no, text, row_hash``: nothing of files, chunks of texts, one row of others."""

    @F.pandas_udf("array<string>")
    def cut(label: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([[f"{x or ''}\n{c}" for c in chunks(x or "", y or "")] for x, y in zip(label, body)])

    said = F.concat(F.lit("passage: "), "label", F.lit("\n"), indexed_body(F.col("kind"), F.col("body")))
    one = nodes.where(~F.col("kind").isin("File", "Text")).select("id", F.lit(0).alias("row_no"), said.alias("text"))
    many = nodes.where("kind = 'Text'").select("id", F.posexplode(cut("label", "body")).alias("row_no", "text"))
    return one.unionByName(many).withColumn("row_hash", F.sha2("text", 256))


def owed(rows: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Rows whose (id, hash) has no vector of ``model``."""
    live = vectors.where(F.col("model") == model).select("id", "row_hash").distinct()
    return rows.join(live, ["id", "row_hash"], "left_anti")


def embed(rows: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """Vectors of ``rows``, of unit length. Each Arrow batch is embedded in order of length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pdf.iloc[np.argsort(pdf["text"].str.len().to_numpy(), kind="stable")]
            v = np.asarray(embedder(pdf["text"].tolist()), np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pdf[["id", "row_no", "row_hash"]].assign(model=model, dim=v.shape[1], embedding=list(v.astype(np.float32)))

    return rows.select("id", "row_no", "row_hash", "text").mapInPandas(
        run, "id string, row_no int, row_hash string, model string, dim int, embedding array<float>"
    )


def sync(rows: DataFrame, vectors: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """The vectors of ``rows`` alone: live ones kept, owed ones embedded, orphans dropped;
    another model's are all dropped. A new snapshot, so nothing has to be compacted."""
    live = vectors.where(F.col("model") == model).drop("row_no")
    kept = live.join(rows.select("id", "row_no", "row_hash"), ["id", "row_hash"])
    return kept.select(vectors.columns).unionByName(embed(owed(rows, vectors, model), embedder, model).select(vectors.columns))


def batches(rows: DataFrame, most_chars: int) -> DataFrame:
    """``rows`` with ``batch``: checkpoint chunks of about ``most_chars`` characters, dealt by hash
    so that no running total over all rows is needed."""
    total = rows.agg(F.sum(F.length("text")).alias("t")).first()["t"] or 0
    n = max(1, -(-total // most_chars))
    return rows.withColumn("batch", F.pmod(F.xxhash64("id", "row_no"), F.lit(n)).cast("int"))


#: Questions compared with each batch of vectors at once.
BLOCK = 1024


def _nearest(asked: dict[int, tuple[list[str], np.ndarray]], k: int):
    """For each batch of vectors, the ``k`` nearest ids of each question, by one product of matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["embedding"]
            size = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            ids = np.asarray(batch["id"].to_pylist(), object)
            for width, (qs, questions) in asked.items():
                at = np.flatnonzero(size == width)
                if not len(at):
                    continue
                v = np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), width)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                scores = v @ questions.T
                out: list[list] = [[], [], []]
                for j, q in enumerate(qs):
                    best: dict[str, float] = {}
                    least = -2.0
                    for i in np.argsort(-scores[:, j], kind="stable").tolist():
                        if len(best) >= k and scores[i, j] < least - 1e-9:  # what ties with the last goes on
                            break
                        if ids[at[i]] not in best:
                            best[ids[at[i]]] = least = float(scores[i, j])
                    for c, x in zip(out, ([q] * len(best), list(best), list(best.values()))):
                        c += x
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["q", "id", "score"])

    return run


def search(vectors: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """``q, id, score, rank`` for ``questions (q, embedding)``: each node at its best row, ties by
    id; rows of another width are passed over.

    The questions are a stated query set. They come to the driver and go to the tasks in
    blocks of ``BLOCK``; each block meets every batch of vectors, which hands on ``k`` ids a
    question, or more where they tie.
    """
    n = questions.count()
    parts = max(1, -(-n // BLOCK))
    found = None
    for p in range(parts):
        block = questions if parts == 1 else questions.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)
        asked: dict[int, tuple[list, list]] = {}
        for r in block.select(F.col("q").cast("string").alias("q"), "embedding").collect():
            qs, rows = asked.setdefault(len(r["embedding"]), ([], []))
            qs.append(r["q"])
            rows.append(r["embedding"])
        ready = {}
        for width, (qs, rows) in asked.items():
            m = np.asarray(rows, np.float64)
            ready[width] = qs, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        part = vectors.select(F.col("id").cast("string").alias("id"), "embedding").mapInArrow(_nearest(ready, k), "q string, id string, score double")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed hashing of words: equal texts get equal vectors, and shared words some closeness."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % dim] += 1 if h >> 63 else -1
            row[0] += 1e-6
        return out

    return run


def resolve_model(override: str | None, recorded: str | None, configured: str, trusted: set[str]) -> str:
    """Override, then what the store records, then the configuration; unknown ones are refused."""
    name = override or recorded or configured
    if name not in trusted:
        raise ValueError(f"embedding model {name!r} is not trusted")
    return name
