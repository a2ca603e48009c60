"""BM25 over terms and adjacent pairs, for one question or for many at once.

The index is three tables: postings, document lengths and one row of corpus statistics.
Questions are rows, so a batch of any number is one plan: questions meet postings on
(gram, key), which prunes the postings to the questions' few keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.tokens import query_tokens, tokens
from ..shared import written

K1, B, PAIR = 1.2, 0.75, 0.25
#: Keys of questions that a plan spells out at most.
LITERAL = 1000
ADMISSION = 0.761


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # gram, key, id, tf
    lengths: DataFrame  # id, len
    corpus: DataFrame  # n, avg_len
    tokens: DataFrame | None = None  # id, toks, not yet written; None once the tables are kept
    again: DataFrame | None = None  # ids of more than one text, if there are any
    sifted: dict = field(default_factory=dict)  # indexes of a few keys, by these

    def persist(self) -> Index:
        """Keep a snapshot's tables for many questions."""
        laid = self.laid()
        return Index(laid.postings.persist(), laid.lengths.persist(), laid.corpus.persist())

    def laid(self) -> Index:
        """The same with its tokens written, for plans that read them more than once."""
        return self if self.tokens is None else _of_tokens(written(self.tokens, "tokens"), self.again)

    def counted(self, *grams: str) -> DataFrame:
        """The postings of some grams alone: others make no rows."""
        if self.tokens is None:
            return self.postings.where(F.col("gram").isin(*grams))
        return _postings(self.tokens, self.again, grams)

    def of(self, keys: DataFrame) -> Index:
        """The index of the questions' keys alone. Of an index that is not kept, and for ``LITERAL`` keys
        or fewer, each document's tokens are sifted by the keys where they stand, in one pass that
        also takes their length, so that neither tokens nor other occurrences are written; more
        keys are joined."""
        wanted = keys.select("gram", "key").distinct()
        few = wanted.limit(LITERAL + 1).collect() if self.tokens is not None else None
        if few is None or len(few) > LITERAL:
            whole = self.laid()
            return Index(whole.postings.join(wanted, ["gram", "key"], "left_semi"), whole.lengths, whole.corpus)
        name = frozenset((r["gram"], r["key"]) for r in few)
        if name not in self.sifted:
            self.sifted[name] = self._sift(sorted(k for g, k in name if g == "term"), sorted(k for g, k in name if g == "pair"))
        return self.sifted[name]

    def _sift(self, terms: list[str], pairs: list[str]) -> Index:
        none = F.array().cast("array<string>")
        spots = F.sequence(F.lit(1), F.size("toks") - 1)
        opens = F.filter(spots, lambda i: F.element_at("toks", i).isin(sorted({p.split(" ")[0] for p in pairs})))
        both = F.transform(opens, lambda i: F.concat_ws(" ", F.element_at("toks", i), F.element_at("toks", i + 1)))
        near = F.when(F.size("toks") > 1, F.filter(both, lambda p: p.isin(pairs))) if pairs else none
        own = F.filter("toks", lambda t: t.isin(terms)) if terms else none
        hit = self.tokens.select("id", F.size("toks").alias("len"), own.alias("term"), F.coalesce(near, none).alias("pair"))
        hit = written(hit.select("id", "len", F.concat(_times("term"), _times("pair")).alias("keys")), "sifted")
        found = hit.select("id", F.inline("keys")).select("gram", "key", "id", "tf")
        if self.again is not None:
            found = found.groupBy("gram", "key", "id").agg(F.sum("tf").cast("int").alias("tf"))
        return Index(found, *_sizes(hit.select("id", "len")))


def _times(gram: str) -> Column:
    """Structs (gram, key, tf) of the few keys in the column named as the gram."""
    count = lambda k: F.size(F.filter(gram, lambda x: x == k))
    return F.transform(F.array_distinct(gram), lambda k: F.struct(F.lit(gram).alias("gram"), k.alias("key"), count(k).alias("tf")))


def _sizes(lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lengths`` and the one row of the corpus."""
    mean = F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0))
    return lengths, lengths.agg(F.count("*").alias("n"), mean.alias("avg_len"))


def _keys(grams: tuple[str, ...]) -> list[Column]:
    """Columns ``term`` and ``pair``, as asked for: a document's keys in order, equal ones side by side."""
    n = F.size("toks")
    first, second = (F.slice("toks", F.lit(i), F.greatest(n - 1, F.lit(0))) for i in (1, 2))
    pair = F.zip_with(first, second, lambda a, b: F.concat_ws(" ", a, b))
    return [F.sort_array({"term": F.col("toks"), "pair": pair}[g]).alias(g) for g in grams]


def _postings(toks: DataFrame, again: DataFrame | None, grams: tuple[str, ...] = ("term", "pair")) -> DataFrame:
    """``gram, key, id, tf``. A document's keys are counted in its own row, as runs of its sorted keys,
    so nothing is shuffled; only texts that share an id are put together by a shuffle."""
    lone = toks if again is None else toks.join(again, toks["id"].eqNullSafe(again["id"]), "left_anti")
    lone = lone.select("id", *_keys(grams))
    none = F.array().cast("array<int>")
    begins = lambda g: lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1))
    starts = [F.when(F.size(g) > 0, F.filter(F.sequence(F.lit(0), F.size(g) - 1), begins(g))).otherwise(none).alias(f"{g}_at") for g in grams]
    lone = lone.select("id", *grams, *starts)

    def runs(g: str) -> Column:
        end = lambda j: F.coalesce(F.get(f"{g}_at", j + 1), F.size(g))
        return F.transform(f"{g}_at", lambda i, j: F.struct(F.lit(g).alias("gram"), F.get(g, i).alias("key"), (end(j) - i).alias("tf")))

    out = lone.select("id", F.inline(F.concat(*map(runs, grams)))).select("gram", "key", "id", "tf")
    if again is None:
        return out
    more = toks.join(again, toks["id"].eqNullSafe(again["id"]), "left_semi").select("id", *_keys(grams))
    said = lambda g: F.transform(g, lambda k: F.struct(F.lit(g).alias("gram"), k.alias("key")))
    more = more.select("id", F.inline(F.concat(*map(said, grams)))).groupBy("gram", "key", "id").agg(F.count("*").cast("int").alias("tf"))
    return out.unionByName(more)


def _of_tokens(toks: DataFrame, again: DataFrame | None) -> Index:
    return Index(_postings(toks, again), *_sizes(toks.select("id", F.size("toks").alias("len"))), toks, again)


def indexed_body(kind: Column, body: Column) -> Column:
    """Of a symbol, the last line of its body; of others all of it."""
    return F.when(kind == "Symbol", F.element_at(F.split(body, "\n", -1), -1)).otherwise(body)


def passage(nodes: DataFrame) -> Column:
    return F.concat_ws(" ", "id", "label", indexed_body(F.col("kind"), F.col("body")))


def build(texts: DataFrame, stemmed: bool = True) -> Index:
    """The index of ``texts (id, text)``: its terms, and pairs of neighbours (after short ones are
    dropped). Ids of more than one text are looked for first; mostly there are none."""
    again = texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    again = written(again, "again")
    toks = texts.select("id", tokens(F.col("text"), stemmed).alias("toks"))
    return _of_tokens(toks, None if again.isEmpty() else again)


def of_nodes(nodes: DataFrame, stemmed: bool = True) -> tuple[Index, Index]:
    """The passages' index (all kinds but files and texts) and the texts' own."""
    said = nodes.where(~F.col("kind").isin("File", "Text")).select("id", passage(nodes).alias("text"))
    own = nodes.where("kind = 'Text'").select("id", passage(nodes).alias("text"))
    return build(said, stemmed), build(own, stemmed)


def question_keys(spark: SparkSession, questions: dict[str, str], stemmed: bool = True) -> DataFrame:
    """``q, gram, key, times``: the questions' terms and pairs; a repeated one counts as often."""
    rows = []
    for q, text in questions.items():
        toks = query_tokens(text, stemmed)
        rows += [(q, "term", t) for t in toks] + [(q, "pair", f"{a} {b}") for a, b in zip(toks, toks[1:])]
    df = spark.createDataFrame(rows, "q string, gram string, key string")
    return df.groupBy("q", "gram", "key").agg(F.count("*").alias("times"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def frequencies(index: Index, keys: DataFrame) -> DataFrame:
    """``gram, key, df`` of the questions' keys."""
    return index.of(keys).postings.groupBy("gram", "key").agg(F.count("*").alias("df"))


def search(index: Index, keys: DataFrame, k: int | None = 20) -> DataFrame:
    """``q, id, score, rank``: the ``k`` best documents of each question, ties by id."""
    index = index.of(keys)
    found = index.postings
    df = found.groupBy("gram", "key").agg(F.count("*").alias("df"))
    hits = found.join(keys, ["gram", "key"]).join(df, ["gram", "key"])
    hits = hits.join(index.lengths, "id").crossJoin(F.broadcast(index.corpus))  # one row of statistics
    weight = F.when(F.col("gram") == "pair", PAIR).otherwise(1.0)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    part = F.col("times") * weight * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / norm
    scores = hits.groupBy("q", "id").agg(F.sum(part).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def attainable(index: Index, keys: DataFrame) -> DataFrame:
    """``q, attainable``: the score of a document of average length that holds every distinct
    term and pair once, unseen ones charged as the rarest; 0 on an empty index."""
    rows = keys.select("q", "gram", "key").distinct().join(frequencies(index, keys), ["gram", "key"], "left")
    rows = rows.crossJoin(F.broadcast(index.corpus))
    weight = F.when(F.col("gram") == "pair", PAIR).otherwise(1.0)
    part = F.when(F.col("n") > 0, weight * idf(F.col("n"), F.coalesce("df", F.lit(0)))).otherwise(0.0)
    return rows.groupBy("q").agg(F.sum(part).alias("attainable"))


def coverage(index: Index, keys: DataFrame) -> DataFrame:
    """``q, best, coverage``: the best score, and its share of what is attainable."""
    best = search(index, keys, 1).select("q", F.col("score").alias("best"))
    out = attainable(index, keys).join(best, "q", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    share = F.when(F.col("attainable") > 0, F.col("best") / F.col("attainable")).otherwise(0.0)
    return out.select("q", "best", share.alias("coverage"))


def admitted(passages: Index, texts: Index, keys: DataFrame, least: float = ADMISSION) -> DataFrame:
    """``q, admitted``: whether the text list is seated beside the passages'."""
    a = coverage(passages, keys).select("q", F.col("coverage").alias("said"))
    b = coverage(texts, keys).select("q", "best", F.col("coverage").alias("own"))
    seat = (F.col("best") > 0) & ((F.col("said") <= 0) | (F.col("own") / F.col("said") >= least))
    return a.join(b, "q").select("q", F.coalesce(seat, F.lit(False)).alias("admitted"))
