"""The engine: build, update, ask and explain a project's graph.

Questions, roots and ends come in lists and are answered in one plan; single ones are lists
of one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..operators import ask as asking
from ..operators import changes as changing
from ..operators import dense, evaluate
from ..operators import families as families_
from ..operators import graph, lexical, resolve, traverse
from ..schema import GRAMMAR
from ..shipping import ship
from ..sources import external, tree
from ..sources.documents import extract
from ..streaming import refresh
from .store import Store

#: Embedders that may be named in a configuration.
EMBEDDERS = {"hashing-64": dense.hashing_embedder(64)}


class Engine:
    def __init__(self, spark: SparkSession, repo: str, store: str | None = None, config: dict | None = None) -> None:
        self.spark, self.repo = spark, repo
        ship(spark)
        self.config = config or external.load_config(f"{repo}/quillgraph.toml")
        self.store = Store(spark, store or f"{repo}/{tree.STORE}")
        self._snap: traverse.Snapshot | None = None
        self._index: tuple | None = None

    # -- writing

    def _texts(self, entries: DataFrame) -> DataFrame:
        content = tree.binary_files(self.spark, self.repo).select("rel", F.expr("try_validate_utf8(cast(content as string))").alias("text"))
        return entries.select("rel", "kind").join(content, "rel").where("text is not null")

    def build(self) -> dict:
        """Read everything again and replace the graph when it is whole."""
        with self.store.writer():
            entries = tree.entries(self.spark, self.repo, self.config).persist()
            nodes, edges = extract(self._texts(entries))
            empty = self.store.table("edges").limit(0)
            n, e, p = refresh.merged(self.store.table("nodes").limit(0), empty, empty, nodes, edges)
            return self._save(n, e, p, entries)

    def update(self) -> dict:
        """Read what changed since the last build or update; all, if its grammar is another."""
        if self.store.state()["grammar"] != GRAMMAR:
            return self.build()
        with self.store.writer():
            manifest = self.store.table("manifest")
            entries = tree.entries(self.spark, self.repo, self.config, manifest).persist()
            diff = tree.diff(manifest, entries).persist()
            if diff.isEmpty():
                return {"changed": 0}
            n, e, p = refresh.apply_diff(self.store.table("nodes"), self.store.table("edges"), self.store.table("pending"), diff, self._texts(entries))
            return {"changed": diff.count()} | self._save(n, e, p, entries)

    def _save(self, nodes: DataFrame, edges: DataFrame, pending: DataFrame, entries: DataFrame) -> dict:
        name = self.config["embed_model"]
        nodes = nodes.persist()
        vectors = self.store.table("vectors")
        if name in EMBEDDERS:
            vectors = dense.sync(dense.row_texts(nodes), vectors, EMBEDDERS[name], name)
        self.store.save({"nodes": nodes, "edges": edges, "pending": pending, "manifest": entries, "vectors": vectors}, model=name)
        self._snap = self._index = None
        return {"nodes": self.store.table("nodes").count(), "edges": self.store.table("edges").count()}

    def embed(self) -> int:
        """Embed what is owed, from the graph alone; the number of live vectors."""
        nodes = self.store.table("nodes")
        if nodes.isEmpty():
            raise ValueError("the graph is empty")
        name = self.config["embed_model"]
        self.store.save({"vectors": dense.sync(dense.row_texts(nodes), self.store.table("vectors"), EMBEDDERS[name], name)}, model=name)
        return self.store.table("vectors").count()

    def set_embedder(self, name: str | None = None) -> str:
        """Report or switch the embedding model; switching drops the other's vectors."""
        if name is not None:
            self.config["embed_model"] = dense.resolve_model(name, None, name, set(EMBEDDERS))
            self.embed()
        return self.config["embed_model"]

    def import_legacy(self, path: str) -> dict:
        old = self.spark.read.option("multiLine", True).json(path)
        nodes = self.store.table("nodes")
        edges, concepts, counts = external.import_graph(nodes, old)
        new = concepts.select("id", "kind", "label", F.lit("").alias("body"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("end"), F.array().cast("array<string>").alias("files"), "community")
        self.store.save({"nodes": nodes.unionByName(new), "edges": graph.union_edges(self.store.table("edges"), edges)})
        self._snap = self._index = None
        return counts.first().asDict()

    # -- reading

    @property
    def snapshot(self) -> traverse.Snapshot:
        if self._snap is None:
            self._snap = traverse.Snapshot.of(self.store.table("nodes"), self.store.table("edges"))
        return self._snap

    @property
    def indexes(self) -> tuple[lexical.Index, lexical.Index]:
        if self._index is None:
            a, b = lexical.of_nodes(self.store.table("nodes"))
            self._index = a.persist(), b.persist()
        return self._index

    def _lists(self, questions: dict[str, str], depth: int) -> dict[str, DataFrame]:
        said, own = self.indexes
        keys = lexical.question_keys(self.spark, questions).persist()
        out = {"lexical": lexical.search(said, keys, depth)}
        seat = lexical.admitted(said, own, keys).where("admitted").select("q")
        out["texts"] = lexical.search(own, keys, depth).join(seat, "q", "left_semi")
        name = self.store.state()["model"]
        if name in EMBEDDERS:
            v = EMBEDDERS[name](list(questions.values()))
            asked = self.spark.createDataFrame([(q, [float(x) for x in row]) for q, row in zip(questions, v)], "q string, embedding array<double>")
            out["dense"] = dense.search(self.store.table("vectors"), asked, depth)
        return out

    def ask_many(self, questions: dict[str, str], seeds: int = asking.SEEDS) -> DataFrame:
        """``q, role, pos, id, file, line, label, score, via`` for all questions in one plan."""
        nodes, edges = self.snapshot.nodes, self.snapshot.edges
        named = asking.exact(nodes, asking.words(self.spark, questions))
        lists = self._lists(questions, asking.DEPTH)
        found = asking.fused(lists.get("dense"), lists["lexical"], lists["texts"]).persist()
        out = asking.answer(nodes, edges, named, found, seeds)
        rows = [(q, stem(w)[:5]) for q, t in questions.items() for w in t.lower().split() if len(w) >= 3]
        prefixes = self.spark.createDataFrame(rows, "q string, prefix string")
        texts = out.join(nodes.where("kind = 'Text'").select("id", "body"), "id").select("q", "id", "body")
        at = asking.text_lines(texts, prefixes).withColumnRenamed("line", "_line")
        return out.join(at, ["q", "id"], "left").withColumn("line", F.coalesce("_line", "line")).drop("_line").orderBy("q", F.desc("role"), "pos")

    def ask(self, question: str, seeds: int = asking.SEEDS, stale: dict | None = None) -> str:
        """One question's answer as a JSON object; what it was given without comes first."""
        rows = [r.asDict() for r in self.ask_many({"q": question}, seeds).drop("q").collect()]
        out = {"stale": stale} if stale else {}
        return json.dumps(out | {"seeds": [r for r in rows if r["role"] == "seed"], "expanded": [r for r in rows if r["role"] == "expanded"]})

    def explain(self, needle: str) -> DataFrame:
        id_ = resolve.resolve_one(self.snapshot, needle)
        return resolve.explain(self.snapshot, self.spark.createDataFrame([(id_,)], "id string"))

    def _code(self, needle: str) -> str:
        row = resolve.resolve_code(self.snapshot, self.spark.createDataFrame([(needle,)], "needle string")).first()
        if row is None or row["ambiguous"]:
            raise resolve.Ambiguous(needle, [])
        return row["id"]

    def impact(self, symbol: str, depth: int = 3, down: bool = False) -> DataFrame:
        roots = self.spark.createDataFrame([(self._code(symbol),)], "root string")
        out = traverse.walk(self.snapshot, roots, depth, not down)
        return out.withColumn("layer", traverse.layer_name(F.col("depth"))).orderBy("depth", "id")

    def trace(self, source: str, target: str, depth: int = 6) -> list[dict] | None:
        ends = self.spark.createDataFrame([(self._code(source), self._code(target))], "`from` string, to string")
        row = traverse.trace(self.snapshot, ends, depth).first()
        return None if row is None else [s.asDict() for s in row["path"]]

    def changes(self, base: str = "HEAD", depth: int = 2) -> dict[str, DataFrame]:
        return changing.report(self.snapshot, external.git_hunks(self.spark, self.repo, base), depth)

    def verify(self) -> DataFrame:
        if self.snapshot.nodes.isEmpty():
            raise ValueError("the graph is empty")
        return resolve.verify(self.snapshot.nodes, self.snapshot.edges, self.store.table("pending"))

    def families(self) -> DataFrame:
        return families_.report(self.store.table("nodes"))

    def prime(self) -> DataFrame:
        return resolve.prime(self.store.table("nodes"), self.store.table("edges"), self.store.state()["model"])

    def bench(self, cases: DataFrame) -> DataFrame:
        rows = {r["q"]: r["q"] for r in cases.select("q").distinct().collect()}  # a suite of questions
        return evaluate.summary(cases, evaluate.found(cases, self.ask_many(rows)))

    def dump(self, questions: dict[str, str], out: str, depth: int = asking.DUMP) -> None:
        lists = [df.withColumn("list", F.lit(n)).select("q", "list", "rank", "id", "score") for n, df in self._lists(questions, depth).items()]
        rows = lists[0]
        for df in lists[1:]:
            rows = rows.unionByName(df)
        evaluate.dump(rows).write.mode("overwrite").json(out)

    def watch(self, stream: DataFrame, batch: int = 1, once: bool = False, checkpoint: str | None = None):
        """Update whenever enough changes have streamed in."""
        return refresh.watch_stream(stream, lambda df, epoch: self.update(), batch=batch, once=once, checkpoint=checkpoint)
