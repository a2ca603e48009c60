import random

from quillgraph.operators import ask, changes, evaluate, families, graph, lexical, traverse
from quillgraph.schema import EDGES, NODES, violations
from quillgraph.sources import documents, external, tree
from quillgraph.sources.code import code, language
from quillgraph.streaming import refresh


def node(id_, kind="Symbol", file="a.py", line=1, end=1, label="", body="", files=None):
    return (id_, kind, label or id_.rpartition("::")[2], body, file, line, end, files or [file], None)


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODES)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, c, f) for a, b, k, c, f in rows], EDGES)


def call(a, b, context=""):
    return (a, b, "Calls", context, "x")


def test_upsert_and_remove_are_inverse(spark):
    from pyspark.sql import functions as F

    rows = nodes(spark, [node("FR-A-1", "Requirement", "a.md"), node("FR-A-1", "Requirement", "b.md"), node("FR-B-1", "Requirement", "b.md")])
    up = graph.upsert(rows.withColumn("seq", F.lit(0)), ["file", "seq"])
    assert {r["id"]: (r["file"], r["files"]) for r in up.collect()} == {"FR-A-1": ("a.md", ["a.md", "b.md"]), "FR-B-1": ("b.md", ["b.md"])}
    e = edges(spark, [("FR-A-1", "FR-B-1", "References", "body", "a.md"), ("FR-B-1", "FR-A-1", "References", "body", "b.md")])
    n2, e2 = graph.remove_files(up, e, spark.createDataFrame([("a.md",)], "rel string"))
    assert {r["id"]: (r["file"], r["files"]) for r in n2.collect()} == {"FR-A-1": ("b.md", ["b.md"]), "FR-B-1": ("b.md", ["b.md"])}
    assert [r["source"] for r in e2.collect()] == ["FR-B-1"]
    assert violations(n2, e2).count() == 0


def test_settle_holds_and_releases(spark):
    e = edges(spark, [("FR-A-1", "ZZ-1", "References", "body", "a"), ("FR-A-1", "FR-A-9", "References", "body", "a"), ("x", "y.get", "Calls", "get", "a")])
    n = nodes(spark, [node("FR-A-1", "Requirement")])
    state = {r["target"]: r["state"] for r in graph.settle(n, e).collect()}
    assert state == {"ZZ-1": "pending", "FR-A-9": "settled"}
    more = n.union(nodes(spark, [node("ZZ-7", "Requirement")]))
    assert {r["state"] for r in graph.settle(more, e).collect()} == {"settled"}
    assert graph.dangling(n, e).count() == 3


S = "sym:s.ts::"


def snapshot(spark):
    n = [
        node(S + "C", file="s.ts", line=3, end=12), node(S + "C.m", file="s.ts", line=5, end=8), node(S + "I", file="s.ts"), node(S + "I.m", file="s.ts"),
        node("sym:c.ts::ctl", file="c.ts"), node("sym:w.ts::work", file="w.ts"), node("sym:d.ts::D", file="d.ts"), node("sym:t.ts::top", file="t.ts"),
        node("sym:m.ts::mod", file="m.ts"),
    ]
    e = [
        (S + "C", S + "C.m", "Declares", "", "s.ts"), (S + "I", S + "I.m", "Declares", "", "s.ts"), (S + "C", S + "I", "Implements", "", "s.ts"),
        call("sym:c.ts::ctl", S + "C.m"), call("sym:w.ts::work", "sym:index.ts::Kind.m"), call("sym:t.ts::top", "sym:c.ts::ctl"),
        ("sym:d.ts::D", S + "C", "Extends", "", "d.ts"), call("sym:m.ts::mod", S + "C.bind", "arg"), call("sym:t.ts::top", S + "I.m"),
        ("file:index.ts", "file:s.ts", "ReExports", "C as Kind", "index.ts"), ("file:w.ts", "file:index.ts", "Imports", "Kind", "w.ts"),
        ("file:c.ts", "file:s.ts", "Imports", "C", "c.ts"),
    ]
    return traverse.Snapshot.of(nodes(spark, n), edges(spark, e))


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def test_walk_up(spark):
    snap = snapshot(spark)
    got = {r["id"]: (r["depth"], r["passed"]) for r in traverse.walk(snap, roots(spark, S + "C"), 3).collect()}
    assert got == {
        "sym:c.ts::ctl": (1, False), "sym:w.ts::work": (1, False), "sym:d.ts::D": (1, False), "sym:m.ts::mod": (1, True), "sym:t.ts::top": (1, False),
    }
    files = {r["file"] for r in traverse.importers(snap, roots(spark, S + "C")).collect()}
    assert files == {"index.ts", "w.ts", "c.ts"}


def test_up_and_down_agree(spark):
    snap = snapshot(spark)
    ids = [r["id"] for r in snap.nodes.collect()]
    down = {(r["root"], r["id"]) for r in traverse.walk(snap, roots(spark, "sym:t.ts::top", "sym:w.ts::work"), 3, up=False).collect()}
    assert ("sym:t.ts::top", S + "C.m") in down and ("sym:w.ts::work", S + "C.m") in down
    assert all(i in ids for _, i in down)
    ends = spark.createDataFrame([("sym:t.ts::top", S + "C.m"), ("sym:t.ts::top", "sym:d.ts::D"), ("sym:t.ts::top", "sym:t.ts::top")], "`from` string, to string")
    path = {(r["from"], r["to"]): [s["id"] for s in r["path"]] for r in traverse.trace(snap, ends).collect()}
    assert len(path) == 2 and path["sym:t.ts::top", "sym:t.ts::top"] == ["sym:t.ts::top"]
    assert path["sym:t.ts::top", S + "C.m"] == ["sym:t.ts::top", S + "C.m"]


def test_walk_against_plain_search(spark):
    rng = random.Random(7)
    names = [f"sym:f{i % 5}.py::n{i}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(90)}
    snap = traverse.Snapshot.of(nodes(spark, [node(n, file=n[4:9]) for n in names]), edges(spark, [call(a, b) for a, b in pairs]))
    want = {}
    for root in names[:6]:
        seen, at = {root: 0}, [root]
        for d in (1, 2, 3):
            at = sorted({a for a, b in pairs if b in at} - set(seen))
            seen |= {i: d for i in at}
        want |= {(root, i): d for i, d in seen.items() if d}
    got = {(r["root"], r["id"]): r["depth"] for r in traverse.walk(snap, roots(spark, *names[:6]), 3).collect()}
    assert got == want


DIFF = """diff --git a/s.ts b/s.ts
--- a/s.ts
+++ b/s.ts
@@ -6,0 +6,2 @@ class C
+  // only said
+
@@ -20,2 +19,0 @@
-gone
-too
diff --git a/old.py b/old.py
--- a/old.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/new.py b/new.py
--- /dev/null
+++ b/new.py
@@ -0,0 +1,3 @@
+# noqa
"""


def test_diff_and_touch(spark):
    hunks = changes.parse_diff(DIFF)
    assert hunks == [("s.ts", 6, 7, True), ("s.ts", 19, 19, False), ("new.py", 1, 3, False)]
    snap = snapshot(spark)
    df = spark.createDataFrame(hunks, changes.HUNKS)
    got = {r["id"]: r["outside"] for r in changes.touch(snap.nodes, df).collect()}
    assert got == {S + "C.m": False, "file:s.ts": True, "file:new.py": True}
    via = changes.parse_diffs(spark.createDataFrame([("d", DIFF)], "id string, diff string")).collect()
    assert [tuple(r)[1:] for r in via] == hunks
    out = changes.report(snap, df.limit(1), 2)
    assert {r["id"] for r in out["affected"].collect()} >= {"sym:c.ts::ctl"}
    assert out["risk"].first()["risk"] in ("LOW", "MEDIUM")


def test_interleave_and_seat(spark):
    rows = [("q", 0, 0, "x"), ("q", 0, 1, "y"), ("q", 1, 0, "z"), ("q", 1, 1, "y")]
    out = ask.interleave(spark.createDataFrame(rows, "q string, list_no int, rank int, id string"))
    assert [r["id"] for r in out.orderBy("place").collect()] == ["x", "z", "y"]
    named = spark.createDataFrame([("q", "w", 0, True)], "q string, id string, pos int, whole boolean")
    assert [r["id"] for r in ask.seat(named, out).collect()] == ["w"]


def test_bm25_average_document_reaches_attainable(spark):
    docs = [("a", "alpha beta gamma delta"), ("b", "one two three four"), ("c", "five six seven eight")]
    index = lexical.build(spark.createDataFrame(docs, "id string, text string"))
    keys = lexical.question_keys(spark, {"q": "alpha beta gamma delta"})
    top = lexical.search(index, keys, 1).first()
    assert top["id"] == "a" and abs(top["score"] - lexical.attainable(index, keys).first()["attainable"]) < 1e-9
    none = lexical.build(spark.createDataFrame([], "id string, text string"))
    assert lexical.search(none, keys, 1).count() == 0 and lexical.attainable(none, keys).first()["attainable"] == 0


def test_documents_and_registry():
    text = "# Pay\n\n**FR-P-1 · MUST · Refund it (`Refund`).** FR-P-2\nBody INV-1/2.\n```\n**FR-P-9 · MUST · no**\n```\n## Next\n### FR-P-2 · SHOULD · Charge\n[l](../a/b.md#x) [m](mailto:x) [u](http://x)\n"
    ex = documents.document("docs/p.md", text)
    ids = {n[0]: n for n in ex.nodes}
    assert set(ids) == {"file:docs/p.md", "FR-P-1", "FR-P-2", "entity:Refund"}
    assert ("FR-P-1", "INV-2", "References", "body", "docs/p.md") in ex.edges
    assert ("file:docs/p.md", "file:a/b.md", "Links", "link", "docs/p.md") in ex.edges
    bad = documents.registry("r.yaml", "invariants:\n  - id: INV-1\n    statement: x\n  - statement: y\n")
    assert [n[0] for n in bad.nodes] == ["file:r.yaml"]
    good = documents.registry("r.yaml", 'invariants:\n  - id: INV-1\n    statement: "**B** rest"\n    mechanism: m\n    test_ref: t\n    basis: FR-P-1\n')
    assert ("INV-1", "gate:t", "Implements", "test_ref", "r.yaml") in good.edges and good.nodes[1][2:4] == ("B", "rest\nm")


def test_code_readers():
    py = code("a/b.py", "from .c import f as g\nclass A(g):\n    '''Doc FR-X-1'''\n    def m(self):\n        return self.n(g)\n    def n(self, h):\n        return h()\n")
    assert ("sym:a/b.py::A.m", "sym:a/b.py::A.n", "Calls", "", "a/b.py") in py.edges
    assert ("sym:a/b.py::A.m", "sym:a/c.py::f", "Calls", "arg", "a/b.py") in py.edges
    assert ("sym:a/b.py::A", "sym:a/c.py::f", "Extends", "", "a/b.py") in py.edges
    assert ("sym:a/b.py::A", "FR-X-1", "References", "string", "a/b.py") in py.edges
    sql = code("m.sql", 'CREATE TABLE App."User" (id int, o int references app.orgs);\nalter table only x add y int;')
    assert {n[2] for n in sql.nodes[1:]} == {"app.User", "x"}
    ts = code("x.ts", "export { a as b } from './y.js'\nexport class K {\n}\n")
    assert ("file:x.ts", "file:y.ts", "ReExports", "a as b", "x.ts") in ts.edges and ts.nodes[1][2] == "K"
    assert language("x", "#!/usr/bin/env python3\n") == "python" and language("q.tf") == "terraform"
    assert code("broken.py", "def (").nodes[0][0] == "file:broken.py"


def test_incremental_equals_rebuild(spark):
    def texts(d):
        return spark.createDataFrame([(k, "Doc" if k.endswith(".md") else "Code", v) for k, v in d.items()], "rel string, kind string, text string")

    old = {"a.md": "### FR-A-1 · MUST · One\nsee FR-B-2\n", "b.md": "### FR-A-1 · MUST · Two\n", "c.py": "def f():\n    return 1\n"}
    new = {"b.md": old["b.md"], "c.py": "def f():\n    return g()\ndef g():\n    return 2\n", "d.md": "### FR-B-2 · MUST · New\n"}

    def build(d):
        none = spark.createDataFrame([], EDGES)
        n, e = documents.extract(texts(d))
        return refresh.merged(spark.createDataFrame([], NODES), none, none, n, e)

    changed = spark.createDataFrame([("a.md", "removed"), ("c.py", "changed"), ("d.md", "changed")], "rel string, change string")
    got = refresh.apply_diff(*build(old), changed, texts(new))
    for a, b in zip(got, build(new)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_watch_and_budget():
    w = refresh.Watch(batch=3)
    assert [w.due(n) for n in (0, 1, 1, 1, 1, 3)] == [False, False, False, False, True, True]
    b = refresh.Budget(1.0)
    assert b.stale(10) is None and b.stale(30) == {"files": 30, "vectors": 0}


def test_tree_scan(spark, tmp_path):
    for rel, data in {"a.md": b"x", "b.bin.md": b"\x00y", ".env": b"s", "sub/c.py": b"z = 1\n", "bad.md": b"\xff\xfe"}.items():
        p = tmp_path / rel
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    config = external.load_config(env={})
    found = tree.entries(spark, str(tmp_path), config).persist()
    assert {r["rel"]: r["kind"] for r in found.collect()} == {"a.md": "Doc", "sub/c.py": "Code"}
    known, unread = tree.prune(tree.listing(spark, str(tmp_path)), found)
    assert {r["rel"] for r in known.collect()} == {"a.md", "sub/c.py"} and "a.md" not in {r["rel"] for r in unread.collect()}
    (tmp_path / "a.md").write_bytes(b"changed")
    assert [tuple(r) for r in tree.diff(found, tree.entries(spark, str(tmp_path), config, found)).collect()] == [("a.md", "changed")]


def test_legacy_and_cases(spark, tmp_path):
    g = tmp_path / "g.json"
    g.write_text('{"nodes":[{"id":"1","label":"FR-A-1 refund","source_file":"x","_origin":"doc","community_name":"c"},{"id":"2","label":"Thing","source_file":"y","_origin":"doc","community_name":"c"},{"id":"3","label":"q","source_file":"z","_origin":"ast","community_name":"c"}],"links":[{"source":"1","target":"2","relation":"uses","context":""},{"source":"1","target":"3","relation":"r","context":""},{"source":"2","target":"2","relation":"r","context":""}]}')
    e, concepts, counts = external.import_graph(nodes(spark, [node("FR-A-1", "Requirement", "x")]), spark.read.option("multiLine", True).json(str(g)))
    assert [(r["source"], r["target"]) for r in e.collect()] == [("FR-A-1", "legacy:2")]
    assert counts.first().asDict() == {"edges_seen": 2, "resolved_both": 0, "resolved_one": 1, "self_loops": 1, "concepts_created": 1}
    c = tmp_path / "c.jsonl"
    c.write_text('{"kind":"k","q":"one","expect":"A"}\n\n{"kind":"k","q":"two","expect":["B","C"]}\n')
    assert [r["expect"] for r in external.read_cases(spark, str(c)).orderBy("pos").collect()] == [["A"], ["B", "C"]]


def test_evaluation(spark):
    assert evaluate.verdict(40, 18, 12, 222, "dense") == 0 and evaluate.verdict(40, 17, 12, 222, "dense") == 3 and evaluate.verdict(1, 1, 1, 1, "x") == 1
    v = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert evaluate.p90(v, "v").first()["v"] == 9.0 and evaluate.median_upper(v, "v").first()["v"] == 5.0
    cases = spark.createDataFrame([(0, "q", "code", ["sym:a::x", "f.md"])], "pos long, q string, kind string, expect array<string>")
    ans = spark.createDataFrame([("q", "sym:a::y", "f.md", "expanded"), ("q", "sym:a::x", "g.md", "seed")], "q string, id string, file string, role string")
    assert {r["anchor"]: r["hit"] for r in evaluate.found(cases, ans).collect()} == {"sym:a::x": True, "f.md": False}
    moved = evaluate.relocate(cases, nodes(spark, [node("sym:b::x")])).first()
    assert moved["at"] == "sym:b::x"


def test_families(spark):
    n = nodes(spark, [node("FR-A-1", "Requirement", files=["a", "b"]), node("FR-A-2", "Requirement"), node("BE-M01/T01", "Task"), node("sym:x::FR-A-3")])
    assert {(r["form"], r["family"]): (r["nodes"], r["definitions"]) for r in families.of_graph(n).collect()} == {("id", "FR-A"): (2, 3), ("milestone", "BE"): (1, 1)}
    assert families.line([str(i) for i in range(22)]).endswith("… +2")


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_postings_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([("a", "x1 yy x1"), ("b", "yy"), ("c", ""), ("d", None)], "id string, text string")
    p = lexical.build(docs, stemmed=False).postings.select("id", "gram", "key", "tf")
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert _rows(p) == _rows(spark.createDataFrame([("a", "term", "x1", 2), ("a", "term", "yy", 1), ("a", "pair", "x1 yy", 1), ("a", "pair", "yy x1", 1), ("b", "term", "yy", 1)], "id string, gram string, key string, tf int"))


def test_texts_of_one_id_are_counted_together(spark):
    docs = spark.createDataFrame([("a", "x1 yy"), ("a", "x1"), (None, "yy yy"), (None, "yy"), ("b", "zz")], "id string, text string")
    index = lexical.build(docs, stemmed=False)
    want = [("a", "term", "x1", 2), ("a", "term", "yy", 1), ("a", "pair", "x1 yy", 1), (None, "term", "yy", 3), (None, "pair", "yy yy", 1), ("b", "term", "zz", 1)]
    want = spark.createDataFrame(want, "id string, gram string, key string, tf int")
    assert _rows(index.postings.select("id", "gram", "key", "tf")) == _rows(want)
    keys = lexical.question_keys(spark, {"q": "x1 yy"}, stemmed=False)
    assert _rows(index.of(keys).postings.select("id", "gram", "key", "tf")) == _rows(want.where("key != 'zz' and key != 'yy yy'"))


def test_adjacent_pairs_lay_out_pairs_alone(spark):
    index = lexical.build(spark.createDataFrame([("a", "x1 yy x1")], "id string, text string"), stemmed=False)
    assert _rows(index.counted("pair").select("key", "tf")) == _rows(spark.createDataFrame([("x1 yy", 1), ("yy x1", 1)], "key string, tf int"))


def test_few_keys_are_sifted_once_and_no_tokens_written(spark):
    from quillgraph import shared

    held = lambda name: sum(x.startswith(f"{name}-") for x in shared.folders(spark, shared._own(spark)))
    tokens, sifted = held("tokens"), held("sifted")
    index = lexical.build(spark.createDataFrame([("a", "alpha beta"), ("b", "beta")], "id string, text string"), stemmed=False)
    got = lexical.coverage(index, lexical.question_keys(spark, {"q": "alpha beta"}, stemmed=False)).collect()
    assert len(got) == 1 and got[0]["best"] > 0
    assert (held("tokens") - tokens, held("sifted") - sifted) == (0, 1)


def test_stems_of_a_batch(spark):
    from pyspark.sql import functions as F

    from quillgraph.functions.stem import stem
    from quillgraph.functions.tokens import stemmer

    rows = [(["running", "cats", "cats"],), (None,), ([],), (["v-2", "cats"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").coalesce(1).select(stemmer()(F.col("t"))).collect()]
    assert got == [None if t is None else [stem(x) for x in t] for (t,) in rows]


def test_walks_hand_on_no_dead_ends(spark):
    ids = [f"sym:a.py::{x}" for x in "abcd"]
    a, b, c, d = ids
    s = traverse.Snapshot.of(nodes(spark, [node(x) for x in ids]), edges(spark, [call(b, a), call(c, b), call(d, a), call(b, c)]))
    assert {(r["at"][-1], r["other"][-1]): r["goes_on"] for r in s.up.collect()} == {("a", "b"): True, ("b", "c"): True, ("a", "d"): False, ("c", "b"): True}
    roots = spark.createDataFrame([(a,), (d,)], "root string")
    assert {(r["root"][-1], r["id"][-1], r["depth"]) for r in traverse.walk(s, roots, 5).collect()} == {("a", "b", 1), ("a", "d", 1), ("a", "c", 2)}


def test_many_live_walks_see_the_same(spark, monkeypatch):
    ids = [f"sym:a.py::{x}" for x in "abcd"]
    a, b, c, d = ids
    s = traverse.Snapshot.of(nodes(spark, [node(x) for x in ids]), edges(spark, [call(b, a), call(c, b), call(a, c), call(d, c)]))
    roots = spark.createDataFrame([(x,) for x in ids], "root string")
    few = _rows(traverse.walk(s, roots, 6))
    monkeypatch.setattr(traverse, "LIVE", 0)
    assert few == _rows(traverse.walk(s, roots, 6))


def test_trace_stops_where_no_step_leads_on(spark):
    from quillgraph import shared

    held = lambda: sum(x.startswith("layer-") for x in shared.folders(spark, shared._own(spark)))
    a, b, c = [f"sym:a.py::{x}" for x in "abc"]
    s = traverse.Snapshot.of(nodes(spark, [node(x) for x in (a, b, c)]), edges(spark, [call(a, b), call(b, c)]))
    before = held()
    got = traverse.trace(s, spark.createDataFrame([(a, c)], "from string, to string"), 6).collect()
    assert [[p["id"] for p in r["path"]] for r in got] == [[a, b, c]]
    assert held() - before == 2
