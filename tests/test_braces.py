"""Code of languages in braces: what is declared, and what references are bound to."""

import pytest

from quillgraph.schema import EDGES, NODES
from quillgraph.sources import documents
from quillgraph.sources.code import code
from quillgraph.streaming import refresh

RUST = {
    "libs/till-core/src/lib.rs": "pub mod ports;\npub mod drawer;\n",
    "libs/till-core/src/ports.rs": "pub trait Printer {\n    fn print(&self, line: &str);\n}\n",
    "libs/till-core/src/drawer.rs": "pub struct Drawer;\n\nimpl Drawer {\n    pub fn unlock() -> Drawer {\n        Drawer\n    }\n}\n",
    "libs/till/src/main.rs": "mod desk;\nmod night;\n\nuse till_core::drawer::Drawer;\n\nfn main() {\n    let _ = Drawer::unlock();\n    night::close();\n}\n",
    "libs/till/src/night.rs": "use till_core::drawer::Drawer;\n\nimpl Drawer {\n    pub fn tally() {}\n}\n\npub fn close() {\n    Drawer::tally();\n    super::desk::open();\n}\n",
    "libs/till/src/desk.rs": "use till_core::{ports::Printer, drawer as d};\n\npub struct Desk<P: Printer> {\n    out: P,\n}\n\nimpl<P: Printer> Desk<P> {\n    pub fn greet(&self) {\n        self.out.print(\"hi\");\n    }\n}\npub fn open() {\n    d::Drawer::unlock();\n}\n",
}
SHOP = {
    "web/lib/index.ts": "export class Base {\n  m() {}\n}\nexport function helper() {}\n",
    "web/util.ts": "export const deep = (n: number) => n\n",
    "web/util.js": "export const deep = 1\n",
    "web/x.ts": "import { Base, helper as h } from './lib'\nimport * as ns from '../web/util'\nimport gone from 'package'\nexport class K extends Base {\n  @In() a = 'x'\n  constructor(private readonly svc: Base) {}\n  run(n: number): void {\n    this.go(h)\n    this.svc.m(n, () => { ns.deep(1) })\n    const run2 = (z) => z\n    gone(1)\n  }\n  go(h: Base) { h() }\n}\n",
    "web/P.vue": "<template><a @click=\"helper()\"/></template>\n<script setup lang=\"ts\">\nimport { helper } from './lib'\nfunction go() {\n  helper()\n}\n</script>\n",
    "j/core/Ledger.java": "package core;\npublic class Ledger {\n  public void add(int n) { }\n  public void add(int n, int m) { }\n}\n",
    "j/shop/Port.java": "package shop;\npublic interface Port {\n  void charge(int n);\n}\n",
    "j/shop/Pay.java": "package shop;\nimport core.Ledger;\n@Named(\"x\")\npublic class Pay implements Port {\n  private final Ledger ledger;\n  @Override\n  public void charge(int n) {\n    ledger.add(n);\n    check(n);\n    Twin.make();\n    elsewhere(n);\n  }\n  private void check(int n) { }\n}\n",
    "j/shop/Kin.kt": "package shop\nimport core.Ledger\nclass Kin(private val ledger: Ledger) : Port {\n    override fun charge(n: Int) {\n        ledger.add(n)\n        twice(n)\n    }\n    fun twice(n: Int) = half(n)\n}\nfun half(n: Int): Int {\n    return n\n}\n",
    "j/shop/TwinA.java": "package shop;\nclass Twin {\n  static void make() { }\n}\n",
    "j/shop/TwinB.java": "package shop;\nclass Twin {\n  static void make() { }\n}\n",
    "c/Books.cs": "namespace Core.Books;\npublic class Ledger {\n    public void Add(int n) { }\n}\npublic interface IPort { }\n",
    "c/Pay.cs": "using Core.Books;\nnamespace Shop;\npublic class Pay : IPort {\n    private readonly Ledger _ledger;\n    public void Charge(int n) {\n        _ledger.Add(n);\n        var o = new Ledger();\n        o.Add(n);\n        Check(n);\n    }\n    void Check(int n) => Charge(n);\n}\n",
    "d/ledger.dart": "class Ledger {\n  void add(int n) {}\n}\nvoid helper(int n) {}\n",
    "d/pay.dart": "import 'ledger.dart';\nclass Pay {\n  final Ledger ledger;\n  void charge(int n) {\n    ledger.add(n);\n    helper(n);\n  }\n}\n",
}


def read(spark, files):
    rows = [(k, "Code", v) for k, v in files.items()]
    return spark.createDataFrame(rows, "rel string, kind string, text string")


def graph_of(spark, files):
    none = spark.createDataFrame([], EDGES)
    nodes, edges = documents.extract(read(spark, files))
    return refresh.merged(spark.createDataFrame([], NODES), none, none, nodes, edges)


def bound(spark, files, kinds=("Calls", "Extends", "Implements", "References")):
    _, edges = documents.extract(read(spark, files))
    return {(r.source.split(":", 1)[1], r.kind, r.target.split(":", 1)[1], r.context) for r in edges.collect() if r.kind in kinds}


def test_rust_workspace(spark):
    core, till = "libs/till-core/src", "libs/till/src"
    assert bound(spark, RUST) == {
        (f"{till}/main.rs::main", "Calls", f"{core}/drawer.rs::Drawer.unlock", ""),
        (f"{till}/main.rs::main", "Calls", f"{till}/night.rs::close", ""),
        (f"{till}/night.rs::close", "Calls", f"{till}/night.rs::Drawer.tally", ""),
        (f"{till}/night.rs::close", "Calls", f"{till}/desk.rs::open", ""),
        (f"{till}/night.rs::Drawer.tally", "References", f"{core}/drawer.rs::Drawer", ""),
        (f"{till}/desk.rs::Desk.greet", "Calls", f"{core}/ports.rs::Printer.print", ""),
        (f"{till}/desk.rs::open", "Calls", f"{core}/drawer.rs::Drawer.unlock", ""),
    }


def test_other_languages(spark):
    got = bound(spark, SHOP)
    assert {g for g in got if g[0].startswith("web/")} == {
        ("web/x.ts::K", "Extends", "web/lib/index.ts::Base", ""),
        ("web/x.ts::K.run", "Calls", "web/x.ts::K.go", ""),
        ("web/x.ts::K.run", "Calls", "web/lib/index.ts::helper", "arg"),
        ("web/x.ts::K.run", "Calls", "web/lib/index.ts::Base.m", ""),
        ("web/x.ts::K.run", "Calls", "web/util.ts::deep", ""),
        ("web/P.vue::go", "Calls", "web/lib/index.ts::helper", ""),
    }
    assert {g for g in got if g[0].startswith("j/")} == {  # two Twins: neither is called
        ("j/shop/Pay.java::Pay", "Implements", "j/shop/Port.java::Port", ""),
        ("j/shop/Pay.java::Pay.charge", "Calls", "j/core/Ledger.java::Ledger.add", ""),
        ("j/shop/Pay.java::Pay.charge", "Calls", "j/shop/Pay.java::Pay.check", ""),
        ("j/shop/Kin.kt::Kin", "Extends", "j/shop/Port.java::Port", ""),
        ("j/shop/Kin.kt::Kin.charge", "Calls", "j/core/Ledger.java::Ledger.add", ""),
        ("j/shop/Kin.kt::Kin.charge", "Calls", "j/shop/Kin.kt::Kin.twice", ""),
        ("j/shop/Kin.kt::Kin.twice", "Calls", "j/shop/Kin.kt::half", ""),
    }
    assert {g for g in got if g[0][:2] in ("c/", "d/")} == {
        ("c/Pay.cs::Pay", "Implements", "c/Books.cs::IPort", ""),
        ("c/Pay.cs::Pay.Charge", "Calls", "c/Books.cs::Ledger.Add", ""),
        ("c/Pay.cs::Pay.Charge", "Calls", "c/Books.cs::Ledger", ""),
        ("c/Pay.cs::Pay.Charge", "Calls", "c/Pay.cs::Pay.Check", ""),
        ("c/Pay.cs::Pay.Check", "Calls", "c/Pay.cs::Pay.Charge", ""),
        ("d/pay.dart::Pay.charge", "Calls", "d/ledger.dart::Ledger.add", ""),
        ("d/pay.dart::Pay.charge", "Calls", "d/ledger.dart::helper", ""),
    }


def test_extents_and_imports(spark):
    pay = {n[2]: n[5:7] for n in code("j/shop/Pay.java", SHOP["j/shop/Pay.java"]).nodes}
    assert pay["Pay"] == (4, 14) and pay["Pay.charge"] == (7, 12) and pay["Pay.check"] == (13, 13)
    desk = {n[2]: n[5:7] for n in code("libs/till/src/desk.rs", RUST["libs/till/src/desk.rs"]).nodes}
    assert desk["Desk"] == (3, 5) and desk["Desk.greet"] == (8, 10)
    _, edges = documents.extract(read(spark, SHOP))
    led = {(e.source, e.target) for e in edges.where("kind = 'Imports'").collect()}
    assert {("file:web/x.ts", "file:web/lib/index.ts"), ("file:web/x.ts", "file:web/util.ts")} <= led


@pytest.mark.parametrize("text", ["", "}", "{", "class", "fn (", "class A extends {", "((((", "a.b.c(", "\u0000", "class A { f( {"])
@pytest.mark.parametrize("rel", ["a.ts", "a.rs", "a.java", "a.kt", "a.cs", "a.dart", "a.vue"])
def test_broken_code_is_read(rel, text):
    assert code(rel, text).nodes[0][0] == f"file:{rel}"


def test_update_equals_rebuild(spark):
    """A declaration that comes makes two answers of one, in a file that did not change."""
    old = {k: v for k, v in SHOP.items() if k.startswith("j/") and "TwinB" not in k}
    new = {**old, "j/shop/TwinB.java": SHOP["j/shop/TwinB.java"]}
    changed = spark.createDataFrame([("j/shop/TwinB.java", "changed")], "rel string, change string")
    got = refresh.apply_diff(*graph_of(spark, old), changed, read(spark, new))
    for a, b in zip(got, graph_of(spark, new)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_compiled_paths_lead_to_sources(spark):
    files = {
        "p/src/a.ts": "export const a = (n: number) => n\n", "p/src/b.ts": "export const b = (n: number) => n\n", "p/dist/b.js": "export const b = 1\n",
        "p/x.ts": "import { a } from './dist/a.js'\nimport { b } from './dist/b.js'\nimport { c } from './dist/none.js'\n",
    }
    _, edges = documents.extract(read(spark, files))
    led = {e.target for e in edges.where("kind = 'Imports'").collect()}
    assert led == {"file:p/src/a.ts", "file:p/dist/b.js", "file:p/dist/none.ts"}
