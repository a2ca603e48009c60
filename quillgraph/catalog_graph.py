"""More of the engine's queries over the driver's tables: identifiers, names, walks' parts,
families, refresh and evaluation, each with its DuckDB oracle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .catalog import ASKED, _IDS, _TOKENS, _asked_sql, _identified, _passages, _requirements, query, table
from .functions.ids import find_ids, node_kind_column
from .operators import ask, bind, changes, dense, evaluate, families, graph, lexical, resolve, traverse
from .schema import EDGE_KEY
from .shared import dealt

# ---- identifiers


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k, 'R-' || n AS id, 4 AS start FROM (SELECT k, unnest(generate_series(1000 + s, 1000 + s + k % 60)) AS n FROM p WHERE k % 60 <= 50)
UNION SELECT k, 'R-' || (1000 + s), 4 FROM p UNION SELECT k, 'R-' || (1000 + s + k % 60), 4 + length('R-1000…') FROM p WHERE k % 60 > 50
UNION SELECT k, unnest(['INV-0' || s, 'INV-' || (s + 1), 'INV-7']), length('see R-1000…R-1000, ') FROM p
UNION SELECT k, 'FR-A-' || s, length('see R-1000…R-1000, INV-0/7/; ') + length((s + 1)::VARCHAR) + length(s::VARCHAR) FROM p""")
def found_ids(spark, d):
    """Ranges (wide ones are their two ends), lists as written, and ids alone."""

    @F.pandas_udf("array<struct<id:string,start:int>>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"id": i, "start": s} for i, s in find_ids(t)])

    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    text = F.concat(F.lit("see R-"), F.col("s") + 1000, F.lit("…R-"), F.col("s") + 1000 + F.col("k") % 60, F.lit(", INV-0"), "s", F.lit("/"), F.col("s") + 1, F.lit("/7; FR-A-"), "s", F.lit(" XFR-B-1Y B1."))
    return p.select("k", F.inline(ids(text))).select("k", "id", "start")


@query(f"SELECT id, CASE WHEN id LIKE 'INV-%' THEN 'Invariant' WHEN id LIKE 'ADR-%' THEN 'Adr' WHEN regexp_matches(id, '^[A-Z]+-M[0-9]{{2}}$') THEN 'Milestone' ELSE 'Requirement' END AS kind FROM (SELECT DISTINCT {_IDS} AS id FROM documents UNION SELECT DISTINCT (['INV-', 'ADR-', 'PL-M', 'X-'])[doc_id % 4 + 1] || lpad((doc_id % 90)::VARCHAR, 2, '0') FROM documents)")
def node_kinds(spark, d):
    docs = table(spark, d, "documents")
    head = F.element_at(F.array(*map(F.lit, ("INV-", "ADR-", "PL-M", "X-"))), (F.col("doc_id") % 4 + 1).cast("int"))
    ids = docs.select(F.concat(head, F.lpad((F.col("doc_id") % 90).cast("string"), 2, "0")).alias("id")).union(_identified(spark, d).select("id")).distinct()
    return ids.select("id", node_kind_column(F.col("id")).alias("kind"))


# ---- names and what walks are made of


@query("SELECT 'sym:f' || p_size || '::A.b' || p_partkey || '.c' AS id, 'sym:f' || p_size || '::A.b' || p_partkey AS holder, 'f' || p_size AS file FROM part UNION ALL SELECT 'sym:f' || p_size || '::A' || p_partkey, NULL, 'f' || p_size FROM part")
def symbol_names(spark, d):
    p = table(spark, d, "part")
    head = F.concat(F.lit("sym:f"), "p_size", F.lit("::A"))
    ids = p.select(F.concat(head, F.lit(".b"), "p_partkey", F.lit(".c")).alias("id")).unionAll(p.select(F.concat(head, "p_partkey")))
    return ids.select("id", traverse.container(F.col("id")).alias("holder"), traverse.file_of_symbol(F.col("id")).alias("file"))


_OWN = """own AS (SELECT 'sym:x::R' || n_regionkey AS id, 'sym:x::R' || n_regionkey || '.N' || n_nationkey AS member FROM nation
  UNION SELECT 'sym:x::R' || n_regionkey || '.N' || n_nationkey, 'sym:x::R' || n_regionkey || '.N' || n_nationkey || '.C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _declares(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    top = F.concat(F.lit("sym:x::R"), "n_regionkey")
    mid = F.concat(top, F.lit(".N"), "n_nationkey")
    low = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(mid.alias("source"), F.concat(mid, F.lit(".C"), "c_custkey").alias("target"))
    e = n.select(top.alias("source"), mid.alias("target")).union(low)
    return e.select("source", "target", F.lit("Declares").alias("kind"), F.lit("").alias("context"), F.lit("x").alias("file"))


@query(f"WITH {_OWN} SELECT id, member, 0::BIGINT AS hop FROM own UNION ALL SELECT a.id, b.member, 1 FROM own a JOIN own b ON b.id = a.member")
def type_members(spark, d):
    return traverse.members(_declares(spark, d)).select("id", "member", F.col("hop").cast("long").alias("hop"))


@query("""
WITH s AS (SELECT 'sym:f' || c_nationkey || '::S' || c_custkey AS id, c_nationkey AS n, 'S' || c_custkey AS name FROM customer),
b AS (SELECT id, 'b' || n_regionkey AS bar, CASE WHEN n_nationkey % 2 = 0 THEN name ELSE 'T' || substring(name, 2) END AS name FROM s JOIN nation ON n = n_nationkey WHERE n_nationkey % 2 = 0 OR name = 'S' || n_nationkey)
SELECT id, 'sym:' || bar || '::' || name AS alias, 1::BIGINT AS hop FROM b UNION ALL SELECT id, 'sym:all::' || name, 2 FROM b""")
def reexport_aliases(spark, d):
    """Files of even nations are re-exported whole, of odd ones by one name, renamed; regions' barrels whole."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    nodes = c.select(F.concat(F.lit("sym:f"), "c_nationkey", F.lit("::S"), "c_custkey").alias("id"), F.lit("Symbol").alias("kind"), F.concat(F.lit("f"), "c_nationkey").alias("file"))
    said = F.when(F.col("n_nationkey") % 2 == 0, F.lit("*")).otherwise(F.concat(F.lit("S"), "n_nationkey", F.lit(" as T"), "n_nationkey"))
    edge = lambda df, a, b, ctx: df.select(F.concat(F.lit("file:"), a).alias("source"), F.concat(F.lit("file:"), b).alias("target"), F.lit("ReExports").alias("kind"), ctx.alias("context"), a.alias("file"))
    barrel, leaf = F.concat(F.lit("b"), "n_regionkey"), F.concat(F.lit("f"), "n_nationkey")
    e = edge(n, barrel, leaf, said).union(edge(n.select("n_regionkey").distinct(), F.lit("all"), barrel, F.lit("*")))
    return traverse.aliases(nodes, e).select("id", "alias", F.col("hop").cast("long").alias("hop"))


@query("""
WITH m AS (SELECT 'sym:c' || (p_size % 9) || '::K' || p_size || '.m' || (p_partkey % 50) AS member, p_size AS k, p_partkey % 50 AS leaf FROM part),
i AS (SELECT DISTINCT 'sym:i::I' || (p_size % 7) || '.m' || (p_partkey % 40) AS id FROM part)
SELECT DISTINCT member, 'sym:i::I' || (k % 7) || '.m' || leaf AS contract FROM m WHERE 'sym:i::I' || (k % 7) || '.m' || leaf IN (SELECT id FROM i)""")
def dispatch_contracts(spark, d):
    p = table(spark, d, "part")
    size, leaf = F.col("p_size"), F.concat(F.lit(".m"), (F.col("p_partkey") % 50).cast("string"))
    cls = F.concat(F.lit("sym:c"), (size % 9).cast("string"), F.lit("::K"), size.cast("string"))
    face = F.concat(F.lit("sym:i::I"), (size % 7).cast("string"))
    nodes = p.select(F.concat(cls, leaf).alias("id")).union(p.select(F.concat(face, F.lit(".m"), (F.col("p_partkey") % 40).cast("string")))).distinct()
    e = p.select(cls.alias("source"), face.alias("target"), F.lit("Implements").alias("kind"), F.lit("").alias("context"), F.lit("").alias("file")).distinct()
    return traverse.dispatch(nodes.withColumn("kind", F.lit("Symbol")), e).select("member", "contract").distinct()


_KINDS = "(['Calls', 'Extends', 'References', 'Implements', 'Imports'])[l_linenumber % 5 + 1]"


@query(f"""
WITH e AS (SELECT l_orderkey AS o, l_linenumber AS n, {_KINDS} AS kind, CASE WHEN l_returnflag = 'R' THEN 'sym:' ELSE '' END || l_partkey AS target, CASE l_linestatus WHEN 'O' THEN 'arg' ELSE '' END AS context FROM lineitem)
SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE context = 'arg')::BIGINT AS passed FROM e WHERE kind IN ('Calls', 'Extends') OR (kind IN ('References', 'Implements') AND target LIKE 'sym:%') GROUP BY kind""")
def walked_edges(spark, d):
    line = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("Calls", "Extends", "References", "Implements", "Imports"))), F.col("l_linenumber") % 5 + 1)
    e = line.select(
        F.col("l_orderkey").cast("string").alias("source"), F.concat(F.when(F.col("l_returnflag") == "R", "sym:").otherwise(""), F.col("l_partkey").cast("string")).alias("target"),
        kind.alias("kind"), F.when(F.col("l_linestatus") == "O", "arg").otherwise("").alias("context"), F.lit("").alias("file"),
    )
    return traverse.walked(e).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query("SELECT 'sym:src/' || lower(p_type) || (['', '/test/', '.spec.', '/e2e/', 'test'])[p_size % 5 + 1] || 'a.ts::P' || p_partkey AS id, p_size % 5 IN (1, 2, 3) AS test FROM part")
def test_ids(spark, d):
    p = table(spark, d, "part")
    part = F.element_at(F.array(*map(F.lit, ("", "/test/", ".spec.", "/e2e/", "test"))), F.col("p_size") % 5 + 1)
    ids = p.select(F.concat(F.lit("sym:src/"), F.lower("p_type"), part, F.lit("a.ts::P"), "p_partkey").alias("id"))
    return ids.select("id", ask.is_test(F.col("id")).alias("test"))


# ---- families


@query(f"""
WITH r AS (SELECT {_IDS} AS id, source, doc_id FROM documents), n AS (SELECT id, count(DISTINCT source) AS f, min(source || lpad(doc_id::VARCHAR, 12, '0')) AS site FROM r GROUP BY id)
SELECT regexp_extract(id, '^(.*)-[0-9]+$', 1) AS family, count(*)::BIGINT AS nodes, sum(f)::BIGINT AS definitions, regexp_replace(min(site), '[0-9]{{12}}$', '') AS file,
       right(min(site), 12)::BIGINT AS line, sum(f) = 1 AS once FROM n GROUP BY family""")
def family_report(spark, d):
    return families.report(_requirements(spark, d)).select("family", "nodes", "definitions", "file", F.col("line").cast("long").alias("line"), "once")


@query("""
WITH a AS (SELECT DISTINCT lang || source AS family FROM documents WHERE doc_id % 3 != 0), b AS (SELECT DISTINCT lang || source AS family FROM documents WHERE n_chars > 3000)
SELECT family, 'gained' AS moved FROM b WHERE family NOT IN (SELECT family FROM a) UNION ALL SELECT family, 'lost' FROM a WHERE family NOT IN (SELECT family FROM b)""")
def families_moved(spark, d):
    docs = table(spark, d, "documents").withColumn("family", F.concat("lang", "source"))
    return families.moved(docs.where("doc_id % 3 != 0"), docs.where("n_chars > 3000"))


# ---- graph and refresh


@query("SELECT file, id, min(seq) AS seq FROM (SELECT source AS file, md5(text) AS id, doc_id AS seq FROM documents) GROUP BY file, id")
def finish_files(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("file"), F.md5("text").alias("id"), F.col("doc_id").alias("seq"))
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE_KEY))
    return graph.finish(docs, none)[0].select("file", "id", "seq")


@query("""
WITH RECURSIVE b AS (SELECT DISTINCT 'f' || (p_partkey % 400) AS rel, 'f' || (p_partkey * 7 % 400 + p_size) AS by_ FROM part WHERE p_size > 25),
r(rel) AS (SELECT 'f3' UNION SELECT by_ FROM r JOIN b USING (rel)) SELECT rel FROM r WHERE rel != 'f3'""")
def importers_closure(spark, d):
    p = table(spark, d, "part").where("p_size > 25")
    by = F.concat(F.lit("f"), (F.col("p_partkey") * 7 % 400 + F.col("p_size")).cast("string"))
    e = p.select(by.alias("file"), F.concat(F.lit("file:f"), (F.col("p_partkey") % 400).cast("string")).alias("target"), F.lit("Imports").alias("kind")).distinct()
    return graph.widen_by_imports(e, spark.createDataFrame([("f3",)], "rel string"))


@query("""
WITH a AS (SELECT doc_id::VARCHAR AS rel, source || '.' || doc_id % 40 AS family, md5(text) AS header FROM documents WHERE doc_id % 50 != 1),
b AS (SELECT doc_id::VARCHAR AS rel, source || '.' || doc_id % 40 AS family, CASE WHEN doc_id % 70 = 2 THEN 'x' ELSE md5(text) END AS header FROM documents),
m AS (SELECT DISTINCT coalesce(a.family, b.family) AS family FROM a FULL JOIN b USING (rel, family) WHERE a.header IS DISTINCT FROM b.header)
SELECT rel FROM b WHERE family IN (SELECT family FROM m)""")
def header_widening(spark, d):
    docs = table(spark, d, "documents")
    family = F.concat("source", F.lit("."), (F.col("doc_id") % 40).cast("string")).alias("family")
    row = lambda df, h: df.select(F.col("doc_id").cast("string").alias("rel"), family, h.alias("header"))
    new = F.when(F.col("doc_id") % 70 == 2, "x").otherwise(F.md5("text"))
    return graph.widen_by_header(row(docs.where("doc_id % 50 != 1"), F.md5("text")), row(docs, new))


@query("""
WITH a AS (SELECT source AS s, lang AS t, (['Calls', 'Links'])[doc_id % 2 + 1] AS kind, (doc_id % 30)::VARCHAR AS file FROM documents WHERE doc_id % 3 != 0),
b AS (SELECT source AS s, lang AS t, (['Calls', 'Links'])[doc_id % 2 + 1] AS kind, (doc_id % 30)::VARCHAR AS file FROM documents WHERE doc_id % 4 != 0),
x AS (SELECT s, t, kind, file, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT s, t, kind, file, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT kind, file, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS lost, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS added FROM x FULL JOIN y USING (s, t, kind, file))
SELECT CASE WHEN file::INT < 20 THEN 'lang' || file::INT % 3 ELSE '-' END AS lang, kind, CASE kind WHEN 'Calls' THEN 'bounded' ELSE 'structural' END AS class, sum(lost)::BIGINT AS lost, sum(added)::BIGINT AS added
FROM m WHERE lost + added > 0 GROUP BY ALL""")
def language_moves(spark, d):
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "Calls").otherwise("Links")
    e = lambda df: df.select("source", F.col("lang").alias("target"), kind.alias("kind"), F.lit("").alias("context"), (F.col("doc_id") % 30).cast("string").alias("file"))
    langs = spark.range(20).select(F.col("id").cast("string").alias("rel"), F.concat(F.lit("lang"), (F.col("id") % 3).cast("string")).alias("lang"))
    return graph.language_diff(e(docs.where("doc_id % 3 != 0")), e(docs.where("doc_id % 4 != 0")), langs)


# ---- retrieval


@query("SELECT doc_id::VARCHAR || ' ' || lang || ' ' || CASE WHEN doc_id % 2 = 0 THEN list_last(string_split(text, chr(10))) ELSE text END AS said FROM documents WHERE text IS NOT NULL")
def passage_text(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    n = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("label"), F.when(F.col("doc_id") % 2 == 0, "Symbol").otherwise("Requirement").alias("kind"), F.col("text").alias("body"))
    return n.select(lexical.passage(n).alias("said"))


def _coverage_sql(name: str, source: str) -> str:
    own = _TOKENS.replace("FROM documents", f"FROM ({source})")
    return f"""{name} AS (WITH {own}, {_asked_sql(ASKED)}, df AS (SELECT gram, key, count(*) AS df FROM post GROUP BY ALL),
scored AS (SELECT q, id, sum(times * CASE gram WHEN 'pair' THEN 0.25 ELSE 1.0 END * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
           FROM post JOIN keys USING (gram, key) JOIN df USING (gram, key) JOIN len USING (id) CROSS JOIN corpus GROUP BY ALL),
att AS (SELECT q, sum(CASE gram WHEN 'pair' THEN 0.25 ELSE 1.0 END * ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1)) AS a
        FROM (SELECT DISTINCT q, gram, key FROM keys) LEFT JOIN df USING (gram, key) CROSS JOIN corpus GROUP BY q)
SELECT att.q, coalesce(max(score), 0) AS best, coalesce(max(score), 0) / a AS share FROM att LEFT JOIN scored USING (q) GROUP BY att.q, a)"""


@query(f"""
WITH {_coverage_sql("p", "SELECT doc_id, text FROM documents")}, {_coverage_sql("t", "SELECT page_id AS doc_id, html AS text FROM pages")}
SELECT q, t.best > 0 AND (p.share <= 0 OR t.share / p.share >= 0.761) AS admitted FROM p JOIN t USING (q)""")
def text_admission(spark, d):
    """Whether the pages are seated beside the documents, question by question."""
    pages = dealt(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("text")))
    keys = lexical.question_keys(spark, ASKED, stemmed=False)
    return lexical.admitted(lexical.build(_passages(spark, d), stemmed=False), lexical.build(pages, stemmed=False), keys)


@query("SELECT doc_id::VARCHAR AS id FROM documents d WHERE doc_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND doc_id % 5 != 0)")
def owed_rows(spark, d):
    """Rows without a vector of the model: a third were never embedded, a fifth have changed since."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("row_hash"), "doc_id")
    old = docs.where("doc_id % 3 != 0").select("id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("row_hash")).alias("row_hash"), F.lit("m").alias("model"))
    other = docs.select("id", "row_hash", F.lit("other").alias("model"))
    return dense.owed(docs, old.unionByName(other), "m").select("id")


@query("""
WITH p AS (SELECT vec_id::VARCHAR AS id, label::VARCHAR AS q, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings)
SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN id::INT % 9 = 4 AND id::INT < 200 THEN -id::INT ELSE 1 END, place)::BIGINT - 1 AS place FROM p""")
def reranked(spark, d):
    """A model's order of some ids (largest first), the fused order after it."""
    from pyspark.sql import Window as W

    v = table(spark, d, "embeddings")
    pool = v.select(F.col("label").cast("string").alias("q"), F.col("vec_id").cast("string").alias("id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("place"), F.lit(1.0).alias("score"))
    order = [str(i) for i in range(199, -1, -1) if i % 9 == 4]
    return ask.rerank(pool, [*order, order[0], "unknown"]).select("q", "id", F.col("place").cast("long").alias("place"))


# ---- graph health, changes and evaluation


@query(f"""
SELECT count(*) FILTER (WHERE kind != 'Symbol')::BIGINT AS documents, count(*) FILTER (WHERE kind = 'Symbol')::BIGINT AS code,
       count(DISTINCT CASE WHEN kind != 'Symbol' THEN regexp_extract(id, '^(.*)-[0-9]+$', 1) END)::BIGINT AS families, any_value(e)::BIGINT AS edges, 'm' AS model
FROM (SELECT {_IDS} AS id, CASE WHEN doc_id % 4 = 0 THEN 'Symbol' ELSE 'Requirement' END AS kind FROM documents), (SELECT count(*) AS e FROM orders)""")
def primed(spark, d):
    n = _identified(spark, d).select("id", F.when(F.col("doc_id") % 4 == 0, "Symbol").otherwise("Requirement").alias("kind"))
    return resolve.prime(n, table(spark, d, "orders"), "m")


@query("""
SELECT 'c' || c_custkey || '.py' AS file, (c_custkey % 90 + 1)::INT AS start, (c_custkey % 90 + 1 + greatest(c_custkey % 4, 1) - 1)::INT AS "end", c_custkey % 3 = 0 AS comment_only FROM customer
UNION ALL SELECT 'c' || c_custkey || '.py', 500, 500, true FROM customer WHERE c_custkey % 5 = 0""")
def diff_hunks(spark, d):
    """A diff a customer: some hunks only of comments, some pure deletions, some deleted files."""
    k = F.col("c_custkey")
    file = F.concat(F.lit("c"), k, F.lit(".py"))
    line = F.when(k % 3 == 0, "+# said\n-   # unsaid\n").otherwise("+x = 1\n+# noqa\n")
    text = F.concat(
        F.lit("diff --git a/x b/x\n--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -1,2 +"), k % 90 + 1, F.lit(","), k % 4, F.lit(" @@ def f\n"), line,
        F.when(k % 5 == 0, "@@ -7 +500 @@\n-\n+# only\n").otherwise(""),
        F.lit("diff --git a/gone b/gone\n--- a/gone.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-a\n"),
    )
    return changes.parse_diffs(table(spark, d, "customer").select(k.cast("string").alias("id"), text.alias("diff"))).select("file", "start", "end", "comment_only")


@query("""
WITH s AS (SELECT 'sym:f' || (p_partkey % 37) || '::P' || (p_partkey % 1500) AS id, 'P' || (p_partkey % 1500) AS name FROM part),
one AS (SELECT name, min(id) AS home FROM (SELECT DISTINCT id, name FROM s) GROUP BY name HAVING count(*) = 1)
SELECT c_custkey::VARCHAR AS q, 'sym:old::P' || c_custkey AS anchor, home AS "at" FROM customer JOIN one ON name = 'P' || c_custkey""")
def relocated_anchors(spark, d):
    p, c = table(spark, d, "part"), table(spark, d, "customer")
    n = p.select(F.concat(F.lit("sym:f"), (F.col("p_partkey") % 37).cast("string"), F.lit("::P"), (F.col("p_partkey") % 1500).cast("string")).alias("id"), F.lit("Symbol").alias("kind")).distinct()
    cases = c.select(F.col("c_custkey").cast("string").alias("q"), F.array(F.concat(F.lit("sym:old::P"), "c_custkey"), F.lit("src/x.py")).alias("expect"))
    return evaluate.relocate(cases, n)


@query("SELECT c_custkey::VARCHAR AS q, 'N' || (c_custkey % 40) AS anchor FROM customer WHERE c_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)")
def unknown_anchors(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    nodes = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.array(F.concat(F.lit("r"), "n_regionkey")).alias("files"))
    cases = c.select(F.col("c_custkey").cast("string").alias("q"), F.array(F.concat(F.lit("N"), (F.col("c_custkey") % 40).cast("string")), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string"))).alias("expect"))
    return evaluate.unknown_anchors(cases, nodes)


@query("""
SELECT o_custkey::VARCHAR AS q, min(CASE WHEN o_orderstatus = 'F' THEN rank END)::BIGINT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) GROUP BY o_custkey""")
def pool_ranks(spark, d):
    """Of each customer's orders, the place of the first that is fulfilled."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").withColumn("rank", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    pool = o.select(F.col("o_custkey").cast("string").alias("q"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("file"), "rank")
    cases = pool.select("q").distinct().withColumn("expect", F.array(F.lit("F"), F.lit("none")))
    return evaluate.pool_rank(cases, pool).select("q", F.col("rank").cast("long").alias("rank"))


@query("""
WITH v AS (SELECT event_type, user_id % 7 AS metric, value, row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type, user_id % 7) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type AS row, metric::BIGINT AS metric, max(CASE WHEN i = n // 2 THEN value END) AS median, min(value) AS low, max(value) AS high, max(value) - min(value) <= max(CASE WHEN i = n // 2 THEN value END) * 0.1 AS steady FROM v GROUP BY ALL""")
def run_gates(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("row"), (F.col("user_id") % 7).alias("metric"), "value").where("value is not null")
    return evaluate.gates(e)


@query("""
SELECT o_orderpriority AS arm, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS hits, count(*)::BIGINT AS cases,
       round(sum(o_custkey)::DOUBLE / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0), 6) AS tokens_per_hit FROM orders GROUP BY arm""")
def agent_scores(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("arm"), F.concat(F.lit("status "), "o_orderstatus", F.lit(" done")).alias("result"), F.array(F.lit("status F"), F.lit("done")).alias("expect"), F.col("o_custkey").alias("tokens"))
    return evaluate.agent_score(rows).select("arm", "hits", "cases", F.round("tokens_per_hit", 6).alias("tokens_per_hit"))


@query("SELECT user_id AS arm, event_id AS run, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def run_deltas(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("arm"), F.col("event_id").alias("run"), "value")
    return evaluate.deltas(e, "value").select("arm", "run", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


@query("""
WITH l AS (SELECT event_type AS arm, user_id AS c, arg_max(value > 50, event_id) AS hit FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT c AS "case", count(*)::BIGINT AS arms FROM l GROUP BY c HAVING NOT bool_or(hit)""")
def systemic_misses(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return evaluate.systemic(e.select(F.col("event_type").alias("arm"), F.col("user_id").alias("case"), F.col("event_id").alias("run"), (F.col("value") > 50).alias("hit")))


@query("""
WITH w AS (SELECT DISTINCT 'f' || doc_id || '.' || lang AS item, '.' || lang AS ext FROM documents), g AS (SELECT DISTINCT 'f' || doc_id || '.' || lang AS item FROM documents WHERE doc_id % 7 = 0)
SELECT ext, count(*)::BIGINT AS want, count(g.item)::BIGINT AS found, round(count(g.item) / count(*), 6) AS recall FROM w LEFT JOIN g USING (item) GROUP BY ext""")
def recall_by_extension(spark, d):
    docs = table(spark, d, "documents")
    item = docs.select(F.concat(F.lit("f"), "doc_id", F.lit("."), "lang").alias("item"), "doc_id")
    out = evaluate.by_extension(item, item.where("doc_id % 7 = 0"))
    return out.select("ext", "want", "found", F.round("recall", 6).alias("recall"))


# ---- references bound over files


_PLACES = """place AS (SELECT DISTINCT 'c' || c_custkey || '.java' AS home, 'p' || c_nationkey AS package, 'C' || (c_custkey // 3) AS name FROM customer),
ref AS (SELECT 'o' || o_orderkey || '.java' AS rel, 1 AS rank, 'p' || (o_custkey % 25) AS package, 'C' || (o_custkey // 3) AS name FROM orders
  UNION ALL SELECT 'o' || o_orderkey || '.java', 2, 'p' || (o_orderkey % 25), 'C' || (o_custkey // 3) FROM orders)"""


@query(f"""WITH {_PLACES}, hit AS (SELECT rel, rank, count(*) AS n, min('sym:' || home || '::' || place.name) AS target FROM ref JOIN place USING (package, name) GROUP BY rel, rank)
SELECT 'sym:' || rel || '::R' AS source, target FROM hit WHERE n = 1 AND rank = (SELECT min(rank) FROM hit h WHERE h.rel = hit.rel)""")
def bound_references(spark, d):
    """Every order refers to a customer's name, first in one package and then in another: the better
    one that has it counts, and only if a single file declares it there."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    at, name = F.concat(F.lit("c"), "c_custkey", F.lit(".java")), F.concat(F.lit("C"), F.expr("c_custkey div 3"))
    files = c.select(F.concat(F.lit("file:"), at).alias("id"), F.lit("File").alias("kind"), F.concat(F.lit("p"), "c_nationkey").alias("body"), at.alias("file"))
    said = c.select(F.concat(F.lit("sym:"), at, F.lit("::"), name).alias("id"), F.lit("Symbol").alias("kind"), F.lit("").alias("body"), at.alias("file"))
    rel = F.concat(F.lit("o"), "o_orderkey", F.lit(".java"))
    tries = F.array(*[F.struct(F.lit(r).alias("rank"), F.concat(F.lit("p"), F.col(k) % 25).alias("package")) for r, k in ((1, "o_custkey"), (2, "o_orderkey"))])
    refs = o.select(
        rel.alias("rel"), F.lit(0).alias("n"), F.concat(F.lit("sym:"), rel, F.lit("::R")).alias("source"), F.lit("Calls").alias("kind"), F.lit("").alias("context"),
        F.concat(F.lit("C"), F.expr("o_custkey div 3")).alias("name"), F.lit(False).alias("proven"), F.inline(tries),
    )
    return bind.bind(refs, files.unionByName(said)).select("source", "target")


@query("""
WITH f AS (SELECT 'm' || s_suppkey || (['.ts', '.js', '/index.ts'])[s_suppkey % 3 + 1] AS home, 'm' || s_suppkey AS stem, (['0', '1', '2'])[s_suppkey % 3 + 1] AS prio FROM supplier
  UNION SELECT 'm' || s_suppkey || '/index.ts', 'm' || s_suppkey, '2' FROM supplier WHERE s_suppkey % 2 = 0),
best AS (SELECT stem, arg_min(home, prio) AS home FROM f GROUP BY stem)
SELECT DISTINCT 'file:p' || ps.l_partkey || '.ts' AS source, 'file:' || coalesce(best.home, 'm' || (ps.l_suppkey + 5) || '.ts') AS target
FROM lineitem ps LEFT JOIN best ON best.stem = 'm' || (ps.l_suppkey + 5)""")
def import_targets(spark, d):
    """Every part's file imports its suppliers' modules: a source file goes before a compiled one, that
    before a folder's index; a module that is not there stays as written."""
    s, li = table(spark, d, "supplier"), table(spark, d, "lineitem")
    stem = F.concat(F.lit("m"), "s_suppkey")
    ends = F.element_at(F.array(*map(F.lit, (".ts", ".js", "/index.ts"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    at = s.select(F.concat(stem, ends).alias("file")).union(s.where("s_suppkey % 2 = 0").select(F.concat(stem, F.lit("/index.ts"))))
    nodes = at.select(F.concat(F.lit("file:"), "file").alias("id"), F.lit("File").alias("kind"), F.regexp_replace("file", r"\.[^.]*$", "").alias("body"), "file")
    file = F.concat(F.lit("p"), "l_partkey", F.lit(".ts"))
    edges = li.select(
        F.concat(F.lit("file:"), file).alias("source"), F.concat(F.lit("file:m"), F.col("l_suppkey") + 5, F.lit(".ts")).alias("target"),
        F.lit("Imports").alias("kind"), F.lit("*").alias("context"), file.alias("file"),
    ).distinct()
    return bind.retarget(edges, nodes).select("source", "target").distinct()
