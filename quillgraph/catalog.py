"""Registry of the engine's queries over the driver's tables, with their DuckDB oracles.

The tables stand for the engine's own: documents are passages and files, ``orders`` and
``lineitem`` make a call graph of customers and suppliers, ``events`` are measurements.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions.ids import family_of, form_of, node_kind_column
from .functions.tokens import raw_tokens
from .operators import ask, changes, dense, evaluate, families, graph, lexical, resolve, traverse
from .schema import EDGE_KEY
from .shared import dealt, written
from .shipping import ship
from .sources import tree
from .streaming import refresh

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


# ---- lexical retrieval

ASKED = {"q1": "the the threa", "q2": "der die und", "q3": "license version 2"}

_TOKENS = r"""
tok0 AS (SELECT doc_id::VARCHAR AS id, list_filter(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}-]+'),
         lambda t: trim(t, '-')), lambda t: length(t) >= 2) AS toks FROM documents),
term AS (SELECT id, 'term' AS gram, unnest(toks) AS key FROM tok0),
pair AS (SELECT id, 'pair' AS gram, unnest(list_transform(generate_series(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1])) AS key FROM tok0),
post AS (SELECT id, gram, key, count(*) AS tf FROM (SELECT * FROM term UNION ALL SELECT * FROM pair) GROUP BY ALL),
len AS (SELECT id, len(toks) AS len FROM tok0), corpus AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len)"""


def _asked_sql(questions: dict[str, str]) -> str:
    from .functions.tokens import query_tokens

    rows = []
    for q, text in questions.items():
        toks = query_tokens(text, False)
        rows += [(q, "term", t) for t in toks] + [(q, "pair", f"{a} {b}") for a, b in zip(toks, toks[1:])]
    return f"asked(q, gram, key) AS (VALUES {', '.join(map(repr, rows))}), keys AS (SELECT q, gram, key, count(*) AS times FROM asked GROUP BY ALL)"


_SCORED = """
df AS (SELECT gram, key, count(*) AS df FROM post GROUP BY ALL),
scored AS (SELECT q, id, sum(times * CASE gram WHEN 'pair' THEN 0.25 ELSE 1.0 END * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2
           / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
           FROM post JOIN keys USING (gram, key) JOIN df USING (gram, key) JOIN len USING (id) CROSS JOIN corpus GROUP BY ALL)"""


def _bm25_sql(questions: dict[str, str]) -> str:
    return f"""WITH {_TOKENS}, {_asked_sql(questions)}, {_SCORED}
SELECT q, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 20"""


def _bm25(spark: SparkSession, d: str, questions: dict[str, str]) -> DataFrame:
    index = lexical.build(_passages(spark, d), stemmed=False)
    keys = lexical.question_keys(spark, questions, stemmed=False)
    return lexical.search(index, keys, 20).select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_bm25_sql({"q": "the"}))
def bm25_topk(spark, d):
    return _bm25(spark, d, {"q": "the"})


@query(_bm25_sql(ASKED))
def bm25_multi_term(spark, d):
    return _bm25(spark, d, ASKED)


@query(f"WITH {_TOKENS} SELECT gram, count(*)::BIGINT AS postings, sum(tf)::BIGINT AS total, count(DISTINCT key)::BIGINT AS keys FROM post GROUP BY gram")
def postings_stats(spark, d):
    p = lexical.build(_passages(spark, d), stemmed=False).postings
    by_key = p.groupBy("gram", "key").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    return by_key.groupBy("gram").agg(
        F.sum("n").cast("long").alias("postings"), F.sum("tf").cast("long").alias("total"), F.count("*").alias("keys")
    )


@query(f"WITH {_TOKENS} SELECT key, sum(tf)::BIGINT AS n FROM post WHERE gram = 'pair' GROUP BY key HAVING sum(tf) >= 20")
def adjacent_pairs(spark, d):
    p = lexical.build(_passages(spark, d), stemmed=False).counted("pair")
    return p.groupBy("key").agg(F.sum("tf").cast("long").alias("n")).where("n >= 20")


@query(rf"""WITH {_TOKENS}, {_asked_sql(ASKED)}, df AS (SELECT gram, key, count(*) AS df FROM post GROUP BY ALL)
SELECT q, round(sum(CASE gram WHEN 'pair' THEN 0.25 ELSE 1.0 END * ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1)), 6) AS attainable
FROM (SELECT DISTINCT q, gram, key FROM keys) LEFT JOIN df USING (gram, key) CROSS JOIN corpus GROUP BY q""")
def attainable(spark, d):
    index = lexical.build(_passages(spark, d), stemmed=False)
    out = lexical.attainable(index, lexical.question_keys(spark, ASKED, stemmed=False))
    return out.select("q", F.round("attainable", 6).alias("attainable"))


@query(rf"""WITH {_TOKENS}, {_asked_sql(ASKED)}, {_SCORED},
att AS (SELECT q, sum(CASE gram WHEN 'pair' THEN 0.25 ELSE 1.0 END * ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1)) AS a
        FROM (SELECT DISTINCT q, gram, key FROM keys) LEFT JOIN df USING (gram, key) CROSS JOIN corpus GROUP BY q)
SELECT att.q, round(coalesce(max(score), 0), 6) AS best, round(coalesce(max(score), 0) / a, 6) AS coverage FROM att LEFT JOIN scored USING (q) GROUP BY att.q, a""")
def coverage_admission(spark, d):
    index = lexical.build(_passages(spark, d), stemmed=False)
    out = lexical.coverage(index, lexical.question_keys(spark, ASKED, stemmed=False))
    return out.select("q", F.round("best", 6).alias("best"), F.round("coverage", 6).alias("coverage"))


@query(None)
def bm25_stemmed(spark, d):
    index = lexical.build(_passages(spark, d))
    return lexical.search(index, lexical.question_keys(spark, ASKED), 20)


# ---- dense retrieval and fusion

_COSINE = """
SELECT q, id, round(score, 6) AS score, rank FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT a.vec_id::VARCHAR AS q, b.vec_id::VARCHAR AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 20"""


def _cosine(spark, d):
    v = table(spark, d, "embeddings")
    vectors = v.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asked = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").cast("string").alias("q"), "embedding")
    return dense.search(vectors, asked, 20)


@query(_COSINE)
def cosine_topk(spark, d):
    return _cosine(spark, d).select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
SELECT q, id, round(max(score), 6) AS score FROM (SELECT 'q' AS q, label::VARCHAR AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score
FROM embeddings) GROUP BY q, id ORDER BY score DESC, id LIMIT 20""")
def dense_best_row(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id = 0").select(F.lit("q").alias("q"), "embedding")
    out = dense.search(v.select(F.col("label").cast("string").alias("id"), "embedding"), asked, 20)
    return out.select("q", "id", F.round("score", 6).alias("score"))


_LISTS = """
l AS (SELECT source AS q, 0 AS list_no, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank, doc_id::VARCHAR AS id FROM documents
      UNION ALL SELECT source, 1, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, doc_id::VARCHAR FROM documents JOIN labels USING (doc_id)),
cut AS (SELECT * FROM l WHERE rank < 20), f AS (SELECT q, id, min((rank, list_no)) AS b FROM cut GROUP BY q, id),
fused AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY b[1], b[2], id) - 1 AS place, 1.0 / (b[1] + 1) AS score FROM f)"""
_LISTS = _LISTS.replace("min((rank, list_no)) AS b", "min(rank * 10 + list_no) AS b").replace("b[1], b[2], id", "b, id").replace("b[1] + 1", "b // 10 + 1")


def _lists(spark, d):
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.col("doc_id").cast("string").alias("id"))
    known = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    by = lambda *o: F.row_number().over(W.partitionBy("source").orderBy(*o))
    a = docs.select(F.col("source").alias("q"), "id", by(F.desc("n_chars"), "doc_id").alias("rank"))
    b = known.select(F.col("source").alias("q"), "id", by("doc_id").alias("rank"))
    return a, b


@query(f"WITH {_LISTS} SELECT q, id, place::BIGINT AS place, round(score, 6) AS score FROM fused")
def interleave_fusion(spark, d):
    a, b = _lists(spark, d)
    return ask.fused(a, b).select("q", "id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query(f"WITH {_LISTS} SELECT q, id, place::BIGINT AS pos FROM fused WHERE place < 5")
def seat_answers(spark, d):
    a, b = _lists(spark, d)
    none = spark.createDataFrame([], "q string, id string, pos int, whole boolean")
    return ask.seat(none, ask.fused(a, b)).select("q", "id", F.col("pos").cast("long").alias("pos"))


# ---- links and paths

_HREF = r"""
h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="(/[^"#]+)', 1)) AS path FROM pages),
e AS (SELECT DISTINCT 'page:' || page_id AS source, 'path:' || path AS target, 'Links' AS kind, host AS context, host AS file FROM h)"""


def _links(spark, d):
    p = table(spark, d, "pages")
    rows = p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#]+)'), F.lit(1))).alias("path"))
    return rows.select(
        F.concat(F.lit("page:"), "page_id").alias("source"), F.concat(F.lit("path:"), "path").alias("target"),
        F.lit("Links").alias("kind"), F.col("host").alias("context"), F.col("host").alias("file"),
    ).distinct()


@query(f"WITH {_HREF} SELECT * FROM e")
def link_edges(spark, d):
    return _links(spark, d)


def _page_nodes(spark, d):
    return table(spark, d, "pages").select(F.concat(F.lit("path:/"), F.regexp_extract("url", "/([a-z]+)/[^/]*/?$", 1)).alias("id"))


@query(rf"""WITH {_HREF}, n AS (SELECT DISTINCT 'path:/' || regexp_extract(url, '/([a-z]+)/[^/]*/?$', 1) AS id FROM pages)
SELECT e.* FROM e WHERE target NOT IN (SELECT id FROM n)""")
def dangling_links(spark, d):
    return graph.dangling(_page_nodes(spark, d), _links(spark, d))


@query(rf"""WITH {_HREF} SELECT * FROM e WHERE source = 'page:7' OR target IN ('path:/the', 'path:/de')""")
def neighbours(spark, d):
    ids = spark.createDataFrame([("page:7",), ("path:/the",), ("path:/de",)], "id string")
    return graph.neighbours(_links(spark, d), ids)


@query(r"""
WITH RECURSIVE p AS (SELECT page_id, string_split('a/b/../' || regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) || '/./x', '/') AS parts FROM pages),
s(page_id, parts, i, stack) AS (SELECT page_id, parts, 1, []::VARCHAR[] FROM p UNION ALL
  SELECT page_id, parts, i + 1, CASE WHEN parts[i] = '..' THEN stack[:len(stack) - 1] WHEN parts[i] IN ('', '.') THEN stack ELSE list_append(stack, parts[i]) END
  FROM s WHERE i <= len(parts))
SELECT page_id, array_to_string(stack, '/') AS path FROM s WHERE i = len(parts) + 1""")
def path_normalise(spark, d):
    rest = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    return table(spark, d, "pages").select("page_id", paths.normalise_column(F.concat(F.lit("a/b/../"), rest, F.lit("/./x"))).alias("path"))


# ---- graph sets: texts are nodes, sources the files that declare them


def _declared(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.md5("text").alias("id"), F.lit("Text").alias("kind"), F.col("lang").alias("label"), F.lit("").alias("body"),
        F.col("source").alias("file"), F.col("doc_id").cast("int").alias("line"), F.col("doc_id").cast("int").alias("end"),
        F.array("source").alias("files"), F.lit(None).cast("string").alias("community"), F.col("doc_id").alias("seq"),
    )


_UPSERT = """
r AS (SELECT md5(text) AS id, source AS file, lang, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS n FROM documents),
node AS (SELECT a.id, a.file, a.lang AS label, a.doc_id AS line, f.files FROM r a JOIN (SELECT id, list_sort(list_distinct(list(file))) AS files FROM r GROUP BY id) f USING (id) WHERE n = 1)"""


@query(f"WITH {_UPSERT} SELECT id, file, label, line, array_to_string(files, ',') AS files FROM node")
def upsert_first_wins(spark, d):
    n = graph.upsert(_declared(spark, d), ["file", "seq"])
    return n.select("id", "file", "label", F.col("line").cast("long").alias("line"), F.array_join("files", ",").alias("files"))


@query(f"""WITH {_UPSERT}, left_ AS (SELECT id, file, list_filter(files, lambda f: f NOT IN ('src0', 'src1')) AS rest FROM node)
SELECT id, CASE WHEN file IN ('src0', 'src1') THEN rest[1] ELSE file END AS file, array_to_string(rest, ',') AS files FROM left_ WHERE len(rest) > 0""")
def remove_file(spark, d):
    n = graph.upsert(_declared(spark, d), ["file", "seq"])
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE_KEY))
    out, _ = graph.remove_files(n, none, spark.createDataFrame([("src0",), ("src1",)], "rel string"))
    return out.select("id", "file", F.array_join("files", ",").alias("files"))


@query("""
WITH RECURSIVE fl AS (SELECT DISTINCT md5(text) AS id, source || '/' || (doc_id % 97) AS rel FROM documents),
r(rel) AS (SELECT 'src3/3' UNION SELECT b.rel FROM r JOIN fl a ON a.rel = r.rel JOIN fl b ON b.id = a.id) SELECT rel FROM r""")
def co_declared_closure(spark, d):
    docs = table(spark, d, "documents")
    rel = F.concat("source", F.lit("/"), (F.col("doc_id") % 97).cast("string"))
    n = docs.groupBy(F.md5("text").alias("id")).agg(F.collect_set(rel).alias("files"))
    return graph.co_declared(n, spark.createDataFrame([("src3/3",)], "rel string"))


_IDS = "'FR-' || upper(lang) || '-' || (doc_id % 1000)"


def _identified(spark, d):
    docs = table(spark, d, "documents")
    id_ = F.concat(F.lit("FR-"), F.upper("lang"), F.lit("-"), (F.col("doc_id") % 1000).cast("string"))
    return docs.select(id_.alias("id"), "source", "doc_id", "lang")


@query(f"""
WITH e AS (SELECT DISTINCT source, {_IDS} AS target FROM documents), n AS (SELECT DISTINCT lang FROM documents WHERE lang != 'fr' AND source < 'src5')
SELECT source, target, CASE WHEN regexp_extract(target, '^FR-([A-Z]+)-', 1) IN (SELECT upper(lang) FROM n) THEN 'settled' ELSE 'pending' END AS state FROM e""")
def settle_pending(spark, d):
    rows = _identified(spark, d)
    e = rows.select("source", F.col("id").alias("target"), F.lit("References").alias("kind"), F.lit("prose").alias("context"), F.col("source").alias("file")).distinct()
    n = rows.where("lang != 'fr' and source < 'src5'").select("id", F.lit("Requirement").alias("kind"), F.lit("").alias("body"))
    return graph.settle(n, e).select("source", "target", "state")


def _requirements(spark, d):
    rows = _identified(spark, d)
    return rows.groupBy("id").agg(F.collect_set("source").alias("files"), F.min(F.struct("source", F.col("doc_id"))).alias("f")).select(
        "id", node_kind_column(F.col("id")).alias("kind"), "files", F.col("f.source").alias("file"), F.col("f.doc_id").cast("int").alias("line")
    )


@query(f"""
WITH r AS (SELECT {_IDS} AS id, source, doc_id FROM documents), n AS (SELECT id, count(DISTINCT source) AS f FROM r GROUP BY id)
SELECT regexp_extract(id, '^(.*)-[0-9]+$', 1) AS family, 'id' AS form, count(*)::BIGINT AS nodes, sum(f)::BIGINT AS definitions FROM n GROUP BY ALL""")
def families_of_graph(spark, d):
    return families.of_graph(_requirements(spark, d)).select("family", "form", "nodes", "definitions")


@query(f"""
WITH r AS (SELECT {_IDS} AS id, source, doc_id FROM documents), s AS (SELECT regexp_extract(id, '^(.*)-[0-9]+$', 1) AS prefix, * FROM r)
SELECT prefix, count(*)::BIGINT AS mentions, count(DISTINCT id)::BIGINT AS ids, count(DISTINCT source)::BIGINT AS files,
       arg_min(source, source || lpad(doc_id::VARCHAR, 12, '0')) AS file, arg_min(doc_id, source || lpad(doc_id::VARCHAR, 12, '0'))::BIGINT AS line FROM s GROUP BY prefix""")
def mention_survey(spark, d):
    m = _identified(spark, d).select("id", F.col("source").alias("file"), F.col("doc_id").alias("line"))
    return families.mention_survey(m)


@query(f"""
WITH r AS (SELECT {_IDS} AS id, lang FROM documents) SELECT DISTINCT regexp_extract(id, '^(.*)-[0-9]+$', 1) AS prefix FROM r WHERE lang NOT IN ('en', 'de')""")
def mention_only(spark, d):
    m = _identified(spark, d).select("id", F.col("source").alias("file"), F.col("doc_id").alias("line"))
    own = _requirements(spark, d).where("id like 'FR-EN-%' or id like 'FR-DE-%'")
    return families.mention_only(families.mention_survey(m), own).select("prefix")


@query("""
SELECT id, CASE WHEN regexp_matches(id, '^[A-Z]+-M[0-9]{2}(/T[0-9]{1,4})?$') THEN 'milestone' WHEN regexp_matches(id, '^[A-Z][A-Z0-9]{0,11}(-[A-Z][A-Z0-9]{0,11}){0,3}-[0-9]{1,4}$') THEN 'id' END AS form,
CASE WHEN regexp_matches(id, '^[A-Z]+-M[0-9]{2}(/T[0-9]{1,4})?$') THEN regexp_extract(id, '^([A-Z]+)-M', 1)
     WHEN regexp_matches(id, '^[A-Z][A-Z0-9]{0,11}(-[A-Z][A-Z0-9]{0,11}){0,3}-[0-9]{1,4}$') THEN regexp_extract(id, '^(.*)-[0-9]+$', 1) END AS family
FROM (SELECT DISTINCT upper(p_brand) || '-M' || lpad((p_size % 120)::VARCHAR, 2, '0') AS id FROM part UNION SELECT DISTINCT upper(replace(p_type, ' ', '-')) || '-' || p_size FROM part
      UNION SELECT DISTINCT 'PL-M' || lpad((p_size % 100)::VARCHAR, 2, '0') || '/T' || p_size FROM part)""")
def classify_ids(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    # lpad cuts what is longer, in both engines
    a = p.select(F.concat(F.upper("p_brand"), F.lit("-M"), F.lpad((F.col("p_size") % 120).cast("string"), 2, "0")).alias("id"))
    b = p.select(F.concat(F.upper(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit("-"), size).alias("id"))
    c = p.select(F.concat(F.lit("PL-M"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit("/T"), size).alias("id"))
    ids = a.union(b).union(c).distinct()
    return ids.select("id", form_of(F.col("id")).alias("form"), family_of(F.col("id")).alias("family"))


@query("""
WITH n AS (SELECT 'doc:' || doc_id AS id, CASE WHEN lang = 'en' THEN 'Text' ELSE 'Requirement' END AS kind FROM documents),
e AS (SELECT 'doc:' || doc_id AS source, 'doc:' || (doc_id * 7 + 3) AS target, CASE WHEN doc_id % 2 = 0 THEN 'Links' ELSE 'References' END AS kind FROM documents)
SELECT 'node' AS what, kind AS name, count(*)::BIGINT AS n FROM n GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind
UNION ALL SELECT 'dangling', '', count(*) FROM e WHERE target NOT IN (SELECT id FROM n) UNION ALL SELECT 'held aside', '', 0""")
def verify_graph(spark, d):
    docs = table(spark, d, "documents")
    n = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.when(F.col("lang") == "en", "Text").otherwise("Requirement").alias("kind"))
    e = docs.select(
        F.concat(F.lit("doc:"), "doc_id").alias("source"), F.concat(F.lit("doc:"), (F.col("doc_id") * 7 + 3).cast("string")).alias("target"),
        F.when(F.col("doc_id") % 2 == 0, "Links").otherwise("References").alias("kind"),
    )
    return resolve.verify(n, e, e.limit(0))


# ---- traversal: customers call suppliers, nations declare both

_CALLS = """
call AS (SELECT 'sym:o::O' || o_orderkey AS source, 'sym:c::C' || o_custkey AS target FROM orders
         UNION SELECT 'sym:c::C' || c_custkey, 'sym:n::N' || c_nationkey FROM customer
         UNION SELECT 'sym:s::S' || s_suppkey, 'sym:n::N' || s_nationkey FROM supplier
         UNION SELECT 'sym:n::N' || n_nationkey, 'sym:r::R' || n_regionkey FROM nation
         UNION SELECT 'sym:o::O' || l_orderkey, 'sym:p::P' || l_partkey FROM lineitem),
node AS (SELECT DISTINCT source AS id FROM call UNION SELECT target FROM call)"""


def _calls(spark, d) -> traverse.Snapshot:
    """Every order calls its customer and parts, customers and suppliers their nation, that its region."""
    ends = [("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"),
            ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("lineitem", "o", "l_orderkey", "p", "l_partkey")]
    name = lambda f, k: F.concat(F.lit(f"sym:{f}::{f.upper()}"), k)
    parts = [table(spark, d, t).select(name(f, a).alias("source"), name(g, b).alias("target")) for t, f, a, g, b in ends]
    e = reduce(DataFrame.unionByName, parts).distinct()
    e = e.select("source", "target", F.lit("Calls").alias("kind"), F.lit("").alias("context"), F.regexp_extract("source", "^sym:(.)", 1).alias("file"))
    e = written(e, "edges")
    ids = e.select(F.col("source").alias("id")).union(e.select(F.col("target").alias("id"))).distinct()
    n = ids.select(
        "id", F.lit("Symbol").alias("kind"), F.regexp_extract("id", "::(.*)$", 1).alias("label"), F.lit("").alias("body"),
        F.regexp_extract("id", "^sym:(.)", 1).alias("file"), F.lit(1).alias("line"), F.lit(1).alias("end"),
    )
    return traverse.Snapshot(written(n, "nodes"), e)


def _parts(spark, snap):
    """What may be changed: all but orders, which nothing calls."""
    return snap.nodes.where("id not like 'sym:o::%'").select(F.col("id").alias("root"))


_ROOTS = "root AS (SELECT id AS root FROM node WHERE id NOT LIKE 'sym:o::%')"
_UP = f"""WITH RECURSIVE {_CALLS}, {_ROOTS},
bfs(root, id, depth) AS (SELECT root, root, 0 FROM root UNION SELECT b.root, c.source, b.depth + 1 FROM bfs b JOIN call c ON c.target = b.id WHERE b.depth < 3),
hit AS (SELECT root, id, min(depth)::BIGINT AS depth FROM bfs WHERE id != root GROUP BY root, id)"""


@query(f"{_UP} SELECT root, id, depth FROM hit")
def impact_bfs(spark, d):
    s = _calls(spark, d)
    return traverse.walk(s, _parts(spark, s), 3).select("root", "id", F.col("depth").cast("long").alias("depth"))


@query(f"{_UP} SELECT depth, CASE depth WHEN 1 THEN 'will break' WHEN 2 THEN 'likely affected' ELSE 'may need testing' END AS layer, count(*)::BIGINT AS n FROM hit GROUP BY depth")
def impact_layers(spark, d):
    s = _calls(spark, d)
    w = traverse.walk(s, _parts(spark, s), 3).groupBy("depth").agg(F.count("*").alias("n"))
    return w.select(F.col("depth").cast("long").alias("depth"), traverse.layer_name(F.col("depth")).alias("layer"), "n")


@query(f"""{_UP}, k AS (SELECT root, count(*) FILTER (WHERE depth = 1) AS direct, count(*) AS dependents, count(DISTINCT substring(id, 5, 1)) AS files FROM hit GROUP BY root)
SELECT root.root, coalesce(direct, 0)::BIGINT AS direct, coalesce(dependents, 0)::BIGINT AS dependents, coalesce(files, 0)::BIGINT AS files,
CASE WHEN direct >= 30 OR files >= 25 THEN 'CRITICAL' WHEN direct >= 15 OR files >= 10 THEN 'HIGH' WHEN direct >= 5 OR files >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM root LEFT JOIN k USING (root)""")
def impact_risk(spark, d):
    s = _calls(spark, d)
    return traverse.impact(s, _parts(spark, s))


@query(f"""WITH {_CALLS} SELECT a.source AS "from", c.target AS "to", a.source || ' > ' || b.source || ' > ' || c.source || ' > ' || c.target AS path
FROM call a JOIN call b ON b.source = a.target JOIN call c ON c.source = b.target WHERE a.source LIKE 'sym:o::%'""")
def trace_path(spark, d):
    """Every order's chain of calls down to its region."""
    s = _calls(spark, d)
    homes = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    both = table(spark, d, "orders").join(homes, F.col("o_custkey") == F.col("c_custkey"))
    reach = both.select(F.concat(F.lit("sym:o::O"), "o_orderkey").alias("from"), F.concat(F.lit("sym:r::R"), "n_regionkey").alias("to"))
    return traverse.trace(s, reach, 6).select("from", "to", F.array_join(F.transform("path", lambda p: p["id"]), " > ").alias("path"))


_IMPORTS = """
imp AS (SELECT DISTINCT 'o' || o_custkey AS by_, 'c' || (o_custkey % 50) AS file, 'N' || (o_orderkey % 5) AS name FROM orders),
sym AS (SELECT DISTINCT 'sym:c' || (c_custkey % 50) || '::N' || c_nationkey AS root, 'c' || (c_custkey % 50) AS file, 'N' || c_nationkey AS name FROM customer)"""


@query(f"WITH {_IMPORTS} SELECT DISTINCT root, by_ AS file FROM sym JOIN imp USING (file, name)")
def importers(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    home = F.concat(F.lit("c"), (F.col("c_custkey") % 50).cast("string"))
    n = c.select(F.concat(F.lit("sym:"), home, F.lit("::N"), "c_nationkey").alias("id"), home.alias("file")).distinct()
    n = n.withColumn("kind", F.lit("Symbol"))
    e = o.select(
        F.concat(F.lit("file:o"), "o_custkey").alias("source"), F.concat(F.lit("file:c"), (F.col("o_custkey") % 50).cast("string")).alias("target"),
        F.lit("Imports").alias("kind"), F.concat(F.lit("N"), (F.col("o_orderkey") % 5).cast("string")).alias("context"), F.lit("").alias("file"),
    ).distinct()
    s = traverse.Snapshot.of(n, e)
    return traverse.importers(s, n.select(F.col("id").alias("root")))


@query(f"""WITH {_CALLS}, seat AS (SELECT target AS q, source AS via, row_number() OVER (PARTITION BY target ORDER BY source) AS pos FROM call WHERE source LIKE 'sym:n::%'),
hop AS (SELECT source AS via, target AS id FROM call UNION SELECT target, source FROM call)
SELECT q, id, arg_min(via, pos) AS via FROM hop JOIN seat USING (via) WHERE NOT EXISTS (SELECT 1 FROM seat s WHERE s.q = seat.q AND s.via = hop.id) GROUP BY q, id""")
def expansion_one_hop(spark, d):
    """A question a region, seated with its nations."""
    from pyspark.sql import Window as W

    s = _calls(spark, d)
    e = s.edges.withColumn("kind", F.lit("References"))
    order = F.row_number().over(W.partitionBy("target").orderBy("source")) - 1
    seats = s.edges.where("source like 'sym:n::%'").select(F.col("target").alias("q"), F.col("source").alias("id"), order.alias("pos"), F.lit(1.0).alias("score"))
    none = spark.createDataFrame([], "q string, id string, place int, score double")
    return ask.candidates(s.nodes, e, seats, none).select("q", "id", "via")


# ---- changes

_SPANS = """
hunk AS (SELECT DISTINCT 'f' || (l_partkey % 200) AS file, l_linenumber * 40 AS start, l_linenumber * 40 + l_quantity::INT AS "end" FROM lineitem),
sym AS (SELECT 'sym:f' || (p_partkey % 200) || '::P' || p_partkey AS id, 'f' || (p_partkey % 200) AS file, (p_partkey % 300)::INT + 1 AS first, (p_partkey % 300)::INT + 1 + p_size AS last FROM part)"""


def _spans(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    h = line.select(
        F.concat(F.lit("f"), (F.col("l_partkey") % 200).cast("string")).alias("file"), (F.col("l_linenumber") * 40).alias("start"),
        (F.col("l_linenumber") * 40 + F.round("l_quantity").cast("int")).alias("end"), F.lit(False).alias("comment_only"),
    ).distinct()
    f = F.concat(F.lit("f"), (F.col("p_partkey") % 200).cast("string"))
    at = (F.col("p_partkey") % 300).cast("int") + 1
    n = part.select(F.concat(F.lit("sym:"), f, F.lit("::P"), "p_partkey").alias("id"), F.lit("Symbol").alias("kind"), f.alias("file"), at.alias("line"), (at + F.col("p_size")).alias("end"))
    return n, h


@query(f"WITH {_SPANS} SELECT DISTINCT id FROM hunk JOIN sym USING (file) WHERE first <= \"end\" AND last >= start UNION SELECT 'file:' || file FROM hunk h WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.file = h.file AND first <= h.\"end\" AND last >= h.start)")
def touch_hunks(spark, d):
    return changes.touch(*_spans(spark, d)).select("id")


@query(f"""WITH {_SPANS}, free AS (SELECT DISTINCT file FROM hunk h WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.file = h.file AND first <= h."end" AND last >= h.start))
SELECT DISTINCT id AS root FROM hunk JOIN sym USING (file) WHERE first <= "end" AND last >= start UNION SELECT id FROM sym WHERE file IN (SELECT file FROM free)""")
def changed_roots(spark, d):
    n, h = _spans(spark, d)
    return changes.roots(n, changes.touch(n, h))


@query("""
WITH a AS (SELECT doc_id, md5(text) AS h, lang AS k FROM documents WHERE doc_id % 3 != 0),
b AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, lang AS k FROM documents WHERE doc_id % 4 != 0)
SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS rel, CASE WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (doc_id) WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.h != b.h""")
def manifest_diff(spark, d):
    docs = table(spark, d, "documents")
    row = lambda df, text: df.select(F.col("doc_id").cast("string").alias("rel"), F.md5(text).alias("hash"), F.col("lang").alias("kind"))
    new = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return tree.diff(row(docs.where("doc_id % 3 != 0"), F.col("text")), row(docs.where("doc_id % 4 != 0"), new))


@query("""
WITH a AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 3 != 0 GROUP BY ALL), b AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 4 != 0 GROUP BY ALL)
SELECT source, lang, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)::BIGINT AS lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)::BIGINT AS added
FROM a FULL JOIN b USING (source, lang) WHERE coalesce(a.n, 0) != coalesce(b.n, 0)""")
def graph_diff(spark, d):
    docs = table(spark, d, "documents")
    e = lambda df: df.select("source", F.col("lang").alias("target"), F.lit("Links").alias("kind"), F.lit("").alias("context"), F.lit("").alias("file"))
    cols = "id string, kind string, label string, body string, file string, line int, `end` int, files array<string>"
    none = spark.createDataFrame([], cols)
    out = graph.diff(none, e(docs.where("doc_id % 3 != 0")), none, e(docs.where("doc_id % 4 != 0")))
    out = out.withColumn("lang", F.split("detail", " ")[1])
    return out.groupBy(F.col("id").alias("source"), "lang").agg(
        F.count_if(F.col("what") == "edge lost").alias("lost"), F.count_if(F.col("what") == "edge added").alias("added")
    )


# ---- evaluation


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = floor(0.9 * n)")
def p90_index(spark, d):
    return evaluate.p90(table(spark, d, "events"), "value", "event_type").select("event_type", "value")


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = n // 2")
def median_upper(spark, d):
    return evaluate.median_upper(table(spark, d, "events"), "value", "event_type").select("event_type", "value")


@query("""
WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 10 + 1 END AS rank FROM documents)
SELECT source, count(*)::BIGINT AS cases, count(rank)::BIGINT AS found, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY source""")
def mrr(spark, d):
    rank = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 10 + 1)
    out = evaluate.scores(table(spark, d, "documents").select("source", rank.alias("rank")), "source")
    return out.select("source", "cases", "found", F.round("mrr", 6).alias("mrr"))


@query("""
WITH r AS (SELECT user_id, event_id, value > 50 AS hit, lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT user_id AS "case", count(*)::BIGINT AS seen, round(avg(CASE WHEN hit THEN 0.0 ELSE 1.0 END), 6) AS miss_rate, coalesce(sum(CASE WHEN prev != hit THEN 1 ELSE 0 END), 0)::BIGINT AS flips,
count(*) >= 2 AND avg(CASE WHEN hit THEN 0.0 ELSE 1.0 END) >= 0.5 AS weak, coalesce(sum(CASE WHEN prev != hit THEN 1 ELSE 0 END), 0) > 1 AS flaky FROM r GROUP BY user_id""")
def weak_and_flaky(spark, d):
    runs = table(spark, d, "events").select(F.col("user_id").alias("case"), F.col("event_id").alias("run"), (F.col("value") > 50).alias("hit"))
    out = evaluate.history(runs)
    return out.select("case", "seen", F.round("miss_rate", 6).alias("miss_rate"), "flips", "weak", "flaky")


@query("""
WITH want AS (SELECT DISTINCT source, lang AS item FROM documents), got AS (SELECT DISTINCT source, lang AS item FROM documents WHERE doc_id % 7 = 0)
SELECT source, count(*)::BIGINT AS want, count(got.item)::BIGINT AS found, round(count(got.item) / count(*), 6) AS recall FROM want LEFT JOIN got USING (source, item) GROUP BY source""")
def recall(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("lang").alias("item"), "doc_id")
    out = evaluate.recall(docs, docs.where("doc_id % 7 = 0"), "source")
    return out.select("source", "want", "found", F.round("recall", 6).alias("recall"))


@query("""
WITH c AS (SELECT doc_id::VARCHAR AS q, source AS kind, [(doc_id + 1)::VARCHAR, source] AS expect FROM documents), a AS (SELECT q, unnest(expect) AS anchor FROM c),
h AS (SELECT q, anchor, anchor IN (SELECT doc_id::VARCHAR FROM documents WHERE lang = 'en') AS hit FROM a), s AS (SELECT q, bool_or(hit) AS hit, count(*) AS n, count(*) FILTER (WHERE hit) AS r FROM h GROUP BY q)
SELECT kind, count(*)::BIGINT AS cases, count(*) FILTER (WHERE hit)::BIGINT AS hits, sum(n)::BIGINT AS anchors, sum(r)::BIGINT AS reached FROM c JOIN s USING (q) GROUP BY kind""")
def bench_summary(spark, d):
    docs = table(spark, d, "documents")
    cases = docs.select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("q"), F.col("source").alias("kind"),
        F.array((F.col("doc_id") + 1).cast("string"), "source").alias("expect"),
    )
    asked = cases.select("q", F.explode("expect").alias("id"))
    ans = asked.join(docs.where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id")), "id")
    ans = ans.select("q", "id", F.lit("none").alias("file"), F.lit("seed").alias("role"))
    return evaluate.summary(cases, evaluate.found(cases, ans))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS no FROM documents),
w AS (SELECT doc_id, no, list_distinct(list_transform(list_filter(regexp_extract_all(line, '[\p{L}\p{N}]+'), lambda x: length(x) >= 3), lambda x: substring(x, 1, 5))) AS p FROM l),
n AS (SELECT doc_id, no, len(list_intersect(p, ['licen', 'versi', 'that', 'und'])) AS n FROM w)
SELECT doc_id::VARCHAR AS id, coalesce(arg_min(no, -n * 1000000 + no) FILTER (WHERE n > 0), 1)::BIGINT AS line FROM n GROUP BY doc_id""")
def text_line(spark, d):
    texts = _passages(spark, d).select(F.lit("q").alias("q"), "id", F.col("text").alias("body"))
    asked = spark.createDataFrame([("q", p) for p in ("licen", "versi", "that", "und")], "q string, prefix string")
    return ask.text_lines(texts, asked).select("id", F.col("line").cast("long").alias("line"))


@query("SELECT id, label FROM (SELECT doc_id::VARCHAR AS id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '…' ELSE text END AS label FROM documents)")
def headline(spark, d):
    return _passages(spark, d).select("id", ask.headline("text").alias("label"))


@query(r"SELECT doc_id::VARCHAR AS id, len(list_filter(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}-]+'), lambda t: trim(t, '-')), lambda t: length(t) >= 2))::BIGINT AS n FROM documents")
def tokenize(spark, d):
    return _passages(spark, d).select("id", F.size(raw_tokens(F.col("text"))).cast("long").alias("n"))


@query(None)
def stream_poll(spark, d):
    """Events as a stream of changes, one refresh a micro-batch that is due: rows a batch."""
    import uuid

    ship(spark)
    name = f"quillgraph_polls_{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    out: list = []

    def step(df: DataFrame, epoch: int) -> None:
        out.append(df.groupBy("event_type").agg(F.count("*").alias("n")).collect())  # a row an event type

    refresh.watch_stream(source, step, once=True).awaitTermination()
    rows = [(r["event_type"], r["n"]) for batch in out for r in batch]
    spark.createDataFrame(rows, "event_type string, n long").createOrReplaceTempView(name)
    return spark.table(name)


from . import catalog_graph  # noqa: E402, F401  registers its own
