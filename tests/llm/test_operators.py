"""Every operator against its oracle or a brute-force version, on awkward small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import (
    decontaminate, html_extract, license_scan, minhash_dedup, mixing, oracles, prints, quality_rules, queries, quote_linking,
    substring_dedup, suffix_dedup, warc,
)
from quillgraph.llm.components import components
from tests.oracle import duck_rows, rows_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["the", "of", "and", "to", "in"] * 40
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(60), say(200)
    texts = [None, "", " \n\t ", "One", "one two", "GNU General Public License mit license mit license, Apache License", "cc by" * 3]
    texts += [say(rng.randint(5, 300)) for _ in range(20)]
    texts += [say(40) + "\n" + passage + " " + say(30) for _ in range(5)]
    texts += [base, base, base.upper(), base + " more"]
    for _ in range(6):
        w = base.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    texts += [(say(8) + " ") * 12, "### $$$ %%% " * 40, "Élan É " + say(50), "line\n" * 30, say(3000) + " " + passage]
    texts += ["Released under the MIT License.\nall rights reserved", "licensed under the apache license version 2", "\x0b".join(say(40).split())]
    langs = ["en", "fr", "de", "es", None, "xx"]
    return [(i, t, langs[i % 6], [None, "a", "b", "é", "z"][i % 5], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{d}/documents.parquet")
    words = rows[30][1].split()
    items = [(0, " ".join(words[5:40])), (1, "one TWO"), (2, None), (3, ""), (4, " ".join(rows[33][1].split()[:30])), (10, " ".join(words[5:40])), (5, "One")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    page = "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>text  one<br>two</p></article></body></html>"
    pages = [(0, "http://a.b/x", page), (1, None, page), (2, "http://a.b/\ny é", None), (3, "http://a.b/z", ""), (4, "u", "\x1f\x8b\x08" * 80), (5, "u", page)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    turns = [
        (1, 0, "u", "Hello there my good friend of mine\nsecond line"), (1, 1, "a", "Bob wrote:\n> Hello there my good friend of mine\nfine"),
        (1, 2, "u", "> > Hello there my good friend of mine\n> fine\ngreat"), (2, 0, "u", "> hello there, my GOOD friend of mine"), (2, 1, None, None), (2, 2, "a", ""),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_oracle(spark, small, name):
    assert rows_of(queries.QUERIES[name](spark, small)) == duck_rows(oracles.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, small, tmp_path, name):
    for t in ("documents", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_awkward_documents(spark):
    """Null ids, repeated rows and extra columns with clashing names."""
    rows = corpus()[5:12]
    rows = [*rows, rows[0], rows[3], (None, "x y z", None, None, 1), (None, None, None, None, None)]
    clash = ["kept", "n_words", "size", "_text", "_id", "_key", "_row", "taken", "h", "bucket", "id", "n", "root", "text_key"]
    docs = spark.createDataFrame([(*r, *["c"] * len(clash)) for r in rows], COLUMNS + "".join(f", {c} string" for c in clash))
    bench = spark.createDataFrame([(1, "x y z", "c")], "item_id long, text string, n_words string")
    for out in (
        quality_rules.judge(docs), license_scan.scan(docs), decontaminate.judge(docs, bench), mixing.judge(docs), suffix_dedup.digest(docs),
        substring_dedup.digest(docs), minhash_dedup.judge(docs),
    ):
        assert out.count() == len(rows)
    for out in (quality_rules.filter_documents(docs), substring_dedup.remove_repeats(docs), decontaminate.clean(docs, bench), minhash_dedup.keep_first(docs)):
        assert out.columns == docs.columns and out.count() <= len(rows)
        assert {r["kept"] for r in out.collect()} <= {"c"}
    assert {"taken", "target"} <= set(mixing.mixed_documents(docs).columns)


def test_suffix_dedup_brute(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    a, b = say(450), say(199)
    texts = [None, "", a, a, a[100:320] + say(80) + a[50:300], b, b + "x", say(30) + b + b, "z" * 700, say(20) + "z" * 199, a[:200], say(5000), a[37:260]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in raw:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    want = {}
    for n, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        want[n] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    for wide in (suffix_dedup.WIDE, 1):
        monkeypatch.setattr(suffix_dedup, "WIDE", wide)
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
        assert got == want


def last_execution(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)


def rows_generated(spark, after: int) -> int:
    """Rows that Generate nodes made in the executions after ``after``."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    for at in range(after + 1, last_execution(spark) + 1):
        nodes, found = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if node.name() == "Generate" and m.name() == "number of output rows" and found.contains(m.accumulatorId()):
                    rows += int(found.apply(m.accumulatorId()).replace(",", ""))
    return rows


@pytest.mark.parametrize("wide", [suffix_dedup.WIDE, 1])
def test_contexts_of_one_anchor_are_not_multiplied(spark, monkeypatch, wide):
    """Many different contexts of one anchor, and one context of many places: the runs of a
    context are copied for its own places, not for all of its anchor's."""
    from quillgraph.llm import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    short, long = say(230), say(700)
    texts = [say(150) + short + say(150) for _ in range(120)] + [say(150) + long + say(150) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = last_execution(spark)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
    made = rows_generated(spark, before)
    starts = [t[i : i + 200] for t in texts for i in range(len(t) - 199)]
    twice = {x for x, n in Counter(starts).items() if n > 1}
    want = {}
    for n, t in enumerate(texts):
        gone = {i + j for i in range(len(t) - 199) if t[i : i + 200] in twice for j in range(200)}
        rest = "".join(c for i, c in enumerate(t) if i not in gone)
        want[n] = (len(t), len(gone), 1, hashlib.sha256(rest.encode()).hexdigest())
    assert got == want
    anchors = sum(len(suffix_dedup._chosen(t.encode())[1]) for t in texts)
    assert anchors / 4 < made < 2 * anchors


def test_neighbours_meet_across_buckets(spark):
    """The buckets' edges, however the suffixes are dealt."""
    rng = random.Random(6)
    made = ["".join(rng.choice("ab") for _ in range(3)) for _ in range(40)]
    made = sorted((t.encode(), b"d%d" % i, i, 1) for i, t in enumerate(made))
    want = {r[2] for r in made if sum(r[0] == x[0] for x in made) > 1}
    for cut in ((), (1,), (5, 6, 7), (3, 20, 21, 39)):
        found, edges = set(), []
        for lo, hi in zip((0, *cut), (*cut, 40)):
            import pyarrow as pa

            rows = pa.RecordBatch.from_pylist([dict(zip(("suffix", "digest", "s", "n"), r)) for r in made[lo:hi]])
            for b in suffix_dedup._neighbours(iter([rows.slice(0, 2), rows.slice(2)])):
                for r in b.to_pylist():
                    found |= {r["s"]} if r["again"] else set()
                    edges += [r] if r["edge"] is not None else []
        for x, y in zip(edges, edges[1:]):
            found |= {x["s"], y["s"]} if x["suffix"] == y["suffix"] else set()
        assert found == want


def test_keys_of_many_rows(spark, monkeypatch):
    from pyspark.sql import functions as F
    from quillgraph.llm import skew

    rows = spark.createDataFrame([(i % 7, str(i % 3), i) for i in range(200)] + [(None, "x", 1)], "h long, g string, at long")
    by = rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("at").alias("top")).where("h > 1")
    want = sorted(map(tuple, rows.join(by, ["h", "g"]).select("at", "n", "top").collect()))
    for most, least in ((20_000, 1_000), (3, 5), (1, 1), (100, 1)):
        monkeypatch.setattr(skew, "HOT_KEYS", most)
        monkeypatch.setattr(skew, "HOT_ROWS", least)
        for keys in (["h", "g"], ["g", "h"]):
            assert sorted(map(tuple, skew.join_by_key(rows, by, keys, "n", F.col("at")).collect())) == want


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 20)).astype(np.uint8)
    order = suffix_dedup.multikey_order(rows)
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)
    near = suffix_dedup.common_prefixes(rows, order)
    for i in range(1, 300):
        a, b = rows[order[i - 1]].tobytes(), rows[order[i]].tobytes()
        assert near[i] == next((k for k in range(20) if a[k] != b[k]), 20)


def test_anchors_follow_content():
    rng = np.random.default_rng(2)
    for _ in range(20):
        common = rng.integers(0, 50, 90).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 50, 31).astype(np.uint64), common, rng.integers(0, 50, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 50, 7).astype(np.uint64), common])
        for span in (10, 30):
            pick = []
            for x, off in ((a, 31), (b, 7)):
                at, lo, hi = prints.anchors(prints.mixed(x), span)
                assert (lo <= hi).all() and lo[0] == 0 and hi[-1] == len(x) - span and (lo[1:] == hi[:-1] + 1).all()
                assert ((at >= hi) & (at < lo + span)).all()
                chosen = np.repeat(at, hi - lo + 1)
                pick.append(chosen[off : off + len(common) - span + 1] - off)
            assert (pick[0] == pick[1]).all()


def test_rolling_is_a_hash_of_content():
    x = np.arange(50, dtype=np.uint64) % np.uint64(7)
    h = prints.rolling(prints.mixed(x), 7)
    assert len(set(h[::7].tolist())) == 1 and len(set(h.tolist())) == 7


def test_minhash_against_all_pairs(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, 150))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randrange(0, 1 + len(w) // 10)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({(a, b) for a, b in zip(w, w[1:])})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.judge(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_duplicates_keep_one_row_a_group(spark):
    """Repeated rows, null ids and several texts of one id; the pipeline keeps a repeated text."""
    say = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [
        (1, say("a")), (1, say("a")), (None, say("b")), (None, say("b")), (2, say("c")), (3, say("d")), (3, say("c")), (3, say("e")),
        (None, say("f")), (4, say("f")), (-1, say("g")), (None, say("g")), (5, ""), (5, ""), (6, say("h")), (7, say("h") + " more"), (7, say("i")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    want = {(1, "a"), (None, "b"), (2, "c"), (3, "d"), (3, "e"), (4, "f"), (-1, "g"), (6, "h"), (7, "i")}
    kept = minhash_dedup.keep_first(docs)
    got = sorted((str(r["doc_id"]), r["text"][:1]) for r in kept.collect())
    assert got == sorted([*((str(i), c) for i, c in want), ("5", ""), ("5", "")])
    verdicts = minhash_dedup.judge(docs, 5).collect()
    assert len(verdicts) == len(rows) and sum(r["kept"] for r in verdicts) == len(want) + 2
    rest = sorted((str(r["doc_id"]), r["text"]) for r in substring_dedup.remove_repeats(kept).collect())
    assert rest == sorted((str(i), say(c)) for i, c in want)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = x[:2000], x[500:2500]
    same = float((minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean())
    assert abs(same - 1500 / 2500) < 0.15


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_splits_and_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    folder, manifest = warc.write_archives(pages)
    whole = sorted(map(str, warc.read_archives(folder, manifest).collect()))
    for split in (1, 7, 100, 1000):
        assert sorted(map(str, warc.read_archives(folder, manifest, split).collect())) == whole
    full = {r["page_id"]: r["payload"].decode() for r in warc.resolved(warc.read_archives(folder, manifest)).collect()}
    assert full == {r["page_id"]: r["html"] or "" for r in pages.collect()}
    urls = {r["page_id"]: r["url"] for r in warc.read_archives(folder, manifest).collect()}
    assert urls == {r["page_id"]: r["url"] for r in pages.collect()}


def test_mixing_budgets(spark, small):
    rows = mixing.judge(spark.read.parquet(f"{small}/documents.parquet").withColumn("source", __import__("pyspark").sql.functions.coalesce("source", __import__("pyspark").sql.functions.lit("null")))).collect()
    by: dict[tuple, list] = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), rs in by.items():
        assert sum(r["taken"] for r in rs) == int(target) and target <= 2 * size + 1e-9
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-3


NOTICE = '<html><body><div class="site-header">Site {h}</div><div class="promo-box">Join us</div><div><p>Buy our book</p></div><div><p>Story {n} goes here</p><p>Second {n} &lt;b&gt;</p></div><div id="footer">foot</div></body></html>'


def test_html_blocks_and_wrapper(spark):
    rows = [(i, "http://h.x/%d" % i, NOTICE.format(h="h", n=i)) for i in range(6)] + [(9, "http://o.x/", NOTICE.format(h="o", n="o")), (10, None, None), (11, "http://[bad", "<p>x")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0]["text"] == "Story 0 goes here\n\nSecond 0 <b>"
    assert got[9]["text"] == "Buy our book\n\nStory o goes here\n\nSecond o <b>"
    assert got[10]["text"] == "" and got[11]["text"] == "x" and got[0]["n_chars"] == len(got[0]["text"])


def test_wrapper_decides_inside_articles(spark):
    """A notice no tag marks, only on the longer pages of its host; edited copies of one story stay
    whole; a small teaser article does not stand for the page."""
    say = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k))
    note = "<p>Read our house rules before you reply</p>"
    page = lambda n, k: f"<article><h1>{say(n, 3)}</h1>" + "".join(f"<p>{say(n * 10 + i, 9)}</p>" for i in range(k)) + f"{note if k > 2 else ''}</article>"
    rows = [(i, "http://h.x/%d" % i, page(i, 2 + i % 2 * 2)) for i in range(12)] + [(90, "http://h.x/e", ""), (91, "http://h.x/n", None)]
    copy = [say(500 + i, 9) for i in range(6)]
    for i in range(6):
        rows.append((100 + i, "http://c.x/%d" % i, "<article>" + "".join(f"<p>{t}{' edit' if j == i else ''}</p>" for j, t in enumerate(copy)) + "</article>"))
    rows.append((200, "http://t.x/", f"<div>{say(7, 30)}</div><article><p>teaser</p></article>"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(docs).collect()}
    assert all("house rules" not in got[i] and got[i].count("\n\n") == 2 + i % 2 * 2 for i in range(12))
    assert all(got[100 + i].count("\n\n") == 5 for i in range(6)) and got[90] == got[91] == ""
    assert got[200].startswith("w7x0") and got[200].endswith("teaser")
    blocks = html_extract.parse(rows[1][2]).blocks
    assert "house rules" in html_extract.main_text(blocks, set())  # without its template the text differs


def test_html_awkward_pages(spark):
    long = "<article>" + "<p>word</p>" * 200_000 + "</article>"
    rows = [(1, "http://a/", "<p>x", "c", "c"), (1, "http://a/", "<p>x", "c", "c"), (None, None, None, None, None), (None, "http://b", "<p>y", "c", "c"), (2, "http://a/", long, "c", "c"), (3, "http://a/", "<p>z", "c", "c")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row string")
    got = html_extract.extract(docs)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted((str(r["page_id"]), r["text"][:9], r["n_chars"]) for r in got.collect())
    assert rows == [("1", "x", 1), ("1", "x", 1), ("2", "word\n\nwor", 200_000 * 6 - 2), ("3", "z", 1), ("None", "", 0), ("None", "y", 1)]


@pytest.mark.parametrize(
    "source, bad",
    [("share-price", False), ("search-result-notice", False), ("ad", True), ("site-header", True), ("promo-box", True), ("comments_list", True), ("header-story", False), ("headline", False)],
)
def test_class_names(source, bad):
    assert html_extract.main_text(html_extract.parse(f"<div class='{source}'>t</div>").blocks, set()) == ("" if bad else "t")


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><h1>A &amp; B</h1><p><b>A<br><p>c\n d</article><footer>f", "A & B\n\nA\n\nc d"),
        ("<main><p>x<span class=ad>buy</span> y</p><div class='comments'>no</div></main>", "x y"),
        ("<p>one<li>two<li>three<script>if (a<b) '</p>'</script>", "one\n\ntwo\n\nthree"),
        ("<!-- <p>no</p> --><p title='a>b'>yes</p>", "yes"),
        ("a < b <", "a < b <"),
        ("<article><header><h1>T</h1><p>by</p></header><p>x</p></article><header><h1>no</h1></header>", "T\n\nx"),
        ("<aside>n</aside><form><p>n</p></form><style>n</style>t", "t"),
    ],
)
def test_html_parse(html, text):
    assert html_extract.main_text(html_extract.parse(html).blocks, set()) == text


def test_tree_matching():
    a, b = html_extract.parse("<div><p>1<p>2<ul><li>x</ul></div>"), html_extract.parse("<div><p>1<h2>n</h2><ul><li>y<li>z</ul></div>")
    pairs = {(a.labels[i], b.labels[j]) for i, j in html_extract.match_trees(a, b)}
    assert pairs == {("#", "#"), ("div", "div"), ("p", "p"), ("ul", "ul"), ("li", "li")}


def test_tree_matching_is_largest():
    """Against the plain recurrence on random trees."""
    rng = random.Random(8)

    def tree(n):
        p = html_extract.Page()
        for i in range(1, n):
            p.labels.append(rng.choice("ab"))
            p.parents.append(rng.randrange(i))
        return p

    def largest(a, b, i, j):
        xs, ys = ([k for k in range(1, len(p.labels)) if p.parents[k] == n] for p, n in ((a, i), (b, j)))
        row = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for x in range(len(xs)):
            for y in range(len(ys)):
                both = row[x][y] + largest(a, b, xs[x], ys[y]) if a.labels[xs[x]] == b.labels[ys[y]] else 0
                row[x + 1][y + 1] = max(row[x][y + 1], row[x + 1][y], both)
        return 1 + row[-1][-1]

    for _ in range(60):
        a, b = tree(rng.randint(1, 12)), tree(rng.randint(1, 12))
        pairs = html_extract.match_trees(a, b)
        assert len(pairs) == len(set(pairs)) == largest(a, b, 0, 0)
        assert all(a.labels[i] == b.labels[j] and (i == 0 or (a.parents[i], b.parents[j]) in pairs) for i, j in pairs)


def test_licenses_over_line_breaks_and_apart(spark):
    texts = {
        1: "x\nLicensed under the Apache License,\nVersion 2.0", 2: "This work is licensed under the GNU General Public License, version 3.",
        3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the \"Software\"), to deal\n"
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
        4: "Licensed under CC BY-NC 4.0.", 5: "all that is mine is reserved by rights", 6: "license " * 50_000 + "all rights reserved", 7: None,
    }
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, row string")
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in license_scan.scan(docs).collect()}
    assert got == {1: ("apache", "apache,apache-2.0"), 2: ("gpl", "gpl,gpl-3.0"), 3: ("", "mit"), 4: ("cc-by", "cc-by,cc-by-nc-4.0"), 5: ("", ""), 6: ("", "reserved"), 7: ("", "")}


def test_no_kept_text_holds_a_window(spark):
    item = [f"b{i}" for i in range(20)]
    far = " ".join(f"w{i}" for i in range(1000))
    texts = [far + " " + " ".join(item[3:16]), far + " " + " ".join(item[:12]), far + " short one", "a short one"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short one")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [1, 2]
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.judge(docs, bench).collect()} == {0: False, 1: False, 2: False, 3: True}


def test_conversations(spark, small):
    out = quote_linking.conversations(spark.read.parquet(f"{small}/conversations.parquet")).where("conv_id = 1").first()
    assert [t["text"] for t in out["turns"]] == ["Hello there my good friend of mine\nsecond line", "fine", "great"]


def test_removed_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a  b " + passage, "en", "s", 1), (2, passage + " c", "en", "s", 1), (3, "kept  as\nis", "en", "s", 1)], COLUMNS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: ("a b", 3), 2: ("c", 1), 3: ("kept  as\nis", 11)}


@pytest.mark.parametrize("kind", [substring_dedup, suffix_dedup])
def test_texts_of_one_id_whose_32_bit_hashes_are_equal(spark, kind):
    a, b = (" ".join(f"{i}w{j}" for j in range(60)) for i in (11969, 106634))
    docs = spark.createDataFrame([(1, a), (1, b), (0, a)], "doc_id long, text string")
    assert docs.selectExpr("hash(text)").distinct().count() == 1
    got = sorted((r["doc_id"], r["n_removed"] > 0) for r in kind.digest(docs).collect())
    assert got == [(0, True), (1, False), (1, True)]


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, small)
        assert out.columns == docs.columns, name
        assert out.count() <= kept.count()
        kept = out
    assert rows_of(corpus_pipeline.run(spark, small)) == duck_rows(corpus_pipeline.ORACLE_SQL, small)
