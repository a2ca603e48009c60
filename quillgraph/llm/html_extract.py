"""Main text of web pages by wrapper induction.

1. Each page is parsed once into a tree and a list of blocks. What marks itself as no part
   of the text is left out here: menus, sidebars, forms, scripts, styles, page headers and
   footers by their element; adverts, notices, comments by a class, id or role that is one
   of these names as a whole. Headings stay where an article has a header of its own.
2. Alignment. Of a host's pages with any element, those of the median and of the ninth
   decile of nodes are its exemplars. Every page's tree is aligned with each by simple tree
   matching: the largest set of node pairs with equal labels that keeps parents and the
   order of siblings. Equal subtrees at either end of two lists of children are paired
   first, which no larger set contradicts, so long pages take time in proportion.
3. Induction. For each exemplar node, Spark counts the aligned pages and their texts. A
   node with one text on all of at least ``MIN_PAGES`` pages that differ is template, a node
   whose text varies is a content slot. Pages differ where the least hashes of their blocks
   do; if most of a slot's pages are copies of each other, it stays content.
4. Extraction. Template blocks go, wherever they stand. If what lies in article or main
   elements is at least half of the rest, it is the content; else all of the rest is.

Trees without texts are what is joined by host (one row a host on the other side, written
first, so adaptive execution splits a hot host's pages); what is aggregated is a row a
node; a wrapper is at most as long as its exemplars. Blocks travel compressed, once. Edge
cases: null or empty html gives an empty text; a null url has the host ''; a page alone on
its host has no template nodes; malformed markup never fails (unclosed elements end with
their parent); very long pages are parsed in one pass; rows are told apart by a number, so
rows that repeat a page id, or have none, each give a row; other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

MIN_PAGES = 3
#: A host's exemplars: the pages at these shares of its pages by number of nodes.
EXEMPLARS = (0.5, 0.9)
# HTML element names by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas".split())
PLAIN = frozenset("title textarea xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form button select option menu dialog audio video map title textarea xmp noembed noframes".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Classes, ids and roles that name boilerplate; places and kinds of box such
# a name may be joined with (site-header, ad-banner). A name in other company
# (share-price, search-result) says what the text is about, not what it is for.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer header login menu modal nav navbar navigation newsletter notice notices pagination pager popup "
    "promo promotion related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget "
    "complementary contentinfo hidden".split()
)
PLACES = frozenset("site page top bottom main global sticky left right".split())
BOXES = frozenset("area banner bar block box buttons container content form items links list notice overlay section slot unit widget wrap wrapper".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]+|\"[^\"]*\"|'[^']*')*+)>)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_JOINTS = re.compile(r"[-_]+")
_BLANK = re.compile(r"\s+")
_CLOSE = {name: re.compile(rf"</{name}\s*/?>|</{name}\s[^>]*>|\Z", re.I) for name in RAW | PLAIN}


#: What is kept of an element: all, an article's own headings, nothing.
TITLE, OUT = 1, 2


class Page:
    """labels and parents of the tree's block elements; blocks: (node, in content, text)."""

    __slots__ = ("labels", "parents", "blocks")

    def __init__(self) -> None:
        self.labels: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, bool, str]] = []


def _names_boilerplate(name: str) -> bool:
    """Whether a class, id or role as a whole names boilerplate: ``ad``, ``site-header``, ``ad-box``."""
    parts = _JOINTS.split(name)
    while len(parts) > 1 and parts[0] in PLACES:
        parts = parts[1:]
    while len(parts) > 1 and parts[-1] in BOXES:
        parts = parts[:-1]
    return all(p in NAMED for p in parts)


def _named(attrs: str) -> tuple[bool, str]:
    """Whether attributes name boilerplate, and the class for the node's label."""
    bad, cls = False, ""
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden":
            bad |= key == "hidden" or value == "true"
            continue
        bad |= any(map(_names_boilerplate, value.split()))
        if key == "class":
            cls = value
    return bad, cls


def parse(source: str) -> Page:
    page, text = Page(), []
    # of each open element: name, node, dropped, in content
    stack: list[tuple[str, int, int, bool]] = [("#", 0, 0, False)]

    def end_block() -> None:
        if text:
            whole = "".join(text)
            text.clear()
            if "&" in whole:
                whole = html.unescape(whole)
            whole = _BLANK.sub(" ", whole).strip()
            _, node, dropped, inside = stack[-1]
            if whole and (not dropped or dropped == TITLE and any(x[0] in HEADINGS for x in stack)):
                page.blocks.append((node, inside, whole))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] in BLOCKS:
                end_block()
            stack.pop()

    pos, n = 0, len(source)
    while pos < n:
        at = source.find("<", pos)
        if at < 0:
            text.append(source[pos:])
            break
        if at > pos:
            text.append(source[pos:at])
        m = _TAG.match(source, at)
        if m is None:
            text.append("<")
            pos = at + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                if name in BLOCKS:
                    end_block()
                close_to(depth)
            elif name == "p":
                end_block()
            continue
        block = name in BLOCKS
        if name == "br":
            text.append(" ")
        if name in VOID:
            if block:
                end_block()
            continue
        if block:
            end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            if name in CLOSED_BY:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in CLOSED_BY[name]:
                        close_to(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
        if name in RAW or name in PLAIN:
            pos = _CLOSE[name].search(source, pos).end()
            continue
        _, node, dropped, inside = stack[-1]
        bad, cls = _named(m[3]) if m[3] else (False, "")
        drop = OUT if bad and name not in ("body", "html") or name in DROPPED else 0
        if drop and name == "header" and inside and not bad:
            drop = TITLE
        if block:
            page.labels.append(f"{name}.{cls}" if cls else name)
            page.parents.append(node)
            node = len(page.labels) - 1
        if not m[3].endswith("/") or block:
            stack.append((name, node, max(dropped, drop), inside or name in CONTENT))
            if drop and not block:  # an inline advert, taken out of the text around it
                pos = _skip_inline(source, pos, name, stack)
    close_to(1)
    end_block()
    return page


def _skip_inline(source: str, pos: int, name: str, stack: list) -> int:
    """Past a dropped inline element: to its end tag, over nested ones of its name; to the
    next tag alone if it is never closed."""
    depth, at = 1, pos
    while (m := re.compile(rf"<(/?){re.escape(name)}\b[^>]*>", re.I).search(source, at)) is not None:
        depth += -1 if m[1] else 1
        at = m.end()
        if depth == 0:
            stack.pop()
            return at
    stack.pop()
    return pos


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _shapes(page: Page, known: dict) -> list[int]:
    """A number for each node; equal ones have equal subtrees."""
    kids: list[list[int]] = [[] for _ in page.labels]
    out = [0] * len(page.labels)
    for i in range(len(page.labels) - 1, -1, -1):
        out[i] = known.setdefault((page.labels[i], tuple(kids[i][::-1])), len(known))
        if i:
            kids[page.parents[i]].append(out[i])
    return out


def match_trees(a: Page, b: Page) -> list[tuple[int, int]]:
    """Simple tree matching: the aligned pairs (node of a, node of b)."""
    kids = [[[] for _ in p.labels] for p in (a, b)]
    for p, k in zip((a, b), kids):
        for i in range(1, len(p.labels)):
            k[p.parents[i]].append(i)
    known: dict = {}
    shapes = _shapes(a, known), _shapes(b, known)
    memo: dict[tuple[int, int], int] = {}
    whole = [[1] * len(p.labels) for p in (a, b)]
    for p, w in zip((a, b), whole):
        for i in range(len(p.labels) - 1, 0, -1):
            w[p.parents[i]] += w[i]

    def ends(i: int, j: int) -> tuple[int, int]:
        """How many first and last children have equal subtrees."""
        xs, ys = kids[0][i], kids[1][j]
        most, lead, tail = min(len(xs), len(ys)), 0, 0
        while lead < most and shapes[0][xs[lead]] == shapes[1][ys[lead]]:
            lead += 1
        while tail < most - lead and shapes[0][xs[-1 - tail]] == shapes[1][ys[-1 - tail]]:
            tail += 1
        return lead, tail

    def table(xs: list[int], ys: list[int]) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            last, row = rows[-1], [0]
            for k, y in enumerate(ys):
                best = last[k + 1] if last[k + 1] > row[k] else row[k]
                if a.labels[x] == b.labels[y] and (w := last[k] + size(x, y)) > best:
                    best = w
                row.append(best)
            rows.append(row)
        return rows

    def middle(i: int, j: int) -> tuple[int, int, list[int], list[int]]:
        lead, tail = ends(i, j)
        xs, ys = kids[0][i], kids[1][j]
        return lead, tail, xs[lead : len(xs) - tail], ys[lead : len(ys) - tail]

    def size(i: int, j: int) -> int:
        if shapes[0][i] == shapes[1][j]:
            return whole[0][i]
        if (i, j) not in memo:
            lead, tail, xs, ys = middle(i, j)
            own = kids[0][i]
            same = sum(whole[0][x] for x in [*own[:lead], *own[len(own) - tail :]])
            memo[i, j] = 1 + same + (table(xs, ys)[-1][-1] if xs and ys else 0)
        return memo[i, j]

    # children have larger numbers than their parents: sizes from the leaves up, no recursion
    by_label: dict[str, list[int]] = {}
    for j in range(len(b.labels) - 1, -1, -1):
        by_label.setdefault(b.labels[j], []).append(j)
    deep = max(_depth(a), _depth(b)) > 200
    if deep:
        for i in range(len(a.labels) - 1, -1, -1):
            for j in by_label.get(a.labels[i], ()):
                size(i, j)
    pairs, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        pairs.append((i, j))
        if not kids[0][i] or not kids[1][j]:
            continue
        lead, tail, xs, ys = middle(i, j)
        todo += zip(kids[0][i][:lead], kids[1][j][:lead])
        todo += zip(kids[0][i][len(kids[0][i]) - tail :], kids[1][j][len(kids[1][j]) - tail :])
        rows = table(xs, ys)
        x, y = len(xs), len(ys)
        while x and y:
            here = rows[x][y]
            if here == rows[x - 1][y]:
                x -= 1
            elif here == rows[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((xs[x], ys[y]))
    return pairs


def _depth(p: Page) -> int:
    depth = [0] * len(p.labels)
    for i in range(1, len(p.labels)):
        depth[i] = depth[p.parents[i]] + 1
    return max(depth)


def _tree(page: Page) -> str:
    """The tree without its texts; of runs of like leaves (paragraphs) nothing is lost."""
    return json.dumps([page.labels, page.parents], separators=(",", ":"))


def _page(tree: bytes) -> Page:
    p = Page()
    p.labels, p.parents = json.loads(zlib.decompress(tree))
    return p


#: Least block hashes that tell whether pages differ; each one salted by its place.
_SALTS = (0, 1, 2)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, trees, sizes, texts, marks, blocks = [], [], [], [], [], []
        for url, source in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
            page = parse(source or "")
            own: dict[int, str] = {}
            for node, _, text in page.blocks:
                own[node] = own.get(node, "") + "\n" + text
            hosts.append(host_of(url))
            trees.append(zlib.compress(_tree(page).encode(), 6))
            sizes.append(len(page.labels))
            texts.append([{"node": k, "hash": xxhash.xxh3_64_intdigest(v) - (1 << 63)} for k, v in own.items()])
            marks.append([min((xxhash.xxh3_64_intdigest(v, seed=k) for v in own.values()), default=0) - (1 << 63) for k in _SALTS])
            blocks.append(zlib.compress(json.dumps(page.blocks, ensure_ascii=False).encode(), 6))
        yield pa.RecordBatch.from_arrays(
            [
                batch["page_id"], batch["url"], pa.array(hosts, pa.string()), pa.array(sizes, pa.int32()),
                pa.array(trees, pa.binary()), pa.array(texts, pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64())]))),
                pa.array(marks, pa.list_(pa.int64())), pa.array(blocks, pa.binary()),
            ],
            names=["page_id", "url", "host", "nodes", "tree", "texts", "marks", "blocks"],
        )


#: Of a page's nodes with text: the node, the exemplar's number and its aligned node, the text's hash.
_SLOTS = pa.list_(pa.struct([("node", pa.int32()), ("model", pa.int32()), ("slot", pa.int32()), ("hash", pa.int64())]))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    pages: dict[bytes, Page] = {}

    def page(tree: bytes) -> Page:
        if tree not in pages:
            if len(pages) > 200:
                pages.clear()
            pages[tree] = _page(tree)
        return pages[tree]

    for batch in batches:
        out = []
        for tree, models, texts in zip(batch["tree"].to_pylist(), batch["models"].to_pylist(), batch["texts"].to_pylist()):
            found, own = [], {t["node"]: t["hash"] for t in texts}
            for k, model in enumerate(models):
                if (tree, model) not in memo:
                    if len(memo) > 2000:
                        memo.clear()
                    memo[tree, model] = match_trees(_page(tree), page(model))
                found += [{"node": i, "model": k, "slot": j, "hash": own[i]} for i, j in memo[tree, model] if i in own]
            out.append(found)
        yield pa.RecordBatch.from_arrays([batch["row"], batch["host"], batch["marks"], pa.array(out, _SLOTS)], names=["row", "host", "marks", "slots"])


def main_text(blocks: list, template: set[int]) -> str:
    """The blocks that are not template: those of articles, if these hold half of their text."""
    rest = [(inside, t) for node, inside, t in blocks if node not in template]
    own = [t for inside, t in rest if inside]
    if 2 * sum(map(len, own)) < sum(len(t) for _, t in rest):
        own = [t for _, t in rest]
    return "\n\n".join(own)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(json.loads(zlib.decompress(z)), set(t or ()))
            for z, t in zip(batch["blocks"].to_pylist(), batch["template"].to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def _models(light: DataFrame) -> DataFrame:
    """``host, models``: the trees of each host's exemplars; no row for hosts of fewer than
    ``MIN_PAGES`` pages with an element."""
    light = light.where("nodes > 1")
    at = light.groupBy("host").agg(F.percentile_approx("nodes", list(EXEMPLARS)).alias("at"), F.count("*").alias("n"))
    at = written(at.where(F.col("n") >= MIN_PAGES).drop("n"), "exemplars")
    near = light.join(at, "host")
    pick = lambda i: F.min(F.struct(F.abs(F.col("nodes") - F.col("at")[i]).alias("off"), "row"))["row"].alias(f"m{i}")
    rows = near.groupBy("host").agg(*[pick(i) for i in range(len(EXEMPLARS))])
    rows = rows.select("host", F.explode(F.array_distinct(F.array(*[f"m{i}" for i in range(len(EXEMPLARS))]))).alias("row"))
    trees = light.select("row", "tree").join(written(rows, "exemplars"), "row")
    return trees.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "tree"))), lambda x: x["tree"]).alias("models"))


def induced(light: DataFrame) -> DataFrame:
    """``row, template``: the template nodes of every page that has any. Two exemplars a host at
    most are gathered; all else is aggregated where it stands before it moves."""
    models = written(_models(light.select("host", "row", "nodes", "tree")), "models")
    slots = written(
        light.join(models, "host").select("row", "host", "marks", "texts", "tree", "models").mapInArrow(
            _align, "row long, host string, marks array<long>, slots array<struct<node:int,model:int,slot:int,hash:long>>"
        ),
        "aligned",
    )
    nodes = slots.select("host", "marks", F.inline("slots"))
    differ = [F.approx_count_distinct(F.col("marks")[k]).alias(f"d{k}") for k in _SALTS]
    nodes = nodes.groupBy("host", "model", "slot").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.count("*").alias("pages"), *differ)
    apart = F.least(*[f"d{k}" for k in _SALTS])
    constant = nodes.where((F.col("lo") == F.col("hi")) & (apart >= MIN_PAGES) & (apart * 2 >= F.col("pages")))
    constant = constant.groupBy("host").agg(F.collect_set(F.struct("model", "slot")).alias("constant"))
    hit = slots.join(written(constant, "template"), "host")
    named = F.filter("slots", lambda s: F.array_contains("constant", F.struct(s["model"].alias("model"), s["slot"].alias("slot"))))
    return hit.select("row", F.array_distinct(F.transform(named, lambda s: s["node"])).alias("template")).where(F.size("template") > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row a row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parsed = rows.mapInArrow(
        _parse,
        "page_id long, url string, host string, nodes int, tree binary, "
        "texts array<struct<node:int,hash:long>>, marks array<long>, blocks binary",
    )
    parsed = written(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
    template = induced(parsed.select("row", "host", "nodes", "tree", "texts", "marks"))
    joined = parsed.select("row", "page_id", "url", "blocks").join(template, "row", "left").drop("row")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
