"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import license_scan, mixing, quality_rules

BLANK_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: str = "text") -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"


def _op2() -> str:
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = [f"({x['t']}, '{x['label']}', {lists(x['own'])}, {lists(x['must'])}, {lists(x['bars'])}::VARCHAR[], {x['need']}, {x['span']})" for x in license_scan.templates()]
    phrases = ", ".join(
        f"('{label}', {text.split(' ')!r})" for label, text in license_scan.PHRASES.items()
    )
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered()}, '{PLAIN_WORD}') AS words FROM documents),
template(t, label, own, must, bars, need, span) AS (VALUES {", ".join(rows)}),
phrase(label, parts) AS (VALUES {phrases}),
spot AS (SELECT r, words, unnest(generate_series(0, len(words) - 1)) AS i FROM w),
place AS (SELECT r, i, label FROM spot JOIN phrase ON words[i + 1:i + len(parts)] = parts),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         list_distinct(list(label)) AS labels FROM place GROUP BY r),
token AS (SELECT t, unnest(own) AS token FROM template),
near AS (SELECT r, t FROM (SELECT r, unnest(list_distinct(words)) AS token FROM w) JOIN token USING (token) GROUP BY r, t
         HAVING count(*) >= (SELECT need FROM template x WHERE x.t = token.t)),
told AS (SELECT t, token, true AS own FROM token UNION ALL SELECT t, unnest(bars), false FROM template),
held AS (SELECT n.r, n.t, i, token, own FROM near n JOIN (SELECT r, i, words[i + 1] AS token FROM spot) USING (r) JOIN told USING (t, token)),
block AS (SELECT a.r, a.t, a.i, list(DISTINCT b.token) AS got FROM (SELECT DISTINCT r, t, i FROM held WHERE own) a JOIN template USING (t)
          JOIN held b ON a.r = b.r AND a.t = b.t AND b.i >= a.i AND b.i < a.i + span GROUP BY a.r, a.t, a.i),
match AS (SELECT r, label, len(got) / len(own) AS share FROM block JOIN template USING (t) WHERE len(got) >= need AND list_has_all(got, must) AND NOT list_has_any(got, bars)),
best AS (SELECT r, list_distinct(list(label)) AS labels, max(share) AS share FROM match GROUP BY r)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two list columns, in SQL."""
    x, y = f"(t[1] / list_sum({p}))", f"(t[2] / list_sum({q}))"
    part = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) ELSE 0.0 END"
    m = f"(({x} + {y}) / 2)"
    return (
        f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform("
        f"list_zip({p}, {q}), lambda t: {part(x, m)} + {part(y, m)})) / 2, 0.0)) END"
    )


def quality_sql(docs: str = "documents") -> str:
    r = quality_rules.Rules()
    quote = lambda x: x.replace("'", "''")
    counts = [f"(length(rare) - length(regexp_replace(rare, '{quote(p)}', '', 'g')))" for p in quality_rules.CLASSES.values()]
    common = " ".join(
        f"WHEN known = '{lang}' THEN ["
        + ", ".join(f"((length(low) - length(replace(low, ' {w} ', ''))) / {len(w) + 2})::DOUBLE" for w in words)
        + "]"
        for lang, words in quality_rules.COMMON_WORDS.items()
    )
    zeros = [0.0] * (quality_rules.WORDS_PER_LANG + 1)
    known = ", ".join(f"'{x}'" for x in quality_rules.COMMON_WORDS)
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE '' END AS known FROM {docs}),
w AS (SELECT *, regexp_extract_all(t, '{BLANK_WORD}') AS words, regexp_replace(t, '{quality_rules.COMMON_RUNS}', '', 'g') AS rare,
      ' ' || lower(t) || ' ' AS low,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{BLANK_WORD}')) AS lines FROM d),
spot AS (SELECT doc_id, i, words[i:i + {r.window - 1}] AS win
       FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {r.window - 1})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM spot) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(generate_series(0, {r.window - 1})) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, known, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
      length(rare) - length(regexp_replace(rare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, length(t) AS size,
      [length(t) - length(rare) - (length(t) - length(replace(t, ' ', ''))), length(t) - length(replace(t, ' ', '')), {", ".join(counts)},
       length(rare) - ({" + ".join(counts)})]::DOUBLE[] AS chars,
      CASE {common} END AS listed
      FROM w LEFT JOIN hit USING (doc_id)),
mm AS (SELECT *, CASE WHEN listed IS NULL THEN {zeros!r}::DOUBLE[] ELSE list_append(listed, greatest(n_words - list_sum(listed), 0.0)) END AS common,
       n_words < {r.min_words} OR 100 * n_repeat_words > {r.repeat_percent} * n_words AS base_failed FROM m),
ref AS (SELECT known, {sums("chars", quality_rules.N_CLASSES)} AS ref_chars, {sums("common", quality_rules.WORDS_PER_LANG + 1)} AS ref_common
        FROM mm WHERE NOT base_failed GROUP BY known),
v AS (SELECT mm.*, {_distance("chars", "ref_chars")} AS dc, {_distance("common", "ref_common")} AS dw FROM mm LEFT JOIN ref USING (known))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(size >= {r.min_chars} AND dc > {r.max_char_distance}, false)
            OR coalesce(n_words >= {r.min_common} AND dw > {r.max_word_distance} + {r.word_noise} / sqrt(n_words), false)) AS kept
FROM v
"""


def leaks_sql(docs: str = "documents", more: str = "") -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered()}, '{PLAIN_WORD}') AS words FROM {docs}),
b AS (SELECT item_id, regexp_extract_all({lowered()}, '{PLAIN_WORD}') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(words)) AS size, words[i:i + least(13, len(words)) - 1] AS win
       FROM (SELECT item_id, words, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, words[i:i + size - 1] AS win
       FROM (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM d, sizes)),
h AS (SELECT doc_id, item_id, dw.size, i FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list_distinct(list(item_id::VARCHAR))) AS items, max(size) = 13 AS whole FROM h GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated{more}
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def repeats_sql(docs: str = "documents", columns: str | None = None) -> str:
    n = 35
    columns = columns or "doc_id, len(words)::BIGINT AS n_words, len(spots)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256"
    return f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{BLANK_WORD}'), []) AS words FROM {docs}),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {n - 1}], ' ') AS w
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {n - 1})) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS c FROM win) WHERE c > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS spots FROM rep, (SELECT unnest(generate_series(0, {n - 1})) AS j) GROUP BY doc_id),
k AS (SELECT d.doc_id, words, coalesce(spots, []) AS spots, list_filter(words, lambda w, i: spots IS NULL OR NOT list_contains(spots, i)) AS kept
      FROM d LEFT JOIN gone USING (doc_id))
SELECT {columns} FROM k
"""


_OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 200)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
edge AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM rep),
part AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS p FROM edge),
span AS (SELECT r, p, min(i) AS s, max(i) + 200 AS e FROM part GROUP BY r, p),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS last FROM span),
cut AS (SELECT r, count(*) AS n, sum(e - s) AS gone, string_agg(substr(h, 2 * last + 1, 2 * (s - last)), '' ORDER BY s) AS head, max(e) AS e
        FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


def near_sql(docs: str = "documents", k: int = 2) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lowered()}, '{BLANK_WORD}') AS words FROM {docs}),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
      ELSE list_transform(generate_series(1, len(words) - {k - 1}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')) END) AS shingles FROM d),
t AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS sh, len(shingles) AS n FROM s),
df AS MATERIALIZED (SELECT sh, count(*) AS f FROM t GROUP BY sh),
o AS MATERIALIZED (SELECT doc_id, sh, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, sh) AS pos FROM t JOIN df USING (sh)),
p AS MATERIALIZED (SELECT * FROM o WHERE pos <= n - ceil(0.8 * n) + 1),
c AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.sh = y.sh AND x.doc_id < y.doc_id
      WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
e AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, na, nb, len(list_intersect(x.shingles, y.shingles)) AS k
      FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b) WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT w.b, r.root FROM r JOIN both_ways w ON w.a = r.id AND r.root < w.b),
k AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, k.root AS component_id, s.doc_id = k.root AS kept
FROM s JOIN k ON k.id = s.doc_id
"""


def mix_sql(docs: str = "documents") -> str:
    """Common table expressions that end in ``mixed``: doc_id, size, source_size, target, taken."""
    w = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
sz AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{BLANK_WORD}')), 0)::BIGINT AS size,
       coalesce(source, '') AS src, (source IS NULL)::INT AS none,
       md5(concat_ws(':', '{mixing.SEED}', doc_id::VARCHAR)) AS sort FROM {docs}),
tot AS (SELECT none, src, sum(size)::BIGINT AS source_size FROM sz GROUP BY ALL),
wt AS (SELECT *, ([{w}])[((row_number() OVER (ORDER BY none, src)) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w,
       source_size::DOUBLE * {mixing.LIMIT} AS cap FROM tot),
run AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * {mixing.PERCENT / 100}::DOUBLE AS pool, sum(w) OVER () AS all_w,
        coalesce(sum(w) OVER r, 0.0) AS w_before, coalesce(sum(cap) OVER r, 0.0) AS cap_before FROM wt
        WINDOW r AS (ORDER BY cap / w, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fl AS (SELECT *, cap * (all_w - w_before) <= w * (pool - cap_before) AS at_cap FROM run),
goal AS (SELECT none, src, source_size, CASE WHEN at_cap THEN cap ELSE w * (pool - coalesce(sum(cap) FILTER (WHERE at_cap) OVER (), 0.0))
         / sum(w) FILTER (WHERE NOT at_cap) OVER () END AS target FROM fl),
pr AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY none, src ORDER BY sort, doc_id, size
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM sz JOIN goal USING (none, src)),
ep AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM pr),
mixed AS (SELECT doc_id, size, source_size, target,
          (epochs * size + greatest(least(budget - epochs * source_size - prior, size), 0))::BIGINT AS taken FROM ep)"""


_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
      min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM q
"""


#: For pages whose text is one article of p, h1, b and br: what the wrapper must come to there.
_OP8 = r"""
WITH a AS (SELECT page_id, url, CASE WHEN html LIKE '%<article>%' THEN regexp_extract(html, '(?s)<article>(.*)</article>', 1) ELSE coalesce(html, '') END AS x FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(x, '</?(?:p|h1)>', chr(1), 'g'), '<br>', ' ', 'g') AS cut FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(string_split(regexp_replace(cut, '<[^>]*>', '', 'g'), chr(1)),
      lambda t: trim(regexp_replace(t, '[\s\x0B\x1C-\x1F]+', ' ', 'g'))), lambda t: t != '') AS blocks FROM b),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(array_to_string(blocks, chr(10) || chr(10)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""


_OP1 = r"""
WITH m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l0 AS (SELECT rid, conv_id, turn, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM m),
l1 AS (SELECT *, length(translate(regexp_extract(line, '^(?:[ \t]*>)+'), ' ' || chr(9), '')) AS lv, regexp_replace(line, '^(?:[ \t]*>)+', '') AS body FROM l0),
l2 AS (SELECT *, CASE WHEN lv = 0 AND lead(lv) OVER (PARTITION BY rid ORDER BY i) > 0
       AND regexp_matches(body, '(?i)\b(?:wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$') THEN 1 ELSE lv END AS level FROM l1),
l3 AS (SELECT *, trim(regexp_replace(lower(body), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM l2),
own AS (SELECT DISTINCT conv_id, turn, norm FROM l3 WHERE level = 0 AND norm != ''),
q AS (SELECT conv_id, turn, norm, rid, i, (SELECT max(o.turn) FROM own o WHERE o.conv_id = l3.conv_id AND o.norm = l3.norm AND o.turn < l3.turn) AS source
      FROM l3 WHERE level > 0 AND norm != ''),
v AS (SELECT conv_id, turn, source, count(*) AS n FROM q WHERE source IS NOT NULL GROUP BY ALL),
w AS (SELECT conv_id, turn, arg_max(source, n * 1000000 + source) AS reply, sum(n) AS n_linked FROM v GROUP BY ALL),
f AS (SELECT norm, min(conv_id) AS origin FROM own GROUP BY norm),
a AS (SELECT conv_id, turn, min(origin) AS source_conv FROM q JOIN f USING (norm)
      WHERE source IS NULL AND origin != conv_id AND len(string_split(norm, ' ')) >= 5 GROUP BY ALL),
g AS (SELECT rid, max(level) AS quote_depth, count(*) FILTER (WHERE level > 0) AS n_quoted,
      trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), ' ') AS clean_text FROM l2 GROUP BY rid),
o AS (SELECT m.conv_id, m.turn, m.role, g.*, w.n_linked, a.source_conv,
      coalesce(w.reply, max(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reply_turn
      FROM m JOIN g USING (rid) LEFT JOIN w ON w.conv_id = m.conv_id AND w.turn = m.turn LEFT JOIN a ON a.conv_id = m.conv_id AND a.turn = m.turn)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY reply_turn NULLS FIRST, turn NULLS FIRST, clean_text) - 1 AS position,
       reply_turn, quote_depth::BIGINT AS quote_depth, n_quoted::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked,
       source_conv, clean_text FROM o
"""


ORACLES: dict[str, str] = {
    "op1_quote_linking": _OP1,
    "op2_license_scan": _op2(),
    "op3_warc": _OP3,
    "op4_mixing": f"WITH {mix_sql()} SELECT * FROM mixed",
    "op5_suffix_dedup": _OP5,
    "op6_substring_dedup": repeats_sql(),
    "op7_minhash_dedup": near_sql(),
    "op8_html_extract": _OP8,
    "op9_quality_rules": quality_sql(),
    "op10_decontaminate": leaks_sql(),
}


def pipeline_sql() -> str:
    """The pipeline's five stages, each over what the one before it kept."""
    kept = "doc_id, len(spots) AS n_removed, array_to_string(kept, ' ') AS rest"
    return f"""
WITH s1 AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({quality_sql()}) v USING (doc_id) WHERE v.kept),
s2 AS MATERIALIZED (SELECT d.* FROM s1 d JOIN ({near_sql("s1", 5)}) v USING (doc_id) WHERE v.kept),
r3 AS MATERIALIZED ({repeats_sql("s2", kept)}),
s3 AS MATERIALIZED (SELECT doc_id, text, lang, source, length(text)::BIGINT AS n_chars FROM (
  SELECT doc_id, CASE WHEN n_removed = 0 THEN text ELSE rest END AS text, lang, source FROM s2 JOIN r3 USING (doc_id)) WHERE text != ''),
s4 AS MATERIALIZED (SELECT d.* FROM s3 d JOIN ({leaks_sql("s3", ", coalesce(whole, false) AS whole")}) v USING (doc_id) WHERE NOT (v.contaminated OR v.whole)),
{mix_sql("s4")}
SELECT s4.*, m.size, m.source_size, m.target, m.taken FROM s4 JOIN mixed m USING (doc_id) WHERE m.taken > 0
"""
