"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]+"

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, greatest(len(w) - n, -1) + 2)) t(i)),
hit AS (SELECT doc_id, i, p.n, item_id FROM placed p JOIN win ON win.n = p.n AND win.s = p.s),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(10) r(k) WHERE k < n GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, len(w) - 1)) x(i)),
again AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) WHERE c > 1 GROUP BY 1),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, source, t, line, lower(trim(regexp_replace(line, '{_BLANK}', ' ', 'g'))) AS k, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY 1),
above AS (SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT t) AS n, max(n) AS long FROM lines GROUP BY 1, 2) c JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source WHERE c.n >= 20 AND (c.long >= 8 OR 100 * c.n > 10 * h.n)),
lost AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM lines JOIN above ON above.k = lines.k AND above.source IS NOT DISTINCT FROM lines.source GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(t) - len(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
       coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_line_words_removed
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_line_words_removed) >= 50 * n_words AS kept FROM m"""

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) t(i)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (s), range(13) r(k) WHERE m < doc_id),
kept AS (SELECT d.doc_id, string_agg(w[q], ' ' ORDER BY q) AS t, count(*) AS n FROM d, unnest(range(1, len(w) + 1)) t(q) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.p = q) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_ESC = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
OP10 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + len(replace({_ESC.format('role')}, chr(10), '\\n')) + 1 + len({_ESC.format('text')}) + 10 + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY 1"""

def _op12(rounds: int = 3, k: int = 16) -> str:
    """Vectors as rows of (vector, place, component); each round assigns and moves the centroids."""
    assign = """
a{r} AS (SELECT id, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT x.id, c.c, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{r} c ON c.p = x.p GROUP BY 1, 2) GROUP BY 1),"""
    move = """
m{r} AS (SELECT a.c, x.p, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM a{r} a JOIN x ON x.id = a.id GROUP BY 1, 2),
c{n} AS (SELECT c.c, c.p, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c AND m.p = c.p),"""
    steps = "".join(assign.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + assign.format(r=rounds)
    return f"""
WITH kept AS (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT id, p, CAST(greatest(least(floor(64 * CAST(embedding[p] AS DOUBLE)), 134217728), -134217728) AS BIGINT) AS v FROM kept, range(1, 65) t(p)),
seeds AS (SELECT id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), embedding) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k}),
c0 AS (SELECT c, p, v FROM seeds JOIN x USING (id)),{steps}
cs AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN kept USING (id) JOIN cs ON cs.c = a.c"""


OP12 = _op12()

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY 1, 2),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 2)) // CAST(coalesce(gn.total, 0) + 2 * s.v AS BIGINT) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
ln AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY 1, 2),
q AS (SELECT ln.lang, ln.term, 1 + CAST(1000000000 * (ln.n + 2) AS BIGINT) // CAST(sum(ln.n) OVER (PARTITION BY ln.lang) + 2 * s.v AS BIGINT) AS q FROM ln JOIN size s ON s.lang = ln.lang),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM cells a JOIN cells b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT c.lang, c.source, c.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM cells c JOIN q ON q.lang = c.lang AND q.term = c.term WHERE c.n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms QUALIFY rank <= 10"""


_HOST = f"CASE WHEN contains({{0}}, '://') THEN translate(regexp_extract({{0}}, '(?s)^.*?://([^/?#]*)', 1), '{_A}', '{_Z}') ELSE '' END"
_PATH = "CASE WHEN contains({0}, '://') THEN regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END"
_QUERY = r"regexp_extract({0}, '(?s)^[^?#]*(\?[^#]*)', 1)"
_KEY = f"CASE WHEN {_HOST} <> '' THEN {_HOST} || {_PATH} || {_QUERY} END"


def op3(rules: tuple[tuple[str, str, str], ...]) -> str:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    fits = "(x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)"
    best = "arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), 2 * len(r.host || r.path) + CASE r.verdict WHEN 'allow' THEN 1 ELSE 0 END)"
    html = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|\z)', '', 'g')"
    link = rf"""list_transform(list_filter(regexp_extract_all({html}, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))"""
    meta = rf"""list_transform(list_filter(regexp_extract_all({html}, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1))"""
    scheme = "regexp_extract(url, '(?s)^(.*?://)', 1)"
    folder = r"CASE WHEN regexp_replace(path, '(?s)[^/]*\z', '') = '' THEN '/' ELSE regexp_replace(path, '(?s)[^/]*\z', '') END"
    # The link's path from the site's root, its segments folded one by one.
    full = f"CASE WHEN starts_with(l, '/') THEN l ELSE {folder} || l END"
    segments = f"string_split(regexp_extract({full}, '(?s)^([^?#]*)', 1), '/')"
    fold = rf"list_reduce(list_concat([''], {segments}[2:]), lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '(?s)/[^/]*\z', '') ELSE a || '/' || x END)"
    resolved = f"{fold} || CASE WHEN {segments}[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract({full}, '(?s)^[^?#]*(.*)', 1)"
    absolute = f"""CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN l = '' OR starts_with(l, '#') OR regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN starts_with(l, '//') THEN regexp_replace({scheme}, '//$', '') || l WHEN starts_with(l, '?') THEN {scheme} || host || CASE WHEN path = '' THEN '/' ELSE path END || l
      ELSE {scheme} || host || {resolved} END"""
    return f"""
WITH RECURSIVE r(verdict, host, path) AS (VALUES {listed}),
p AS (SELECT page_id, url, html, {_HOST.format("coalesce(url, '')")} AS host, {_PATH.format("coalesce(url, '')")} AS path, {_KEY.format("url")} AS k FROM pages),
own AS (SELECT x.page_id, {best} AS b FROM (SELECT DISTINCT page_id, host, path FROM p) x JOIN r ON {fits} GROUP BY 1),
links AS (SELECT k, url, host, path, replace(unnest(list_concat({link}, {meta})), '&amp;', '&') AS l FROM p),
targets AS (SELECT k, {absolute} AS target FROM links),
e AS (SELECT DISTINCT k AS u, {_KEY.format("target")} AS v FROM targets WHERE target IS NOT NULL),
linked AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach(a, b) AS (SELECT u, v FROM linked UNION SELECT a, v FROM reach JOIN linked ON u = b),
nodes AS (SELECT DISTINCT u AS k, regexp_extract(u, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(u, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM linked),
judged AS (SELECT x.k, {best}.verdict AS verdict FROM nodes x JOIN r ON {fits} GROUP BY 1),
alias AS (SELECT a AS k, max(CASE verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS s FROM (SELECT a, b FROM reach UNION SELECT k, k FROM nodes) JOIN judged ON judged.k = b GROUP BY 1)
SELECT p.page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE s WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN own ON own.page_id = p.page_id LEFT JOIN alias ON alias.k = p.k"""
