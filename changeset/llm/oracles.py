"""DuckDB SQL for the rows of the queries that SQL can express; written apart from the operators."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _host(u: str) -> str:
    return _lower(rf"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)")


def _path(u: str) -> str:
    return rf"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _node(u: str) -> str:
    return rf"CASE WHEN contains({u}, '://') THEN regexp_replace({_host(u)}, '^www\.', '') || regexp_replace({_path(u)} || regexp_extract({u}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '/$', '') END"


URLS = rf"""WITH RECURSIVE p AS (SELECT row_number() OVER () rid, page_id, coalesce(url, '') url, coalesce(html, '') html FROM pages),
q AS (SELECT rid, page_id, html, {_host('url')} host, {_path('url')} AS path, {_node('url')} node FROM p),
rules(verdict, h, pre) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (SELECT rid, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) verdict FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY rid),
tags AS (SELECT node, host, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) tag FROM q WHERE node IS NOT NULL),
targets AS (SELECT node, host, CASE WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END x FROM tags),
goals AS (SELECT node, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN 'http://' || host || x END x FROM targets WHERE x <> ''),
edges AS (SELECT node a, {_node('x')} b FROM goals WHERE x IS NOT NULL), ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT node, node FROM q WHERE node IS NOT NULL UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
said AS (SELECT r.a node, bool_or(fit.verdict = 'allow') allowed FROM reach r JOIN q ON q.node = r.b JOIN fit USING (rid) GROUP BY 1)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN said.allowed = false THEN 'block' ELSE 'allow' END) verdict FROM q LEFT JOIN fit USING (rid) LEFT JOIN said USING (node)"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)] END) sh FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
met AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x doc_id, coalesce(any_value(n), 0) n_shingles, min(y) component_id, x = min(y) kept FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x"""

CHAT = """WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 0) turn, coalesce(role, 'unknown') role, coalesce(text, '') x FROM conversations WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, role perspective FROM t WHERE role <> 'system'),
d AS (SELECT *, CAST(floor(turn / 1024) AS bigint) part FROM t),
lead AS (SELECT * FROM t WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, x) = 1),
e AS (SELECT * FROM d UNION ALL SELECT lead.*, part FROM lead JOIN (SELECT DISTINCT conv_id, part FROM d) USING (conv_id) WHERE part > floor(turn / 1024)),
j AS (SELECT *, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) || x || '<|im_end|>' || chr(10) line FROM e JOIN who USING (conv_id))
SELECT conv_id, perspective, part, count(*) n_turns, CAST(sum(length(line)) AS bigint) n_chars, count(*) FILTER (WHERE role = perspective) n_spans, CAST(coalesce(sum(length(x) + 10) FILTER (WHERE role = perspective), 0) AS bigint) n_learned,
sha256(string_agg(line, '' ORDER BY turn, role, x)) rendered_sha256 FROM j GROUP BY 1, 2, 3"""

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents), w AS (SELECT rid, doc_id, t, {_words('t')} ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
l AS (SELECT rid, pos, line, {_words('line')} lw FROM (SELECT rid, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) pos FROM d)),
lx AS (SELECT rid, len(lw) n, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 dup,
  NOT right(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1) IN ('.', '!', '?', ':', ';', ',', '"', '''', ')', ']', '…', '”', '’', '»', '。', '！', '？')
  OR 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 3 * len(lw)
  OR len(lw) >= 3 AND 5 * len(list_filter(lw, lambda x: x IN ('|', '»', '›', '•'))) >= len(lw)
  OR regexp_matches({_lower('line')}, 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|subscribe to our newsletter|click here to') bad FROM l WHERE len(lw) > 0),
ls AS (SELECT rid, count(*) FILTER (WHERE dup) dups, CAST(coalesce(sum(n) FILTER (WHERE bad), 0) AS bigint) lost FROM lx GROUP BY 1),
b AS (SELECT doc_id, CAST(len(ws) AS bigint) n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS bigint) word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS bigint) n_symbols, coalesce(dups, 0) n_dup_lines, coalesce(cov.n, 0) n_repeat_words, coalesce(lost, 0) lost
FROM w LEFT JOIN cov USING (rid) LEFT JOIN ls USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= n_words kept, n_words - lost words_left FROM b"""

SUBSTRINGS = f"""WITH w AS (SELECT row_number() OVER () rid, doc_id, {_words("coalesce(text, '')")} ws FROM documents),
g AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT rid, i + o i FROM twice, (SELECT unnest(range(0, 35)) o)),
word AS (SELECT rid, unnest(ws) word, generate_subscripts(ws, 1) i FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) t, count(*) n FROM word ANTI JOIN gone USING (rid, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS bigint) n_words, len(ws) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (rid)"""

ORACLES = {"op2_url_filter": URLS, "op3_near_dedup": NEAR, "op7_chat_format": CHAT, "op9_quality_rules": QUALITY, "op10_substring_dedup": SUBSTRINGS}
