"""DuckDB SQL for the numbered operators, written from their contracts and not from the Spark code."""

from __future__ import annotations

#: Words are split at blank and U+0009 to U+000D.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

OP10_ROWS = rf"""
WITH source_rows AS (
    SELECT row_number() OVER () AS row_id, * FROM documents),
worded AS (
    SELECT row_id, doc_id, lang, source, coalesce(text, '') AS content, {_WORDS} AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS full_lines
    FROM source_rows),
windows AS (
    SELECT row_id, unnest(range(1, len(words) - 1)) AS i, words FROM worded WHERE len(words) >= 3),
keyed AS (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i], words[i + 1], words[i + 2]) AS times FROM windows),
covered AS (
    SELECT row_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE times > 1) GROUP BY row_id),
counts AS (
    SELECT row_id, doc_id, lang, source, len(words)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
           (length(content) - length(regexp_replace(content, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
           len(full_lines)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM worded LEFT JOIN covered USING (row_id)),
shares AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           1000 * n_symbols // greatest(word_chars, 1) AS symbol_share,
           1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share,
           1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share,
           least(10 * word_chars // greatest(n_words, 1), 1000) AS word_length
    FROM counts),
long AS (
    SELECT lang, source, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'word_length']) AS share,
           unnest([symbol_share, dup_line_share, repeat_share, word_length]) AS v
    FROM shares WHERE NOT base_failed),
parts(share, p_low, p_high, least) AS (VALUES
    ('symbol_share', 250, 750, 10), ('dup_line_share', 500, 950, 25), ('repeat_share', 500, 950, 25),
    ('word_length', 250, 750, 5)),
ranked AS (
    SELECT *, row_number() OVER s AS rs, row_number() OVER l AS rl, row_number() OVER o AS ro,
           count(*) OVER (PARTITION BY lang, source, share) AS ns, count(*) OVER (PARTITION BY lang, share) AS nl,
           count(*) OVER (PARTITION BY share) AS n_all
    FROM long JOIN parts USING (share)
    WINDOW s AS (PARTITION BY lang, source, share ORDER BY v), l AS (PARTITION BY lang, share ORDER BY v),
           o AS (PARTITION BY share ORDER BY v)),
by_source AS (
    SELECT lang, source, share, max(ns) AS n, max(least) AS least, min(v) FILTER (1000 * rs >= p_low * ns) AS lo,
           min(v) FILTER (1000 * rs >= p_high * ns) AS hi FROM ranked GROUP BY ALL),
by_lang AS (
    SELECT lang, share, max(nl) AS n, min(v) FILTER (1000 * rl >= p_low * nl) AS lo,
           min(v) FILTER (1000 * rl >= p_high * nl) AS hi FROM ranked GROUP BY ALL),
overall AS (
    SELECT share, min(v) FILTER (1000 * ro >= p_low * n_all) AS lo,
           min(v) FILTER (1000 * ro >= p_high * n_all) AS hi FROM ranked GROUP BY ALL),
chosen AS (
    SELECT s.lang, s.source, s.share, s.least,
           CASE WHEN s.n >= 200 THEN s.lo WHEN l.n >= 200 THEN l.lo ELSE o.lo END AS lo,
           CASE WHEN s.n >= 200 THEN s.hi WHEN l.n >= 200 THEN l.hi ELSE o.hi END AS hi
    FROM by_source s JOIN by_lang l ON s.lang IS NOT DISTINCT FROM l.lang AND s.share = l.share
    JOIN overall o ON o.share = s.share),
limits AS (
    SELECT lang, source,
           max(hi + 4 * greatest(hi - lo, least)) FILTER (share = 'symbol_share') AS max_symbol,
           max(hi + 4 * greatest(hi - lo, least)) FILTER (share = 'dup_line_share') AS max_dup,
           max(hi + 4 * greatest(hi - lo, least)) FILTER (share = 'repeat_share') AS max_repeat,
           max(hi + 4 * greatest(hi - lo, least)) FILTER (share = 'word_length') AS max_word,
           max(lo - 4 * greatest(hi - lo, least)) FILTER (share = 'word_length') AS min_word
    FROM chosen GROUP BY lang, source),
judged AS (
    SELECT s.*, NOT base_failed AND symbol_share <= max_symbol AND dup_line_share <= max_dup
                AND repeat_share <= max_repeat AND word_length BETWEEN min_word AND max_word AS kept
    FROM shares s LEFT JOIN limits m ON s.lang IS NOT DISTINCT FROM m.lang AND s.source IS NOT DISTINCT FROM m.source)
"""

OP10 = OP10_ROWS + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""


def _spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT row_id, '{kind}' AS kind, {number} AS number, h.start AS start, h.start + length(h.hit) AS finish FROM (
        SELECT row_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
            'hit': hits[i], 'value': vals[i],
            'start': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
                   + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0)}})) AS h
        FROM (SELECT row_id, regexp_extract_all(content, '{quoted}') AS hits,
                     regexp_extract_all(content, '{quoted}', {group}) AS vals,
                     string_split_regex(content, '{quoted}') AS gaps FROM source_rows)
        WHERE len(hits) > 0)
    WHERE length(h.value) >= {least}"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_ASSIGN = ("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|"
           + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

OP1 = rf"""
WITH source_rows AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS content FROM documents),
spans AS (
    {_spans("assign", 0, _ASSIGN, 2, 6)}
    UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
    UNION ALL {_spans("hex", 2, "[0-9a-f]+", 0, 24)}
    UNION ALL {_spans("private_key", 3, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1)}
    UNION ALL {_spans("hosting_token", 4, "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1)}
    UNION ALL {_spans("chat_token", 5, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1)}
    UNION ALL {_spans("web_token", 6, "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1)}),
named AS (SELECT *, kind || ':' || start || ':' || finish AS name FROM spans),
gathered AS (
    SELECT row_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
           count(*) FILTER (number = 2) AS n_hex,
           string_agg(name, ',' ORDER BY start, number) FILTER (number < 3) AS base,
           string_agg(name, ',' ORDER BY start, number) AS spans
    FROM named GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM source_rows LEFT JOIN gathered USING (row_id)
"""


def _license_oracle() -> str:
    from ledgerline.llm.license_scan import RULES, SENTENCES

    plain = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    values = ", ".join(f"({number}, '{sentence}')" for number, sentence in SENTENCES.items())
    ranked = sorted(enumerate(RULES), key=lambda x: (-len(x[1][1]), x[0]))
    choices = []
    for _, (licence, ids) in ranked:
        met = [f"s0 = {ids[0]}"]
        met += [f"s{k} = {ids[k]} AND a{k} - e{k - 1} <= 2" for k in range(1, len(ids))]
        choices.append(f"WHEN {' AND '.join(met)} THEN '{licence}'")
    longest = max(len(ids) for _, ids in RULES)
    leads = ", ".join(f"lead(sentence, {k}) OVER w AS s{k}, lead(pos, {k}) OVER w AS a{k}, lead(finish, {k}) OVER w AS e{k}" for k in range(1, longest))
    return rf"""
WITH source_rows AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS content FROM documents),
known AS (SELECT n AS sentence, {plain.format('s')} AS words FROM (VALUES {values}) AS v(n, s)),
lines AS (
    SELECT row_id, list_filter(list_transform(
        string_split(regexp_replace(content, '([.!?:])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)),
        lambda raw: {plain.format('raw')}), lambda piece: piece <> '') AS pieces
    FROM source_rows),
numbered AS (SELECT row_id, unnest(range(0, len(pieces))) AS pos, pieces FROM lines),
spans AS (
    SELECT row_id, pos, sentence, n.words,
           list_filter(range(pos + 1, least(len(pieces), pos + len(string_split(n.words, ' '))) + 1), lambda stop:
               array_to_string(pieces[pos + 1:stop], ' ') = n.words) AS stops
    FROM numbered JOIN known n ON split_part(pieces[pos + 1], ' ', 1) = split_part(n.words, ' ', 1)
         AND starts_with(n.words, pieces[pos + 1])),
found AS (
    SELECT row_id, pos, max_by(sentence, (stops[1], -sentence)) AS sentence, max(stops[1]) - 1 AS finish
    FROM spans WHERE len(stops) > 0 GROUP BY row_id, pos),
chains AS (
    SELECT row_id, pos, sentence AS s0, pos AS a0, finish AS e0, {leads}
    FROM found WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
chosen AS (SELECT row_id, pos, CASE {' '.join(choices)} END AS licence FROM chains),
firsts AS (SELECT row_id, licence, min(pos) AS pos FROM chosen WHERE licence IS NOT NULL GROUP BY ALL),
joined AS (SELECT row_id, string_agg(licence, ',' ORDER BY pos) AS licences FROM firsts GROUP BY row_id),
counted AS (SELECT row_id, count(*) AS n_sentences, min(pos) AS first_at FROM found GROUP BY row_id)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, first_at::BIGINT AS first_at,
       coalesce(licences, '') AS licences
FROM source_rows LEFT JOIN counted USING (row_id) LEFT JOIN joined USING (row_id)
"""


OP2 = _license_oracle()

#: Smallest node reachable over ``links`` (x, y) from each node of ``nodes`` (node).
_REACH = """
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
    SELECT node, node AS seen FROM nodes
    UNION
    SELECT reach.node, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.seen),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

OP3 = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_REACH},
counted AS (SELECT x AS node, count(*) AS n FROM both_ways GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN least ON least.node = vec_id LEFT JOIN counted ON counted.node = vec_id
"""

OP4 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### : </turn>') + 2 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g'))
           + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
    FROM documents),
shingled AS (
    SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
                                                       lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
    FROM worded WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * c >= 80 * (p.n + q.n - c)),
nodes AS (SELECT DISTINCT doc_id AS node FROM documents),
{_REACH}
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id
FROM documents JOIN least ON least.node = documents.doc_id LEFT JOIN sizes ON sizes.doc_id = documents.doc_id
"""

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '^(?s:.*?)://([^/?#]*)', 1), {_ABC})"


def _tail(url: str, stops: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '^(?s:.*?)://[^/?#]*([^{stops}]*)', 1)"


def _address(url: str) -> str:
    tail = _tail(url, "#")
    return f"{_host(url)} || CASE WHEN starts_with({tail}, '/') THEN {tail} ELSE '/' || {tail} END"


#: Comments, and elements whose text is no markup.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(
    rf"<{name}\b.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "textarea", "title"))

#: Pages without a rule: this twin covers canonical and refresh links with full addresses.
OP8 = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
    SELECT url, unnest(regexp_extract_all(
        regexp_replace(coalesce(html, ''), '{_UNREAD}', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages
    WHERE contains(url, '://')),
targets AS (
    SELECT url, CASE
        WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
        THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
        WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')
        THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS target
    FROM tags),
links AS (
    SELECT DISTINCT {_address('url')} AS x, {_address('target')} AS y
    FROM targets WHERE contains(target, '://')),
nodes AS (SELECT x AS node FROM links UNION SELECT y FROM links),
{_REACH},
addresses AS (
    SELECT node AS address, {_host("'http://' || node")} AS host, {_tail("'http://' || node", '?#')} AS path FROM nodes
    UNION
    SELECT CASE WHEN contains(url, '://') THEN {_address('url')} END,
           {_host('url')}, {_tail('url', '?#')} FROM pages),
judged AS (
    SELECT a.address, a.host, a.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
           arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM addresses a JOIN rules r ON (a.host = r.host OR ends_with(a.host, '.' || r.host))
         AND starts_with(a.path, r.path)
    GROUP BY ALL),
bad AS (
    SELECT component FROM least LEFT JOIN judged ON judged.address = least.node GROUP BY component
    HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false)),
blocked AS (SELECT node FROM least SEMI JOIN bad USING (component)),
placed AS (
    SELECT page_id, {_host('url')} AS host, {_tail('url', '?#')} AS path,
           CASE WHEN contains(url, '://') THEN {_address('url')} END AS address FROM pages)
SELECT page_id, placed.host, placed.path, rule,
       coalesce(verdict, CASE WHEN blocked.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM placed LEFT JOIN judged ON judged.address IS NOT DISTINCT FROM placed.address
     AND judged.host = placed.host AND judged.path = placed.path
LEFT JOIN blocked ON blocked.node = placed.address
"""


def crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit."""
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, 3988292384 * (x % 2)))"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), lambda c, b: {byte}), 4294967295)"


#: All pairs of equal words up to a third of the text apart, in stretches on one diagonal; a run is left out if another
#: run over its words has a smaller period.
OP11 = rf"""
WITH source_rows AS (
    SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words, coalesce({crc32("doc_id")}, 1) AS h FROM documents),
sized AS (
    SELECT row_id, doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS changed,
           (h // 10) % greatest(len(words), 1) AS a, 3 + (h // 10) % 8 AS parts FROM source_rows),
rebuilt AS (
    SELECT row_id, doc_id, n, CASE WHEN changed THEN list_transform(range(0, n), lambda i:
               words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE words END AS words
    FROM sized),
tokens AS (SELECT row_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM rebuilt),
pairs AS (
    SELECT x.row_id, x.i, x.i - y.i AS q
    FROM tokens x JOIN tokens y ON x.row_id = y.row_id AND x.word = y.word AND y.i < x.i AND 3 * (x.i - y.i) <= x.n),
stretches AS (
    SELECT row_id, q, min(i) - q AS start, count(*) + q AS length
    FROM (SELECT row_id, q, i, i - row_number() OVER (PARTITION BY row_id, q ORDER BY i) AS diagonal FROM pairs)
    GROUP BY row_id, q, diagonal HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (
    SELECT row_id, start, length, q AS period FROM stretches r
    WHERE NOT EXISTS (SELECT 1 FROM stretches o WHERE o.row_id = r.row_id AND o.q < r.q AND o.start <= r.start
                      AND o.start + o.length >= r.start + r.length)),
dropped AS (
    SELECT DISTINCT row_id, unnest(range(start + period, start + length)) AS i FROM runs),
short AS (
    SELECT row_id, string_agg(word, ' ' ORDER BY i) AS collapsed
    FROM tokens ANTI JOIN dropped USING (row_id, i) GROUP BY row_id),
listed AS (
    SELECT row_id, count(*) AS n_runs,
           string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS names
    FROM runs GROUP BY row_id),
best AS (
    SELECT row_id, start, length, period FROM runs r
    WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.row_id = r.row_id AND (
        o.length * r.period > r.length * o.period OR o.length * r.period = r.length * o.period
        AND (o.start < r.start OR o.start = r.start AND o.period < r.period))))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(names, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM rebuilt LEFT JOIN listed USING (row_id) LEFT JOIN best USING (row_id) LEFT JOIN short USING (row_id)
"""

#: Prefixes as whole texts, every node's ancestors by way of one member's path.
OP12 = rf"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {crc32("conv_id")} % 9 AS h FROM turns GROUP BY conv_id),
shared AS (
    SELECT s.*, least(s.h, coalesce(b.n, 0)) AS m FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
    SELECT conv_id, pos - h + m AS depth, role, text FROM turns JOIN shared USING (conv_id) WHERE pos > h
    UNION ALL
    SELECT s.conv_id, t.pos, t.role, t.text FROM shared s JOIN turns t ON t.conv_id = s.base AND t.pos <= s.m),
paths AS (
    SELECT conv_id, depth, strlen(text) AS bytes, string_agg(
        length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM sizes),
nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved
    FROM paths GROUP BY depth, path),
parents AS (
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id
    FROM nodes n JOIN paths q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1
    JOIN nodes p ON p.depth = q.depth AND p.path = q.path),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY ALL),
subtrees AS (
    SELECT q.depth, q.path, sum(u.saved)::BIGINT AS saved_tokens, count(*) FILTER (c.conv_id IS NULL) AS n_leaves
    FROM nodes u LEFT JOIN children c ON c.conv_id = u.conv_id AND c.depth = u.depth
    JOIN paths q ON q.conv_id = u.conv_id AND q.depth <= u.depth GROUP BY q.depth, q.path),
ends AS (
    SELECT depth, path, string_agg(conv_id, ',' ORDER BY conv_id) AS members
    FROM paths JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) USING (conv_id, depth)
    GROUP BY depth, path)
SELECT n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
       s.saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (depth, path) LEFT JOIN ends e USING (depth, path)
LEFT JOIN parents p ON p.conv_id = n.conv_id AND p.depth = n.depth
LEFT JOIN children c ON c.conv_id = n.conv_id AND c.depth = n.depth
"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def _matches(table: str, column: str, pattern: str) -> str:
    """(row_id, start, hit, before, after) of the leftmost matches in each row."""
    return f"""
        SELECT row_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
            'hit': hits[i], 'before': gaps[i], 'after': gaps[i + 1],
            'start': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
                   + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0)}})) AS m
        FROM (SELECT row_id, regexp_extract_all({column}, '{pattern}') AS hits,
                     string_split_regex({column}, '{pattern}') AS gaps FROM {table}) WHERE len(hits) > 0"""


def _pii_kind(kind: str, number: int, pattern: str, entity: str, valid: str) -> str:
    return f"""
    SELECT row_id, {number} AS number, '{kind}' AS kind, m.start AS start, m.start + length(m.hit) AS finish,
           '{kind}:' || {entity} AS entity, m.before AS before, m.after AS after
    FROM ({_matches("source_rows", "content", pattern)}) WHERE {valid}"""


def _side(gap: str, part: str, cut: str) -> str:
    whole = f"CASE WHEN length({gap}) > 80 THEN regexp_replace({part}({gap}, 80), '{cut}', ' ') ELSE {gap} END"
    return rf"regexp_extract_all(lower(regexp_replace({whole}, '{_EMAIL}', ' ', 'g')), '\p{{L}}{{3,}}')"


_DIGITS = "regexp_replace(m.hit, '[^0-9]+', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT
             WHEN reverse({_DIGITS})[i]::INT > 4 THEN 2 * reverse({_DIGITS})[i]::INT - 9
             ELSE 2 * reverse({_DIGITS})[i]::INT END)) % 10 = 0"""
_PARTS = "list_max(list_transform(string_split(m.hit, '.'), lambda p: p::HUGEINT)) <= 255"

OP13 = rf"""
WITH source_rows AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS content FROM documents),
found AS (
    {_pii_kind("email", 0, _EMAIL, "lower(m.hit)", "true")}
    UNION ALL {_pii_kind("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "m.hit", _PARTS)}
    UNION ALL {_pii_kind("card", 2, r"[0-9](?:[\x20-]?[0-9])+", _DIGITS, _LUHN)}
    UNION ALL {_pii_kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", _DIGITS, f"length({_DIGITS}) BETWEEN 9 AND 15")}),
mentions AS (
    SELECT row_id, entity,
           list_reverse(list_reverse({_side("before", "right", r"^\p{L}+")})[1:6]) || {_side("after", "left", r"\p{L}+$")}[1:6]
               AS words
    FROM found),
near AS (SELECT row_id, entity, words, unnest(list_distinct(words)) AS word FROM mentions),
pairs AS (
    SELECT entity, word, count(DISTINCT row_id) AS joint FROM near GROUP BY entity, word
    HAVING count(DISTINCT array_to_string(words, ' ')) >= 3),
masked AS (
    SELECT row_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i:
               gaps[i] || repeat(' ', coalesce(length(hits[i]), 0))), '') AS masked
    FROM (SELECT row_id, regexp_extract_all(content, '{_EMAIL}') AS hits,
                 string_split_regex(content, '{_EMAIL}') AS gaps FROM source_rows)),
tokens AS (
    SELECT DISTINCT row_id, lower(token) AS word
    FROM (SELECT row_id, unnest(list_distinct(regexp_extract_all(masked, '\p{{L}}{{3,}}'))) AS token FROM masked)
    WHERE lower(token) IN (SELECT word FROM pairs)),
scored AS (
    SELECT word, max(CASE WHEN df_entity < n THEN
               log2(n * joint / (df_word * df_entity)) / log2(n / df_entity) END) AS share
    FROM pairs JOIN (SELECT word, count(*) AS df_word FROM tokens GROUP BY word) USING (word)
    JOIN (SELECT entity, count(DISTINCT row_id) AS df_entity FROM mentions GROUP BY entity) USING (entity)
    CROSS JOIN (SELECT count(*) AS n FROM source_rows) GROUP BY word),
flagged AS (SELECT word, CASE WHEN share >= 0.95 THEN 'removed' ELSE 'general' END AS kind FROM scored WHERE share >= 0.8),
holding AS (
    SELECT row_id, masked FROM masked WHERE row_id IN (SELECT row_id FROM tokens JOIN flagged USING (word))),
spans AS (
    SELECT row_id, number, kind, start, finish FROM found
    UNION ALL
    SELECT row_id, CASE kind WHEN 'removed' THEN 4 ELSE 5 END, kind, m.start, m.start + length(m.hit)
    FROM ({_matches("holding", "masked", r"\p{L}{3,}")}) JOIN flagged ON flagged.word = lower(m.hit)),
gathered AS (
    SELECT row_id, {", ".join(f"count(*) FILTER (number = {i}) AS n_{k}" for i, k in enumerate(("email", "ip", "card", "phone")))},
           string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY number, start) FILTER (number < 4) AS base,
           string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY number, start) AS spans
    FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM source_rows LEFT JOIN gathered USING (row_id)
"""
