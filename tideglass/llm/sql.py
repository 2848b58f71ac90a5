"""Equivalent SQL of the queries that SQL can express."""

from __future__ import annotations

from . import repair
from .license_texts import TEMPLATES
from .licenses import PHRASES, pattern
from .secret_scan import ALLOWED, ALLOWED_BEFORE, ASSIGN, CLASSES, CONTEXT, KINDS
from .urls import PATTERNS, PLACES, expression

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _starts(phrase: str) -> str:
    test = " AND ".join(f"ws[i + {k}] = {_quoted(w)}" for k, w in enumerate(phrase.split(), 1))
    return f"list_filter(range(len(ws)), lambda i: {test})"


def licenses() -> str:
    base = ", ".join(f"CASE WHEN len({_starts(p)}) > 0 THEN {_quoted(label)} END" for p, label in PHRASES.items())
    more = ", ".join(f"CASE WHEN regexp_matches(line, {_quoted(pattern(t))}) THEN {_quoted(label.partition('#')[0])} END" for label, t in TEMPLATES.items())
    joined = "array_to_string(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), ',')"
    return f"""
    WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
    p AS (SELECT doc_id, ws, list_sort(list_concat(list_concat({', '.join(_starts(x) for x in list(PHRASES)[:2])}), {_starts(list(PHRASES)[2])})) AS places,
                 [{base}] AS base, ' ' || array_to_string(ws, '  ') || ' ' AS line FROM w),
    t AS (SELECT *, [{more}] AS more FROM p)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(places[1] AS BIGINT) AS first_word,
           CAST(places[-1] AS BIGINT) AS last_word, {joined.format('base')} AS base_labels, {joined.format('list_concat(base, more)')} AS labels,
           CAST(CASE WHEN len(list_filter(more, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.6 ELSE 0.0 END AS DOUBLE) AS score
    FROM t"""


def near_dups(threshold: float = 0.95) -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: coalesce(x, 0)) AS e FROM v
                        WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {threshold}),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
    FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def chat() -> str:
    return r"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
    t AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS safe,
                 regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS name FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('<|im_start|>' || name || chr(10) || safe || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""


def contamination(window: int = 13, share: int = 20) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS ws FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, ws, least({window}, len(ws)) AS m FROM (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
    iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[s:s + m - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS s FROM i)),
    dw AS (SELECT rid, m, s, array_to_string(ws[s:s + m - 1], ' ') AS w
           FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw))),
    hits AS (SELECT dw.rid, dw.s, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.w = iw.w),
    n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hits) GROUP BY rid),
    k AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)"""


def urls() -> str:
    ranked = sorted(PLACES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    fits = [(f"(host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)})", h + p, v) for v, h, p in ranked]
    rule = " ".join(f"WHEN {test} THEN {_quoted(name)}" for test, name, _ in fits)
    verdict = " ".join(f"WHEN {test} THEN {_quoted(v)}" for test, _, v in fits)
    any_own = _quoted("|".join(f"(?:{expression(p, '$')})" for p in PATTERNS))
    own = f"regexp_matches({_LOWER.format('url')}, {any_own})"
    return f"""
    WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, url, {_LOWER.format("split_part(rest, '/', 1)")} AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM r)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {own} THEN 'block' ELSE 'allow' END AS verdict FROM h"""


def jaccard(words: int = 4, num: int = 85, den: int = 100) -> str:
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPACED.format('text')} AS ws FROM documents),
    s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + least({words}, len(ws)) - 1], ' ') AS g
          FROM (SELECT rid, ws, unnest(range(1, len(ws) - least({words}, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    both_in AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_in JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE {den} * c >= {num} * (na.n + nb.n - c)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(doc_id) AS id FROM reach JOIN d ON d.rid = b GROUP BY a)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(least.id, doc_id)) AS component_id
    FROM d LEFT JOIN n USING (rid) LEFT JOIN least ON least.a = d.rid"""


def secrets() -> str:
    """Places from the texts between matches; each window's entropy from a histogram of its own."""
    head, _, tail = ASSIGN.partition(")")
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        parts.append(_places(either if kind == "assign" else pattern, group, f"{rank} AS rank, '{kind}' AS kind, first, last", f"length(said) >= {least}"))
    for rank, (kind, of) in enumerate(CLASSES.items(), len(KINDS)):
        allowed = f"NOT regexp_matches(said, {_quoted(ALLOWED)}) AND NOT regexp_matches({_LOWER.format(f'right(rest, {CONTEXT})')}, {_quoted(ALLOWED_BEFORE)})"
        weight = f"list_sum(list_transform(map_values(list_histogram(string_split(said[k + 1:k + {of.window}], ''))), lambda c: CAST([{', '.join(map(str, of.weights))}][CAST(c + 1 AS BIGINT)] AS BIGINT)))"
        hot = f"list_filter(range(length(said) - {of.window} + 1), lambda k: {weight} <= {of.most})"
        inner = _places(of.pattern, 0, f"{rank} AS rank, '{kind}' AS kind, first AS run, {hot} AS hot", allowed)
        parts.append(f"SELECT rid, rank, kind, run + hot[1] AS first, run + hot[-1] + {of.window} AS last FROM ({inner}) WHERE len(hot) > 0")
    told = "string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank){0}"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in KINDS)
    columns = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({' UNION ALL '.join(parts)}),
    n AS (SELECT rid, {counts}, {told.format(f' FILTER (rank < {len(KINDS)})')} AS base, {told.format('')} AS spans FROM s GROUP BY rid)
    SELECT doc_id, {columns}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (rid)"""


def _places(pattern: str, group: int, columns: str, where: str) -> str:
    p = _quoted(pattern)
    size = "CAST(list_sum(list_transform({0}, lambda x: length(x))) AS BIGINT)"
    last = f"{size.format('rests[:i]')} + {size.format('whole[:i]')}"
    return f"""SELECT rid, {columns} FROM (SELECT rid, groups[i] AS said, rests[i] AS rest, {last} - length(whole[i]) AS first, {last} AS last
               FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, {p}, 0) AS whole, regexp_extract_all(text, {p}, {group}) AS groups,
                     string_split_regex(text, {p}) AS rests FROM d WHERE regexp_matches(text, {p})))) WHERE {where}"""


def repairs() -> str:
    """The cheapest way to each state, row by row; before each row at most one is inserted, as two in a row never pay."""
    moves = []
    for state in repair.STATES:
        for insert in (False, True):
            at = repair.FOLLOWS[state] if insert else state
            head, paid, said = ("I", repair.INSERT, _quoted(repair.ROLES[at])) if insert else ("", 0, "NULL")
            for own in "suaxb":
                moves.append((state, own, head + "D", paid + repair.DELETE, 0, said, "NULL", at))
                follows = repair.FOLLOWS[at]
                if own == follows or own == "s" and at == "0":
                    moves.append((state, own, head + "K", paid, 1, said, "'K'", own))
                if own != "b":
                    moves.append((state, own, head + "R", paid + repair.REROLE, 1, said, _quoted(repair.ROLES[follows]), follows))
    values = ", ".join(f"('{a}', '{b}', '{c}', {d}, {e}, {f}, {g}, '{h}')" for a, b, c, d, e, f, g, h in moves)
    bits = "list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(k, ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), CAST(4294967295 AS BIGINT))"
    blanks = "\\x20\\x09-\\x0D"
    return f"""
    WITH RECURSIVE t AS (SELECT *, {crc} % 20 AS fate FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
    d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM t JOIN (VALUES (1), (2)) c(copy) ON copy = 1 OR fate = 3 WHERE fate <> 0),
    ids AS (SELECT row_number() OVER () AS cid, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
    o AS (SELECT cid, d.*, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, left(text, {repair.HEAD})) AS i FROM d JOIN ids ON ids.conv_id IS NOT DISTINCT FROM d.conv_id),
    f AS (SELECT *, NOT regexp_matches(text, '[^{blanks}]') AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again,
                 NOT regexp_matches(text, '[.!?][{blanks}]*\\z') AS cut, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS own,
                 lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS pair FROM o),
    n AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
                 count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid),
    moves(state, own, edits, paid, stays, inserted, becomes, goal) AS (VALUES {values}),
    ways AS (SELECT cid, CAST(0 AS BIGINT) AS i, '0' AS state, CAST(0 AS BIGINT) AS cost, {{'audit': '', 'said': ''}} AS told FROM n
             UNION ALL
             SELECT cid, i, goal, min(cost), arg_min({{'audit': audit, 'said': said}}, (cost, audit))
             FROM (SELECT f.cid, f.i, m.goal, w.cost + m.paid + CASE WHEN m.stays = 1 AND f.cut THEN {repair.TRUNCATED} ELSE 0 END AS cost, w.told.audit || m.edits AS audit,
                          w.told.said || coalesce(m.inserted || ':' || chr(10), '') || coalesce(CASE WHEN m.becomes = 'K' THEN f.role ELSE m.becomes END || ':' || f.text || chr(10), '') AS said
                   FROM ways w JOIN f ON f.cid = w.cid AND f.i = w.i + 1 JOIN moves m ON m.state = w.state AND m.own = CASE WHEN f.blank OR f.again THEN 'b' ELSE f.own END)
             GROUP BY cid, i, goal),
    ends AS (SELECT cid, cost, told.audit AS audit, told.said AS said FROM ways JOIN n USING (cid) WHERE i = n AND state IN ('0', 'a')
             UNION ALL SELECT cid, cost + {repair.INSERT}, told.audit || 'I', told.said || 'assistant:' || chr(10) FROM ways JOIN n USING (cid) WHERE i = n AND state = 'u'),
    best AS (SELECT cid, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(said, (cost, audit)) AS said FROM ends GROUP BY cid)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(said, length(said) - 1), '')) AS repaired_sha256
    FROM ids LEFT JOIN n USING (cid) LEFT JOIN best USING (cid)"""
