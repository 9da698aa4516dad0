"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from .quality_rules import CAPITALS, MIN_WORDS, PATH, STEP, SYMBOLS, RiskControl


def quality_rules_sql(control: RiskControl = RiskControl()) -> str:
    """The base counts, the certified cutoffs and the verdicts, with the exact binomial sum written out."""
    bins = ", ".join(f"('{rule}', least(floor(CASE WHEN {bottom} > 0 THEN {top} / {bottom} ELSE 0 END / {step} + 1e-9), {control.grid})::INT)" for rule, (top, bottom, step) in control.rules.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (SELECT rid, unnest(generate_series(1, len(ws) - 2)) AS i, unnest(ws[1:len(ws) - 2]) AS a, unnest(ws[2:len(ws) - 1]) AS b, unnest(ws[3:len(ws)]) AS c FROM w WHERE len(ws) > 2)),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid),
counts AS (SELECT w.rid, doc_id, lang, md5(t) AS text_key, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (length(t) - length(translate(t, '{CAPITALS}', '')))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated r ON r.rid = w.rid),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
binned AS (SELECT rid, doc_id, lang, text_key, base_failed, b.rule, b.bin FROM based, LATERAL (VALUES {bins}) b(rule, bin)),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT lang, text_key, rule, any_value(bin) AS bin, min(good) AS good, ('0x' || substr(text_key, 1, 8))::BIGINT % 3 = 0 AS tuning FROM binned JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY lang, text_key, rule),
hist AS (SELECT lang, rule, bin, count(*) FILTER (good = 1) AS g, count(*) FILTER (good = 0) AS j FROM labelled WHERE tuning GROUP BY ALL),
cut AS (SELECT lang, rule, c, sum(g) AS g, sum(j) AS j FROM (SELECT lang, rule, g, j, unnest(generate_series(0, bin)) AS c FROM hist) GROUP BY ALL),
policies AS (SELECT a.lang, a.rule, a.c, ceil(CASE WHEN b.g > 0 THEN a.g / ({STEP} * b.g) ELSE 0 END - 1e-9)::INT AS q FROM cut a JOIN cut b ON a.lang = b.lang AND a.rule = b.rule AND b.c = 0 WHERE a.c > 0 AND a.j > a.g),
path AS (SELECT lang, q, n FROM (SELECT lang, count(DISTINCT text_key) AS n FROM labelled WHERE NOT tuning AND good = 1 GROUP BY lang), (SELECT unnest(generate_series(0, {PATH})) AS q)),
fired AS (SELECT l.lang, l.text_key, min(p.q) AS q FROM labelled l JOIN policies p ON l.lang = p.lang AND l.rule = p.rule AND l.bin >= p.c WHERE NOT tuning AND good = 1 AND p.q <= {PATH} GROUP BY ALL),
tested AS (SELECT path.lang, path.q, path.n, count(f.text_key) AS k FROM path LEFT JOIN fired f ON f.lang = path.lang AND f.q <= path.q GROUP BY ALL),
chances AS (SELECT lang, q, CASE WHEN k >= n * {control.alpha} THEN 1.0 ELSE list_sum(list_transform(generate_series(0, k::BIGINT), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({control.alpha}) + (n - i) * ln(1 - {control.alpha})))) END AS p FROM tested),
last AS (SELECT lang, max(q) AS q FROM chances WHERE p <= {control.delta} / (SELECT count(DISTINCT lang) FROM labelled) GROUP BY lang),
chosen AS (SELECT p.lang, rule, min(c) AS c FROM policies p JOIN last l ON p.lang = l.lang AND p.q <= l.q AND p.q <= {PATH} GROUP BY ALL),
refused AS (SELECT DISTINCT rid FROM binned JOIN chosen USING (lang, rule) WHERE bin >= c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM refused r WHERE r.rid = based.rid) AS kept FROM based
"""


def conversation_repair_sql() -> str:
    """Damage by crc32, faults, and the cheapest edits by a recursion over rows that keeps the best (cost, audit, text) per state."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(key[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda acc, v: CASE WHEN xor(acc, v) & 1 = 1 THEN xor(xor(acc, v) >> 1, 3988292384) ELSE xor(acc, v) >> 1 END), 4294967295::BIGINT)"""
    word = r"[^\x20\x09-\x0D]"
    return rf"""WITH RECURSIVE src AS (SELECT conv_id, turn, role, text, {crc} % 20 AS d FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations)),
        damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM src)),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
        faulty AS (SELECT *, role[1:1] AS ini, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM ordered),
        chain(s, m, c, l, o) AS (VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
            (2, 2, 0, '', ''), (2, 3, 5, 'I', chr(10) || 'assistant:'), (2, 2, 10, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', chr(10) || 'user:'), (3, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        step(m, ini, t, l) AS (VALUES (0, 's', 1, 'K'), (0, 'u', 2, 'K'), (1, 'u', 2, 'K'), (3, 'u', 2, 'K'), (2, 'a', 3, 'K'), (0, NULL, 2, 'R'), (1, NULL, 2, 'R'), (2, NULL, 3, 'R'), (3, NULL, 2, 'R'), (0, NULL, 0, 'D'), (1, NULL, 1, 'D'), (2, NULL, 2, 'D'), (3, NULL, 3, 'D')),
        ways AS (SELECT s, t, ini, c, chain.l || step.l AS l, o, step.l AS own FROM chain JOIN step USING (m)),
        best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS b FROM (SELECT DISTINCT conv_id FROM faulty)
            UNION ALL SELECT f.conv_id, f.i, w.t, min({{'c': p.b.c + w.c + CASE w.own WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN w.own <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'a': p.b.a || w.l,
                'o': p.b.o || w.o || CASE w.own WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || CASE w.t WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || f.text END}})
            FROM best p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ways w ON w.s = p.s AND (w.own = 'D' OR ((w.ini IS NULL OR w.ini = f.ini) AND coalesce(f.fault, '') NOT IN ('blank', 'duplicate'))) GROUP BY f.conv_id, f.i, w.t),
        ends AS (SELECT conv_id, min({{'c': b.c + c, 'a': b.a || l, 'o': b.o || o}}) AS b FROM best JOIN chain USING (s) JOIN (SELECT conv_id AS conv, max(i) AS last FROM faulty GROUP BY conv_id) n ON best.conv_id IS NOT DISTINCT FROM conv AND i = last WHERE m IN (0, 3) GROUP BY conv_id),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
        SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.b.c, 0) AS cost, coalesce(e.b.a, '') AS audit, sha256(coalesce(e.b.o[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM k.conv_id"""
