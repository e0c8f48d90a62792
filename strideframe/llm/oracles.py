"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from strideframe.llm import pii, quality

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BLANK = r"'[^\x20\x09-\x0D]+'"

#: The contract's patterns as they stand.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _located(source: str, key: str, text: str, pattern: str) -> str:
    """Rows (key, k, start, stop, value) of the matches in a text column."""
    return (
        f"SELECT {key}, k, CAST(sum(gap + len(value)) OVER (PARTITION BY {key} ORDER BY k) - len(value) AS BIGINT) AS start, CAST(sum(gap + len(value)) OVER (PARTITION BY {key} ORDER BY k) AS BIGINT) AS stop, value FROM "
        f"(SELECT {key}, unnest(range(1, len(h) + 1)) AS k, unnest(h) AS value, unnest(list_transform(list_slice(g, 1, len(h)), lambda x: len(x))) AS gap FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS h, string_split_regex({text}, '{pattern}') AS g FROM {source}))"
    )


_KINDS = " UNION ALL ".join(f"SELECT t, {i} AS kind, start, stop, value FROM ({_located('x', 't', 't', p)})" for i, p in enumerate(_PLAIN.values()))
#: Places from what a split leaves; terms by counts of distinct texts and mutual information.
OP3 = f"""WITH x AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
a AS ({_KINDS}),
n AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS dg FROM a),
b AS (SELECT t, kind, start, stop, value FROM n WHERE kind = 0 OR (kind = 1 AND regexp_full_match(value, '{_BYTE}(?:\\.{_BYTE}){{3}}'))
 OR (kind = 2 AND len(dg) BETWEEN 14 AND 19 AND (SELECT sum(CASE WHEN j % 2 = 0 THEN c WHEN c > 4 THEN 2 * c - 9 ELSE 2 * c END) % 10 FROM (SELECT j, CAST(substr(dg, CAST(len(dg) - j AS BIGINT), 1) AS INTEGER) AS c FROM range(len(dg)) z(j))) = 0)
 OR (kind = 3 AND len(dg) BETWEEN 10 AND 15)),
o AS (SELECT *, kind || ':' || lower(value) AS entity, row_number() OVER (PARTITION BY t ORDER BY start, kind, stop) AS place FROM b),
mx AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY t ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM o),
bl AS (SELECT t, string_agg(substr(t, past + 1, greatest(start - past, 0)) || repeat(' ', greatest(stop - greatest(start, past), 0)), '' ORDER BY place) || substr(t, CAST(max(stop) + 1 AS BIGINT)) AS blank FROM mx GROUP BY 1),
w AS (SELECT t, start AS s, stop AS e, lower(value) AS term FROM ({_located('bl', 't', 'blank', r'[\p{L}\p{N}]+')})),
en AS (SELECT entity, count(DISTINCT t) AS n_entity FROM o GROUP BY 1 HAVING count(DISTINCT t) >= {pii.SUPPORT}),
pr AS (SELECT entity, term, count(*) AS together FROM (SELECT DISTINCT entity, t FROM o JOIN en USING (entity)) JOIN (SELECT DISTINCT t, term FROM w) USING (t) GROUP BY 1, 2 HAVING count(*) >= {pii.SUPPORT}),
tm AS (SELECT term, count(*) AS n_term FROM (SELECT t, unnest(list_distinct(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM x) GROUP BY 1),
tt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
fl AS (SELECT entity, term FROM pr JOIN en USING (entity) JOIN tm USING (term), tt WHERE log2(together * n / (n_entity * greatest(n_term, together))) >= {pii.ALPHA} * log2(n / least(n_entity, n / 2))),
sp AS (SELECT t, start, kind, stop FROM o UNION ALL SELECT DISTINCT w.t, s, 4, e FROM w JOIN o USING (t) JOIN fl ON fl.entity = o.entity AND fl.term = w.term),
r AS (SELECT t, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
 string_agg(list_extract(['email', 'ip', 'card', 'phone', 'term'], kind + 1) || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans, string_agg(list_extract(['email', 'ip', 'card', 'phone'], kind + 1) || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 4) AS base FROM sp GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN r ON r.t = coalesce(d.text, '')"""

#: Windows of 50 bytes as 100 hexadecimal digits; a byte goes if one of the 50 windows that cover it starts in a smaller doc_id.
OP4 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM h),
w AS (SELECT doc_id, i, CASE WHEN (i + 50) * 2 <= length(h) THEN substr(h, CAST(2 * i + 1 AS BIGINT), 100) END AS s, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS byte FROM b),
f AS (SELECT doc_id, i, byte, CASE WHEN s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END AS rep FROM w),
g AS (SELECT doc_id, i, byte, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
r AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)"""

#: Windows of the benchmark's items against all windows of those lengths.
OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT item, w, CAST(least(10, len(w)) AS BIGINT) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM bw),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM t) WHERE len(w) >= k),
hit AS (SELECT x.doc_id, x.i, x.k, t.item FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM dw) x JOIN t ON t.k = x.k AND t.s = x.s),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: Windows of 20 words; a word goes if one of the 20 windows that cover it is not the first of its kind.
OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(list_slice(w, i, i + 19), ' ') END AS s FROM p),
f AS (SELECT doc_id, i, word, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS rep FROM x),
g AS (SELECT doc_id, i, word, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
r AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

_GRID = ", ".join(f"('{rule}', CAST({cut!r} AS DOUBLE))" for rule, cuts in quality.RULES.items() for cut in cuts)
_SIGNALS = " UNION ALL ".join(f"SELECT doc_id, stratum, t, '{rule}' AS rule, CAST({rule} AS DOUBLE) AS v FROM m" for rule in quality.RULES)
_N_CUTS = sum(map(len, quality.RULES.values()))
_P = quality.ALPHA / len(quality.RULES)

#: Counts by lists and windows; binomial tails by gamma functions.
OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(nullif(regexp_extract(lower(coalesce(lang, '')), '^([a-z]{{2}})', 1), ''), 'other') AS stratum, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT doc_id, i, CASE WHEN i + 7 <= len(w) THEN array_to_string(list_slice(w, i, i + 7), ' ') END AS s FROM p),
f AS (SELECT doc_id, i, CASE WHEN s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 THEN 1 ELSE 0 END AS rep FROM x),
g AS (SELECT doc_id, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM f),
n AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM g GROUP BY 1),
c AS (SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, t, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)),
m AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS long_words, -word_chars / greatest(n_words, 1) AS short_words FROM c),
v AS ({_SIGNALS}),
q AS (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)),
s AS (SELECT count(DISTINCT stratum) * {_N_CUTS} AS tests FROM m JOIN q USING (doc_id)),
u AS (SELECT stratum, rule, t, any_value(v) AS v, max(quality) AS quality FROM v JOIN q USING (doc_id) GROUP BY 1, 2, 3),
grid(rule, cut) AS (VALUES {_GRID}),
r AS (SELECT stratum, rule, cut, count(*) FILTER (quality = 1 AND v > cut) AS good, count(*) FILTER (quality = 0 AND v > cut) AS bad, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS n_bad FROM u JOIN grid USING (rule) GROUP BY 1, 2, 3),
k AS (SELECT stratum, rule, cut, bad / greatest(n_bad, 1) - {quality.CAUTION} * good / n AS gain FROM r, s WHERE good + bad > 0 AND good < n * {_P}
 AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P}) + (n - i) * ln(1 - {_P}))) FROM range(good + 1) z(i)) <= {quality.DELTA} / tests),
b AS (SELECT stratum, rule, max(cut) AS cut FROM (SELECT *, max(gain) OVER (PARTITION BY stratum, rule) AS top FROM k WHERE gain >= {quality.LEAST_GAIN}) WHERE gain >= {quality.NEARLY} * top GROUP BY 1, 2),
bad AS (SELECT DISTINCT doc_id FROM v JOIN b USING (stratum, rule) WHERE v > cut)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad ON bad.doc_id = m.doc_id"""

SQL = {"op3_pii": OP3, "op4_suffix_array": OP4, "op5_quality": OP5, "op7_decontaminate": OP7, "op8_substrings": OP8}
