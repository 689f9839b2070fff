"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .divergence import COMMON

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_CLASS = {0: "[a-z]", 1: "[A-Z]", 2: "[0-9]", 3: r"[\x20\x09-\x0D]", 4: r"[.,;:''\"()\-]", 5: r"[!?#*$%&|<>@\[\]{}^_~=+/]"}
_LISTS = ", ".join(f"('{lang}', '{w}')" for lang, ws in COMMON.items() for w in ws)
_COUNTS = " UNION ALL ".join(f"SELECT rid, {k} k, length(t) - length(regexp_replace(t, '{c}', '', 'g')) c FROM d" for k, c in _CLASS.items())
_TERM = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"

#: Base counts by plain lists and groups; both distances in long form, a row for each document, language and bin.
_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, lang, coalesce(text, '') t FROM documents),
w AS (SELECT rid, {_WORDS.format(t='t')} ws FROM d),
windows AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') k FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 6, 1))) i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (SELECT rid, count(DISTINCT i + j) n FROM twice, range(8) r(j) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) n FROM (SELECT rid, unnest(string_split(t, chr(10))) l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (SELECT rid, doc_id, lang, length(t) chars, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
  coalesce(l.n, 0) n_dup_lines, coalesce(c.n, 0) n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN lines l USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM base),
named AS ({_COUNTS}),
classes AS (SELECT * FROM named UNION ALL SELECT rid, 6, length(t) - (SELECT sum(c) FROM named n WHERE n.rid = d.rid) FROM d),
known AS (SELECT DISTINCT lang FROM d WHERE lang IN ('de', 'en', 'es', 'fr')),
class_refs AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) q FROM classes JOIN d USING (rid) WHERE lang IN (FROM known) GROUP BY lang, k),
class_terms AS (SELECT rid, r.lang, c / nullif(chars, 0) p, q FROM classes JOIN class_refs r USING (k) JOIN base USING (rid)),
class_distance AS (SELECT rid, min(x) x FROM (SELECT rid, lang, sqrt(greatest(sum({_TERM}) / 2, 0)) x FROM class_terms GROUP BY rid, lang) GROUP BY rid),
listed(lang, word) AS (VALUES {_LISTS}),
tokens AS (SELECT rid, lower(unnest(ws)) word FROM w),
counted AS (SELECT rid, word, count(*) c FROM tokens WHERE word IN (SELECT word FROM listed) GROUP BY ALL),
bins AS (SELECT b.rid, b.lang own, b.n_words, l.lang, l.word, coalesce(c, 0) c FROM base b CROSS JOIN listed l LEFT JOIN counted x ON x.rid = b.rid AND x.word = l.word WHERE l.lang IN (FROM known)),
bins2 AS (SELECT rid, own, n_words, lang, word, c FROM bins UNION ALL SELECT rid, any_value(own), any_value(n_words), lang, NULL, any_value(n_words) - sum(c) FROM bins GROUP BY rid, lang),
word_refs AS (SELECT lang, word, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) q FROM bins2 WHERE own = lang GROUP BY lang, word),
word_terms AS (SELECT b.rid, b.lang, c / nullif(n_words, 0) p, q FROM bins2 b JOIN word_refs r ON r.lang = b.lang AND r.word IS NOT DISTINCT FROM b.word),
word_distance AS (SELECT rid, min(x) x FROM (SELECT rid, lang, sqrt(greatest(sum({_TERM}) / 2, 0)) x FROM word_terms GROUP BY rid, lang) GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols, CAST(n_dup_lines AS BIGINT) n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words, base_failed,
  NOT base_failed AND (chars < 200 OR coalesce(c.x, 0) <= 0.26) AND (n_words < 50 OR coalesce(v.x, 0) <= 0.32) kept
FROM judged LEFT JOIN class_distance c USING (rid) LEFT JOIN word_distance v USING (rid)
"""

_OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) bytes, sha256(coalesce(html, '')) digest FROM pages),
f AS (SELECT digest, min(page_id) first FROM p WHERE bytes >= 100 GROUP BY digest)
SELECT page_id, bytes payload_bytes, digest payload_digest, CASE WHEN first <> page_id AND bytes >= 100 THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN first <> page_id AND bytes >= 100 THEN first END refers_to FROM p LEFT JOIN f USING (digest)
"""

_OP5 = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END verdict FROM r
"""

_OP6 = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') ws FROM benchmark),
items AS (SELECT item_id, ws, least(len(ws), 5) k, len(ws) - least(len(ws), 5) + 1 n FROM item_words WHERE len(ws) > 0),
item_shingles AS (SELECT item_id, k, n, array_to_string(ws[i : i + k - 1], ' ') s, count(*) c
  FROM (SELECT item_id, ws, k, n, unnest(range(1, n + 1)) i FROM items) GROUP BY ALL),
doc_words AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') ws FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, k, i - 1 p, array_to_string(ws[i : i + k - 1], ' ') s, len(ws) - k + 1 total
  FROM (SELECT doc_id, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) i FROM doc_words, (SELECT DISTINCT k FROM items))),
anchors AS (SELECT doc_id, item_id, n, c, p, p.s, total FROM places p JOIN item_shingles USING (k, s)),
windows AS (SELECT a.doc_id, a.item_id, a.n, a.p AS start, least(a.n, a.total - a.p) size, b.s, least(count(*), any_value(b.c)) common
  FROM anchors a JOIN anchors b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + a.n - 1
  GROUP BY a.doc_id, a.item_id, a.n, a.p, a.total, b.s),
scored AS (SELECT doc_id, item_id, start, sum(common) / (size + n - sum(common)) similarity FROM windows GROUP BY doc_id, item_id, n, start, size)
SELECT doc_id, item_id, round(max(similarity), 9) similarity, CAST(arg_min(start, (-similarity, start)) AS INTEGER) AS start
FROM scored WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id
"""

_OP9 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') t FROM conversations UNION ALL
  SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
o AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, t) before, length(replace(replace(t, '\', '\\'), '<|', '<\|')) n FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) loss_sha256,
  CAST(sum(12 + length(role) + 1 + n + 11) AS BIGINT) formatted_chars,
  count_if(NOT ((before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))) n_errors
FROM o GROUP BY conv_id
"""

#: crc32 bit by bit over the digits of the id; runs as stretches of equal triples of words at one distance, which a run of
#: four periods and six words has, with the least distance of each stretch.
_OP11 = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws, doc_id || '' s FROM documents),
c AS (SELECT *, len(ws) n, xor(list_reduce(list_transform(range(9 * length(s)), lambda i: CASE WHEN i % 9 = 0 THEN CAST(ascii(s[i // 9 + 1]) AS BIGINT) ELSE -1 END),
  lambda h, v: CASE WHEN v >= 0 THEN xor(h, v) ELSE xor(h >> 1, 3988292384 * (h & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) h FROM d),
p AS (SELECT *, h // 10 % greatest(n, 1) a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) p FROM c),
x AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END ws FROM p),
w AS (SELECT rid, n, unnest(range(n)) i, unnest(ws) word FROM x),
g AS (SELECT rid, n, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o) g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i) QUALIFY lead(word, 2) OVER o IS NOT NULL),
same AS (SELECT a.rid, a.i, b.i - a.i q FROM g a JOIN g b ON a.rid = b.rid AND a.g = b.g AND b.i > a.i AND b.i - a.i <= a.n // 4),
islands AS (SELECT rid, q, min(i) AS start, count(*) + 2 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) k FROM same) GROUP BY rid, q, k),
runs AS (SELECT rid, start, length, min(q) period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
told AS (SELECT rid, count(*) n_runs, arg_max({'s': start, 'l': length, 'p': period}, (length / period, -start, -period)) top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) t FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) n_runs, top.s AS start, top.l AS length, top.p period, 1000 * top.l // top.p exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
FROM x LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""

SQL: dict[str, str] = {
    "op1_distribution_divergence": _OP1,
    "op4_warc_salvage": _OP4,
    "op5_url_range_join": _OP5,
    "op6_benchmark_decontamination": _OP6,
    "op9_chat_format": _OP9,
    "op11_periodic_runs": _OP11,
}
