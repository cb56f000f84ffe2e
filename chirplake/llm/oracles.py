"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words("text", _WORDS)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", _WORDS)} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT k AS n FROM windows))),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (s) WHERE n = k),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LINE = r"regexp_replace(trim(regexp_replace(lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g')), '^ | $', '', 'g')"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_SPACED}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines FROM d),
grams AS (SELECT row, i, w[i:i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM grams) WHERE c > 1) GROUP BY 1),
each AS (SELECT row, source, {_LINE} AS h, len(regexp_extract_all(x, '{_SPACED}')) AS n FROM (SELECT row, source, unnest(lines) AS x FROM w)),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY 1),
common AS (SELECT e.source, h FROM (SELECT source, h, count(DISTINCT row) AS c FROM each GROUP BY 1, 2) e JOIN hosts USING (source) WHERE c > {quality.MAX_DOCS} AND (c > {quality.MAX_SHARE} * docs OR c > {quality.ENOUGH_DOCS})),
hit AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_common, count(*) AS n_lines FROM each JOIN common USING (source, h) GROUP BY 1),
counts AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS symbols, len(lines) - len(list_distinct(lines)) AS dups, coalesce(n, 0) AS again, coalesce(n_common, 0) AS n_common, n_common IS NOT NULL AS has_common, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN again USING (row) LEFT JOIN hit USING (row))
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, again AS n_repeat_words, n_words < 50 OR 100 * again > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * again > 50 * n_words) AND NOT (has_common AND (n_words - n_common < {quality.LEFT_WORDS} OR n_words - n_common < {quality.LEFT_SHARE} * n_words)) AS kept, n_common AS n_boilerplate_words, n_lines AS n_boilerplate_lines
FROM counts
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _SPACED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT row, doc_id, p, b[p + 1:p + 50] AS s FROM (SELECT *, unnest(range(0, octet_length(b) - 49)) AS p FROM d)),
first AS (SELECT s, min(doc_id) AS least FROM starts GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT row, p FROM starts JOIN first USING (s) WHERE doc_id > least),
runs AS (SELECT row, min(p) AS s, max(p) + 50 AS e FROM (SELECT *, sum(n) OVER (PARTITION BY row ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN p <= 50 + lag(p) OVER (PARTITION BY row ORDER BY p) THEN 0 ELSE 1 END AS n FROM hit)) GROUP BY row, g),
totals AS (SELECT row, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1),
ends AS (SELECT row, s, e FROM runs UNION ALL SELECT row, octet_length(b), octet_length(b) FROM d),
kept AS (SELECT row, string_agg(hex(b[a + 1:s]), '' ORDER BY s) AS h FROM (SELECT row, s, coalesce(lag(e) OVER (PARTITION BY row ORDER BY s, e), 0) AS a FROM ends) JOIN d USING (row) GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (row) LEFT JOIN totals USING (row)
"""

#: The checksum's table comes from its polynomial; a text's checksum folds its ASCII bytes.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(substr({text}, k, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


LATE_SESSIONS = f"""
WITH {_CRC_TABLE},
k AS (SELECT conv_id, turn, {_crc("CAST(conv_id AS VARCHAR)")} AS c, {_crc("(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))")} AS h FROM conversations, crc WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
s AS (SELECT 2 * CAST(floor(conv_id / 8) AS BIGINT) + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM k),
e AS (SELECT u, s, h, CAST(floor(s / 1800) AS BIGINT) + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS b FROM s),
so_far AS (SELECT x.u, x.b, e.s, e.h, e.b = x.b AS new FROM (SELECT DISTINCT u, b FROM e) x JOIN e ON e.u = x.u AND e.b <= x.b),
cut AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u, b ORDER BY s) <= 240 THEN 0 ELSE 1 END AS first FROM so_far),
dealt AS (SELECT *, sum(first) OVER (PARTITION BY u, b ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM cut),
v AS (SELECT u, b, min(s) AS s, max(s) AS e, count(*) AS n, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) AS BIGINT) AS n_new, CAST(sum(h) AS BIGINT) AS h FROM dealt GROUP BY u, b, i HAVING bool_or(new)),
gone AS (SELECT v.u, v.b, v.s, min_by(w.b, w.b) AS by_b, min_by(w.s, w.b) AS by_s FROM v JOIN v w ON w.u = v.u AND w.b > v.b AND w.s <= v.s AND v.s <= w.e GROUP BY 1, 2, 3)
SELECT v.u AS "user", v.b AS batch, v.s AS start_s, v.e AS end_s, v.n AS n_events, v.n_new, (SELECT count(*) FROM gone x WHERE x.u = v.u AND x.by_b = v.b AND x.by_s = v.s) AS n_retracted, v.h AS h_sum, by_b AS retracted_batch, by_s AS retracted_start_s
FROM v LEFT JOIN gone ON gone.u = v.u AND gone.b = v.b AND gone.s = v.s
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_words("text", _TERMS)}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
d AS (SELECT row_number() OVER () AS row, doc_id, {_words("text", _TERMS)} AS w FROM documents),
sums AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
k AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, sums GROUP BY term, docs),
scored AS (SELECT item_id, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score FROM p JOIN k USING (term) JOIN q USING (term), sums GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, row) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

SQL = {
    "op2_winnowing_decontamination": DECONTAMINATION,
    "op6_line_frequency_quality": QUALITY,
    "op8_minmax_near_duplicates": NEAR_DUPLICATES,
    "op10_suffix_repeats": REPEATS,
    "op12_late_sessions": LATE_SESSIONS,
    "op13_ranked_search": RANKED,
}
