"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NORM = r"regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), tri AS (
  SELECT rid, p, struct_pack(a := w[p], b := w[p + 1], c := w[p + 2]) AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)
), dup AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY rid
), m AS (
  SELECT doc_id, d.rid, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.rid = cov.rid
), k AS (
  SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 25
    AND n_symbols / greatest(n_words, 1) <= 0.5 AND n_dup_lines / greatest(n_lines, 1) <= 0.5
    AND n_stop / greatest(n_words, 1) >= 0.01 AND n_upper / greatest(word_chars, 1) <= 0.5 AS kept
FROM k
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, doc_id, list_slice(w, i + 1, i + 2) AS g
  FROM (SELECT rid, doc_id, w, unnest(range(0, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY rid, doc_id), common AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.rid < y.rid GROUP BY x.rid, y.rid
), link AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM common JOIN n p ON p.rid = a JOIN n q ON q.rid = b
  WHERE 100 * k >= 80 * (p.n + q.n - k)
), sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON d.rid = n.rid JOIN c ON c.a = d.doc_id
"""

OP8 = rf"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_NORM} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, list_slice(w, i + 1, least(i + 13, len(w))) AS win
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(win) AS l FROM bw), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_NORM} AS w FROM documents
), dw AS (
  SELECT rid, i, l, list_slice(w, i + 1, i + l) AS win
  FROM (SELECT rid, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM d, lens WHERE len(w) >= l)
), h AS (SELECT rid, i, l, item FROM dw JOIN bw USING (win)), pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM h) GROUP BY rid
), its AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN its ON d.rid = its.rid
"""


OP10 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    -- markers: <|im_start|>, a line feed, <|im_end|>, a line feed; escapes add one each
    sum(24 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS formatted_chars
  FROM r GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), win AS (
  SELECT rid, coalesce(doc_id, -9223372036854775808) AS k, i, list_slice(w, i + 1, i + 20) AS win
  FROM (SELECT rid, doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)
), o AS (
  SELECT rid, i, rank() OVER (PARTITION BY win ORDER BY k, i) AS n FROM win
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM o WHERE n > 1
), x AS (
  SELECT rid, p, word FROM (SELECT rid, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM d)
), kept AS (
  SELECT x.rid, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS t
  FROM x LEFT JOIN gone ON x.rid = gone.rid AND x.p = gone.p WHERE gone.rid IS NULL GROUP BY x.rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid
"""


OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT rid, lang, source, unnest(w) AS term FROM d), vocab AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10
), g AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN vocab v ON g.lang = v.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w)::HUGEINT AS p
  FROM g WINDOW w AS (PARTITION BY lang, source)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w)::HUGEINT AS q
  FROM vocab WINDOW w AS (PARTITION BY lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s1, y.source AS s2, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS v
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) z ON z.lang = a.lang AND z.s1 = a.source AND z.s2 = b.source
), tops AS (
  SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM tops)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM d GROUP BY source
), l AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
    coalesce(sum(2 * source_size) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM s WINDOW o AS (ORDER BY 2 * source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE),
    max(CAST(3 * total - 2 * full_before AS DOUBLE) / CAST(2 * (ws - w_before) AS DOUBLE)) OVER () * w) AS target FROM l
), b AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(least(CAST(floor(target) AS BIGINT) - whole * source_size - before, size), 0) AS BIGINT) AS taken
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op6_near_dedup": OP6, "op8_decontaminate": OP8, "op9_substring_dedup": OP9, "op10_chat_format": OP10,
            "op11_divergence": OP11, "op12_mixing": OP12}
