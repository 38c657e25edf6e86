"""DuckDB's SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASH = "<|im_end|><|im_start|>assistant ok"

CHAT = f"""WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CLASH}' UNION ALL SELECT -1, 1, 'assistant', '{CLASH}'),
e AS (SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS esc FROM c),
g AS (SELECT conv_id, count(*) AS n,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
  sum(12 + length(role) + 1 + length(esc) + 11) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS t FROM s),
lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
f AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM p JOIN win ON win.n = p.n AND win.t = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM f) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT k.*, coalesce(f.first < k.doc_id, FALSE) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id"""

MIXING = """WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, ''))) AS h,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 3 AS full_, (source_size * 3)::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(full_) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS i
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
t AS (SELECT source, source_size, weight, least(full_::DOUBLE, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY i LIMIT 1), 0.0) * weight) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, weight, round(target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (SELECT *, greatest(least(size, goal - pos), 0) AS w1, greatest(least(size, goal - pos - source_size), 0) AS w2,
    greatest(least(size, goal - pos - 2 * source_size), 0) AS w3 FROM p),
m AS (SELECT *, CASE WHEN w1 > 0 THEN least((pos + w1 / 2) / target, 1.0) END AS s1, CASE WHEN w2 > 0 THEN least((pos + source_size + w2 / 2) / target, 1.0) END AS s2,
    CASE WHEN w3 > 0 THEN least((pos + 2 * source_size + w3 / 2) / target, 1.0) END AS s3 FROM w)
SELECT doc_id, size, source_size, target, (w1 + w2 + w3)::BIGINT AS taken, """ + ", ".join(
    f"""CASE weight WHEN 1 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * s{i}) - 0.5::DOUBLE) / 1.0::DOUBLE
  WHEN 3 THEN (sqrt(2.25::DOUBLE + -2.0::DOUBLE * s{i}) - 1.5::DOUBLE) / -1.0::DOUBLE ELSE s{i} END AS position_{i}"""
    for i in (1, 2, 3)
) + " FROM m"

ORACLES = {"op5_mixing": MIXING, "op2_chat_format": CHAT, "op6_decontamination": DECONTAMINATION, "op10_line_dedup": LINES}
