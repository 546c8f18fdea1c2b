"""DuckDB SQL for the corpus queries that SQL can express; written from the contracts."""

from __future__ import annotations

from tidemark.llm.preferences import ORACLE as OP1

WORD = r"[^\x20\x09-\x0D]+"
WORDS = f"SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents"
ROWS = "SELECT doc_id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d"

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(x) AS n, unnest(x) AS byte, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(h, '..') AS x FROM d)),
c AS (SELECT doc_id, i, byte, CASE WHEN i <= n - 49 THEN md5(string_agg(byte, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS s FROM b),
f AS (SELECT s, min(doc_id) AS least FROM c WHERE s IS NOT NULL GROUP BY s),
m AS (SELECT c.*, coalesce(least < doc_id, false) AS late FROM c LEFT JOIN f USING (s)),
g AS (SELECT doc_id, i, byte, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP3 = f"""
WITH RECURSIVE l AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM l),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM d),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = doc_id
"""

OP6 = f"""
WITH d AS ({WORDS}), r AS ({ROWS}),
k AS (SELECT *, CASE WHEN i <= n - 34 THEN md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS s FROM r),
f AS (SELECT s FROM k WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, i, w, bool_or(coalesce(s IN (FROM f), false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM k),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

OP8 = f"""
WITH d AS ({WORDS}), r AS ({ROWS}),
k AS (SELECT *, CASE WHEN i <= n - 4 THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END AS s FROM r),
t AS (SELECT *, s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 AS twice FROM k),
u AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS marked FROM t),
p AS (SELECT doc_id, count(*) FILTER (WHERE marked) AS rep FROM u GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
q AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d JOIN ln USING (doc_id) LEFT JOIN p USING (doc_id)),
j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols > 0.1 * word_chars OR n_dup_lines > 0.3 * greatest(n_lines, 1) OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15 AS suspect FROM q),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR suspect) AS f FROM j GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS m, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS inv FROM h),
b AS (SELECT m, greatest(v - m * (1 - m) * inv, 0) AS w FROM a),
c AS (SELECT m, CASE WHEN w > 0 THEN least(greatest(m * (1 - m) / w - 1, 1), 1e4) ELSE 1e4 END AS k FROM b),
x AS (SELECT source, (f + greatest(m * k, 1e-3)) / (n + greatest(m * k, 1e-3) + greatest((1 - m) * k, 1e-3)) AS rate FROM h, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.5 AND suspect) AS kept, round(rate, 6) AS host_rate, suspect
FROM j JOIN x ON j.source IS NOT DISTINCT FROM x.source
"""

#: the table of the crc32 of a byte, and the crc32 of an ASCII string by it
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"


def crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _encoded(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


_HEAD = " || ".join(map(_encoded, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
d AS (SELECT doc_id, lang, sha256({_HEAD} || {_encoded("text")}) AS leaf, sha256({_HEAD} || {_encoded(_LOWER)}) AS lower_leaf, {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS hit FROM documents, t),
l AS (SELECT doc_id, leaf, CASE WHEN hit THEN lower_leaf ELSE leaf END AS claim, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS cnt FROM d),
n AS (SELECT tree, 0 AS lvl, idx, leaf AS h, cnt FROM l
      UNION ALL SELECT tree, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(cnt) + 7) // 8 FROM n WHERE cnt > 1 GROUP BY tree, lvl, idx // 8),
s AS (SELECT tree, lvl AS depth, h FROM n WHERE cnt = 1),
o AS (SELECT 0 AS lvl, tree AS idx, h, (SELECT count(*) FROM s) AS cnt FROM s
      UNION ALL SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(cnt) + 7) // 8 FROM o WHERE cnt > 1 GROUP BY lvl, idx // 8),
a AS (SELECT tree, lvl, idx, h FROM n WHERE cnt > 1 UNION ALL SELECT -1, lvl, idx, h FROM o WHERE cnt > 1),
b AS (SELECT x.tree, x.lvl, x.idx, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (WHERE y.idx < x.idx), '') AS lefts, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (WHERE y.idx > x.idx), '') AS rights
      FROM a x JOIN a y ON x.tree = y.tree AND x.lvl = y.lvl AND x.idx // 8 = y.idx // 8 GROUP BY ALL),
p AS (SELECT l.tree, l.idx, b.lvl AS step, lefts, rights FROM l JOIN b ON b.tree = l.tree AND b.idx = l.idx >> (3 * b.lvl)
      UNION ALL SELECT l.tree, l.idx, s.depth + b.lvl, lefts, rights FROM l JOIN s ON s.tree = l.tree JOIN b ON b.tree = -1 AND b.idx = l.tree >> (3 * b.lvl)),
q AS (SELECT tree, idx, count(*) AS steps, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof_sha256 FROM p GROUP BY tree, idx),
f AS (SELECT tree, idx, 0 AS step, claim AS h FROM l UNION ALL SELECT f.tree, f.idx, f.step + 1, sha256(lefts || h || rights) FROM f JOIN p ON p.tree = f.tree AND p.idx = f.idx AND p.step = f.step)
SELECT l.doc_id, l.leaf, s.h AS subroot, o.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM l JOIN s ON s.tree = l.tree JOIN o ON o.cnt = 1 LEFT JOIN q ON q.tree = l.tree AND q.idx = l.idx
JOIN f ON f.tree = l.tree AND f.idx = l.idx AND f.step = coalesce(q.steps, 0)
"""

OP12 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least, n >= 100 AND (page_id > least OR page_id IS NULL AND least IS NOT NULL) AS later FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN least END AS refers_to FROM f
"""

OP13 = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
r AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, t),
m AS (SELECT id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM r WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM m),
f AS (SELECT id, turn, i, role, text, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY id ORDER BY i) || left(role, 1) AS pair,
        CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'b' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'd'
             WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM n),
h AS (SELECT id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
        count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY id),
v(q, m, p) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
w(p, c, e, q, cost) AS (VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0),
        (0, '*', 'R', 2, 3), (1, '*', 'R', 2, 3), (3, '*', 'R', 2, 3), (2, '*', 'R', 3, 3), (0, '*', 'D', 0, 4), (1, '*', 'D', 1, 4), (2, '*', 'D', 2, 4), (3, '*', 'D', 3, 4)),
g AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, 0 AS q, '100000000' AS best FROM r
      UNION ALL
      SELECT g.id, g.i + 1, w.q, min(CAST(CAST(left(best, 9) AS BIGINT) + 3 * v.m + w.cost + CASE WHEN fault = 't' AND w.e <> 'D' THEN 3 ELSE 0 END AS VARCHAR) || substr(best, 10) || repeat('I', v.m) || w.e)
      FROM g JOIN f ON f.id = g.id AND f.i = g.i + 1 JOIN v ON v.q = g.q JOIN w ON w.p = v.p AND (w.c = '*' OR w.c = f.c) AND (w.e = 'D' OR fault NOT IN ('b', 'd')) GROUP BY g.id, g.i, w.q),
e AS (SELECT g.id, min(CAST(CAST(left(best, 9) AS BIGINT) + 3 * v.m AS VARCHAR) || substr(best, 10) || repeat('I', v.m)) AS best
      FROM g LEFT JOIN h ON h.id = g.id JOIN v ON v.q = g.q AND v.p IN (0, 3) WHERE g.i = coalesce(h.rows, 0) GROUP BY g.id),
a AS (SELECT id, unnest(string_split(substr(best, 10), '')) AS e, generate_subscripts(string_split(substr(best, 10), ''), 1) AS k FROM e WHERE length(best) > 9),
b AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY id ORDER BY k) AS i, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY id ORDER BY k) AS o FROM a),
x AS (SELECT b.*, f.role, f.text, max(CASE WHEN o = 1 AND e = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY b.id) AS lead FROM b LEFT JOIN f ON f.id = b.id AND f.i = b.i WHERE e <> 'D'),
y AS (SELECT id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS repaired FROM x GROUP BY id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(left(best, 9) AS BIGINT) - 100000000 AS cost, substr(best, 10) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, id FROM r) c JOIN e ON e.id = c.id LEFT JOIN h ON h.id = c.id LEFT JOIN y ON y.id = c.id
"""

ORACLE_SQL = {"op1_preferences": OP1, "op2_suffix_dedup": OP2, "op3_ngram_join": OP3, "op6_window_dedup": OP6, "op8_quality_rules": OP8, "op11_merkle_manifest": OP11, "op12_warc_bundles": OP12, "op13_conversation_repair": OP13}
