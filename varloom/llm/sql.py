"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from varloom.llm.licenses import TEMPLATES

PREFERENCES = """
WITH g AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, turn, text, lead(text) OVER (ORDER BY pair_id) AS other FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, text DESC) AS k FROM g WHERE role = 'assistant') WHERE k = 1),
t AS (SELECT g.pair_id, side, g.turn, g.role, CASE WHEN side = 1 AND g.role = 'assistant' AND g.turn IS NOT DISTINCT FROM l.turn AND g.text = l.text THEN l.other ELSE g.text END AS text
      FROM g JOIN l USING (pair_id) CROSS JOIN (VALUES (0), (1)) z(side) WHERE l.other IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
p AS (SELECT pair_id, max(CASE WHEN side = 0 THEN k END) AS a, max(CASE WHEN side = 1 THEN k END) AS b FROM n GROUP BY pair_id HAVING a > 0 AND b > 0),
d AS (SELECT x.pair_id, min(x.k) AS k FROM n x JOIN n y ON x.pair_id = y.pair_id AND x.k = y.k AND x.side = 0 AND y.side = 1
      WHERE x.role <> y.role OR x.text <> y.text GROUP BY x.pair_id),
c AS (SELECT p.pair_id, coalesce(d.k - 1, least(a, b)) AS m FROM p LEFT JOIN d USING (pair_id)),
r AS (SELECT n.*, c.m, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM n JOIN c USING (pair_id)),
s AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY k) - length(shown) AS ahead FROM r WHERE k > m),
u AS (SELECT pair_id, side, string_agg(shown, '' ORDER BY k) AS shown,
      string_agg(CASE WHEN role = 'assistant' THEN (ahead + length(role) + 5)::BIGINT::VARCHAR || ':' || (ahead + length(shown) - 1)::BIGINT::VARCHAR END, ',' ORDER BY k) AS mask
      FROM s GROUP BY pair_id, side)
SELECT c.pair_id, c.m::BIGINT AS n_common,
 coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM r WHERE r.pair_id = c.pair_id AND side = 0 AND k <= r.m), '') AS prompt,
 coalesce(a.shown, '') AS chosen, coalesce(b.shown, '') AS rejected, coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM c LEFT JOIN u a ON a.pair_id = c.pair_id AND a.side = 0 LEFT JOIN u b ON b.pair_id = c.pair_id AND b.side = 1
"""


def licenses(least: float = 0.8) -> str:
    """Every document against every template, by exact containment of word pairs."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))
    words = "string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH k AS (SELECT license, {pairs} AS p FROM (SELECT license, {words} AS w FROM (VALUES {rows}) t(license, text))),
e AS (SELECT license, len(p) AS n, unnest(p) AS pair FROM k),
d AS (SELECT doc_id, unnest({pairs}) AS pair FROM (SELECT doc_id, {words} AS w FROM documents)),
m AS (SELECT DISTINCT doc_id, license, n, pair FROM d JOIN e USING (pair))
SELECT doc_id, license, round(count(*) / n, 6) AS containment, n::BIGINT AS n_pairs FROM m GROUP BY doc_id, license, n HAVING count(*) / n >= {least}
"""


#: ASCII letters to lower case, others as they are.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')".format(_LOWER)
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

#: Windows of 50 bytes as hexadecimal strings, whose first place is odd.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, o, substr(h, 2 * o + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS o FROM d)),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, o FROM w JOIN f USING (w) WHERE doc_id > first),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY o) AS run FROM (SELECT *, (o > coalesce(lag(o) OVER (PARTITION BY doc_id ORDER BY o), -100) + 50)::INT AS new FROM c)),
s AS (SELECT doc_id, run, min(o) AS a, max(o) + 50 AS b FROM r GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(CASE WHEN n_spans IS NULL THEN unhex(h) ELSE unhex(list_aggregate(list_transform(range(1, n_spans + 2), lambda i: substr(h, (2 * CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END + 1)::BIGINT, (2 * (CASE WHEN i > n_spans THEN length(h) // 2 ELSE a[i] END - CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END))::BIGINT)), 'string_agg', '')) END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

PHRASES = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
p AS (SELECT DISTINCT item, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS phrase, least(len(w), 10) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
n AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN n)),
h AS (SELECT doc_id, i, x.n, item FROM x JOIN p USING (phrase, n)),
k AS (SELECT doc_id, count(DISTINCT o) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS o FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""

NEAR_COPIES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def _vector_codes(rounds: int) -> str:
    """Every part against every entry, `rounds` times with new codebooks and once more for the codes."""
    steps = ["""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x * 256)::BIGINT) AS x, len(embedding) // 16 AS w FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, i // w AS part, i % w AS pos, x[i + 1] AS val FROM (SELECT *, unnest(range(0, len(x))) AS i FROM v)),
b0 AS (SELECT entry, part, pos, val FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64) USING (vec_id))"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT vec_id, c.part, entry, sum((c.val - b.val) * (c.val - b.val))::BIGINT AS d FROM c JOIN b{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (SELECT b.entry, b.part, b.pos, coalesce(m.val, b.val) AS val FROM b{k} b LEFT JOIN (SELECT a.part, a.entry, c.pos, floor(sum(c.val)::DOUBLE / count(*))::BIGINT AS val FROM a{k} a JOIN c USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))""")
    return "WITH " + ",\n".join(steps) + f""",
r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} JOIN v USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


VECTOR_CODES = _vector_codes(2)

LINES = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, line, i, coalesce(doc_id > first, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

#: A field as it is digested, and the lowest bit of a decimal number's crc32, eight shifts a byte.
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_CRC_LOW = """(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) & 1)"""
_OTHERS = "string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx {} a.idx)"

MANIFEST = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC_LOW} = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
l AS (SELECT doc_id, sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf, sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "changed"))}) AS other,
 row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n FROM d),
q AS (SELECT g, min(n) AS n, (SELECT count(*) FROM range(0, 39) r(k) WHERE 3 ** k < min(n)) AS deep FROM l GROUP BY g),
t(k, g, idx, h) AS (SELECT 0::BIGINT, g, idx, leaf FROM l UNION ALL SELECT t.k + 1, t.g, t.idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM t JOIN q ON t.g = q.g AND t.k < q.deep GROUP BY t.k, t.g, t.idx // 3),
w AS (SELECT count(*) AS n, (SELECT count(*) FROM range(0, 39) r(k) WHERE 3 ** k < (SELECT count(*) FROM q)) AS deep FROM q),
u(k, idx, h) AS (SELECT 0::BIGINT, q.g, h FROM q JOIN t ON t.g = q.g AND t.k = q.deep UNION ALL SELECT u.k + 1, u.idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM u JOIN w ON u.k < w.deep GROUP BY u.k, u.idx // 3),
ti AS (SELECT a.k, a.g, a.idx, coalesce({_OTHERS.format("<")}, '') AS l, coalesce({_OTHERS.format(">")}, '') AS r FROM t a JOIN q ON a.g = q.g AND a.k < q.deep JOIN t b ON a.k = b.k AND a.g = b.g AND a.idx // 3 = b.idx // 3 GROUP BY ALL),
ui AS (SELECT a.k, a.idx, coalesce({_OTHERS.format("<")}, '') AS l, coalesce({_OTHERS.format(">")}, '') AS r FROM u a JOIN w ON a.k < w.deep JOIN u b ON a.k = b.k AND a.idx // 3 = b.idx // 3 GROUP BY ALL),
p AS (SELECT l.g, l.idx, ti.k AS rung, ti.l, ti.r FROM l JOIN ti ON l.g = ti.g AND ti.idx = l.idx // (3 ** ti.k)::BIGINT UNION ALL SELECT l.g, l.idx, 100 + ui.k, ui.l, ui.r FROM l JOIN ui ON ui.idx = l.g // (3 ** ui.k)::BIGINT),
s AS (SELECT *, row_number() OVER (PARTITION BY g, idx ORDER BY rung) AS step FROM p),
f(g, idx, step, h) AS (SELECT g, idx, 0::BIGINT, other FROM l UNION ALL SELECT f.g, f.idx, s.step, sha256(s.l || f.h || s.r) FROM f JOIN s ON f.g = s.g AND f.idx = s.idx AND s.step = f.step + 1),
e AS (SELECT g, idx, arg_max(h, step) AS folded_root FROM f GROUP BY ALL),
x AS (SELECT g, idx, string_agg(l || r, '' ORDER BY rung) AS siblings FROM p GROUP BY ALL)
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = u.h AS verified
FROM l JOIN q USING (g) JOIN t ON t.g = l.g AND t.k = q.deep JOIN w ON true JOIN u ON u.k = w.deep JOIN e ON e.g = l.g AND e.idx = l.idx LEFT JOIN x ON x.g = l.g AND x.idx = l.idx
"""
