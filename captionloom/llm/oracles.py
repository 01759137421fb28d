"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from captionloom.llm import licenses, secrets

OP1 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS rn,
         first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS first_id
  FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rn > 1 THEN first_id END AS refers_to
FROM ranked
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2 = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(10, len(ws)) AS n,
         array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM items WHERE len(ws) > 0)
),
places AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS i
        FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n)
),
hits AS (SELECT doc_id, places.n, i, item FROM places JOIN grams USING (n, gram)),
covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
lows AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, low) AS component_id, vec_id = least(vec_id, low) AS kept
FROM v LEFT JOIN counts ON v.vec_id = counts.a LEFT JOIN lows ON v.vec_id = lows.a
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(concat_ws(':', '5', coalesce(doc_id::VARCHAR, '-'), text)), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS draw
  FROM documents
),
sized AS (SELECT *, length(format('{:b}', greatest(size, 1))) - 1 AS tier FROM d),
sources AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY src) - 1) % 3 + 1]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM sources
),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
aims AS (
  SELECT src, source_size,
         least(cap, coalesce((SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, src LIMIT 1), 'inf'::DOUBLE) * w) AS target
  FROM levels
),
cells AS (SELECT src, tier, sum(size)::BIGINT AS words FROM sized GROUP BY src, tier),
tried AS (
  SELECT src, tier, (target - 2 * coalesce(sum(words) OVER (PARTITION BY src ORDER BY tier DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(words * (1 + tier / 20.0::DOUBLE)) OVER (PARTITION BY src ORDER BY tier DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor
  FROM cells JOIN aims USING (src)
),
factors AS (
  SELECT src, arg_max(factor, tier) AS factor FROM tried WHERE factor * (1 + tier / 20.0::DOUBLE) <= 2 GROUP BY src
),
expected AS (
  SELECT sized.*, source_size, target, coalesce(least(2.0::DOUBLE, coalesce(factor * (1 + tier / 20.0::DOUBLE), 2.0::DOUBLE)), 0) AS e
  FROM sized JOIN aims USING (src) LEFT JOIN factors USING (src)
),
split AS (SELECT *, floor(e)::INT AS sure, e - floor(e) AS part FROM expected),
keyed AS (
  SELECT *, CASE WHEN part > 0 THEN
    floor((draw / (1 - draw) * (1 - part) / part) / (1 + draw / (1 - draw) * (1 - part) / part) * 1099511627776.0::DOUBLE)::BIGINT END AS key
  FROM split
),
rest AS (SELECT src, any_value(target) - sum(size * sure) AS rest FROM keyed GROUP BY src),
ranked AS (
  SELECT keyed.*, rest, sum(size) OVER (PARTITION BY src ORDER BY key, draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed JOIN rest USING (src) WHERE key IS NOT NULL
  UNION ALL
  SELECT keyed.*, 0, 1 FROM keyed WHERE key IS NULL
)
SELECT doc_id, size, source_size, target,
       (size * (sure + CASE WHEN key IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_PHRASES = _values([(p, label, len(p.split())) for p, label in licenses.PHRASES.items()])
_TEMPLATES = _values([(t, label, text, key) for t, (label, text, key) in enumerate(licenses.TEMPLATES)])
_VOCABULARY = _values([(w,) for w in licenses.VOCABULARY])

OP9 = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
phrases(phrase, label, n) AS (VALUES {_PHRASES}),
templates(t, label, body, key) AS (VALUES {_TEMPLATES}),
vocabulary(w) AS (VALUES {_VOCABULARY}),
spots AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM docs),
base AS (
  SELECT DISTINCT rid, label, i FROM (
    SELECT docs.rid, s.i, p.label, array_to_string(ws[s.i + 1 : s.i + p.n], ' ') = p.phrase AS ok
    FROM spots s JOIN docs USING (rid) JOIN phrases p ON s.w = split_part(p.phrase, ' ', 1)) WHERE ok),
own AS (SELECT DISTINCT rid, w FROM spots SEMI JOIN vocabulary USING (w)),
df AS (SELECT w, count(*) AS n FROM own GROUP BY w),
keys AS (SELECT t, string_split(key, ' ') AS ks, len(string_split(split_part(' ' || body || ' ', ' ' || key || ' ', 1), ' ')) - 1 AS key_at FROM templates),
postings AS (
  SELECT t, w, min(k) AS k FROM (SELECT t, unnest(ks) AS w, key_at + generate_subscripts(ks, 1) - 1 AS k FROM keys) SEMI JOIN vocabulary USING (w) GROUP BY t, w),
rare AS (SELECT rid, t, w, k FROM own JOIN df USING (w) JOIN postings USING (w) QUALIFY row_number() OVER (PARTITION BY rid, t ORDER BY n, w) = 1),
offsets AS (SELECT rid, t, s.i - k AS spot FROM spots s JOIN rare USING (rid, w)),
keyed AS (
  SELECT rid, t, spot FROM offsets JOIN keys USING (t) JOIN docs USING (rid)
  WHERE spot + key_at >= 0 AND list_slice(ws, (spot + key_at + 1)::BIGINT, (spot + key_at + len(ks))::BIGINT) = ks),
parts AS (SELECT t, unnest(string_split(body, ' ')) AS w, generate_subscripts(string_split(body, ' '), 1) - 1 AS k FROM templates),
near AS (
  SELECT DISTINCT o.rid, o.t, o.spot, p.k FROM keyed o JOIN parts p USING (t)
  JOIN spots s ON s.rid = o.rid AND s.w = p.w AND s.i BETWEEN o.spot + p.k - {licenses.GAP} AND o.spot + p.k + {licenses.GAP}),
standing AS (
  SELECT rid, label, cover FROM (
    SELECT rid, t, spot, count(*)::DOUBLE / (SELECT count(*) FROM parts p WHERE p.t = near.t) AS cover FROM near GROUP BY rid, t, spot)
  JOIN templates USING (t) WHERE cover >= {licenses.COVER}),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY rid),
named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label, true AS is_base FROM base UNION ALL SELECT rid, label, false FROM standing) GROUP BY rid),
best AS (SELECT rid, max(cover) AS cover FROM standing GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN b USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)
"""

_SHAPES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", "AKIA[A-Z0-9]{14,}", 0),
    ("hex", "[0-9a-f]{16,}", 0),
    ("entropy", f"[A-Za-z0-9+/_-]{{{secrets.WINDOW},}}", 0),
]
_FOUND = " UNION ALL ".join(
    f"""SELECT rid, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {g}) AS gs,
  string_split_regex(t, '{p}') AS ps FROM d"""
    for k, kind, p, g in ((k, kind, p.replace("'", "''"), g) for k, (kind, p, g) in enumerate(_SHAPES))
)
_RUN = f"[A-Za-z0-9+/_-]{{{secrets.WINDOW},}}"
_UNMARKED = "v"
for _mark, _length in secrets.MARKS:
    _UNMARKED = f"regexp_replace({_UNMARKED}, '{_mark}', '{' ' * _length}', 'g')"
OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
each AS (
  SELECT rid, k, kind, unnest(ms) AS v, unnest(gs) AS g, unnest(list_slice(ps, 1, len(ms))) AS p, generate_subscripts(ms, 1) AS i
  FROM found WHERE len(ms) > 0),
placed AS (SELECT *, sum(length(p) + length(v)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM each),
cut AS (
  SELECT rid, i, e - length(v) AS begun,
         CASE WHEN regexp_matches(v, '{secrets.PATH}') THEN replace({_UNMARKED}, '/', ' ') ELSE {_UNMARKED} END AS x
  FROM placed WHERE k = 3 AND NOT regexp_matches(v, '{secrets.ALLOWED_RUN}')),
pieces AS (
  SELECT rid, i, begun, unnest(ms) AS v, unnest(list_slice(ps, 1, len(ms))) AS p, generate_subscripts(ms, 1) AS j
  FROM (SELECT rid, i, begun, regexp_extract_all(x, '{_RUN}') AS ms, string_split_regex(x, '{_RUN}') AS ps FROM cut) WHERE len(ms) > 0),
likely AS (
  SELECT rid, i, v, begun + sum(length(p) + length(v)) OVER (PARTITION BY rid, i ORDER BY j) AS e,
         CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN {secrets.HEX_BITS}
              WHEN regexp_matches(v, '[0-9]') THEN {secrets.BASE64_BITS} ELSE {secrets.LETTER_BITS} END AS least
  FROM pieces),
windows AS (
  SELECT rid, e, v, least, CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN lower(v) ELSE v END AS x,
         unnest(range(1, length(v) - {secrets.WINDOW} + 2)) AS s
  FROM likely WHERE NOT regexp_matches(v, '{"|".join(secrets.ALLOWED)}')),
counted AS (
  SELECT rid, e, v, least, s, c, count(*) AS n FROM (
    SELECT rid, e, v, least, s, unnest(string_split(substr(x, s, {secrets.WINDOW}), '')) AS c FROM windows) GROUP BY ALL),
peaks AS (
  SELECT rid, e, v FROM (
    SELECT rid, e, v, least, s, log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} AS bits FROM counted GROUP BY ALL)
  GROUP BY rid, e, v, least HAVING max(bits) >= least),
spans AS (
  SELECT rid, k, kind, (e - length(v))::BIGINT AS s, e::BIGINT AS e FROM placed
  WHERE k IN (1, 2) OR k = 0 AND length(g) >= {secrets.LEAST_SECRET}
  UNION ALL SELECT rid, 3, 'entropy', (e - length(v))::BIGINT, e::BIGINT FROM peaks),
told AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         count(*) FILTER (k = 3) AS n_entropy,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_entropy, 0)::BIGINT AS n_entropy
FROM d LEFT JOIN told USING (rid)
"""

OP11 = r"""
WITH RECURSIVE table_ AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT)),
           lambda crc, b: xor(t[(xor(crc, b) & 255) + 1], crc >> 8))) % 20 AS kind
  FROM conversations, table_
),
turns AS (
  SELECT coalesce('=' || conv_id, '-') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM coded)
),
placed AS (
  SELECT *, left(role, 1) AS first, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS mark,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(conv || chr(10) || length(role) || chr(10) || role || text)) AS i
  FROM turns
),
marked AS (
  SELECT *, CASE WHEN mark = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
                 WHEN mark NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(first) OVER (PARTITION BY conv ORDER BY i) || first AS pair
  FROM placed
),
bases(src, dst, role, first) AS (
  VALUES ('N', 'S', NULL, 's'), ('N', 'U', 'user', 'u'), ('S', 'U', 'user', 'u'), ('A', 'U', 'user', 'u'), ('U', 'A', 'assistant', 'a')
),
inserts(src, dst, role) AS (VALUES ('N', 'U', 'user'), ('S', 'U', 'user'), ('A', 'U', 'user'), ('U', 'A', 'assistant')),
single AS (
  SELECT src, dst, 0 AS cost, 'K' AS letters, first, NULL AS role FROM bases
  UNION ALL SELECT src, dst, 1, 'R', NULL, role FROM bases WHERE role IS NOT NULL
  UNION ALL SELECT s, s, 2, 'D', NULL, NULL FROM (VALUES ('N'), ('S'), ('U'), ('A')) x(s)
),
moves AS (
  SELECT src, dst, cost, letters, first, role, []::VARCHAR[] AS lead FROM single
  UNION ALL
  SELECT inserts.src, single.dst, cost + 5, 'I' || letters, first, single.role, [inserts.role || ':']
  FROM inserts JOIN single ON inserts.dst = single.src
),
reach(conv, i, state, best) AS (
  SELECT DISTINCT conv, 0::BIGINT, 'N', {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} FROM marked
  UNION ALL
  SELECT r.conv, r.i + 1, m.dst,
         min({'cost': r.best.cost + m.cost + CASE WHEN t.fault = 3 AND right(m.letters, 1) <> 'D' THEN 5 ELSE 0 END,
              'audit': r.best.audit || m.letters,
              'lines': r.best.lines || m.lead || CASE right(m.letters, 1) WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [m.role || ':' || t.text] END})
  FROM reach r JOIN marked t ON t.conv = r.conv AND t.i = r.i + 1
  JOIN moves m ON m.src = r.state AND (m.first IS NULL OR m.first = t.first) AND (right(m.letters, 1) = 'D' OR t.fault NOT IN (1, 2))
  GROUP BY ALL
),
ends AS (
  SELECT conv, min(CASE state WHEN 'U' THEN {'cost': best.cost + 5, 'audit': best.audit || 'I', 'lines': best.lines || ['assistant:']} ELSE best END) AS best
  FROM reach JOIN (SELECT conv, max(i) AS i FROM marked GROUP BY conv) USING (conv, i) WHERE state <> 'S' GROUP BY conv
),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '-') AS conv FROM conversations) o LEFT JOIN counted USING (conv) LEFT JOIN ends USING (conv)
"""

OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE * 256) AS e FROM embeddings
),
whole AS (
  SELECT rid, vec_id, list_transform(e, lambda x: floor(x)) AS e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score, c.rid AS other
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.rid <> c.rid AND len(q.e) = len(c.e)
)
SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
spots AS (
  SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM words, (VALUES (1), (2), (3)) s(size) WHERE len(ws) >= size
),
counts AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE size > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.ws, c.a, x.f AS l, y.f AS r, k, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1 : c.size], ' ')
),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (
  SELECT lang, array_to_string(ws[s : s + 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest([1, 2]) AS s FROM candidates WHERE size = 3) GROUP BY ALL
),
kept AS (
  SELECT least.* FROM least LEFT JOIN within USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {"op1_warc": OP1, "op2_decontaminate": OP2, "op3_embed_dedup": OP3, "op5_secrets": OP5, "op8_mixing": OP8, "op9_licenses": OP9, "op11_dialogue": OP11, "op12_vector_search": OP12, "op13_collocations": OP13}
