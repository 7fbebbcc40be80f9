"""SQL for the queries that SQL can express."""

from tallyloom.llm import license_index

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Ids of linked pairs (table link: a, b, both ways) -> the least id reachable (table comp: id, component).
_COMPONENTS = """
reach(id, other) AS (SELECT DISTINCT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.label = q.label AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.e, q.e) >= 0.98
), {_COMPONENTS}
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.component, v.vec_id) AS component_id, v.vec_id = coalesce(comp.component, v.vec_id) AS kept
FROM v LEFT JOIN comp ON v.vec_id = comp.id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = v.vec_id
"""

OP2 = f"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', 'en/'), ('allow', 'example.com', 'en/7'), ('allow', 'net', 'de/'), ('block', 'example.net', 'de/8'), ('block', 'org', 'es/')),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), fit AS (
  SELECT p.page_id, r.host || '/' || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || '/' || r.path) DESC, r.host || '/' || r.path DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, '/' || r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fit f ON f.page_id = p.page_id AND f.k = 1
"""

OP4 = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM wins),
grams AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lens WHERE len(w) >= m)
), hits AS (SELECT x.doc_id, x.i, x.m, y.item_id FROM grams x JOIN wins y ON x.m = y.m AND x.g = y.g),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.joined, '')) AS items_sha256, coalesce(s.n_hit, 0) > 0 AND 20 * coalesce(s.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN spots s ON s.doc_id = d.doc_id LEFT JOIN names n ON n.doc_id = d.doc_id
"""

OP8 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
overlap AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT o.a, o.b FROM overlap o JOIN sizes p ON o.a = p.doc_id JOIN sizes q ON o.b = q.doc_id WHERE 100 * o.both >= 90 * (p.n + q.n - o.both)
), {_COMPONENTS}
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN comp c ON c.id = w.doc_id
"""



def _template_rows() -> str:
    """(t, label, base, n, need, must, pos, word, key) of every word of every licence template."""
    rows = []
    for t, one in enumerate(license_index.BASE + license_index.STATEMENTS):
        w = one.text.split()
        keys: set[int] = set()
        for key in one.keys:
            k = key.split()
            at = min(i for i in range(len(w)) if w[i : i + len(k)] == k)
            keys |= set(range(at, at + len(k)))
        need = min(m for m in range(1, len(w) + 1) if 10 * m >= round(10 * one.share) * len(w))
        rows += [f"({t}, '{one.label}', {one.base}, {len(w)}, {need}, {len(keys)}, {i}, '{x}', {int(i in keys)})" for i, x in enumerate(w)]
    return ", ".join(rows)


OP11 = f"""
WITH tmpl(t, label, base, n, need, must, pos, word, is_key) AS (VALUES {_template_rows()}),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
toks AS (SELECT doc_id, w[i] AS word, i - 1 AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
met AS (
  SELECT doc_id, t, label, base, n, p - pos AS start, count(*) AS c
  FROM toks JOIN tmpl ON toks.word = tmpl.word GROUP BY doc_id, t, label, base, n, need, must, p - pos HAVING count(*) >= need AND sum(is_key) = must
), spots AS (
  SELECT doc_id, sum(CASE WHEN base THEN 1 ELSE 0 END) AS n_base, min(CASE WHEN base THEN start END) AS first_word, max(CASE WHEN base THEN start END) AS last_word, max(c / CAST(n AS DOUBLE)) AS score FROM met GROUP BY doc_id
), own AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM met) GROUP BY doc_id),
basic AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM met WHERE base) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.n_base, 0) AS BIGINT) AS n_base, CAST(s.first_word AS BIGINT) AS first_word, CAST(s.last_word AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(o.labels, '') AS labels, coalesce(s.score, 0.0) AS score
FROM docs d LEFT JOIN spots s ON s.doc_id = d.doc_id LEFT JOIN own o ON o.doc_id = d.doc_id LEFT JOIN basic b ON b.doc_id = d.doc_id
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM scores WHERE same) WHERE k <= 5
), found AS (
  SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS k
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE k <= 5
"""

#: Table crc (held: the 256 steps of crc32 over one byte) and an expression for the crc32 of a string's UTF-8 bytes.
_CRC_STEPS = "crc(held) AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)))"
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(1, 2 * strlen(f), 2), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(i AS BIGINT), 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, held[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295))"""

OP13 = f"""
WITH {_CRC_STEPS},
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), target AS (SELECT {_WORDS} AS w FROM benchmark),
grams AS (SELECT doc_id, unnest(w) AS f FROM docs), wanted AS (SELECT unnest(w) AS f FROM target),
hashed AS (SELECT f, {_CRC32} % 10000 AS bucket FROM (SELECT f FROM grams UNION SELECT f FROM wanted) g, crc),
counts AS (
  SELECT h.bucket, sum(CASE WHEN u.side = 0 THEN u.n ELSE 0 END) AS s, sum(CASE WHEN u.side = 1 THEN u.n ELSE 0 END) AS t
  FROM (SELECT 0 AS side, f, count(*) AS n FROM grams GROUP BY f UNION ALL SELECT 1, f, count(*) FROM wanted GROUP BY f) u JOIN hashed h ON h.f = u.f GROUP BY h.bucket
), whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(c.t + 1 AS DOUBLE) * CAST(w.s + 10000 AS DOUBLE)) / (CAST(c.s + 1 AS DOUBLE) * CAST(w.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts c, whole w
), weights AS (SELECT g.doc_id, CAST(sum(k.gain) AS BIGINT) AS weight FROM grams g JOIN hashed h ON h.f = g.f JOIN gains k ON k.bucket = h.bucket GROUP BY g.doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(x.weight, 0) AS weight,
         coalesce(x.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM docs d LEFT JOIN weights x ON x.doc_id = d.doc_id
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""

ORACLE_SQL = {
    "op1_grid_order_join": OP1,
    "op2_url_filter": OP2,
    "op4_tiered_shards": OP4,
    "op5_winnowing": OP5,
    "op8_jaccard_join": OP8,
    "op11_license_index": OP11,
    "op12_hard_negatives": OP12,
    "op13_importance_resampling": OP13,
}
