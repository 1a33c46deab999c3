"""DuckDB SQL with the results of the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from loomspan.llm import repair
from loomspan.llm.license_scan import CONTAINED, K, TEMPLATES, template_shingles, window

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1() -> str:
    rows = []
    for name, text in TEMPLATES.items():
        own = template_shingles(text)
        length, stride = window(len(own))
        rows.append(f"({_quoted(name)}, [{', '.join(map(_quoted, own))}], {length}, {stride})")
    return f"""
WITH template(license, own, length, stride) AS (VALUES {', '.join(rows)}),
word AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
shingle AS (SELECT doc_id, list_transform(range(0, greatest(len(w) - {K}, 0) + 1), lambda i: array_to_string(w[i + 1 : i + {K}], ' ')) AS s FROM word WHERE len(w) > 0),
pair AS (SELECT * FROM shingle, template WHERE list_has_any(s, own)),
win AS (SELECT doc_id, license, own, length, s, unnest(range(0, len(s), stride)) AS pos FROM pair),
held AS (SELECT doc_id, license, pos, len(list_distinct(list_intersect(s[pos + 1 : pos + length], own)))::DOUBLE / len(own) AS containment FROM win)
SELECT doc_id, license, max(containment) AS containment, arg_max(pos, (containment, -pos))::INTEGER AS first_word, count(*)::INTEGER AS windows
FROM held WHERE containment >= {CONTAINED} GROUP BY doc_id, license"""


OP2 = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""

OP3 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

OP4 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, avg(size) AS mean FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1) AS weight, source_size * 2.0::DOUBLE AS lim FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, source IS NULL, source) AS nth FROM w),
l AS (SELECT *, greatest((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0)
             / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM l WHERE level * weight <= lim),
a AS (SELECT source, source_size, mean, CASE WHEN f.nth IS NULL OR l.nth < f.nth THEN lim ELSE least(f.level * weight, lim) END AS target FROM l LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM a),
c AS (SELECT *, floor(ratio + 1e-12::DOUBLE) AS certain FROM r),
e AS (SELECT *, greatest(ratio - certain, 0.0::DOUBLE) AS rest, greatest(target - certain * source_size, 0.0::DOUBLE) AS wanted FROM c),
j AS (SELECT doc_id, size, e.*, least(greatest(rest * (0.9::DOUBLE + 0.1::DOUBLE * (2.0::DOUBLE / (1.0::DOUBLE + size / greatest(mean, 1.0::DOUBLE)))), 1e-9::DOUBLE), (1 - 1e-9)::DOUBLE) AS p,
             (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
k AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM j)
SELECT doc_id, size, source_size, target,
       (least(certain + CASE WHEN size > 0 AND wanted > 0 AND before + size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken
FROM k"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS shingle FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM part LEFT JOIN n USING (doc_id)"""

OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM m"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of code points below 2048, bit by bit: its reversed polynomial is 0xEDB88320."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))"
    byte = "flatten(list_transform(string_split(%s, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch) >> 6)::BIGINT, 128 + (unicode(ch) & 63)::BIGINT] END))" % text
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: {bits}), 4294967295::BIGINT)"


# a layer holds the cheapest (cost, audit) of each state (0: none yet, 1: s, 2: u, 3: a); turns are inserted, then the next row is edited
OP11 = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE h <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nth FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS mark, lag(role) OVER (PARTITION BY conv_id ORDER BY nth) AS before FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(mark = 'b')::BIGINT AS blank, count_if(mark = 'd')::BIGINT AS duplicate, count_if(mark = 't')::BIGINT AS truncated,
             count_if(before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(nth) AS rows FROM f GROUP BY conv_id),
ins(origin, too, price, edits, turns) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
move(origin, edit, initial, too, price) AS (VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, {repair.REROLE}), (1, 'R', NULL, 2, {repair.REROLE}), (2, 'R', NULL, 3, {repair.REROLE}), (3, 'R', NULL, 2, {repair.REROLE}),
  (0, 'D', NULL, 0, {repair.DELETE}), (1, 'D', NULL, 1, {repair.DELETE}), (2, 'D', NULL, 2, {repair.DELETE}), (3, 'D', NULL, 3, {repair.DELETE})),
layer AS (
  SELECT conv_id, 0::BIGINT AS nth, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS turns FROM n
  UNION ALL
  SELECT conv_id, nth, state, min(cost), arg_min(audit, (cost, audit)), arg_min(turns, (cost, audit)) FROM (
    SELECT l.conv_id, f.nth, m.too AS state, l.cost + i.price + m.price + CASE WHEN f.mark = 't' AND m.edit <> 'D' THEN {repair.TRUNCATED} ELSE 0 END AS cost, l.audit || i.edits || m.edit AS audit,
           l.turns || i.turns || CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE m.too WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END AS turns
    FROM layer l JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND f.nth = l.nth + 1 JOIN ins i ON i.origin = l.state JOIN move m ON m.origin = i.too
    WHERE (m.edit <> 'K' OR m.initial = left(f.role, 1)) AND (m.edit = 'D' OR f.mark NOT IN ('b', 'd'))) GROUP BY conv_id, nth, state),
done AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(turns, (cost, audit)) AS turns FROM (
  SELECT l.conv_id, l.cost + i.price AS cost, l.audit || i.edits AS audit, l.turns || i.turns AS turns FROM layer l JOIN n ON l.conv_id IS NOT DISTINCT FROM n.conv_id AND l.nth = n.rows JOIN ins i ON i.origin = l.state AND i.too IN (0, 3)) GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN done ON a.conv_id IS NOT DISTINCT FROM done.conv_id"""

# words one edit apart have a variant without one code point in common, or are one another's; they are verified by their distance
OP12 = f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM t GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM u),
r AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
v AS (SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1))))) AS less FROM w),
p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.less = b.less AND a.word <> b.word),
q AS (SELECT word, n, other, other_n, length(word) AS x, length(other) AS y, length(word) - len(list_filter(range(1, length(word) + 1), lambda i: left(word, i) <> left(other, i))) AS front FROM p),
e AS (SELECT * FROM q WHERE (x = y AND substr(word, front + 2) = substr(other, front + 2)) OR (x + 1 = y AND substr(word, front + 1) = substr(other, front + 2)) OR (x = y + 1 AND substr(word, front + 2) = substr(other, front + 1))),
b AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
chain AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)"""

_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
OP13 = f"""
WITH r(verdict, domain, start) AS (VALUES {', '.join(str(r) for r in _RULES)}),
p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM pages),
m AS (SELECT k, arg_max(domain || start, (length(domain), length(start))) AS rule, arg_max(verdict, (length(domain), length(start))) AS verdict FROM p JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": op1(), "op2_exact_dedup": OP2, "op3_ann": OP3, "op4_mixing": OP4, "op6_near_dedup": OP6, "op10_warc": OP10, "op11_structure_repair": OP11, "op12_spelling_variants": OP12, "op13_url_filter": OP13}
