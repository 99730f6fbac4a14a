"""SQL counterparts of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .line_frequency import MAX_DOCS, MAX_REMOVED, MIN_WORDS
from .positional import WINDOW
from .warc_zip import MIN_BYTES

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
f AS (SELECT digest, max(page_id) AS response FROM d WHERE n >= {MIN_BYTES} GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN d.page_id < f.response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id < f.response THEN f.response END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM d),
pos AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
tri AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS t FROM pos),
again AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
  trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS norm
  FROM raw WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
held AS (SELECT l.r, d.source, d.doc_id, d.text, l.norm, sum(l.n) AS n FROM lines l JOIN d USING (r) WHERE norm <> '' GROUP BY ALL),
freq AS (SELECT h.source, h.norm, count(DISTINCT h.text) AS docs, min(h.doc_id) AS first_id FROM held h GROUP BY h.source, h.norm),
gone AS (SELECT h.r, sum(h.n) AS n FROM held h JOIN freq f ON h.norm = f.norm AND h.source IS NOT DISTINCT FROM f.source
  WHERE f.docs > {MAX_DOCS} AND h.doc_id IS DISTINCT FROM f.first_id GROUP BY h.r),
base AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= {MAX_REMOVED}::DOUBLE * n_words AS kept FROM base
"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bench_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '{_BENCH_WORD}')"


OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_bench_words('text')} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_bench_words('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM
  (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM
  (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(len(items.items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items.items, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string; needs the table `crc`."""
    step = "xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""

OP11 = f"""
WITH {_CRC},
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
  {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, max(i) AS own FROM t GROUP BY c),
h AS (SELECT k.c, k.own, {_crc32("k.c::VARCHAR")} % 9 AS h, b.own AS there FROM k CROSS JOIN crc LEFT JOIN k b ON b.c = k.c - k.c % 5),
z AS (SELECT c, h, least(h, coalesce(there, 0)) AS taken FROM h),
re AS (SELECT z.c, t.i AS i, t.x FROM z JOIN t ON t.c = z.c - z.c % 5 AND t.i <= z.taken
  UNION ALL SELECT z.c, t.i - z.h + z.taken, t.x FROM z JOIN t ON t.c = z.c AND t.i > z.h),
l AS (SELECT z.c, coalesce(list(re.x ORDER BY re.i) FILTER (re.x IS NOT NULL), []) AS l FROM z LEFT JOIN re ON re.c = z.c GROUP BY z.c),
pre AS (SELECT c, d, l[1:d] AS p, d = len(l) AS last FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM l)),
node AS (SELECT p, any_value(d) AS depth, min(c) AS conv, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends,
  CASE WHEN any_value(d) = 0 THEN 0 ELSE octet_length(encode(p[-1].t)) END AS bytes FROM pre GROUP BY p),
kid AS (SELECT p[1:depth - 1] AS p, count(*) AS kids FROM node WHERE depth > 0 GROUP BY ALL),
w AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kid USING (p)),
up AS (SELECT p[1:e] AS p, kids, n, bytes FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM w)),
sub AS (SELECT p, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * bytes) AS saved FROM up GROUP BY p)
SELECT w.conv AS conv_id, w.depth::BIGINT AS depth, q.conv AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, sub.leaves AS n_leaves,
  sub.saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sub USING (p) LEFT JOIN node q ON w.depth > 0 AND q.p = w.p[1:w.depth - 1]
"""

OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.r AS r, v.vec_id AS vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON v.r <> q.r AND len(v.x) = len(q.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM p
QUALIFY rank <= 5
"""



def _op13() -> str:
    """Costs and letters so far are one string for each state, so that the least of them is the cheapest and then the least."""
    def add(e: str, cost: str, letter: str, when: str = "true") -> str:
        return f"CASE WHEN {e} = '~' OR NOT ({when}) THEN '~' ELSE printf('%09d', left({e}, 9)::INTEGER + {cost}) || substr({e}, 10) || '{letter}' END"

    def kept(state: str, initial: str) -> str:
        return add(state, "extra", "K", f"NOT gone AND initial = '{initial}'")

    def reroled(state: str) -> str:
        return add(state, "3 + extra", "R", "NOT gone")

    before_u = ("e0", "e1", "e3")
    return f"""
WITH RECURSIVE {_CRC},
o AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT o.*, {_crc32("name")} % 20 AS kind FROM o, crc),
d AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k.role, k.text, copy) AS i
  FROM k, (SELECT unnest([0, 1]) AS copy) x WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS broken, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair FROM d),
r AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND broken THEN 3 ELSE 0 END AS extra FROM f),
s AS (SELECT c, max(i) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (extra > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
dp AS (SELECT c, 0::BIGINT AS i, '000000000' AS e0, '~' AS e1, '000000003I' AS e2, '000000006II' AS e3 FROM s UNION ALL
  SELECT c, i, n0, n1, m2, least(n3, {add("m2", "3", "I")}) FROM (
    SELECT c, i, n0, n1, least(n2, {", ".join(add(e, "3", "I") for e in ("n0", "n1", "n3"))}) AS m2, n3 FROM (
      SELECT dp.c, r.i, {add("e0", "4", "D")} AS n0, least({add("e1", "4", "D")}, {kept("e0", "s")}) AS n1,
        least({add("e2", "4", "D")}, {", ".join(kept(e, "u") for e in before_u)}, {", ".join(map(reroled, before_u))}) AS n2,
        least({add("e3", "4", "D")}, {kept("e2", "a")}, {reroled("e2")}) AS n3
      FROM dp JOIN r ON r.c IS NOT DISTINCT FROM dp.c AND r.i = dp.i + 1) x) y),
best AS (SELECT s.*, left(least(e0, e3), 9)::BIGINT AS cost, substr(least(e0, e3), 10) AS audit FROM dp JOIN s ON s.c IS NOT DISTINCT FROM dp.c AND s.size = dp.i),
l AS (SELECT c, n, audit[n] AS letter FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS n FROM best)),
p AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM l WINDOW w AS (PARTITION BY c ORDER BY n)),
q AS (SELECT p.*, r.role, r.text, max(CASE WHEN p.o = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.c) AS led
  FROM p LEFT JOIN r ON letter <> 'I' AND r.c IS NOT DISTINCT FROM p.c AND r.i = p.i WHERE letter <> 'D'),
t AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END,
  chr(10) ORDER BY n) AS text FROM q GROUP BY c)
SELECT v.conv_id, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN best b ON b.c IS NOT DISTINCT FROM v.conv_id LEFT JOIN t ON t.c IS NOT DISTINCT FROM v.conv_id
"""


OP13 = _op13()

ORACLES: dict[str, str] = {"op2_warc_zip": OP2, "op4_line_frequency": OP4, "op8_positional_index": OP8, "op11_prefix_trie": OP11,
    "op12_norm_topk": OP12, "op13_structure_repair": OP13}
