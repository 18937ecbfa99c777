"""DuckDB SQL of the queries that SQL can express over whole tables.

The others rest on 64-bit hashes, models or files that SQL lacks: 1 (XXH64 fingerprints and components), 2 (EM and the
classifier), 3 (Viterbi), 4, 5 (language models) and 6 (byte-level BPE). tests/llm compares those with brute force.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP8 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, ''))) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s),
w AS (SELECT source, source_size, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM n),
f AS (SELECT source, source_size, weight, CAST(2 AS DOUBLE) * source_size / weight AS full_at FROM w),
r AS (SELECT source, source_size, weight, full_at, row_number() OVER (ORDER BY full_at, source IS NULL, source) AS rank,
  (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - CAST(2 AS DOUBLE) * coalesce(sum(source_size) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE))) AS level FROM f),
l AS (SELECT level FROM r WHERE level <= full_at ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(weight * (SELECT level FROM l), CAST(2 AS DOUBLE) * source_size), CAST(2 AS DOUBLE) * source_size) AS target FROM r),
q AS (SELECT d.doc_id, d.size, d.hash, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.doc_id, q.size, q.hash, x.pass, CAST(q.upto + x.pass * q.source_size AS DOUBLE) / q.target AS finish FROM q CROSS JOIN (SELECT unnest([0, 1]) AS pass) x WHERE q.size > 0 AND q.target > 0),
o AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, hash, pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM p),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM o WHERE total <= floor(CAST(1.5 AS DOUBLE) * (SELECT sum(size) FROM d)) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

OP10 = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM (SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) s WHERE len(d.w) >= s.n)),
m AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
ni AS (SELECT row_number() OVER () AS r, item_id, w FROM (SELECT DISTINCT item_id, w FROM i WHERE len(w) > 0)),
nw AS (SELECT DISTINCT r, item_id, word FROM (SELECT r, item_id, unnest(w) AS word FROM ni)),
dp AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d) WHERE word IN (SELECT word FROM nw)),
pf AS (SELECT word, count(*) AS n FROM dp GROUP BY word),
nr AS (SELECT r, item_id, word, k, least(m, 3) AS m FROM (SELECT r, item_id, nw.word, row_number() OVER (PARTITION BY r ORDER BY n, nw.word) AS k, count(*) OVER (PARTITION BY r) AS m FROM nw JOIN pf ON nw.word = pf.word) WHERE k <= 3 AND m > 1),
nc AS (SELECT p.doc_id, nr.r, nr.item_id, nr.m, p.pos AS c FROM nr JOIN dp p ON p.word = nr.word WHERE nr.k = 1),
ns AS (SELECT nc.doc_id, nc.r, nc.item_id, nc.m, nc.c, nr.word, max(CASE WHEN p.pos < nc.c THEN p.pos END) AS l, min(CASE WHEN p.pos > nc.c THEN p.pos END) AS g
  FROM nc JOIN nr ON nr.r = nc.r AND nr.k > 1 JOIN dp p ON p.doc_id = nc.doc_id AND p.word = nr.word AND abs(p.pos - nc.c) < 20 GROUP BY nc.doc_id, nc.r, nc.item_id, nc.m, nc.c, nr.word),
nb AS (SELECT doc_id, r, c, c AS b FROM ns UNION SELECT doc_id, r, c, l AS b FROM ns WHERE l IS NOT NULL),
ne AS (SELECT ns.doc_id, ns.r, any_value(ns.item_id) AS item_id, ns.c, nb.b FROM ns JOIN nb ON nb.doc_id = ns.doc_id AND nb.r = ns.r AND nb.c = ns.c GROUP BY ns.doc_id, ns.r, ns.c, nb.b
  HAVING count(*) = any_value(ns.m) - 1 AND count(CASE WHEN ns.l >= nb.b THEN ns.c ELSE ns.g END) = count(*) AND max(CASE WHEN ns.l >= nb.b THEN ns.c ELSE ns.g END) - nb.b < 20),
nl AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM ne) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(nl.n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(nl.ids, '')) AS near_sha256
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN nl ON d.doc_id = nl.doc_id
"""

#: What op7's alignment and lookups come to: words in windows of 50, and in lines of 5 or more, that an earlier document holds.
OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, len(w) AS n, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS f FROM d),
x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, i, f FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS f FROM x) WHERE f < doc_id),
k AS (SELECT doc_id, nr, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM d)),
m AS (SELECT doc_id, array_to_string(w, ' ') AS line, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY nr) - len(w) AS a FROM k),
q AS (SELECT doc_id, a, n, f FROM (SELECT doc_id, a, n, min(doc_id) OVER (PARTITION BY line) AS f FROM m WHERE n >= 5) WHERE f < doc_id),
p AS (SELECT doc_id, unnest(range(i - 1, i + 49)) AS p FROM r UNION SELECT doc_id, unnest(range(CAST(a AS BIGINT), CAST(a + n AS BIGINT))) AS p FROM q),
s AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS grp FROM p) GROUP BY doc_id, grp),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed_words, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id),
e AS (SELECT doc_id, min(f) AS f FROM r GROUP BY doc_id),
g AS (SELECT doc_id, min(f) AS f FROM q GROUP BY doc_id)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_words, coalesce(t.removed_words, 0) AS removed_words, least(CASE WHEN c.f < c.doc_id AND c.n >= 50 THEN c.f ELSE e.f END, g.f) AS first_source, coalesce(t.spans, '') AS spans
FROM c LEFT JOIN t ON t.doc_id = c.doc_id LEFT JOIN e ON e.doc_id = c.doc_id LEFT JOIN g ON g.doc_id = c.doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
b AS (SELECT doc_id, source, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM d),
s AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM s) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
n AS (SELECT doc_id, source, list_transform(lines, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))) AS norm, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS sizes FROM d),
l AS (SELECT doc_id, source, array_to_string(norm, chr(10)) AS whole, unnest(norm) AS line, unnest(sizes) AS size FROM n),
h AS (SELECT source, count(DISTINCT array_to_string(norm, chr(10))) AS host_docs FROM n GROUP BY source),
bad AS (SELECT l.source, l.line FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.line, h.host_docs HAVING count(DISTINCT l.whole) > 8 AND count(DISTINCT l.whole) > h.host_docs * 0.002),
g AS (SELECT l.doc_id, CAST(sum(l.size) AS BIGINT) AS n FROM l JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line GROUP BY l.doc_id),
v AS (SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, coalesce(g.n, 0) AS removed_words FROM b LEFT JOIN rw ON rw.doc_id = b.doc_id LEFT JOIN g ON g.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT removed_words > 0.5 * n_words AS kept FROM v
"""

#: The table of CRC-32 from its rule, and the checksum of an integer's decimal digits.
_CRC_TABLE = "(WITH RECURSIVE c AS (SELECT CAST(range AS UINTEGER) AS b, CAST(range AS UINTEGER) AS v, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UINTEGER)) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8) SELECT list(v ORDER BY b) FROM c WHERE k = 8)"


def _crc32(digits: str, table: str = "crc_table.t") -> str:
    codes = f"list_transform(string_split({digits}, ''), lambda x: CAST(ascii(x) AS UINTEGER))"
    return f"xor(list_reduce({codes}, lambda v, b: xor(v >> 8, {table}[(xor(v, b) & 255) + 1]), CAST(4294967295 AS UINTEGER)), CAST(4294967295 AS UINTEGER))"


OP13 = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
p AS (SELECT sale_id, CAST(floor(epoch_ms(date_trunc('second', sold_at)) / 1000 / 3600.0) AS BIGINT) AS slot, CAST(floor(floor(CAST(100 AS DOUBLE) * total + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE)) AS BIGINT) AS level, 1 + {_crc32("CAST(sale_id AS VARCHAR)")} % 2 AS w FROM sales, crc_table),
c AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM p WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
a AS (SELECT x.slot, x.level, sum(y.n) AS n, sum(y.w) AS w FROM c x JOIN c y ON y.slot <= x.slot AND y.level > x.level GROUP BY x.slot, x.level)
SELECT p.sale_id, p.slot, p.level, CASE WHEN p.slot IS NOT NULL AND p.level IS NOT NULL THEN CAST(coalesce(a.n, 0) AS BIGINT) END AS n_sales, CASE WHEN p.slot IS NOT NULL AND p.level IS NOT NULL THEN CAST(coalesce(a.w, 0) AS BIGINT) END AS n_rows
FROM p LEFT JOIN a ON a.slot = p.slot AND a.level = p.level
"""

def _merkle_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _merkle_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"({_merkle_field(x)})" for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Nodes (g, levels, h, idx, hash) of the trees over a table of leaves (g, pos, n, hash).
_MERKLE_TREE = "SELECT g, CAST(ceil(log2(n)) AS BIGINT) AS levels, 0 AS h, pos AS idx, hash FROM {leaves} UNION ALL SELECT g, levels, h + 1 AS h, idx // 2 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM {tree} WHERE h < levels GROUP BY g, levels, h, idx // 2"

OP11 = f"""
WITH RECURSIVE crc_table AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, lang, {_merkle_leaf("n_chars")} AS hash, {_merkle_leaf("CASE WHEN " + _crc32("CAST(doc_id AS VARCHAR)") + " % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS claim FROM documents, crc_table),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM d)),
l AS (SELECT d.doc_id, g.g, d.hash, d.claim, row_number() OVER (PARTITION BY g.g ORDER BY d.doc_id NULLS FIRST, d.hash) - 1 AS pos, count(*) OVER (PARTITION BY g.g) AS n FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
t AS ({_MERKLE_TREE.format(leaves="l", tree="t")}),
s AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, hash FROM t WHERE h = levels),
u AS ({_MERKLE_TREE.format(leaves="s", tree="u")}),
steps AS (
  SELECT a.g, a.h, a.idx, a.levels, a.idx % 2 AS slot, coalesce(b.hash, '') AS sibling FROM t a LEFT JOIN t b ON b.g = a.g AND b.h = a.h AND b.idx = xor(a.idx, 1) WHERE a.h < a.levels
), upper AS (
  SELECT a.h, a.idx, a.idx % 2 AS slot, coalesce(b.hash, '') AS sibling FROM u a LEFT JOIN u b ON b.h = a.h AND b.idx = xor(a.idx, 1) WHERE a.h < a.levels
), way AS (
  SELECT l.doc_id, l.g, l.pos, s.h AS step, s.slot, s.sibling FROM l JOIN steps s ON s.g = l.g AND s.idx = l.pos >> s.h
  UNION ALL SELECT l.doc_id, l.g, l.pos, 1000 + x.h AS step, x.slot, x.sibling FROM l JOIN upper x ON x.idx = l.g >> x.h
), listed AS (SELECT g, pos, string_agg(sibling, '' ORDER BY step) AS siblings, list(slot || sibling ORDER BY step) AS steps FROM way GROUP BY g, pos),
f AS (SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, (SELECT hash FROM u WHERE h = levels) AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256,
  substr(list_reduce(list_concat(['x' || l.claim], coalesce(w.steps, [])), lambda v, x: 'x' || sha256(CASE WHEN x[1] = '0' THEN substr(v, 2) || substr(x, 2) ELSE substr(x, 2) || substr(v, 2) END)), 2) AS folded_root
  FROM l JOIN s ON s.pos = l.g LEFT JOIN listed w ON w.g = l.g AND w.pos = l.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

ORACLES: dict[str, str] = {"op7_line_dedup": OP7, "op9_quality_rules": OP9, "op8_weighted_mixing": OP8, "op10_decontamination": OP10, "op11_merkle_manifest": OP11, "op13_dominance_counts": OP13}
