"""SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from pairlab.llm.quality_rules import GAMMA, RULES


def crc_table() -> list[int]:
    """The 256 remainders of CRC-32, from its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


METRIC_JOIN = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN n ON vec_id = n.a"""

SHARDING = f"""
WITH d AS (
    SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
crc AS (
    SELECT doc_id, len(h) // 2 + 8 AS size, xor(4294967295, list_reduce(
        list_transform(regexp_extract_all(h, '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1),
        lambda c, x: xor(c >> 8, {crc_table()}[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32
    FROM d),
bids AS (
    SELECT doc_id, s.shard, -ln((CAST('0x' || substr(md5(doc_id::VARCHAR || '/' || s.shard), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE) AS bid
    FROM documents, range(25) AS s(shard)),
best AS (
    SELECT doc_id, first(shard ORDER BY bid, shard) FILTER (shard < 24) AS shard, first(shard ORDER BY bid, shard) AS grown_shard
    FROM bids GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM crc JOIN best USING (doc_id)"""


def _level(name: str, columns: str) -> str:
    return f"""
{name} AS (
    SELECT {columns} rule, max(docs) AS docs, {", ".join(f"min(CASE WHEN upto * 4 >= docs * {k} THEN bucket END) AS q{k}" for k in (1, 2, 3))}
    FROM (SELECT *, sum(n) OVER (PARTITION BY {columns} rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {columns} rule) AS docs
          FROM (SELECT {columns} rule, bucket, sum(n) AS n FROM sketch GROUP BY ALL))
    GROUP BY {columns} rule)"""


_RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
}
_LONG = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, n_words, '{r.name}' AS rule, {r.low} AS low_side, {r.spread} AS spread, "
    f"CAST(ceil(ln(greatest({_RATIOS[r.name]}, {r.least}::DOUBLE)) / ln({GAMMA}::DOUBLE)) AS INTEGER) AS bucket FROM m"
    for r in RULES
)
_PICK = ", ".join(
    f"CASE WHEN o.docs >= 200 THEN o.{q} WHEN u.docs >= 200 THEN u.{q} ELSE w.{q} END AS {q}" for q in ("q1", "q2", "q3")
)
QUALITY_RULES = f"""
WITH w AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(3) AS r(j) GROUP BY doc_id),
lines AS (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM w),
m AS (
    SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS ({_LONG}),
sketch AS (SELECT lang, source, rule, bucket, count(*) AS n FROM b WHERE n_words > 0 GROUP BY ALL),
{_level("own", "lang, source,")},
{_level("upper_", "lang,")},
{_level("whole", "")},
picked AS (
    SELECT o.lang, o.source, o.rule, {_PICK} FROM own AS o JOIN upper_ AS u ON o.lang = u.lang AND o.rule = u.rule JOIN whole AS w ON o.rule = w.rule),
beyond AS (
    SELECT DISTINCT doc_id FROM b JOIN picked USING (lang, source, rule)
    WHERE bucket > q2 + 4 * greatest(q2 - q1, spread) OR low_side AND bucket < q2 - 4 * greatest(q3 - q2, spread)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.doc_id IS NULL AS kept
FROM judged AS j LEFT JOIN beyond AS x ON j.doc_id = x.doc_id"""

_FIELDS = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    for c in ("doc_id", "source", "lang", "{n}", "text")
)
_CRC = f"""xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)),
    lambda c, x: xor(c >> 8, {crc_table()}[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)))"""


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels of all trees, and the siblings of every leaf's path with their sides."""
    return f"""
{name}(tree, lvl, idx, n, d) AS (
    SELECT tree, 0, idx, n, d FROM {leaves}
    UNION ALL
    SELECT tree, lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 2),
{name}_path AS (
    SELECT l.tree, l.idx, a.lvl, (l.idx >> a.lvl) & 1 AS slot, coalesce(s.d, '') AS sib
    FROM {leaves} AS l JOIN {name} AS a ON a.tree = l.tree AND a.idx = l.idx >> a.lvl AND a.n > 1
    LEFT JOIN {name} AS s ON s.tree = a.tree AND s.lvl = a.lvl AND s.idx = xor(a.idx, 1))"""


MERKLE = f"""
WITH RECURSIVE h AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIELDS.format(n="n_chars")}) AS leaf,
        CASE WHEN {_CRC} % 7 = 0 THEN sha256({_FIELDS.format(n="(n_chars + 1)")}) END AS changed FROM documents),
p AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS d FROM h),
{_tree("low", "p")},
tops AS (
    SELECT 1 AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, d FROM low WHERE n = 1),
{_tree("high", "tops")},
steps AS (
    SELECT tree, idx, lvl, slot, sib FROM low_path
    UNION ALL SELECT p.tree, p.idx, 100 + h.lvl, h.slot, h.sib FROM p JOIN tops AS t ON t.lang = p.tree JOIN high_path AS h ON h.idx = t.idx),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, idx ORDER BY lvl) AS k FROM steps),
proofs AS (SELECT tree, idx, string_agg(sib, '' ORDER BY k) AS sibs FROM numbered GROUP BY tree, idx),
fold(tree, idx, k, d) AS (
    SELECT tree, idx, CAST(0 AS BIGINT), coalesce(changed, leaf) FROM p
    UNION ALL
    SELECT f.tree, f.idx, f.k + 1, sha256(CASE WHEN s.slot = 1 THEN s.sib || f.d ELSE f.d || s.sib END)
    FROM fold AS f JOIN numbered AS s ON s.tree = f.tree AND s.idx = f.idx AND s.k = f.k + 1),
ends AS (SELECT tree, idx, arg_max(d, k) AS folded_root FROM fold GROUP BY tree, idx)
SELECT p.doc_id, p.leaf, t.d AS subroot, r.d AS root, sha256(coalesce(sibs, '')) AS proof_sha256, folded_root, folded_root = r.d AS verified
FROM p JOIN tops AS t ON t.lang = p.tree JOIN (SELECT d FROM high WHERE n = 1) AS r ON true
JOIN ends AS e ON e.tree = p.tree AND e.idx = p.idx LEFT JOIN proofs AS q ON q.tree = p.tree AND q.idx = p.idx"""

PHRASES = """
WITH pieces AS (
    SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]')) AS p
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS ws FROM pieces),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM w, unnest(range(1, len(ws))) AS u(i) GROUP BY ALL),
f3 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM w, unnest(range(1, len(ws) - 1)) AS u(i) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
two AS (
    SELECT p.lang, p.x, p.y, p.f AS a, a.f AS l, b.f AS r, 1000000 * p.f::HUGEINT * p.f // (a.f::HUGEINT * b.f) AS score
    FROM f2 AS p JOIN f1 AS a ON a.lang = p.lang AND a.x = p.x JOIN f1 AS b ON b.lang = p.lang AND b.x = p.y WHERE p.f >= 10),
three AS (
    SELECT t.*, a.f AS l1, yz.f AS r1, xy.f AS l2, c.f AS r2,
        1000000 * t.f::HUGEINT * t.f // (a.f::HUGEINT * yz.f) AS s1, 1000000 * t.f::HUGEINT * t.f // (xy.f::HUGEINT * c.f) AS s2
    FROM f3 AS t JOIN f1 AS a ON a.lang = t.lang AND a.x = t.x JOIN f1 AS c ON c.lang = t.lang AND c.x = t.z
    JOIN f2 AS xy ON xy.lang = t.lang AND xy.x = t.x AND xy.y = t.y JOIN f2 AS yz ON yz.lang = t.lang AND yz.x = t.y AND yz.y = t.z),
touch AS (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three),
alive AS (
    SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM touch AS t WHERE t.lang = two.lang AND t.x = two.x AND t.y = two.y AND 100 * t.f >= 50 * two.a)),
whole AS (
    SELECT lang, x || ' ' || y AS phrase, a, l, r, score FROM alive
    UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM three)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM whole JOIN n USING (lang) QUALIFY rank <= 2000"""

TOP_PRODUCTS = """
WITH v AS (
    SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""

ORACLES = {"op11_topk": TOP_PRODUCTS, "op13_phrases": PHRASES, "op12_merkle": MERKLE, "op3_metric_join": METRIC_JOIN, "op4_sharding": SHARDING, "op6_quality_rules": QUALITY_RULES}
