"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op2_ann
from .extraction import op13_extraction
from .hardneg import op11_negatives
from .importance import op12_importance
from .language import op6_language
from .lines import op4_lines
from .mixing import op3_mixing
from .mtree import op8_mtree
from .neardup import op9_neardup
from .packing import op5_packing
from .pii import op10_pii
from .sharding import op1_sharding
from .suffix import op7_suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_ann": op2_ann,
    "op3_mixing": op3_mixing,
    "op4_lines": op4_lines,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_suffix": op7_suffix,
    "op8_mtree": op8_mtree,
    "op9_neardup": op9_neardup,
    "op10_pii": op10_pii,
    "op11_negatives": op11_negatives,
    "op12_importance": op12_importance,
    "op13_extraction": op13_extraction,
}

PRODUCTS_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([a.q[i] * b.q[i] FOR i IN range(1, least(len(a.q), len(b.q)) + 1)])::BIGINT AS score
 FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum([a.q[i] * b.q[i] FOR i IN range(1, least(len(a.q), len(b.q)) + 1)])::BIGINT AS score
 FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""



def _crc_nibbles() -> list[int]:
    """The checksum's steps of four bits."""
    out = list(range(16))
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


#: The hexadecimal digits of a feature's bytes, the lower one of each byte first, through the steps above.
_CRC_SQL = f"""xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h) + 1), lambda i: instr('123456789ABCDEF', h[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END])::BIGINT),
 lambda a, x: xor(a >> 4, ({_crc_nibbles()}::BIGINT[])[(xor(a, x) & 15) + 1])), 4294967295)"""
_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
IMPORTANCE_SQL = f"""WITH words AS (SELECT 's' AS side, doc_id AS id, {_WORDS_SQL} AS w FROM documents UNION ALL SELECT 't', item_id, {_WORDS_SQL} FROM benchmark),
runs AS (SELECT side, id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f FROM words),
counted AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
buckets AS (SELECT f, {_CRC_SQL} % 10000 AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted))),
per AS (SELECT side, id, b, sum(n) AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t FROM per GROUP BY 1),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, whole),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM per JOIN gains USING (b) WHERE side = 's' GROUP BY 1),
scored AS (SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(len(w), 0) >= 20 AS able, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
 FROM (SELECT *, list_reduce([0::BIGINT] || [instr('123456789abcdef', x)::BIGINT FOR x IN string_split(sha256('42:' || coalesce(id::VARCHAR, ''))[1:8], '')], lambda a, x: a * 16 + x) AS h FROM words WHERE side = 's') LEFT JOIN weights USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 5 * n // 100 THEN r END AS rank FROM ranked"""

NEAR_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

#: The other operators have several right results, or models, or strings of bytes that SQL is too slow for; their
#: queries are tested against brute force, round trips and held-out accuracy instead.
ORACLE_SQL: dict[str, str] = {"op8_mtree": PRODUCTS_SQL, "op9_neardup": NEAR_SQL, "op11_negatives": NEGATIVES_SQL, "op12_importance": IMPORTANCE_SQL}
