"""The operators' queries, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontam import op3_decontam
from .langid import op7_langid
from .sharding import op1_sharding
from .simhash import op9_simhash
from .suffix import op2_suffix
from .tokenfile import op5_tokenfile
from .topk import op6_topk
from .toxicity import op10_toxicity
from .wrappers import op8_wrappers

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix": op2_suffix,
    "op3_decontam": op3_decontam,
    "op4_bpe": op4_bpe,
    "op5_tokenfile": op5_tokenfile,
    "op6_topk": op6_topk,
    "op7_langid": op7_langid,
    "op8_wrappers": op8_wrappers,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}

# Bytes are pairs of hex digits. A string of 200 bytes is repeated if its digits occur again; a
# byte goes if one of the 200 strings that cover it is repeated.
_OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, x, unnest(range(CAST(length(x) // 2 AS BIGINT))) AS i FROM d),
s AS (SELECT r, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 400 <= length(x) THEN md5_number(substr(x, 2 * i + 1, 400)) END AS string FROM p),
n AS (SELECT r, i, byte, CAST(string IS NOT NULL AND count(*) OVER (PARTITION BY string) > 1 AS INTEGER) AS again FROM s),
c AS (SELECT r, i, byte, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM n),
g AS (SELECT r, i, byte, gone, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS opens FROM c),
k AS (SELECT r, count(*) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(opens) AS BIGINT) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS left_over FROM g GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

_OP6_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""

# The test pages' text is that of their one article, in which only p and h1 end a block.
_OP8_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda t: regexp_replace(replace(t, '<br>', ' '), '<[^>]*>', '', 'g')) AS blocks FROM a),
c AS (SELECT page_id, url, list_transform(blocks, lambda t: trim(regexp_replace(replace(regexp_replace(t, '&quot;', '"', 'g'), '&amp;', '&'), '[\s\x0b\x85\xa0\x1c-\x1f\x{2000}-\x{200a}\x{3000}]+', ' ', 'g'))) AS blocks FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda t: t <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

ORACLES: dict[str, str] = {"op2_suffix": _OP2_SQL, "op6_topk": _OP6_SQL, "op8_wrappers": _OP8_SQL}
