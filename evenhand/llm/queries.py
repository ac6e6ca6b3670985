"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, lm, mixing, neardup, quality, substring, tokencount, topk, toxicity

QUERIES = {
    "op1_lm_scoring": lm.query,
    "op2_byte_bpe": bpe.query,
    "op3_source_mixing": mixing.query,
    "op4_exact_topk": topk.query,
    "op5_chat_formatting": chat.query,
    "op6_toxicity": toxicity.query,
    "op7_ngram_jaccard_join": neardup.query,
    "op8_substring_dedup": substring.query,
    "op9_quality_rules": quality.query,
    "op10_token_counts": tokencount.query,
}

TOPK_SQL = """
WITH raw AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM raw),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {"op4_exact_topk": TOPK_SQL}
