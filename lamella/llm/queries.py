"""The queries of this subpackage and the SQL that expresses some of them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .bpe_stream import op4_bpe_stream
from .cover import op7_near_vectors
from .language import op5_language
from .packing import op10_packing
from .pii import op1_pii
from .sharding import op8_sharding
from .simhash import op3_simhash
from .token_files import op2_token_files
from .topk import op6_top_k
from .toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_token_files": op2_token_files,
        "op3_simhash": op3_simhash,
        "op4_bpe_stream": op4_bpe_stream,
        "op5_language": op5_language,
        "op6_top_k": op6_top_k,
        "op7_near_vectors": op7_near_vectors,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op6_top_k": TOP_K}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


TOP_K = """
WITH parts AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
whole AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
