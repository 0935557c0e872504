"""Queries of this subpackage, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.langid import language

    return language(_table(spark, sf_dir, "documents"), _vocab("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.linedup import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.substring import substring_digest

    return substring_digest(_table(spark, sf_dir, "documents")).withColumnRenamed("kept", "kept_sha256")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP2_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20
"""


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n_words FROM d),
p AS (SELECT doc_id, unnest(range(1, n_words - 48)) AS i, w FROM n WHERE n_words >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM p),
m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM
  (SELECT h.doc_id, unnest(range(h.i, h.i + 50)) AS j FROM h JOIN m USING (k) WHERE m.least < h.doc_id) GROUP BY doc_id)
SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE
    coalesce((SELECT string_agg(w[j], ' ' ORDER BY j) FROM (SELECT unnest(range(1, n_words + 1)) AS j) WHERE NOT list_contains(gone, j)), '') END) AS kept_sha256
FROM n LEFT JOIN c USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(id, comp) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT t.id, t.comp FROM (SELECT u.a AS id, min(c2.comp) AS comp FROM u JOIN recurring.cc c2 ON c2.id = u.b GROUP BY 1) t
  JOIN recurring.cc o ON o.id = t.id WHERE t.comp < o.comp)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, cc.comp AS component_id, cc.comp = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN cc ON cc.id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_language": op5_language,
        "op6_line_dedup": op6_line_dedup,
        "op7_licenses": op7_licenses,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest_neighbours": OP2_SQL, "op8_substring_dedup": OP8_SQL, "op9_near_duplicates": OP9_SQL}
