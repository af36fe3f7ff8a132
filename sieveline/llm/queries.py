"""The queries of this folder: one per operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_array_dedup

    return suffix_array_dedup(spark, documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import language_model_scores

    return language_model_scores(spark, documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_output

    return token_output(spark, documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end_id=2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark, documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_scan import piece_round_trip

    return piece_round_trip(spark, documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_near_duplicates

    return simhash_near_duplicates(spark, documents(spark, sf_dir))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .nearest import nearest

    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_vectors

    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_lm_scoring, op3_token_output, op4_sentencepiece, op5_simhash, op6_nearest_neighbours, op7_embedding_near_dedup, op8_toxicity, op9_quality, op10_best_fit_packing)}
_VALID = """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

ORACLE_SQL: dict[str, str] = {
    "op6_nearest_neighbours": f"""WITH e AS ({_VALID}), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b, 0.0::DOUBLE) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
}
