"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import alignment, centroids, chat_format, decontaminate, exact_dedup, pieces, sharding, simhash, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which each machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), texts=False)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", chat_format.HARD_TEXT), (-7, 1, "assistant", chat_format.HARD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.turn_digests(turns.unionByName(hard))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.with_verdicts(_read(spark, sf_dir, "pages").select("page_id", "url"), weights).drop("url")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(_read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(_read(spark, sf_dir, "documents"), texts=False)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_exact_dedup, op3_substring_dedup, op4_chat_formatting, op5_sharding, op6_simhash, op7_url_filters, op8_sentencepiece, op9_token_counts, op10_toxicity, op11_alignment, op12_suffix_dedup, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE, "op3_substring_dedup": substring_dedup.ORACLE, "op4_chat_formatting": chat_format.ORACLE, "op12_suffix_dedup": suffix_dedup.ORACLE, "op13_centroids": centroids.ORACLE}
