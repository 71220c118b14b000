"""A corpus pipeline of five stages. Each takes all that its predecessor kept; all but the last return documents.

1. toxicity: documents scored toxic go. 2. exact dedup: one document of each text stays, the one with the largest id.
3. near-dedup by SimHash: of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the one with
the smallest id stays; links that fingerprints can't show are added by a prefix filter. 4. benchmark decontamination: spans of benchmark windows are cut from the texts; a document of which
nothing is left goes. 5. SentencePiece: ids of each text.

Null and empty texts are one text. Rows with null ids are scored, and one of each text stays if no row with an id has
it. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate as decontamination
from quarry.llm import exact_dedup, pieces, shingle_join, toxicity
from quarry.llm.frames import cut
from quarry.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.drop_near_copies(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("decontamination", cut_benchmark), ("sentencepiece", encode)]

#: No SQL: scores, fingerprints and ids are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage keeps is written to the shared checkpoint folder before the next reads
    it, once or several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) else docs
    return docs
