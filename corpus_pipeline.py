"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All stages but the last keep the columns.

Cases, in every stage: an empty table gives an empty one; other columns pass through whatever their names
are; texts are read whole. Null and empty texts are scored by ``quality_filter`` like any text and
go if the score of no features is too low; they are neither cut nor duplicates nor
contaminated, and pack as one piece with the end token alone. Rows that share a doc_id are judged
each by its own text; of rows that agree in both, ``near_dedup`` keeps one. Null doc_ids are
neither cut nor dropped by the deduplicating stages. Ties at the quality threshold stay, of
near-duplicates the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, linedup, minhash, packing, quality
from weftline.llm.common import free_name
from weftline.scratch import Scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose Bradley-Terry score is below the learned quantile."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = free_name(docs, "score")
    scored = quality.score(docs, quality.fit(docs, labels), tuple(docs.columns), name)
    return scored.where(F.col(name) >= 0.7).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts aligned common blocks from later documents; drops documents of which nothing is left."""
    counts = free_name(docs, "lines"), free_name(docs, "removed")
    cut = F.col(counts[1]) > 0
    out = linedup.line_dedup(docs, counts=counts).where(~(cut & (F.trim("text") == "")) | F.col("text").isNull())
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(cut, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates (five-word shingles, 0.8)."""
    return minhash.first_of_group(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_filter", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Patience alignment, minhash and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, scratch.table(out)
        if k:  # what a stage has read is not needed once its result is written
            scratch.drop(before)
