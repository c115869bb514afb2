"""The training-data pipeline: five stages over documents, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, near_dedup, quality_rules, substring_dedup
from tracelake.llm._shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words, stays, that with the least id."""
    return near_dedup.keep_one(docs, shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; a document of which nothing is
    left goes. A text that loses nothing stays as it is."""
    done = substring_dedup.remove_repeats(docs)
    cut_down = F.col("n_removed") > 0
    done = done.filter(~cut_down | (F.col("n_removed") < F.col("n_words")))
    done = done.withColumn("n_chars", F.when(cut_down, F.length("kept")).otherwise(F.col("n_chars")).cast("long"))
    return done.withColumn("text", F.when(cut_down, F.col("kept")).otherwise(F.col("text"))).select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim passage of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", contaminated),
    ("byte-level BPE", encoded),
]

#: The near-duplicate stage follows links to their end, which is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
    return docs
