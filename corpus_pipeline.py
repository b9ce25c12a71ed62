"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing to
target weights, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; all but the last return the columns of ``documents``.
``run`` writes every stage's documents as Parquet in the shared folder and
reads them again, so a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import line_dedup, mixing, quality, sentencepiece_bpe, simhash
from skein.session import ensure_checkpoint_dir, scratch_path, ship_package

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars is the length of the text that a stage leaves."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_rules(docs).where("kept").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the documents stay."""
    return _recounted(line_dedup.line_dedup(docs).select(docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return _recounted(mixing.mixed_documents(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, with digests of them and of the text
    that they decode to."""
    coded = sentencepiece_bpe.encode_decode(docs, MODEL, keep=["doc_id", "source"])
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(joined, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def _ready(stage):
    """The stage, with the package made importable on the executors first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", _ready(keep_quality)),
    ("line_dedup", _ready(drop_repeated_lines)),
    ("simhash_near_dedup", _ready(keep_one_of_near_copies)),
    ("source_mixing", _ready(mix_sources)),
    ("sentencepiece", _ready(encode_pieces)),
]

#: SQL has neither XXH64 fingerprints nor SentencePiece; tests/llm compares the
#: stages with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
