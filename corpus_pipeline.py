"""From raw documents to packed training sequences, stage by stage.

Each stage gets the documents that its predecessor kept, as written to the shared folder, and
returns documents of the same columns; the last returns pieces of packed sequences. Texts that
a stage does not change stay as they are; ``n_chars`` follows changed texts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvigrid.llm import frames, minhash, packing, secret_scan, substrings, toxicity
from pluvigrid.sources.files import remove


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below a half."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five words, similarity 0.8)."""
    return minhash.deduplicate(docs)


def cut_copied_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that occur earlier; one may end up empty."""
    return _recounted(substrings.deduplicate(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return _recounted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_copied_passages),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# Classifier, similarity groups and tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once a stage's result is written, its working tables and the result before it are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = frames.shared_path(spark, name)
        with frames.working_tables(spark):
            docs = frames.stored(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
