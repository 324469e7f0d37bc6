"""Registered queries of the subpackage: ``name -> (spark, sf_dir) -> DataFrame``, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pluvigrid.llm import (
    alignment, bpe, merkle, minhash, packing, quality, secret_scan, sharding, simhash, sql, substrings, token_counts, topk, toxicity,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark, sf_dir):
    return minhash.groups(documents(spark, sf_dir), size=4)


def op2_substring_dedup(spark, sf_dir):
    return substrings.removals(documents(spark, sf_dir))


def op3_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir))


def op4_sharding(spark, sf_dir):
    return sharding.assignment(documents(spark, sf_dir))


def op5_packing(spark, sf_dir):
    return packing.pieces(documents(spark, sf_dir))


def op6_secret_scan(spark, sf_dir):
    return secret_scan.report(documents(spark, sf_dir))


def op7_quality_rules(spark, sf_dir):
    return quality.rules(documents(spark, sf_dir))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


def op9_topk(spark, sf_dir):
    return topk.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_toxicity(spark, sf_dir):
    return toxicity.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_merkle(spark, sf_dir):
    return merkle.report(documents(spark, sf_dir))


def op12_alignment(spark, sf_dir):
    return alignment.report(documents(spark, sf_dir))


def op13_simhash(spark, sf_dir):
    return simhash.groups(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash, op2_substring_dedup, op3_bpe, op4_sharding, op5_packing,
        op6_secret_scan, op7_quality_rules, op8_token_counts, op9_topk, op10_toxicity,
        op11_merkle, op12_alignment, op13_simhash,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": sql.op1(), "op2_substring_dedup": sql.op2(), "op6_secret_scan": sql.op6(),
        "op7_quality_rules": sql.op7(), "op9_topk": sql.op9(), "op11_merkle": sql.op11(),
    }
