"""Saved models: Spark ML files, code tables, metadata and the importance report."""

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession

from pluvigrid.sources import versions
from pluvigrid.sources.files import exists


class SavedModel(NamedTuple):
    model: PipelineModel
    metadata: Row
    districts: DataFrame
    states: DataFrame


def write_report(importance: DataFrame, folder: str) -> None:
    """Nine rows, one CSV file."""
    importance.coalesce(1).write.mode("overwrite").csv(f"{folder}/importance.csv", header=True)


def save_model(
    model: PipelineModel, metadata: DataFrame, districts: DataFrame, states: DataFrame, folder: str
) -> None:
    """Write all parts of a model as a new version and publish it; until then the old one is loaded."""
    spark, version = districts.sparkSession, versions.staged(folder)
    model.write().save(f"{version}/forest")
    districts.write.parquet(f"{version}/district_codes")
    states.write.parquet(f"{version}/state_codes")
    metadata.write.json(f"{version}/metadata")
    versions.publish(spark, folder, version)
    versions.prune(spark, folder)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One row that describes the model last published."""
    return spark.read.json(f"{versions.location(spark, folder)}/metadata")


def load_model(spark: SparkSession, folder: str) -> SavedModel | None:
    """The model last published, or None if there is none."""
    folder = versions.location(spark, folder)
    if not exists(spark, f"{folder}/forest") or not exists(spark, f"{folder}/metadata"):
        return None
    return SavedModel(
        PipelineModel.load(f"{folder}/forest"),
        spark.read.json(f"{folder}/metadata").first(),
        spark.read.parquet(f"{folder}/district_codes"),
        spark.read.parquet(f"{folder}/state_codes"),
    )
