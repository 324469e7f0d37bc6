"""Processed tables to a trained, evaluated and saved model, and batch scoring with it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvigrid.operators import forest
from pluvigrid.operators.features import (
    district_codes,
    district_stats,
    drop_missing_june,
    june_lpa,
    season_rows,
    state_codes,
)
from pluvigrid.operators.filters import filter_season
from pluvigrid.functions.fixed_values import TARGET_SEASON
from pluvigrid.session import cut_lineage
from pluvigrid.sources.models import load_model, save_model, write_report
from pluvigrid.sources.processed import read_monthly, read_seasonal


def run_trainer(
    spark: SparkSession,
    processed_folder: str,
    model_folder: str,
    fmt: str = "parquet",
    fold_column: str = "year",
    folds: int = forest.FOLDS,
) -> DataFrame:
    """Train, evaluate and save; returns one row: the evaluation, and how many rows were used and left out.

    ``fold_column`` is ``year`` or ``hash``, see :func:`forest.leave_one_out`, or ``row``: every row is
    judged by forests that have not seen it, see :func:`forest.out_of_bag`.
    """
    seasonal = read_seasonal(spark, processed_folder, fmt)
    monthly = read_monthly(spark, processed_folder, fmt)
    codes = (district_codes(seasonal), state_codes(seasonal))
    # Every fold and every tree level reads the matrix again.
    rows = cut_lineage(season_rows(seasonal, monthly, codes))
    features = drop_missing_june(rows)
    counts = {name: F.lit(n).cast("long") for name, n in forest.training_counts(rows).items()}
    row_wise = fold_column == "row"
    scores = forest.out_of_bag(features) if row_wise else forest.leave_one_out(features, fold_column, folds)
    summary = cut_lineage(forest.cv_summary(scores).withColumns(counts))
    model = forest.train_forest(features)
    save_model(model, forest.model_metadata(summary), *codes, model_folder)
    write_report(forest.feature_importance(model, features), model_folder)
    return summary


def score_with_saved_model(
    requests: DataFrame, processed_folder: str, model_folder: str, fmt: str = "parquet"
) -> DataFrame:
    """Forecasts for a table of requests from the saved model and the processed tables."""
    spark = requests.sparkSession
    saved = load_model(spark, model_folder)
    if saved is None:
        raise FileNotFoundError(f"no model in {model_folder!r}: run run_trainer first")
    seasonal = read_seasonal(spark, processed_folder, fmt)
    return forest.score_requests(
        requests,
        saved.model,
        saved.districts,
        saved.states,
        district_stats(filter_season(seasonal, TARGET_SEASON)),
        june_lpa(read_monthly(spark, processed_folder, fmt)),
        saved.metadata["cv_mean_accuracy"],
    )
