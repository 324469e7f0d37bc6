"""The season forecast model: Spark ML random forest, evaluation and batch scoring."""

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvigrid.functions.classes import (
    forecast_advice,
    forecast_category,
    forecast_colour,
    low_accuracy,
    score_verdict,
)
from pluvigrid.functions.fixed_values import (
    ABOVE_NORMAL_PCT,
    FEATURE_COLUMNS,
    FOREST_DEPTH,
    FOREST_SEED,
    FOREST_TREES,
    PREDICTOR_MONTH,
    TARGET_SEASON,
)
from pluvigrid.functions.numbers import round_even
from pluvigrid.operators.features import (
    KEYS,
    balanced_weights,
    score_lookup,
    serving_features,
    validate_june_input,
)
from pluvigrid.operators.filters import not_null_values

_PARALLEL_FITS = 4
FOLDS = 10
REPLICAS = 10
# Chances that a row is drawn at most 0, 1, 2, ... times, as often as rows are, one by one.
DRAWN = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
ROWS_PER_PARTITION = 20_000
# Both classes are declared, so training data with only one of them still fits.
_TWO_CLASSES = {"ml_attr": {"type": "nominal", "name": "label", "vals": ["0", "1"]}}


def _assembler(handle_invalid: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="features", handleInvalid=handle_invalid)


def trainable_rows(features: DataFrame) -> DataFrame:
    """Rows without a missing input; a district with one year has no deviation."""
    return not_null_values(features, *FEATURE_COLUMNS)


def train_forest(
    features: DataFrame, trees: int = FOREST_TREES, seed: int = FOREST_SEED, times: str | None = None
) -> PipelineModel:
    """Class weights come from the given rows, so each fold has its own; a row counts ``times`` a row.

    Rows are placed by key and sorted, because the forest's sampling depends on how
    rows are laid out: the same rows give the same forest on any cluster.
    """
    rows = trainable_rows(features)
    parts = rows.count() // ROWS_PER_PARTITION + 1
    weighted = balanced_weights(rows, times=F.col(times) if times else None).withColumn(
        "label", F.col("target_above_normal").cast("double").alias("label", metadata=_TWO_CLASSES)
    )
    if times:
        weighted = weighted.withColumn("class_weight", F.col("class_weight") * F.col(times))
    laid_out = weighted.repartition(parts, *KEYS).sortWithinPartitions(*KEYS)
    vectors = _assembler("error").transform(laid_out).select("features", "label", "class_weight")
    forest = RandomForestClassifier(
        numTrees=trees,
        maxDepth=FOREST_DEPTH,
        seed=seed,
        weightCol="class_weight",
        featureSubsetStrategy="sqrt",
        maxBins=64,
    )
    # When scoring, a missing input must not drop the request.
    return PipelineModel([_assembler("keep"), forest.fit(vectors)])


def hashed_unit(*values: Column) -> Column:
    """A number in [0, 1) from the values' texts, the same in every engine that has MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *(v.cast("string") for v in values))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 2.0**32


def dealt_to(parts: int) -> Column:
    """The part, 0 to ``parts`` - 1, to which a row is dealt by its keys."""
    return F.floor(hashed_unit(*map(F.col, KEYS)) * parts).cast("int")


def leave_one_out(
    features: DataFrame, fold_column: str = "year", folds: int = FOLDS, trees: int = FOREST_TREES
) -> DataFrame:
    """Accuracy on each held-out fold, a few distributed fits at a time.

    ``fold_column="year"`` holds out one year at a time. ``"hash"`` deals single rows into
    ``folds`` folds by a hash of district, state and year. Either way every row is held
    out exactly once.
    """
    spark = features.sparkSession
    rows = trainable_rows(features)
    if fold_column == "hash":
        rows = rows.withColumn("hash", dealt_to(folds))
    elif fold_column != "year":
        raise ValueError(f"folds are by 'year' or 'hash', not {fold_column!r}")
    held = [r[0] for r in rows.select(fold_column).distinct().orderBy(fold_column).collect()]

    def evaluate(fold):
        held_out = F.col(fold_column) == F.lit(fold)
        model = train_forest(rows.where(~held_out), trees)
        correct = F.col("prediction") == F.col("target_above_normal")
        scored = model.transform(rows.where(held_out))
        n, right = scored.agg(F.count(F.lit(1)), F.count(F.when(correct, 1))).first()
        return str(fold), n, right, right / n

    with ThreadPoolExecutor(_PARALLEL_FITS) as pool:
        scores = list(pool.map(evaluate, held))
    return spark.createDataFrame(scores, "fold STRING, n_rows BIGINT, n_correct BIGINT, accuracy DOUBLE")


def times_drawn(replica: int, replicas: int) -> Column:
    """How often a replica of the rows holds a row: Poisson of mean one by hash, and never if the row is dealt to it."""
    chance = hashed_unit(*map(F.col, KEYS), F.lit(replica))
    drawn = F.lit(len(DRAWN))
    for k in range(len(DRAWN) - 1, -1, -1):
        drawn = F.when(chance < DRAWN[k], k).otherwise(drawn)
    return F.when(dealt_to(replicas) == replica, 0).otherwise(drawn)


def out_of_bag(features: DataFrame, replicas: int = REPLICAS, trees: int = FOREST_TREES) -> DataFrame:
    """Every row judged by forests that have not seen it, at a fixed number of fits.

    ``replicas`` forests share the ``trees``, each fitted to its own replica of the rows
    (:func:`times_drawn`). A row is judged by those whose replica does not hold it, at least by the one it is dealt to:
    the mean of their chances decides. Rows are scored in one pass, without a shuffle. Adds
    ``n_judges``, ``chance``, ``prediction`` and ``accuracy``, 1 if that is right, to the trainable rows; :func:`cv_summary` of it
    is the row-wise hold-out.
    """
    rows = trainable_rows(features)
    held = {r: f"__times_{r}" for r in range(replicas)}
    drawn = rows.withColumns({name: times_drawn(r, replicas) for r, name in held.items()})

    def fitted(replica):
        bag = drawn.where(F.col(held[replica]) > 0)
        return train_forest(bag, max(trees // replicas, 1), FOREST_SEED + replica, held[replica])

    with ThreadPoolExecutor(_PARALLEL_FITS) as pool:
        models = list(pool.map(fitted, held))
    judged = models[0].stages[0].transform(drawn)
    votes, judges = F.lit(0.0), F.lit(0)
    for replica, model in enumerate(models):
        # Only the chance is wanted.
        forest = model.stages[-1].setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"__chance_{replica}")
        judged = forest.transform(judged)
        unseen = F.col(held[replica]) == 0
        votes = votes + F.when(unseen, vector_to_array(f"__chance_{replica}")[1]).otherwise(0.0)
        judges = judges + F.when(unseen, 1).otherwise(0)
    decided = judged.withColumns({"n_judges": judges, "chance": votes / judges})
    prediction = F.when(F.col("chance") > 0.5, 1).otherwise(0)
    return decided.withColumn("prediction", prediction).select(
        *rows.columns, "n_judges", "chance", "prediction",
        (F.col("prediction") == F.col("target_above_normal")).cast("double").alias("accuracy"),
    )


def training_counts(season_rows: DataFrame) -> dict[str, int]:
    """Rows given, dropped for want of June, skipped for another missing input, and trained on."""
    has_june = F.col("june_rainfall_mm").isNotNull() & F.col("june_departure_pct").isNotNull()
    complete = has_june
    for column in FEATURE_COLUMNS:
        complete = complete & F.col(column).isNotNull()
    given, with_june, trained = season_rows.agg(
        F.count(F.lit(1)), F.count(F.when(has_june, 1)), F.count(F.when(complete, 1))
    ).first()
    return {
        "rows_given": given,
        "rows_without_june": given - with_june,
        "rows_incomplete": with_june - trained,
        "rows_trained": trained,
    }


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold accuracies, with the verdict."""
    return folds.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("accuracy").alias("cv_mean_accuracy"),
        F.stddev_pop("accuracy").alias("cv_std_accuracy"),
    ).withColumns(
        {
            "verdict": score_verdict(F.col("cv_mean_accuracy")),
            "low_accuracy": low_accuracy(F.col("cv_mean_accuracy")),
        }
    )


def feature_importance(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Importance of each input, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(FEATURE_COLUMNS, values)]
    return features.sparkSession.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(
        F.desc("importance"), "feature"
    )


def model_metadata(cv: DataFrame) -> DataFrame:
    """One row that describes a model; known names are stored as code tables beside it."""
    return cv.select(
        F.array(*(F.lit(c) for c in FEATURE_COLUMNS)).alias("feature_columns"),
        F.lit(ABOVE_NORMAL_PCT).alias("above_normal_threshold"),
        F.lit(PREDICTOR_MONTH).alias("predictor_month"),
        F.lit(TARGET_SEASON).alias("target_season"),
        "cv_mean_accuracy",
        "cv_std_accuracy",
    )


# Columns of a forecast.
FORECAST = (
    "district", "state", "june_rainfall_mm", "june_departure_pct", "probability", "category", "colour", "advice",
    "model_accuracy", "state_known", "error",
)


def score_requests(
    requests: DataFrame,
    model: PipelineModel,
    districts: DataFrame,
    states: DataFrame,
    stats: DataFrame,
    lpa: DataFrame,
    cv_mean_accuracy: float,
) -> DataFrame:
    """Forecast for every request; an unknown district or an impossible June total gets an ``error`` instead.

    All other columns of a request come back with its forecast, in front; one named like a result is replaced.
    """
    some = [r[0] for r in districts.where(F.col("district_encoded") < 5).orderBy("district_encoded").collect()]
    asked = ("district_name", "state_name", "june_rainfall_mm")
    carried = [c for c in requests.columns if c not in (*asked, *FORECAST)]
    # Packed, so that no name clashes with those of the model's columns.
    packed = requests.select(*asked, F.struct(F.lit(0), *(F.col(f"`{c}`") for c in carried)).alias("__request"))
    found = validate_june_input(score_lookup(packed, districts, states, stats, lpa))
    scored = model.transform(serving_features(found))
    chance = vector_to_array("probability")[1]
    unknown = F.concat(
        F.lit("District '"), F.col("district_name"), F.lit(f"' was not in training data. Available: {some}...")
    )
    error = F.when(~F.col("district_known"), unknown).otherwise(F.col("input_error"))
    only_known = lambda value: F.when(error.isNull(), value)
    return scored.withColumn("chance", chance).select(
        *(F.col("__request")[c].alias(c) for c in carried),
        F.col("district_name").alias("district"),
        F.col("state_name").alias("state"),
        "june_rainfall_mm",
        only_known(round_even(F.col("june_departure_pct"), 2)).alias("june_departure_pct"),
        only_known(round_even(F.col("chance") * 100, 1)).alias("probability"),
        only_known(forecast_category(F.col("chance"))).alias("category"),
        only_known(forecast_colour(F.col("chance"))).alias("colour"),
        only_known(forecast_advice(F.col("chance"))).alias("advice"),
        only_known(round_even(F.lit(cv_mean_accuracy * 100), 1)).alias("model_accuracy"),
        "state_known",
        error.alias("error"),
    )
