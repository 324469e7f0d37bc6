import pytest
from pyspark.sql import functions as F

from pluvigrid.checks import catalog
from pluvigrid.functions.fixed_values import FEATURE_COLUMNS
from pluvigrid.operators import features, forest
from pluvigrid.operators.lookup import lookup
from pluvigrid.operators.ordering import label_codes
from pluvigrid.plans.train import run_trainer, score_with_saved_model
from pluvigrid.schemas import SCORE_REQUEST
from pluvigrid.session import cut_lineage
from pluvigrid.sources import models
from tests_support import SF


def seasonal(spark, rows):
    schema = "state_name STRING, district_name STRING, year INT, season STRING, total_rainfall_mm DOUBLE, departure_pct DOUBLE"
    return spark.createDataFrame([(s, n, y, "Kharif", t, d) for s, n, y, t, d in rows], schema)


def monthly(spark, rows):
    schema = "district_name STRING, year INT, month INT, total_rainfall_mm DOUBLE, departure_pct DOUBLE, lpa_mm DOUBLE"
    return spark.createDataFrame([(n, y, 6, t, d, l) for n, y, t, d, l in rows], schema)


@pytest.fixture(scope="module")
def toy(spark):
    seasons = seasonal(spark, [
        ("S", "B", 2019, 400.0, 6.0), ("S", "B", 2020, 600.0, 5.0), ("S", "C", 2019, 300.0, 9.0), ("S", "A", 2019, 1.0, 0.0),
    ])
    june = monthly(spark, [("B", 2019, 100.0, 5.01, 80.0), ("B", 2020, 50.0, -3.0, 80.0), ("C", 2019, 10.0, 0.0, 10.0)])
    return seasons, june


def test_feature_matrix(toy):
    rows = features.feature_matrix(*toy).orderBy("district_name", "year").collect()
    assert [(r["district_name"], r["year"], r["target_above_normal"]) for r in rows] == [
        ("B", 2019, 1), ("B", 2020, 0), ("C", 2019, 1)]
    first, _, single = rows
    assert (first["district_mean_mm"], first["june_vs_district_mean"], first["june_was_above_normal"]) == (500.0, 0.2, 1)
    assert first["district_std_mm"] == pytest.approx(141.4213562)
    # One year has no deviation but the row stays; codes also count A, which has no June.
    assert single["district_std_mm"] is None and single["district_cv"] is None
    assert [r["district_encoded"] for r in rows] == [1, 1, 2]


def test_same_name_in_two_states_fans_out(spark):
    seasons = seasonal(spark, [("S", "A", 2019, 1.0, 0.0), ("T", "A", 2019, 2.0, 0.0)])
    june = monthly(spark, [("A", 2019, 1.0, 0.0, 1.0), ("A", 2019, 2.0, 0.0, 1.0)])
    assert features.feature_matrix(seasons, june).count() == 4


def test_label_codes(spark):
    names = [f"n{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "name STRING").repartition(7)
    codes = {r["name"]: r["code"] for r in label_codes(df, "name", "code").collect()}
    assert codes == {n: i for i, n in enumerate(names)}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "target_above_normal INT")
    weights = {r[0]: r[1] for r in features.balanced_weights(df).collect()}
    assert weights == {1: 2.0, 0: pytest.approx(4 / 6)}
    one_class = features.balanced_weights(df.where("target_above_normal = 0"))
    assert {r[1] for r in one_class.collect()} == {1.0}


def test_june_input_limits(spark):
    df = spark.createDataFrame([(0.0,), (1000.0,), (-0.1,), (1000.1,), (None,)], "june_rainfall_mm DOUBLE")
    errors = [r["input_error"] is None for r in features.validate_june_input(df).collect()]
    assert errors == [True, True, False, False, False]


def test_serving_features_and_fallbacks(spark, toy):
    seasons, june = toy
    requests = spark.createDataFrame(
        [("B", "S", 100.0), ("C", "X", 20.0), ("A", "S", 1.0), ("Z", "S", 50.0)], SCORE_REQUEST)
    looked_up = features.score_lookup(
        requests, features.district_codes(seasons), features.state_codes(seasons),
        features.district_stats(features.kharif_target(seasons)), features.june_lpa(june))
    rows = {r["district_name"]: r for r in features.serving_features(looked_up).collect()}
    assert rows["B"]["june_departure_pct"] == 25.0 and rows["B"]["june_was_above_normal"] == 1
    assert rows["C"]["state_encoded"] == 0 and not rows["C"]["state_known"]
    assert rows["C"]["district_std_mm"] is None
    assert rows["A"]["june_lpa_mm"] == 0.25
    unknown = rows["Z"]
    assert not unknown["district_known"]
    assert [unknown[c] for c in ("district_mean_mm", "district_std_mm", "district_cv", "june_lpa_mm")] == [
        500.0, 100.0, 0.2, 125.0]


@pytest.fixture(scope="module")
def stored(spark):
    return cut_lineage(catalog.matrix(spark, SF))


def test_forest_is_repeatable(stored):
    a, b = (forest.train_forest(stored.repartition(n), trees=10) for n in (2, 5))
    assert a.stages[-1].toDebugString.split("\n", 1)[1] == b.stages[-1].toDebugString.split("\n", 1)[1]


def test_importance(stored):
    rows = forest.feature_importance(forest.train_forest(stored, trees=10), stored).collect()
    assert sorted(r["feature"] for r in rows) == sorted(FEATURE_COLUMNS)
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_missing_deviation_is_scored(stored):
    model = forest.train_forest(stored, trees=5)
    gaps = stored.withColumn("district_std_mm", F.lit(None).cast("double"))
    assert model.transform(gaps).where("prediction in (0, 1)").count() == stored.count()


def test_one_class_training(spark, stored):
    only = stored.withColumn("target_above_normal", F.lit(0))
    scored = forest.train_forest(only, trees=3).transform(stored)
    assert {tuple(r["probability"].toArray()) for r in scored.collect()} == {(1.0, 0.0)}


def test_leave_one_out(stored):
    folds = forest.leave_one_out(stored, trees=5).collect()
    years = [r[0] for r in stored.select("year").distinct().orderBy("year").collect()]
    assert [r["fold"] for r in folds] == [str(y) for y in years]
    assert sum(r["n_rows"] for r in folds) == forest.trainable_rows(stored).count()
    with pytest.raises(ValueError, match="'year' or 'hash'"):
        forest.leave_one_out(stored, fold_column="row")


def test_hashed_folds_hold_out_every_row_once(spark, stored):
    """More rows than there could be folds; same-named districts are dealt by state too."""
    many = stored
    for i in range(5):
        many = many.unionByName(stored.withColumn("state_name", F.concat("state_name", F.lit(f" {i}"))))
    assert forest.trainable_rows(many).count() > 200
    folds = forest.leave_one_out(many, fold_column="hash", folds=4, trees=2).collect()
    assert len(folds) == 4 and sum(r["n_rows"] for r in folds) == forest.trainable_rows(many).count()


def test_cv_summary(spark):
    folds = spark.createDataFrame([(1.0,), (0.5,)], "accuracy DOUBLE")
    row = forest.cv_summary(folds).first()
    assert tuple(row)[:3] == (2, 0.75, 0.25) and row["verdict"].startswith("GOOD") and not row["low_accuracy"]


def test_train_save_and_score(spark, tmp_path):
    processed_folder, _ = catalog._processed(spark, SF)
    model_folder = str(tmp_path / "model")
    assert models.load_model(spark, model_folder) is None
    summary = run_trainer(spark, processed_folder, model_folder).first()
    saved = models.load_model(spark, model_folder)
    assert saved.metadata["cv_mean_accuracy"] == pytest.approx(summary["cv_mean_accuracy"])
    assert list(saved.metadata["feature_columns"]) == list(FEATURE_COLUMNS)
    assert spark.read.csv(f"{model_folder}/importance.csv", header=True).columns == ["feature", "importance"]

    requests = spark.createDataFrame(
        [("Nation_3", "Nowhere", 40.0), ("Atlantis", "Asia", 40.0), ("Nation_3", "Nowhere", 900.0),
         ("Nation_3", "Asia", -500.0), ("Nation_3", "Asia", 9000.0), ("Nation_3", "Asia", None)], SCORE_REQUEST)
    rows = score_with_saved_model(requests, processed_folder, model_folder).collect()
    assert len(rows) == 6
    refused = [r for r in rows if r["state"] == "Asia" and r["district"] == "Nation_3"]
    assert {r["error"] for r in refused} == {"June rainfall must be between 0 and 1000 mm"}
    assert all(r["probability"] is None and r["category"] is None and r["june_departure_pct"] is None for r in refused)
    counts = summary.asDict()
    assert counts["rows_given"] == sum(counts[k] for k in ("rows_without_june", "rows_incomplete", "rows_trained"))
    for row in (r for r in rows if r not in refused):
        if row["district"] == "Atlantis":
            assert row["error"].startswith("District 'Atlantis' was not in training data. Available: ['")
            assert row["probability"] is None and row["advice"] is None
        else:
            assert row["error"] is None and 0 <= row["probability"] <= 100 and not row["state_known"]
            assert row["model_accuracy"] == pytest.approx(summary["cv_mean_accuracy"] * 100, abs=0.051)


def test_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), (None, 3), ("z", 4)], "k STRING, n INT").repartition(6)
    dimension = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "?")], "k STRING, label STRING")
    result = [tuple(r) for r in lookup(rows, dimension, "k").collect()]
    assert sorted(result, key=str) == sorted([("a", 1, "A")] * 50 + [("b", 2, "B"), (None, 3, None), ("z", 4, None)], key=str)
