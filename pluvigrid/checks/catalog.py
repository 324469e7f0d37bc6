"""Every registered query: ``name -> (spark, sf_dir) -> DataFrame``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvigrid.checks.derived import raw_readings, requests, table, write_csv_folder
from pluvigrid.functions import calendar, classes, numbers, text
from pluvigrid.functions.fixed_values import FEATURE_COLUMNS, TABLE_NAMES
from pluvigrid.operators import departure, features, filters, forest, gapfill, quality, reports, rollup
from pluvigrid.operators.cleaning import clean_daily, rename_columns, require_columns, standardise
from pluvigrid.plans.process import output_row_counts, process_frame, process_readings
from pluvigrid.plans.train import run_trainer, score_with_saved_model
from pluvigrid.session import cut_lineage, shared_path
from pluvigrid.sources import models, processed, readings

POINT_DISTRICT = "Nation_3"
PREVIEW = (
    "district_name", "year", "month", "total_rainfall_mm", "lpa_mm", "departure_pct", "anomaly_category",
)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """For results that still depend on the order of addition."""
    return df.withColumns({c: numbers.round_even(F.col(c), digits) for c in columns})


# Tables of the chain, each built from the raw test tables.


def daily(spark: SparkSession, sf: str, keep_raw: bool = False) -> DataFrame:
    return clean_daily(raw_readings(spark, sf), keep_raw=keep_raw)


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.monthly_totals(daily(spark, sf))


def seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.rounded_totals(rollup.seasonal_units(rollup.monthly_units(daily(spark, sf))))


def monthly_dep(spark: SparkSession, sf: str) -> DataFrame:
    return departure.monthly_departure(monthly(spark, sf))


def seasonal_dep(spark: SparkSession, sf: str) -> DataFrame:
    return departure.flag_above_normal(departure.seasonal_departure(seasonal(spark, sf)))


def probability(spark: SparkSession, sf: str) -> DataFrame:
    return departure.above_normal_probability(seasonal_dep(spark, sf))


def kharif(spark: SparkSession, sf: str) -> DataFrame:
    return features.kharif_target(seasonal_dep(spark, sf))


def stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Monthly and seasonal tables for queries that read them several times.

    As in the real job, month totals are stored once and all else starts from them.
    """
    months = cut_lineage(rollup.monthly_units(daily(spark, sf)))
    seasons = departure.seasonal_departure(rollup.rounded_totals(rollup.seasonal_units(months)))
    return departure.monthly_departure(rollup.rounded_totals(months)), departure.flag_above_normal(seasons)


def joined(spark: SparkSession, sf: str) -> DataFrame:
    months, seasons = stored(spark, sf)
    return features.june_features_join(features.kharif_target(seasons), features.june_rows(months))


def joined_with_stats(spark: SparkSession, sf: str) -> DataFrame:
    months, seasons = stored(spark, sf)
    target = features.kharif_target(seasons)
    rows = features.june_features_join(target, features.june_rows(months))
    return features.district_stats_join(rows, features.district_stats(target))


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    months, seasons = stored(spark, sf)
    return features.feature_matrix(seasons, months)


def districts(seasons: DataFrame) -> DataFrame:
    return seasons.select("district_name").distinct()


def found(spark: SparkSession, sf: str) -> DataFrame:
    months, seasons = stored(spark, sf)
    return features.score_lookup(
        requests(spark, sf),
        features.district_codes(seasons),
        features.state_codes(seasons),
        features.district_stats(features.kharif_target(seasons)),
        features.june_lpa(months),
    )


# Sources and sinks


def _read_back(spark, sf):
    return readings.read_daily_csv(spark, write_csv_folder(spark, sf))


def _read_daily_csv(spark, sf):
    rows = _read_back(spark, sf)
    return rows.select(
        F.col("Date").cast("date").alias("Date"), "State", "District",
        F.col("Avg_rainfall").cast("double").alias("Avg_rainfall"), "Note",
    )


def _require_inputs(spark, sf):
    paths = readings.require_inputs(spark, write_csv_folder(spark, sf))
    return spark.createDataFrame([(p,) for p in paths], "path STRING")


def _source_file(spark, sf):
    return _read_back(spark, sf).select("Date", "District", "source_file")


def _file_row_counts(spark, sf):
    return readings.file_row_counts(_read_back(spark, sf))


def _file_rows_by_header(spark, sf):
    """Counts of files with and without ``Note``, from the counts per file."""
    rows = _read_back(spark, sf)
    counts = readings.file_row_counts(rows)
    noted = rows.groupBy("source_file").agg(F.bool_or(F.col("Note").isNotNull()).alias("with_note"))
    return counts.join(noted, "source_file").groupBy("with_note").agg(F.sum("n_rows").alias("n_rows"))


def _union_by_name(spark, sf):
    shipped = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("flag"))
        .agg(F.count(F.lit(1)).alias("amount"))
    )
    ordered = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("priority"))
        .agg(numbers.round_even(F.sum("o_totalprice"), 2).alias("amount"))
    )
    return readings.union_by_name(shipped, ordered)


def _processed(spark, sf):
    folder = shared_path(spark, "processed")
    summary = process_frame(raw_readings(spark, sf), folder)
    return folder, summary


def _read_seasonal(spark, sf):
    return processed.read_seasonal(spark, _processed(spark, sf)[0])


def _read_monthly(spark, sf):
    return processed.read_monthly(spark, _processed(spark, sf)[0])


def _process_daily(spark, sf):
    """The daily table as the job writes it."""
    return processed.read_table(spark, _processed(spark, sf)[0], "daily")


def _load_processed(spark, sf):
    return processed.load_processed(spark, _processed(spark, sf)[0])["probability"]


def _process_summary(spark, sf):
    """What the job reports, as one row."""
    summary = _processed(spark, sf)[1]
    row = {
        "n_rows": summary.rows["daily"], "rejected": summary.rejected,
        "missing_before": summary.missing_before, "missing_after": summary.missing_after, **summary.coverage,
    }
    return spark.createDataFrame(
        [tuple(row.values())],
        "n_rows BIGINT, rejected BIGINT, missing_before BIGINT, missing_after BIGINT, first_date DATE, "
        "last_date DATE, n_districts BIGINT, n_states BIGINT, n_years BIGINT",
    )


def _output_row_counts(spark, sf):
    return output_row_counts(spark, {TABLE_NAMES[k]: n for k, n in _processed(spark, sf)[1].rows.items()})


def _write_outputs(spark, sf):
    """Written as CSV and counted from the files."""
    folder = shared_path(spark, "processed-csv")
    tables = (daily(spark, sf), monthly_dep(spark, sf), seasonal_dep(spark, sf), probability(spark, sf))
    processed.write_outputs(*tables, folder, fmt="csv")
    counts = [
        processed.read_table(spark, folder, key, "csv").agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows")
        for key, name in TABLE_NAMES.items()
    ]
    return readings.union_by_name(*counts)


def _process_readings(spark, sf):
    folder = shared_path(spark, "processed")
    process_readings(spark, write_csv_folder(spark, sf), folder)
    return processed.read_table(spark, folder, "seasonal")


def _departure_matrix(spark, sf):
    """The matrix over all years of the data, one row per cell."""
    months = cut_lineage(monthly_dep(spark, sf))
    years = reports.departure_years(months)
    matrix = reports.departure_matrix(months, years)
    keys = ["district_name", "month", "month_label"]
    cells = matrix.unpivot(keys, [f"`{y}`" for y in map(str, years)], "year", "departure_pct")
    return cells.where("departure_pct is not null")


# Rows and lookups


def _drop_missing_june(spark, sf):
    return features.drop_missing_june(joined(spark, sf)).drop("target_above_normal")


def _codes_shown(df):
    """-1 for unknown, as comparing tools differ in how they show a missing integer."""
    return df.fillna(-1, subset=[c for c in ("district_encoded", "state_encoded") if c in df.columns])


def _known_district(spark, sf):
    codes = features.district_codes(seasonal_dep(spark, sf))
    return _codes_shown(features.known_district(requests(spark, sf), codes))


def _default_values(spark, sf):
    ready = features.default_values(found(spark, sf))
    return _codes_shown(ready)


def _score_lookup(spark, sf):
    return _codes_shown(found(spark, sf))


def _probability_lookup(spark, sf):
    looked_up = reports.probability_lookup(requests(spark, sf), probability(spark, sf))
    return looked_up.fillna(0, subset=["years_above_normal", "total_years"])


def _serving_features(spark, sf):
    ready = features.serving_features(found(spark, sf))
    return _codes_shown(ready).select("request_id", *FEATURE_COLUMNS)


def _monthly_lpa_join(spark, sf):
    totals = monthly(spark, sf)
    return departure.attach_lpa(totals, departure.monthly_lpa(totals))


def _seasonal_lpa_join(spark, sf):
    totals = seasonal(spark, sf)
    return departure.attach_lpa(totals, departure.seasonal_lpa(totals))


def _customer_share(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("chance"))


def _advice_lookup(spark, sf):
    return reports.advice_lookup(_customer_share(spark, sf), "chance")


# Windows


def _interpolate_linear(spark, sf):
    filled = gapfill.fill_gaps(standardise(raw_readings(spark, sf)), edges="trailing")
    return filled.select("date", "district_name", "rainfall_mm")


def _fill_edges(spark, sf):
    filled = gapfill.fill_gaps(standardise(raw_readings(spark, sf)))
    return filled.select("date", "district_name", "rainfall_mm")


# Scalar functions over whole tables


def _on_orders(name, expression):
    def query(spark, sf):
        orders = table(spark, sf, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
        return orders.select("o_orderkey", expression(F.col("date")).alias(name))

    return query


def _parse_date(date):
    return calendar.parse_date_strict(F.date_format(date, "yyyy-M-d"))


def _season_year(date):
    month = F.month(date)
    return calendar.season_year(F.year(date), month, calendar.assign_season(month))


def _year_month(spark, sf):
    date = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", F.year(date).alias("year"), F.month(date).alias("month"))


def _on_customers(name, expression):
    def query(spark, sf):
        return table(spark, sf, "customer").select("c_custkey", expression(F.col("c_acctbal")).alias(name))

    return query


def _on_lines(**expressions):
    def query(spark, sf):
        keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        columns = [expression().alias(name) for name, expression in expressions.items()]
        return table(spark, sf, "lineitem").select(*keys, *columns)

    return query


def _clean_name(spark, sf):
    messy = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("-"), F.col("c_name"), F.lit("\t"))
    return table(spark, sf, "customer").select("c_custkey", text.clean_name(messy).alias("name"))


def _probability_band(spark, sf):
    chance = F.col("chance")
    return _customer_share(spark, sf).select(
        "c_custkey",
        classes.forecast_category(chance).alias("category"),
        classes.forecast_colour(chance).alias("forecast_colour"),
        classes.outlook_colour(chance * 100).alias("outlook_colour"),
        classes.outlook_title(chance * 100).alias("outlook_title"),
    )


def _all_features(spark, sf):
    return features.june_signals(joined_with_stats(spark, sf))


def _vs_lpa_flag(spark, sf):
    flag = classes.vs_lpa(F.col("total_rainfall_mm"), F.col("lpa_mm"))
    return seasonal_dep(spark, sf).select("district_name", "state_name", "year", "season", flag.alias("vs_lpa"))


def _departure_sign_band(spark, sf):
    value = F.col("departure_pct")
    return seasonal_dep(spark, sf).select(
        "district_name", "state_name", "year", "season",
        classes.departure_colour(value).alias("colour"), classes.departure_text(value).alias("departure_text"),
    )


def _advice_text(spark, sf):
    _, seasons = stored(spark, sf)
    advice = reports.advice_points(districts(seasons), departure.above_normal_probability(seasons))
    return advice.withColumn("points", F.array_join("points", " | "))


def _cv_summary(spark, sf):
    """Share of open orders per year stands in for fold accuracies."""
    right = F.count(F.when(F.col("o_orderstatus") != "F", 1))
    folds = (
        table(spark, sf, "orders")
        .groupBy(F.year("o_orderdate").cast("string").alias("fold"))
        .agg(F.count(F.lit(1)).alias("n_rows"), right.alias("n_correct"))
        .withColumn("accuracy", F.col("n_correct") / F.col("n_rows"))
    )
    return _rounded(forest.cv_summary(folds), 9, "cv_mean_accuracy", "cv_std_accuracy")


# Model


def _stored_matrix(spark, sf):
    return cut_lineage(matrix(spark, sf))


def _train_forest(spark, sf):
    rows = _stored_matrix(spark, sf)
    scored = forest.train_forest(rows).transform(rows)
    return scored.select("district_name", "state_name", "year", "target_above_normal", "prediction")


def _leave_one_out(spark, sf):
    return forest.leave_one_out(_stored_matrix(spark, sf))


def _out_of_bag(spark, sf):
    return forest.out_of_bag(_stored_matrix(spark, sf))


def _importance_checks(importance):
    """What holds whatever the forest: nine shares of one."""
    return importance.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.round(F.sum("importance"), 9).alias("total"),
        F.bool_and(F.col("importance").between(0, 1)).alias("all_shares"),
    )


def _save_load_checks(spark, sf):
    """Rows on which the model says the same before and after storage, and all rows."""
    rows = _stored_matrix(spark, sf)
    months, seasons = stored(spark, sf)
    codes = (features.district_codes(seasons), features.state_codes(seasons))
    model = forest.train_forest(rows)
    folder = shared_path(spark, "model")
    in_sample = model.transform(rows).select((F.col("prediction") == F.col("target_above_normal")).cast("double").alias("accuracy"))
    models.save_model(model, forest.model_metadata(forest.cv_summary(in_sample)), *codes, folder)
    again = models.load_model(spark, folder).model.stages[-1].setPredictionCol("again").setProbabilityCol("").setRawPredictionCol("")
    both = again.transform(model.transform(rows))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("prediction") == F.col("again"), 1)).alias("n_same")
    )


def _score_checks(spark, sf):
    """Per request: whether it has a forecast, and whether its numbers are in range."""
    return _score_requests(spark, sf).select(
        "request_id",
        F.col("category").isNotNull().alias("answered"),
        F.coalesce(F.col("probability").between(0, 100) & F.col("model_accuracy").between(0, 100), F.col("error").isNotNull()).alias("in_range"),
    )


def _feature_importance(spark, sf):
    rows = _stored_matrix(spark, sf)
    return forest.feature_importance(forest.train_forest(rows), rows)


def _trained(spark, sf):
    processed_folder, _ = _processed(spark, sf)
    model_folder = shared_path(spark, "model")
    summary = run_trainer(spark, processed_folder, model_folder)
    return processed_folder, model_folder, summary


def _run_trainer(spark, sf):
    return _trained(spark, sf)[2]


def _model_metadata(spark, sf):
    return models.read_metadata(spark, _trained(spark, sf)[1])


def _write_report(spark, sf):
    rows = _stored_matrix(spark, sf)
    folder = shared_path(spark, "model")
    models.write_report(forest.feature_importance(forest.train_forest(rows), rows), folder)
    return spark.read.csv(f"{folder}/importance.csv", header=True, schema="feature STRING, importance DOUBLE")


def _save_load_model(spark, sf):
    """Predictions of the model after a round trip through storage."""
    months, seasons = stored(spark, sf)
    codes = (features.district_codes(seasons), features.state_codes(seasons))
    rows = cut_lineage(features.feature_matrix(seasons, months, codes))
    folder = shared_path(spark, "model")
    model = forest.train_forest(rows)
    in_sample = model.transform(rows).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("prediction") == F.col("target_above_normal"), 1)).alias("n_correct"),
        F.avg((F.col("prediction") == F.col("target_above_normal")).cast("double")).alias("accuracy"),
    )
    summary = forest.cv_summary(in_sample)
    models.save_model(model, forest.model_metadata(summary), *codes, folder)
    return models.load_model(spark, folder).model.transform(rows).select(
        "district_name", "state_name", "year", "target_above_normal", "prediction"
    )


def _score_requests(spark, sf):
    processed_folder, model_folder, _ = _trained(spark, sf)
    return score_with_saved_model(requests(spark, sf), processed_folder, model_folder)


def _overview_with_forecast(spark, sf):
    """Every district at its suggested June total."""
    processed_folder, model_folder, _ = _trained(spark, sf)
    tables = processed.load_processed(spark, processed_folder)
    asked = reports.input_defaults(tables["seasonal"], features.june_lpa(tables["monthly"])).select(
        "district_name", "state_name", F.col("june_default_mm").alias("june_rainfall_mm")
    )
    scores = score_with_saved_model(asked, processed_folder, model_folder)
    return reports.district_overview(tables["seasonal"], tables["probability"], scores)


def _district_overview(spark, sf):
    _, seasons = stored(spark, sf)
    cards = reports.district_overview(seasons, departure.above_normal_probability(seasons))
    return cards.drop(*reports.MODEL_COLUMNS)


def _farmer_advice(spark, sf):
    _, seasons = stored(spark, sf)
    return reports.farmer_advice(districts(seasons), departure.above_normal_probability(seasons))


def _input_defaults(spark, sf):
    months, seasons = stored(spark, sf)
    return reports.input_defaults(seasons, features.june_lpa(months))


def queries():
    month_of = lambda date: F.month(date)
    return {
        # Sources and sinks
        "read_daily_csv": _read_daily_csv,
        "require_inputs": _require_inputs,
        "source_file": _source_file,
        "file_basename": lambda s, d: _source_file(s, d).select("source_file").distinct(),
        "file_row_counts": _file_row_counts,
        "union_by_name": _union_by_name,
        "read_seasonal": _read_seasonal,
        "read_monthly": _read_monthly,
        "load_processed": _load_processed,
        "write_outputs": _write_outputs,
        "output_row_counts": _output_row_counts,
        "process_readings": _process_readings,
        "process_daily": _process_daily,
        "process_summary": _process_summary,
        "file_rows_by_header": _file_rows_by_header,
        # Projections, filters, predicates
        "rename_columns": lambda s, d: rename_columns(raw_readings(s, d)),
        "require_columns": lambda s, d: require_columns(rename_columns(raw_readings(s, d)), "rainfall_mm"),
        "project": lambda s, d: monthly_dep(s, d).select(*PREVIEW),
        "filter_season": lambda s, d: filters.filter_season(seasonal_dep(s, d), "Kharif"),
        "filter_month": lambda s, d: filters.filter_month(monthly_dep(s, d), 6),
        "filter_district_season": lambda s, d: filters.filter_district_season(seasonal_dep(s, d), POINT_DISTRICT, "Kharif"),
        "filter_district_month": lambda s, d: filters.filter_district_month(monthly_dep(s, d), POINT_DISTRICT, 6),
        "filter_district": lambda s, d: filters.filter_district(seasonal_dep(s, d), POINT_DISTRICT),
        "drop_missing_june": _drop_missing_june,
        "not_null_values": lambda s, d: filters.not_null_values(raw_readings(s, d), "Avg_rainfall"),
        "known_district": _known_district,
        "default_values": _default_values,
        "validate_june_input": lambda s, d: features.validate_june_input(requests(s, d)),
        # Joins
        "monthly_lpa_join": _monthly_lpa_join,
        "seasonal_lpa_join": _seasonal_lpa_join,
        "june_features_join": joined,
        "district_stats_join": joined_with_stats,
        "score_lookup": _score_lookup,
        "probability_lookup": _probability_lookup,
        "advice_lookup": _advice_lookup,
        # Aggregations
        "monthly_totals": monthly,
        "seasonal_totals": lambda s, d: rollup.seasonal_totals(daily(s, d)),
        "seasonal_from_monthly": seasonal,
        "monthly_lpa": lambda s, d: departure.monthly_lpa(monthly(s, d)),
        "seasonal_lpa": lambda s, d: departure.seasonal_lpa(seasonal(s, d)),
        "above_normal_probability": probability,
        "district_stats": lambda s, d: features.district_stats(kharif(s, d)),
        "coverage_summary": lambda s, d: quality.coverage_summary(standardise(raw_readings(s, d))),
        "missing_summary": lambda s, d: quality.missing_summary(daily(s, d, keep_raw=True)),
        "class_balance": lambda s, d: quality.class_balance(kharif(s, d)),
        "departure_matrix": _departure_matrix,
        "june_lpa": lambda s, d: features.june_lpa(monthly_dep(s, d)),
        "cv_summary": _cv_summary,
        # Windows and time series
        "interpolate_linear": _interpolate_linear,
        "fill_edges": _fill_edges,
        "clean_daily": daily,
        "monthly_departure": monthly_dep,
        "seasonal_departure": lambda s, d: departure.seasonal_departure(seasonal(s, d)),
        "last_season": lambda s, d: reports.last_season(seasonal_dep(s, d)),
        "label_codes": lambda s, d: features.district_codes(seasonal_dep(s, d)),
        "lpa_of_series": lambda s, d: reports.lpa_of_series(seasonal_dep(s, d)),
        # Sorts, limits
        "monthly_sorted": lambda s, d: rollup.monthly_sorted(monthly(s, d)),
        "seasonal_sorted": lambda s, d: rollup.seasonal_sorted(seasonal(s, d)),
        "importance_ranked": _feature_importance,
        "rainfall_trend": lambda s, d: reports.rainfall_trend(seasonal_dep(s, d)),
        "district_seasonal_table": lambda s, d: reports.district_seasonal_table(seasonal_dep(s, d)),
        "compare_districts": lambda s, d: reports.compare_districts(probability(s, d)),
        "preview": lambda s, d: rollup.preview(monthly_dep(s, d).select(*PREVIEW), "district_name", "year", "month"),
        # Lists
        "list_states": lambda s, d: filters.list_states(seasonal(s, d)),
        "list_districts": lambda s, d: filters.list_districts(seasonal(s, d)),
        "list_years": lambda s, d: filters.list_years(seasonal(s, d)),
        # Scalar functions
        "parse_date": _on_orders("date", _parse_date),
        "year_month": _year_month,
        "iso_week": _on_orders("week_number", calendar.iso_week),
        "assign_season": _on_orders("season", lambda date: calendar.assign_season(month_of(date))),
        "clean_name": _clean_name,
        "clip_negative": _on_customers("amount", numbers.clip_negative),
        "season_year": _on_orders("season_year", _season_year),
        "departure_pct": _on_lines(
            departure_pct=lambda: numbers.departure_pct(F.col("l_quantity"), F.col("l_tax") * 1000)),
        "round_even": _on_lines(
            amount=lambda: numbers.round_even(F.col("l_extendedprice") * F.col("l_discount"), 2)),
        "classify_anomaly": _on_customers("anomaly_category", lambda x: classes.classify_anomaly(x / 100)),
        "is_above_normal": _on_customers("is_above_normal", lambda x: classes.above_normal_flag(x / 100)),
        "target_above_normal": lambda s, d: kharif(s, d).select("district_name", "state_name", "year", "target_above_normal"),
        "june_vs_district_mean": lambda s, d: _all_features(s, d).select("district_name", "year", "june_vs_district_mean"),
        "june_was_above_normal": lambda s, d: _all_features(s, d).select("district_name", "year", "june_was_above_normal"),
        "serving_features": _serving_features,
        "probability_band": _probability_band,
        "vs_lpa_flag": _vs_lpa_flag,
        "departure_sign_band": _departure_sign_band,
        "month_label": _on_orders("month_label", lambda date: calendar.month_label(month_of(date))),
        "format_number": _on_lines(
            whole=lambda: numbers.format_fixed(F.col("l_extendedprice") / 8, 0),
            tenths=lambda: numbers.format_fixed(F.col("l_extendedprice"), 1),
            signed=lambda: numbers.format_fixed(F.col("l_discount") * 10 - 0.25, 1, plus=True, suffix="%"),
        ),
        "score_verdict": lambda s, d: _customer_share(s, d).select("c_custkey", classes.score_verdict(F.col("chance")).alias("verdict")),
        "low_accuracy_warning": lambda s, d: _customer_share(s, d).select("c_custkey", classes.low_accuracy(F.col("chance")).alias("low_accuracy")),
        "advice_text": _advice_text,
        # Model
        "feature_matrix": matrix,
        "feature_columns": lambda s, d: matrix(s, d).select(*FEATURE_COLUMNS),
        "balanced_weights": lambda s, d: features.balanced_weights(_stored_matrix(s, d)).select(
            "district_name", "state_name", "year", "target_above_normal", "class_weight"),
        "train_forest": _train_forest,
        "leave_one_out": _leave_one_out,
        "feature_importance": _feature_importance,
        "score_requests": _score_requests,
        "model_metadata": _model_metadata,
        "write_report": _write_report,
        "save_load_model": _save_load_model,
        "run_trainer": _run_trainer,
        "run_trainer_counts": lambda s, d: _run_trainer(s, d).select(
            "rows_given", "rows_without_june", "rows_incomplete", "rows_trained"),
        "leave_one_out_folds": lambda s, d: _leave_one_out(s, d).select("fold", "n_rows"),
        "leave_one_out_hashed": lambda s, d: forest.leave_one_out(_stored_matrix(s, d), "hash").select("fold", "n_rows"),
        "out_of_bag": _out_of_bag,
        "out_of_bag_judges": lambda s, d: _out_of_bag(s, d).select(
            "district_name", "state_name", "year", "target_above_normal", "n_judges"),
        "train_forest_rows": lambda s, d: _train_forest(s, d).drop("prediction"),
        "feature_importance_names": lambda s, d: _feature_importance(s, d).select("feature"),
        "score_requests_known": lambda s, d: _score_requests(s, d).select(
            "request_id", "district", "state", "june_rainfall_mm", "june_departure_pct", "state_known", "error"),
        "feature_importance_checks": lambda s, d: _importance_checks(_feature_importance(s, d)),
        "write_report_checks": lambda s, d: _importance_checks(_write_report(s, d)),
        "save_load_model_checks": _save_load_checks,
        "model_metadata_known": lambda s, d: _model_metadata(s, d).select(
            F.array_join("feature_columns", " ").alias("feature_columns"), "above_normal_threshold", "predictor_month",
            "target_season", F.col("cv_mean_accuracy").between(0, 1).alias("accuracy_in_range")),
        "score_requests_checks": _score_checks,
        # Reports
        "district_overview": _district_overview,
        "district_overview_forecast": _overview_with_forecast,
        "farmer_advice": _farmer_advice,
        "input_defaults": _input_defaults,
    }
