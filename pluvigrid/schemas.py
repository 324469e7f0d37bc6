"""Column lists and Spark types of the stored tables."""

# Columns of the stored tables, in their order.
PROCESSED_SCHEMAS = {
    "daily": (
        "date DATE, state_name STRING, district_name STRING, rainfall_mm DOUBLE, source_file STRING, "
        "year INT, month INT, week_number INT, season STRING"
    ),
    "monthly": (
        "state_name STRING, district_name STRING, year INT, month INT, total_rainfall_mm DOUBLE, "
        "rainy_days BIGINT, data_days BIGINT, lpa_mm DOUBLE, departure_pct DOUBLE, anomaly_category STRING"
    ),
    "seasonal": (
        "state_name STRING, district_name STRING, year INT, season STRING, total_rainfall_mm DOUBLE, "
        "rainy_days BIGINT, data_days BIGINT, lpa_mm DOUBLE, departure_pct DOUBLE, anomaly_category STRING, "
        "is_above_normal INT"
    ),
    "probability": (
        "district_name STRING, season STRING, years_above_normal BIGINT, total_years BIGINT, "
        "prob_above_normal_pct DOUBLE"
    ),
}

# What the trainer needs from the seasonal table.
SEASONAL_REQUIRED = (
    "district_name", "state_name", "year", "season", "total_rainfall_mm", "departure_pct",
)

MONTHLY_REQUIRED = (
    "district_name", "year", "month", "total_rainfall_mm", "departure_pct", "lpa_mm",
)

SCORE_REQUEST = "district_name STRING, state_name STRING, june_rainfall_mm DOUBLE"
