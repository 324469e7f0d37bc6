"""Names, thresholds and texts that results must reproduce exactly."""

# Raw CSV header -> internal column name.
RAW_COLUMNS = {
    "Date": "date",
    "State": "state_name",
    "District": "district_name",
    "Avg_rainfall": "rainfall_mm",
}

# Calendar months of the two named seasons; the rest is Zaid.
KHARIF_MONTHS = (6, 7, 8, 9)
RABI_MONTHS = (10, 11, 12, 1, 2)

# Thresholds.
RAINY_DAY_MM = 2.5
ABOVE_NORMAL_PCT = 5.0
PREDICTOR_MONTH = 6
TARGET_SEASON = "Kharif"
JUNE_INPUT_MIN_MM = 0.0
JUNE_INPUT_MAX_MM = 1000.0
LOW_ACCURACY_PCT = 65.0

# Fallbacks for lookups without a match.
DEFAULT_PROBABILITY_PCT = 50.0
DEFAULT_JUNE_LPA_MM = 100.0
DEFAULT_MEAN_MM = 500.0
DEFAULT_STD_MM = 100.0
DEFAULT_CV = 0.2
DEFAULT_JUNE_RATIO = 1.0
DEFAULT_STATE_CODE = 0

# Spellings of a missing reading in CSV text.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Names of the processed tables.
TABLE_NAMES = {
    "daily": "01_daily_clean",
    "monthly": "02_monthly_with_departure",
    "seasonal": "03_seasonal_with_departure",
    "probability": "04_above_normal_probability",
}

# Model inputs in vector order.
FEATURE_COLUMNS = (
    "june_rainfall_mm",
    "june_departure_pct",
    "june_vs_district_mean",
    "june_was_above_normal",
    "district_mean_mm",
    "district_std_mm",
    "district_cv",
    "district_encoded",
    "state_encoded",
)

# Forest settings.
FOREST_TREES = 100
FOREST_DEPTH = 4
FOREST_SEED = 42

# Accuracy verdicts, lowest accuracy first reached from the top.
VERDICTS = (
    (0.75, "GOOD — model has useful predictive signal"),
    (0.60, "MODERATE — better than random, but interpret with caution"),
    (None, "WEAK — model struggles; more data or features needed"),
)

# Forecast bands on a 0..1 probability:
# (lowest probability, category, colour, advice).
FORECAST_BANDS = (
    (0.70, "Above Normal", "green",
     "High confidence of above-normal monsoon. "
     "Proceed with full Kharif sowing plan. "
     "Ensure drainage channels are clear to handle surplus water."),
    (0.50, "Normal to Above Normal", "blue",
     "Moderate confidence of good monsoon. "
     "Sow primary crops as planned but keep 20% area as buffer. "
     "Monitor weekly rainfall and adjust irrigation accordingly."),
    (0.35, "Normal", "orange",
     "Season likely to be near average. "
     "Follow standard sowing schedule. "
     "Keep drought-tolerant variety seeds as backup."),
    (None, "Below Normal", "red",
     "Risk of below-normal monsoon. "
     "Consider drought-resistant crop varieties. "
     "Prioritise water conservation. "
     "Consult local Krishi Vigyan Kendra before full sowing."),
)

# Outlook bands on a 0..100 probability:
# (lowest percent, colour, title, points); %s in the first point is the district.
OUTLOOK_BANDS = (
    (65, "green", "✅ Good monsoon likely — plan for full sowing", (
        "Strong signal of above-normal rainfall for %s this Kharif season.",
        "Proceed with your full sowing plan for water-intensive crops (paddy, sugarcane).",
        "Ensure drainage channels and bunds are cleared before June to handle surplus water.",
        "Stock up on seeds and fertilisers early — demand will be high.",
        "Consider crop insurance nonetheless; even good monsoons can have dry spells.",
    )),
    (50, "blue", "🔵 Moderate outlook — proceed with caution", (
        "Moderate confidence of above-normal rainfall for %s.",
        "Sow primary crops as planned but reserve 20% of your area as a buffer.",
        "Diversify: mix a high-value water-intensive crop with one drought-tolerant variety.",
        "Monitor weekly district rainfall updates — adjust irrigation schedules accordingly.",
        "Consult your local Krishi Vigyan Kendra (KVK) for variety recommendations.",
    )),
    (35, "orange", "🟡 Near-normal expected — standard precautions advised", (
        "Season likely to be near the historical average for %s.",
        "Follow your standard sowing schedule for the district.",
        "Keep drought-tolerant variety seeds (e.g. millets, sorghum) as backup.",
        "Check soil moisture before each irrigation cycle to avoid over-watering.",
        "Review your crop insurance policy before June 30th.",
    )),
    (None, "red", "🔴 Below-normal risk — take protective action", (
        "Higher than usual risk of below-normal monsoon for %s.",
        "Strongly consider drought-resistant crop varieties this season.",
        "Prioritise water conservation: repair farm ponds and check-dams now.",
        "Avoid over-investment in water-intensive crops like paddy this cycle.",
        "Contact your district agriculture officer and register for drought relief schemes.",
        "Visit the nearest Krishi Vigyan Kendra before finalising sowing plans.",
    )),
)

# The column that holds a field beyond a CSV file's header.
SURPLUS = "surplus_field"
