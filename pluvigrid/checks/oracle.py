"""DuckDB SQL with the same results as the registered queries.

Written straight from the rules and not from the Spark code: seasons come from the
daily rows, averages from joins, gap filling from frames over whole series. Sums are taken
over whole numbers of 2**-65, so that they do not depend on the order of addition.
Limits are written out here; texts are shared.
"""

from pluvigrid.functions import fixed_values


def _limited(limits, bands):
    return tuple((limit, *band[1:]) for limit, band in zip((*limits, None), bands, strict=True))


FORECAST_BANDS = _limited((0.70, 0.50, 0.35), fixed_values.FORECAST_BANDS)
OUTLOOK_BANDS = _limited((65, 50, 35), fixed_values.OUTLOOK_BANDS)
VERDICTS = _limited((0.75, 0.60), fixed_values.VERDICTS)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _title(expr: str) -> str:
    runs = rf"regexp_extract_all(lower({expr}), '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || x[2:]), '')"


def _even(expr: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"CAST(round_even(({expr}) * {scale}, 0) / {scale} AS DOUBLE)"


def _exact(expr: str) -> str:
    """The double nearest to the sum, with every value in units of 2**-65."""
    units = f"SUM(CAST(round_even(({expr}) * 36893488147419103232e0, 0) AS HUGEINT))"
    return f"CAST(CAST({units} AS VARCHAR) AS DOUBLE) / 36893488147419103232e0"


def _mean(expr: str) -> str:
    return f"{_exact(expr)} / COUNT({expr})"


def _season(month: str) -> str:
    return (
        f"CASE WHEN {month} IN (6, 7, 8, 9) THEN 'Kharif' WHEN {month} IN (10, 11, 12, 1, 2) THEN 'Rabi' ELSE 'Zaid' END"
    )


def _anomaly(x: str) -> str:
    return (
        f"CASE WHEN {x} > 20 THEN 'Large Excess' WHEN {x} > 5 THEN 'Above Normal' WHEN {x} >= -5 THEN 'Normal' "
        f"WHEN {x} >= -20 THEN 'Below Normal' ELSE 'Large Deficit' END"
    )


def _band(value: str, bands, column: int) -> str:
    cases = " ".join(f"WHEN {value} >= {band[0]} THEN {_text(band[column])}" for band in bands[:-1])
    return f"CASE WHEN {value} IS NULL THEN NULL {cases} ELSE {_text(bands[-1][column])} END"


def _departure(total: str, lpa: str) -> str:
    return f"CASE WHEN {lpa} > 0 THEN ({total} - {lpa}) / {lpa} * 100 ELSE 0.0e0 END"


def _dep_colour(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 5 THEN 'green' WHEN {x} < -5 THEN 'red' ELSE 'orange' END"


def _dep_text(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN '+' ELSE '' END) || printf('%.0f%%', {x})"


_WITHS = {
    "raw": ((), """
        SELECT CAST(l_shipdate AS DATE) AS "Date", r_name AS "State", n_name AS "District",
               SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "Avg_rainfall"
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3"""),
    "named": (("raw",), f"""
        SELECT "Date" AS date, {_title('"State"')} AS state_name, {_title('"District"')} AS district_name,
               "Avg_rainfall" AS reading_mm, CAST(year("Date") AS INT) AS year, CAST(month("Date") AS INT) AS month,
               CAST(weekofyear("Date") AS INT) AS week_number, {_season('month("Date")')} AS season
        FROM raw"""),
    "numbered": (("named",), """
        SELECT *, row_number() OVER (PARTITION BY district_name ORDER BY date) AS rn FROM named"""),
    "neighbours": (("numbered",), """
        SELECT *, last_value(reading_mm IGNORE NULLS) OVER up AS pv,
               last_value(CASE WHEN reading_mm IS NOT NULL THEN rn END IGNORE NULLS) OVER up AS pk,
               first_value(reading_mm IGNORE NULLS) OVER down AS nv,
               first_value(CASE WHEN reading_mm IS NOT NULL THEN rn END IGNORE NULLS) OVER down AS nk
        FROM numbered
        WINDOW up AS (PARTITION BY district_name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               down AS (PARTITION BY district_name ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    "daily": (("neighbours",), """
        SELECT date, state_name, district_name, coalesce(reading_mm, (nv - pv) / (nk - pk) * (rn - pk) + pv, pv, nv)
               AS rainfall_mm, reading_mm, year, month, week_number, season FROM neighbours"""),
    "monthly": (("daily",), f"""
        SELECT state_name, district_name, year, month, coalesce({_exact('rainfall_mm')}, 0) AS total_rainfall_mm,
               COUNT(CASE WHEN rainfall_mm > 2.5 THEN 1 END) AS rainy_days, COUNT(rainfall_mm) AS data_days
        FROM daily GROUP BY 1, 2, 3, 4"""),
    "seasonal": (("daily",), f"""
        SELECT state_name, district_name,
               CAST(CASE WHEN season = 'Rabi' AND month <= 2 THEN year - 1 ELSE year END AS INT) AS year, season,
               coalesce({_exact('rainfall_mm')}, 0) AS total_rainfall_mm,
               COUNT(CASE WHEN rainfall_mm > 2.5 THEN 1 END) AS rainy_days, COUNT(rainfall_mm) AS data_days
        FROM daily GROUP BY 1, 2, 3, 4"""),
    "monthly_lpa": (("monthly",), f"""
        SELECT district_name, month, {_mean('total_rainfall_mm')} AS lpa_mm FROM monthly GROUP BY 1, 2"""),
    "seasonal_lpa": (("seasonal",), f"""
        SELECT district_name, season, {_mean('total_rainfall_mm')} AS lpa_mm FROM seasonal GROUP BY 1, 2"""),
    "monthly_dep": (("monthly", "monthly_lpa"), f"""
        SELECT *, {_anomaly('departure_pct')} AS anomaly_category FROM (
          SELECT m.*, {_even('lpa_mm', 2)} AS lpa_mm,
                 {_even(_departure('total_rainfall_mm', 'lpa_mm'), 2)} AS departure_pct
          FROM monthly m LEFT JOIN monthly_lpa USING (district_name, month)) t"""),
    "seasonal_dep": (("seasonal", "seasonal_lpa"), f"""
        SELECT *, {_anomaly('departure_pct')} AS anomaly_category,
               CASE WHEN departure_pct > 5 THEN 1 ELSE 0 END AS is_above_normal FROM (
          SELECT s.*, {_even('lpa_mm', 2)} AS lpa_mm,
                 {_even(_departure('total_rainfall_mm', 'lpa_mm'), 2)} AS departure_pct
          FROM seasonal s LEFT JOIN seasonal_lpa USING (district_name, season)) t"""),
    "probability": (("seasonal_dep",), f"""
        SELECT *, {_even('years_above_normal / total_years * 100', 1)} AS prob_above_normal_pct FROM (
          SELECT district_name, season, COUNT(CASE WHEN is_above_normal = 1 THEN 1 END) AS years_above_normal,
                 COUNT(*) AS total_years FROM seasonal_dep GROUP BY 1, 2) t"""),
    "kharif": (("seasonal_dep",), """
        SELECT *, CASE WHEN departure_pct > 5.0 THEN 1 ELSE 0 END AS target_above_normal
        FROM seasonal_dep WHERE season = 'Kharif'"""),
    "means": (("kharif",), f"""
        SELECT district_name, {_mean('total_rainfall_mm')} AS district_mean_mm FROM kharif GROUP BY 1"""),
    "stats": (("kharif", "means"), f"""
        SELECT *, district_std_mm / district_mean_mm AS district_cv FROM (
          SELECT district_name, any_value(district_mean_mm) AS district_mean_mm,
                 CASE WHEN COUNT(*) > 1 THEN sqrt({_exact('(total_rainfall_mm - district_mean_mm) * (total_rainfall_mm - district_mean_mm)')}
                   / (COUNT(*) - 1)) END AS district_std_mm
          FROM kharif JOIN means USING (district_name) GROUP BY 1) t"""),
    "june": (("monthly_dep",), """
        SELECT district_name, year, total_rainfall_mm AS june_rainfall_mm, departure_pct AS june_departure_pct
        FROM monthly_dep WHERE month = 6"""),
    "june_lpa": (("monthly_dep",), f"""
        SELECT district_name, {_mean('lpa_mm')} AS june_lpa_mm FROM monthly_dep WHERE month = 6 GROUP BY 1"""),
    "district_codes": (("kharif",), """
        SELECT DISTINCT district_name, CAST(dense_rank() OVER (ORDER BY district_name) - 1 AS INT) AS district_encoded
        FROM kharif"""),
    "state_codes": (("kharif",), """
        SELECT DISTINCT state_name, CAST(dense_rank() OVER (ORDER BY state_name) - 1 AS INT) AS state_encoded
        FROM kharif"""),
    "joined": (("kharif", "june"), """
        SELECT district_name, state_name, k.year AS year, target_above_normal, june_rainfall_mm, june_departure_pct
        FROM kharif k LEFT JOIN june USING (district_name, year)"""),
    "all_features": (("joined", "stats", "district_codes", "state_codes"), f"""
        SELECT j.*, district_mean_mm AS district_mean_mm, district_std_mm AS district_std_mm,
               district_cv AS district_cv,
               {_even('june_rainfall_mm / district_mean_mm', 4)} AS june_vs_district_mean,
               CASE WHEN june_departure_pct > 5 THEN 1 ELSE 0 END AS june_was_above_normal,
               district_encoded, state_encoded
        FROM joined j LEFT JOIN stats USING (district_name) LEFT JOIN district_codes USING (district_name)
             LEFT JOIN state_codes USING (state_name)"""),
    "features": (("all_features",), """
        SELECT * FROM all_features WHERE june_rainfall_mm IS NOT NULL AND june_departure_pct IS NOT NULL"""),
    "requests": ((), f"""
        SELECT c_custkey AS request_id,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN c_mktsegment ELSE {_title('n_name')} END AS district_name,
               CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE {_title('r_name')} END AS state_name,
               c_acctbal / 10 AS june_rainfall_mm
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "found": (("requests", "district_codes", "state_codes", "stats", "june_lpa"), """
        SELECT r.*, district_encoded, district_encoded IS NOT NULL AS district_known, state_encoded,
               state_encoded IS NOT NULL AS state_known, s.district_name IS NOT NULL AS has_stats,
               district_mean_mm, district_std_mm, june_lpa_mm
        FROM requests r LEFT JOIN district_codes USING (district_name) LEFT JOIN state_codes USING (state_name)
             LEFT JOIN stats s USING (district_name) LEFT JOIN june_lpa USING (district_name)"""),
    "defaulted": (("found",), """
        SELECT * EXCLUDE (district_mean_mm, district_std_mm, june_lpa_mm, state_encoded, has_stats),
               coalesce(district_mean_mm, 500.0e0) AS district_mean_mm,
               CASE WHEN has_stats THEN district_std_mm ELSE 100.0e0 END AS district_std_mm,
               CASE WHEN coalesce(district_mean_mm, 500.0e0) > 0 THEN
                 (CASE WHEN has_stats THEN district_std_mm ELSE 100.0e0 END) / coalesce(district_mean_mm, 500.0e0)
                 ELSE 0.2e0 END AS district_cv,
               coalesce(june_lpa_mm, coalesce(district_mean_mm, 500.0e0) / 4) AS june_lpa_mm,
               coalesce(state_encoded, 0) AS state_encoded
        FROM found"""),
    "latest": (("kharif",), """
        SELECT district_name, year AS last_year, total_rainfall_mm AS last_total_mm,
               departure_pct AS last_departure_pct, lpa_mm AS last_lpa_mm
        FROM kharif QUALIFY row_number() OVER (PARTITION BY district_name ORDER BY year DESC, state_name) = 1"""),
    "districts": (("seasonal_dep",), "SELECT DISTINCT district_name FROM seasonal_dep"),
    "odds": (("districts", "probability"), """
        SELECT d.district_name, years_above_normal, total_years, coalesce(prob_above_normal_pct, 50.0e0) AS primary_prob
        FROM districts d LEFT JOIN (SELECT * FROM probability WHERE season = 'Kharif') p USING (district_name)"""),
    "order_years": ((), """
        SELECT CAST(year(o_orderdate) AS VARCHAR) AS fold, COUNT(*) AS n_rows,
               COUNT(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS n_correct,
               COUNT(CASE WHEN o_orderstatus <> 'F' THEN 1 END) / COUNT(*) AS accuracy
        FROM orders GROUP BY 1"""),
    "cv": (("order_years",), f"""
        SELECT COUNT(*) AS n_folds, {_even('AVG(accuracy)', 9)} AS cv_mean_accuracy,
               {_even('stddev_pop(accuracy)', 9)} AS cv_std_accuracy,
               {_band('AVG(accuracy)', VERDICTS, 1)} AS verdict, AVG(accuracy) * 100 < 65 AS low_accuracy
        FROM order_years"""),
}


def _needed(names, seen):
    for name in names:
        if name not in seen:
            _needed(_WITHS[name][0], seen)
            seen.append(name)
    return seen


def _sql(body: str, *tables: str) -> str:
    ctes = ",\n".join(f"{name} AS ({_WITHS[name][1]})" for name in _needed(tables, []))
    return f"WITH {ctes}\n{body}" if ctes else body


def _unit(*more: str) -> str:
    """A number in [0, 1) from a feature row's keys."""
    keys = ", ".join(f"{c}::VARCHAR" for c in ("district_name", "state_name", "year", *more))
    return f"(('0x' || substr(md5(concat_ws('|', {keys})), 1, 8))::BIGINT / 4294967296e0)"


_PREVIEW = "district_name, year, month, total_rainfall_mm, lpa_mm, departure_pct, anomaly_category"
_DAILY = "date, state_name, district_name, rainfall_mm, year, month, week_number, season"
_CUSTOMER_SHARE = "c_acctbal / 10000"
_MESSY = "' ' || lower(c_mktsegment) || '-' || c_name || chr(9)"


def _points() -> str:
    cases = []
    for low, _, _, points in OUTLOOK_BANDS:
        before, after = points[0].split("%s")
        first = f"{_text(before)} || district_name || {_text(after)}"
        items = ", ".join([first, *(_text(p) for p in points[1:])])
        cases.append(f"WHEN primary_prob >= {low} THEN [{items}]" if low is not None else f"ELSE [{items}]")
    return "CASE " + " ".join(cases) + " END"


def _outlook(value: str) -> tuple[str, str]:
    return _band(value, OUTLOOK_BANDS, 1), _band(value, OUTLOOK_BANDS, 2)


def oracle_sql() -> dict[str, str]:
    colour, title = _outlook("primary_prob")
    share_colour, share_title = _outlook(f"{_CUSTOMER_SHARE} * 100")
    seasonal_dep = _sql("SELECT * EXCLUDE (is_above_normal) FROM seasonal_dep", "seasonal_dep")
    monthly_dep = _sql("SELECT * FROM monthly_dep", "monthly_dep")
    counted = (
        "SELECT '01_daily_clean' AS table_name, COUNT(*) AS n_rows FROM daily UNION ALL "
        "SELECT '02_monthly_with_departure', COUNT(*) FROM monthly UNION ALL "
        "SELECT '03_seasonal_with_departure', COUNT(*) FROM seasonal UNION ALL "
        "SELECT '04_above_normal_probability', COUNT(*) FROM probability"
    )
    return {
        # Sources and sinks
        "read_daily_csv": _sql(
            """SELECT "Date", "State", "District", "Avg_rainfall",
               CASE WHEN "Date" >= DATE '1998-07-01' THEN "State" END AS "Note" FROM raw""", "raw"),
        "union_by_name": """
            SELECT CAST(l_shipdate AS DATE) AS date, CAST(COUNT(*) AS DOUBLE) AS amount, l_returnflag AS flag,
                   CAST(NULL AS VARCHAR) AS priority FROM lineitem GROUP BY 1, 3
            UNION ALL
            SELECT CAST(o_orderdate AS DATE), """ + _even("SUM(o_totalprice)", 2) + """, NULL, o_orderpriority
            FROM orders GROUP BY 1, 4""",
        "read_seasonal": _sql("SELECT * FROM seasonal_dep", "seasonal_dep"),
        "read_monthly": _sql("SELECT * FROM monthly_dep", "monthly_dep"),
        "load_processed": _sql("SELECT * FROM probability", "probability"),
        "process_daily": _sql(f"SELECT {_DAILY} FROM daily", "daily"),
        "process_summary": _sql(
            """SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS rejected, COUNT(*) - COUNT(reading_mm) AS missing_before,
               COUNT(*) - COUNT(rainfall_mm) AS missing_after, MIN(date) AS first_date, MAX(date) AS last_date,
               COUNT(DISTINCT district_name) AS n_districts, COUNT(DISTINCT state_name) AS n_states,
               COUNT(DISTINCT year) AS n_years FROM daily""", "daily"),
        "file_rows_by_header": _sql(
            """SELECT "Date" >= DATE '1998-07-01' AS with_note, COUNT(*) AS n_rows FROM raw GROUP BY 1""", "raw"),
        "write_outputs": _sql(counted, "daily", "monthly", "seasonal", "probability"),
        "output_row_counts": _sql(counted, "daily", "monthly", "seasonal", "probability"),
        "process_readings": _sql("SELECT * FROM seasonal_dep", "seasonal_dep"),
        # Projections, filters, predicates
        "rename_columns": _sql(
            'SELECT "Date" AS date, "State" AS state_name, "District" AS district_name, '
            '"Avg_rainfall" AS rainfall_mm FROM raw', "raw"),
        "require_columns": _sql(
            'SELECT "Date" AS date, "State" AS state_name, "District" AS district_name, '
            '"Avg_rainfall" AS rainfall_mm FROM raw', "raw"),
        "project": _sql(f"SELECT {_PREVIEW} FROM monthly_dep", "monthly_dep"),
        "filter_season": _sql("SELECT * FROM seasonal_dep WHERE season = 'Kharif'", "seasonal_dep"),
        "filter_month": _sql("SELECT * FROM monthly_dep WHERE month = 6", "monthly_dep"),
        "filter_district_season": _sql(
            "SELECT * FROM seasonal_dep WHERE district_name = 'Nation_3' AND season = 'Kharif'", "seasonal_dep"),
        "filter_district_month": _sql(
            "SELECT * FROM monthly_dep WHERE district_name = 'Nation_3' AND month = 6", "monthly_dep"),
        "filter_district": _sql("SELECT * FROM seasonal_dep WHERE district_name = 'Nation_3'", "seasonal_dep"),
        "drop_missing_june": _sql(
            "SELECT district_name, state_name, year, june_rainfall_mm, june_departure_pct FROM joined "
            "WHERE june_rainfall_mm IS NOT NULL AND june_departure_pct IS NOT NULL", "joined"),
        "not_null_values": _sql('SELECT * FROM raw WHERE "Avg_rainfall" IS NOT NULL', "raw"),
        "known_district": _sql(
            "SELECT r.*, coalesce(district_encoded, -1) AS district_encoded, "
            "district_encoded IS NOT NULL AS district_known "
            "FROM requests r LEFT JOIN district_codes USING (district_name)", "requests", "district_codes"),
        "default_values": _sql(
            f"""SELECT request_id, district_name, state_name, june_rainfall_mm,
                coalesce(district_encoded, -1) AS district_encoded, district_known,
                state_known, district_mean_mm AS district_mean_mm,
                district_std_mm AS district_std_mm, district_cv AS district_cv,
                june_lpa_mm AS june_lpa_mm, state_encoded FROM defaulted""", "defaulted"),
        "validate_june_input": _sql(
            """SELECT *, CASE WHEN june_rainfall_mm BETWEEN 0 AND 1000 THEN NULL
               ELSE 'June rainfall must be between 0 and 1000 mm' END AS input_error FROM requests""", "requests"),
        # Joins
        "monthly_lpa_join": _sql(
            f"SELECT m.*, lpa_mm AS lpa_mm FROM monthly m LEFT JOIN monthly_lpa "
            "USING (district_name, month)", "monthly", "monthly_lpa"),
        "seasonal_lpa_join": _sql(
            f"SELECT s.*, lpa_mm AS lpa_mm FROM seasonal s LEFT JOIN seasonal_lpa "
            "USING (district_name, season)", "seasonal", "seasonal_lpa"),
        "june_features_join": _sql("SELECT * FROM joined", "joined"),
        "district_stats_join": _sql(
            f"""SELECT j.*, district_mean_mm AS district_mean_mm,
                district_std_mm AS district_std_mm, district_cv AS district_cv
                FROM joined j LEFT JOIN stats USING (district_name)""", "joined", "stats"),
        "score_lookup": _sql(
            f"""SELECT * EXCLUDE (district_mean_mm, district_std_mm, june_lpa_mm, district_encoded, state_encoded),
                coalesce(district_encoded, -1) AS district_encoded, coalesce(state_encoded, -1) AS state_encoded,
                district_mean_mm AS district_mean_mm, district_std_mm AS district_std_mm,
                june_lpa_mm AS june_lpa_mm FROM found""", "found"),
        "probability_lookup": _sql(
            """SELECT request_id, district_name, state_name, june_rainfall_mm,
               coalesce(years_above_normal, 0) AS years_above_normal, coalesce(total_years, 0) AS total_years,
               coalesce(prob_above_normal_pct, 50.0e0) AS primary_prob
               FROM requests LEFT JOIN (SELECT * FROM probability WHERE season = 'Kharif') p USING (district_name)""",
            "requests", "probability"),
        "advice_lookup": f"""
            SELECT c_custkey, {_CUSTOMER_SHARE} AS chance, {_band(_CUSTOMER_SHARE, FORECAST_BANDS, 1)} AS category,
                   {_band(_CUSTOMER_SHARE, FORECAST_BANDS, 2)} AS colour,
                   {_band(_CUSTOMER_SHARE, FORECAST_BANDS, 3)} AS advice FROM customer""",
        # Aggregations
        "monthly_totals": _sql("SELECT * FROM monthly", "monthly"),
        "seasonal_totals": _sql("SELECT * FROM seasonal", "seasonal"),
        "seasonal_from_monthly": _sql("SELECT * FROM seasonal", "seasonal"),
        "monthly_lpa": _sql(
            f"SELECT district_name, month, lpa_mm AS lpa_mm FROM monthly_lpa", "monthly_lpa"),
        "seasonal_lpa": _sql(
            f"SELECT district_name, season, lpa_mm AS lpa_mm FROM seasonal_lpa", "seasonal_lpa"),
        "above_normal_probability": _sql("SELECT * FROM probability", "probability"),
        "district_stats": _sql(
            f"""SELECT district_name, district_mean_mm AS district_mean_mm,
                district_std_mm AS district_std_mm, district_cv AS district_cv
                FROM stats""", "stats"),
        "coverage_summary": _sql(
            """SELECT MIN(date) AS first_date, MAX(date) AS last_date, COUNT(DISTINCT district_name) AS n_districts,
               COUNT(DISTINCT state_name) AS n_states, COUNT(DISTINCT year) AS n_years FROM named""", "named"),
        "missing_summary": _sql(
            f"""SELECT COUNT(*) AS n_rows, COUNT(*) - COUNT(reading_mm) AS missing_before,
                COUNT(*) - COUNT(rainfall_mm) AS missing_after,
                {_even('(COUNT(*) - COUNT(reading_mm)) / COUNT(*) * 100', 2)} AS missing_before_pct FROM daily""",
            "daily"),
        "class_balance": _sql(
            f"""SELECT COUNT(CASE WHEN target_above_normal = 1 THEN 1 END) AS n_above, COUNT(*) AS n_rows,
                {_even('COUNT(CASE WHEN target_above_normal = 1 THEN 1 END) / COUNT(*) * 100', 1)} AS above_pct
                FROM kharif""", "kharif"),
        "departure_matrix": _sql(
            """SELECT district_name, month, strftime(make_date(2000, month, 1), '%b') AS month_label,
               CAST(year AS VARCHAR) AS year, AVG(departure_pct) AS departure_pct
               FROM monthly_dep GROUP BY ALL""", "monthly_dep"),
        "june_lpa": _sql(
            f"SELECT district_name, june_lpa_mm AS june_lpa_mm FROM june_lpa", "june_lpa"),
        "cv_summary": _sql("SELECT * FROM cv", "cv"),
        # Windows and time series
        "interpolate_linear": _sql(
            f"""SELECT date, district_name, coalesce(reading_mm, (nv - pv) / (nk - pk) * (rn - pk) + pv, pv)
                AS rainfall_mm FROM neighbours""", "neighbours"),
        "fill_edges": _sql(
            "SELECT date, district_name, rainfall_mm FROM daily", "daily"),
        "clean_daily": _sql(
            f"SELECT {_DAILY} FROM daily", "daily"),
        "monthly_departure": monthly_dep,
        "seasonal_departure": seasonal_dep,
        "last_season": _sql("SELECT * FROM latest", "latest"),
        "label_codes": _sql("SELECT * FROM district_codes", "district_codes"),
        "lpa_of_series": _sql(
            """SELECT district_name, lpa_mm AS series_lpa_mm FROM kharif
               QUALIFY row_number() OVER (PARTITION BY district_name ORDER BY year, state_name) = 1""", "kharif"),
        # Sorts, limits
        "monthly_sorted": _sql("SELECT * FROM monthly ORDER BY district_name, year, month, state_name", "monthly"),
        "seasonal_sorted": _sql("SELECT * FROM seasonal ORDER BY district_name, year, season, state_name", "seasonal"),
        "rainfall_trend": _sql(
            """SELECT district_name, state_name, year, total_rainfall_mm, series_lpa_mm,
               CASE WHEN total_rainfall_mm >= series_lpa_mm THEN 'above' ELSE 'below' END AS vs_lpa,
               printf('%.0f', total_rainfall_mm) AS total_text
               FROM (SELECT *, first_value(lpa_mm) OVER (PARTITION BY district_name ORDER BY year, state_name)
                     AS series_lpa_mm FROM kharif) t""", "kharif"),
        "district_seasonal_table": _sql(
            """SELECT district_name, state_name, year, season, printf('%.1f', total_rainfall_mm) AS total_text,
               printf('%.1f', lpa_mm) AS lpa_text, printf('%+.1f%%', departure_pct) AS departure_text,
               anomaly_category FROM seasonal_dep""", "seasonal_dep"),
        "compare_districts": _sql(
            f"""SELECT district_name, prob_above_normal_pct, {_band('prob_above_normal_pct', OUTLOOK_BANDS, 1)} AS colour,
                printf('%.0f%%', prob_above_normal_pct) AS odds_text FROM probability WHERE season = 'Kharif'""",
            "probability"),
        "preview": _sql(
            f"SELECT {_PREVIEW} FROM monthly_dep ORDER BY district_name, year, month LIMIT 5", "monthly_dep"),
        # Lists
        "list_states": _sql("SELECT DISTINCT state_name FROM seasonal", "seasonal"),
        "list_districts": _sql("SELECT DISTINCT state_name, district_name FROM seasonal", "seasonal"),
        "list_years": _sql("SELECT DISTINCT year FROM seasonal", "seasonal"),
        # Scalar functions
        "parse_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders",
        "year_month": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, "
                      "CAST(month(o_orderdate) AS INT) AS month FROM orders",
        "iso_week": "SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS INT) AS week_number FROM orders",
        "assign_season": f"SELECT o_orderkey, {_season('month(o_orderdate)')} AS season FROM orders",
        "clean_name": f"SELECT c_custkey, {_title(f'trim({_MESSY}, chr(9) || chr(32))')} AS name FROM customer",
        "clip_negative": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0e0 ELSE c_acctbal END AS amount FROM customer",
        "season_year": "SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) <= 2 THEN year(o_orderdate) - 1 "
                       "ELSE year(o_orderdate) END AS INT) AS season_year FROM orders",
        "departure_pct": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_departure('l_quantity', '(l_tax * 1000)')} "
                         "AS departure_pct FROM lineitem",
        "round_even": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_even('l_extendedprice * l_discount', 2)} "
                      "AS amount FROM lineitem",
        "classify_anomaly": f"SELECT c_custkey, {_anomaly('c_acctbal / 100')} AS anomaly_category FROM customer",
        "is_above_normal": "SELECT c_custkey, CASE WHEN c_acctbal / 100 > 5 THEN 1 ELSE 0 END AS is_above_normal FROM customer",
        "target_above_normal": _sql("SELECT district_name, state_name, year, target_above_normal FROM kharif", "kharif"),
        "june_vs_district_mean": _sql("SELECT district_name, year, june_vs_district_mean FROM all_features", "all_features"),
        "june_was_above_normal": _sql("SELECT district_name, year, june_was_above_normal FROM all_features", "all_features"),
        "serving_features": _sql(
            f"""SELECT request_id, june_rainfall_mm,
                {_departure('june_rainfall_mm', 'june_lpa_mm')} AS june_departure_pct,
                CASE WHEN district_mean_mm > 0 THEN june_rainfall_mm / district_mean_mm ELSE 1.0e0 END
                  AS june_vs_district_mean,
                CASE WHEN {_departure('june_rainfall_mm', 'june_lpa_mm')} > 5 THEN 1 ELSE 0 END AS june_was_above_normal,
                district_mean_mm AS district_mean_mm, district_std_mm AS district_std_mm,
                district_cv AS district_cv, coalesce(district_encoded, -1) AS district_encoded,
                state_encoded FROM defaulted""",
            "defaulted"),
        "probability_band": f"""
            SELECT c_custkey, {_band(_CUSTOMER_SHARE, FORECAST_BANDS, 1)} AS category,
                   {_band(_CUSTOMER_SHARE, FORECAST_BANDS, 2)} AS forecast_colour,
                   {share_colour} AS outlook_colour, {share_title} AS outlook_title FROM customer""",
        "vs_lpa_flag": _sql(
            "SELECT district_name, state_name, year, season, CASE WHEN total_rainfall_mm >= lpa_mm THEN 'above' "
            "ELSE 'below' END AS vs_lpa FROM seasonal_dep", "seasonal_dep"),
        "departure_sign_band": _sql(
            f"""SELECT district_name, state_name, year, season, {_dep_colour('departure_pct')} AS colour,
                {_dep_text('departure_pct')} AS departure_text FROM seasonal_dep""", "seasonal_dep"),
        "month_label": "SELECT o_orderkey, strftime(o_orderdate, '%b') AS month_label FROM orders",
        "format_number": """
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.0f', l_extendedprice / 8) AS whole,
                   printf('%.1f', l_extendedprice) AS tenths, printf('%+.1f%%', l_discount * 10 - 0.25e0) AS signed
            FROM lineitem""",
        "score_verdict": f"SELECT c_custkey, {_band(_CUSTOMER_SHARE, VERDICTS, 1)} AS verdict FROM customer",
        "low_accuracy_warning": f"SELECT c_custkey, {_CUSTOMER_SHARE} * 100 < 65 AS low_accuracy FROM customer",
        "advice_text": _sql(
            f"""SELECT district_name, primary_prob, {colour} AS colour, {title} AS title,
                array_to_string({_points()}, ' | ') AS points FROM odds""", "odds"),
        # Model inputs
        "feature_matrix": _sql("SELECT * FROM features", "features"),
        "feature_columns": _sql(
            """SELECT june_rainfall_mm, june_departure_pct, june_vs_district_mean, june_was_above_normal,
               district_mean_mm, district_std_mm, district_cv, district_encoded, state_encoded FROM features""",
            "features"),
        "balanced_weights": _sql(
            """SELECT district_name, state_name, year, target_above_normal,
               (SELECT COUNT(*) FROM features) / ((SELECT COUNT(DISTINCT target_above_normal) FROM features) * n)
                 AS class_weight
               FROM features JOIN (SELECT target_above_normal, COUNT(*) AS n FROM features GROUP BY 1) c
                    USING (target_above_normal)""", "features"),
        # Model: what does not depend on the forest
        "run_trainer_counts": _sql(
            """SELECT (SELECT COUNT(*) FROM joined) AS rows_given,
               (SELECT COUNT(*) FROM joined WHERE june_rainfall_mm IS NULL OR june_departure_pct IS NULL)
                 AS rows_without_june,
               (SELECT COUNT(*) FROM joined JOIN stats USING (district_name) WHERE june_rainfall_mm IS NOT NULL
                 AND june_departure_pct IS NOT NULL AND district_std_mm IS NULL) AS rows_incomplete,
               (SELECT COUNT(*) FROM joined JOIN stats USING (district_name) WHERE june_rainfall_mm IS NOT NULL
                 AND june_departure_pct IS NOT NULL AND district_std_mm IS NOT NULL) AS rows_trained""",
            "joined", "stats"),
        "leave_one_out_folds": _sql(
            """SELECT CAST(year AS VARCHAR) AS fold, COUNT(*) AS n_rows FROM features
               WHERE district_std_mm IS NOT NULL GROUP BY 1""", "features"),
        "leave_one_out_hashed": _sql(
            f"""SELECT CAST(CAST(floor({_unit()} * 10) AS INT) AS VARCHAR) AS fold, COUNT(*) AS n_rows FROM features
                WHERE district_std_mm IS NOT NULL GROUP BY 1""", "features"),
        "out_of_bag_judges": _sql(
            f"""SELECT district_name, state_name, year, target_above_normal, CAST(COUNT(CASE WHEN {_unit('r')} < exp(-1)
                  OR floor({_unit()} * 10) = r THEN 1 END) AS INT) AS n_judges
                FROM (SELECT *, unnest(range(10)) AS r FROM features WHERE district_std_mm IS NOT NULL) t
                GROUP BY ALL""", "features"),
        "train_forest_rows": _sql("SELECT district_name, state_name, year, target_above_normal FROM features", "features"),
        "feature_importance_names": "SELECT unnest(["
            "'june_rainfall_mm', 'june_departure_pct', 'june_vs_district_mean', 'june_was_above_normal', "
            "'district_mean_mm', 'district_std_mm', 'district_cv', 'district_encoded', 'state_encoded']) AS feature",
        "score_requests_known": _sql(
            f"""SELECT request_id, district_name AS district, state_name AS state, june_rainfall_mm, state_known,
                CASE WHEN error IS NULL THEN departure END AS june_departure_pct, error
                FROM (SELECT *, {_even(_departure('june_rainfall_mm', 'june_lpa_mm'), 2)} AS departure,
                      CASE WHEN NOT district_known THEN 'District ''' || district_name ||
                             ''' was not in training data. Available: [' ||
                             (SELECT string_agg('''' || district_name || '''', ', ' ORDER BY district_encoded)
                              FROM district_codes WHERE district_encoded < 5) || ']...'
                           WHEN june_rainfall_mm BETWEEN 0 AND 1000 THEN NULL
                           ELSE 'June rainfall must be between 0 and 1000 mm' END AS error
                      FROM defaulted) t""", "defaulted", "district_codes"),
        "feature_importance_checks": "SELECT CAST(9 AS BIGINT) AS n_features, 1.0e0 AS total, true AS all_shares",
        "write_report_checks": "SELECT CAST(9 AS BIGINT) AS n_features, 1.0e0 AS total, true AS all_shares",
        "save_load_model_checks": _sql("SELECT COUNT(*) AS n_rows, COUNT(*) AS n_same FROM features", "features"),
        "model_metadata_known": """
            SELECT 'june_rainfall_mm june_departure_pct june_vs_district_mean june_was_above_normal district_mean_mm '
                   || 'district_std_mm district_cv district_encoded state_encoded' AS feature_columns,
                   5.0e0 AS above_normal_threshold, CAST(6 AS BIGINT) AS predictor_month, 'Kharif' AS target_season,
                   true AS accuracy_in_range""",
        "score_requests_checks": _sql(
            """SELECT request_id, district_known AND coalesce(june_rainfall_mm BETWEEN 0 AND 1000, false) AS answered,
               true AS in_range FROM found""", "found"),
        # Reports
        "district_overview": _sql(
            f"""SELECT district_name, last_year, last_total_mm, last_departure_pct, last_lpa_mm, years_above_normal,
                total_years, primary_prob, {colour} AS primary_colour, printf('%.0f%%', primary_prob) AS primary_text,
                {_dep_colour('last_departure_pct')} AS departure_colour,
                {_dep_text('last_departure_pct')} AS departure_text,
                printf('%.0f', last_total_mm) AS last_total_text, printf('%.0f', last_lpa_mm) AS last_lpa_text
                FROM odds LEFT JOIN latest USING (district_name)""", "odds", "latest"),
        "farmer_advice": _sql(
            f"""SELECT district_name, primary_prob, colour, title, CAST(i AS INT) AS point_no, points[i] AS point
                FROM (SELECT *, unnest(range(1, len(points) + 1)) AS i FROM (
                  SELECT district_name, primary_prob, {colour} AS colour, {title} AS title, {_points()} AS points
                  FROM odds) a) b""", "odds"),
        "input_defaults": _sql(
            f"""SELECT state_name, district_name, CAST(printf('%.1f', lpa) AS DOUBLE) AS june_default_mm,
                'Historical June LPA for ' || district_name || ': ' || printf('%.1f', lpa) || ' mm' AS june_help
                FROM (SELECT s.*, coalesce(june_lpa_mm, 100.0e0) AS lpa
                      FROM (SELECT DISTINCT state_name, district_name FROM seasonal) s
                           LEFT JOIN june_lpa USING (district_name)) t""", "seasonal", "june_lpa"),
    }
