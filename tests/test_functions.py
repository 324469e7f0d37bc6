import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pluvigrid.functions import calendar, classes, numbers, text
from pluvigrid.functions.fixed_values import FORECAST_BANDS, NULL_TOKENS, OUTLOOK_BANDS

NAMES = {
    "WARANGAL ": "Warangal",
    "jayashankar-bhupalpally": "Jayashankar-Bhupalpally",
    "o'brien": "O'Brien",
    "medchal (malkajgiri)": "Medchal (Malkajgiri)",
    "y.s.r. kadapa": "Y.S.R. Kadapa",
    "2nd town": "2Nd Town",
    " \ta \n": "A",
    "NATION_3": "Nation_3",
    "NORTH  nation_3 EAST": "North  Nation_3 East",
    "élan ÇA": "Élan Ça",
}


def test_clean_name(values):
    assert values(text.clean_name, list(NAMES)) == list(NAMES.values())


def test_clean_name_equals_python(values):
    rng = random.Random(5)
    letters = "abXYz09_-' .(é\t"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    assert values(text.clean_name, names) == [name.strip().title() for name in names]


def test_clean_name_keeps_null(values):
    assert values(text.clean_name, [None]) == [None]


def test_null_tokens(values):
    assert len(NULL_TOKENS) == 19
    inputs = ["1.5", "NA", "", "n/a", "NaN", "2"]
    assert values(text.parse_amount_strict, inputs) == [1.5, None, None, None, None, 2.0]
    assert values(text.parse_amount, ["trace"]) == [None]
    with pytest.raises(Exception, match="not a number: trace"):
        values(text.parse_amount_strict, ["trace"])


def test_parse_date(values):
    assert values(calendar.parse_date_strict, ["2016-06-01", "2016-6-1"]) == [datetime.date(2016, 6, 1)] * 2
    assert values(calendar.parse_date, ["01-06-2016", None, "2016-02-30"]) == [None] * 3
    for bad in ("01-06-2016", None):
        with pytest.raises(Exception, match="not a YYYY-MM-DD date"):
            values(calendar.parse_date_strict, [bad])


def test_iso_week(values):
    days = [datetime.date(2016, 1, 1), datetime.date(2018, 12, 31)]
    assert values(calendar.iso_week, days, "DATE") == [53, 1]


def test_seasons(values):
    expected = {
        "2020-05-31": ("Zaid", 2020),
        "2020-06-01": ("Kharif", 2020),
        "2020-09-30": ("Kharif", 2020),
        "2020-10-01": ("Rabi", 2020),
        "2020-12-31": ("Rabi", 2020),
        "2021-02-28": ("Rabi", 2020),
        "2021-03-01": ("Zaid", 2021),
    }

    def both(day):
        season = calendar.assign_season(F.month(day))
        return F.struct(season, calendar.season_year(F.year(day), F.month(day), season))

    days = [datetime.date.fromisoformat(d) for d in expected]
    assert [tuple(r) for r in values(both, days, "DATE")] == list(expected.values())


def test_month_label(values):
    assert values(calendar.month_label, range(1, 13), "INT") == (
        "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    )


def test_round_even(values):
    inputs = [0.125, 0.375, 2.675, 1.005, -0.125, None]
    assert values(lambda x: numbers.round_even(x, 2), inputs, "DOUBLE") == [0.12, 0.38, 2.68, 1.0, -0.12, None]


def test_round_even_equals_numpy(values):
    inputs = [random.Random(1).uniform(-1e4, 1e4) for _ in range(200)] + [k / 8 for k in range(-50, 50)]
    assert values(lambda x: numbers.round_even(x, 2), inputs, "DOUBLE") == [float(np.round(x, 2)) for x in inputs]


def test_exact_rounding_equals_python_text(values):
    rng = random.Random(2)
    inputs = [k / 20 for k in range(-400, 400)] + [round(rng.uniform(-5000, 5000), 2) for _ in range(2000)]
    assert values(lambda x: numbers.format_fixed(x, 1), inputs, "DOUBLE") == [f"{x:.1f}" for x in inputs]
    assert values(lambda x: numbers.format_fixed(x, 0), inputs, "DOUBLE") == [f"{x:.0f}" for x in inputs]
    signed = values(lambda x: numbers.format_fixed(x, 1, plus=True, suffix="%"), inputs, "DOUBLE")
    assert signed == [f"{x:+.1f}%" for x in inputs]
    assert values(numbers.round_exact, inputs, "DOUBLE") == [round(x, 1) for x in inputs]


def test_clip_and_nan(values):
    assert values(numbers.clip_negative, [-1.0, None, 3.0], "DOUBLE") == [0.0, None, 3.0]
    assert values(numbers.nan_to_null, [float("nan"), 2.0, None], "DOUBLE") == [None, 2.0, None]


def test_anomaly_classes(values):
    expected = {
        20.01: "Large Excess", 20.0: "Above Normal", 5.01: "Above Normal", 5.0: "Normal",
        -5.0: "Normal", -5.01: "Below Normal", -20.0: "Below Normal", -20.01: "Large Deficit",
    }
    assert values(classes.classify_anomaly, list(expected), "DOUBLE") == list(expected.values())
    assert values(classes.above_normal_flag, [*expected, None], "DOUBLE") == [1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_bands(values):
    assert values(classes.forecast_category, [0.70, 0.50, 0.35, 0.349, None], "DOUBLE") == [
        "Above Normal", "Normal to Above Normal", "Normal", "Below Normal", None,
    ]
    assert values(classes.forecast_colour, [0.7, 0.0], "DOUBLE") == ["green", "red"]
    assert values(classes.forecast_advice, [0.5], "DOUBLE") == [FORECAST_BANDS[1][3]]
    assert values(classes.outlook_colour, [65.0, 50.0, 35.0, 34.9], "DOUBLE") == ["green", "blue", "orange", "red"]


def test_advice_points(values):
    for percent, band in zip([65.0, 50.0, 35.0, 0.0], OUTLOOK_BANDS):
        (points,) = values(lambda x: classes.outlook_points(x, F.lit("Medak")), [percent], "DOUBLE")
        assert points == [p.replace("%s", "Medak") for p in band[3]]
    assert [len(band[3]) for band in OUTLOOK_BANDS] == [5, 5, 5, 6]


def test_departure_texts(values):
    inputs = [5.01, 5.0, -5.0, -5.01, 0.3, None]
    assert values(classes.departure_colour, inputs, "DOUBLE") == ["green", "orange", "orange", "red", "orange", None]
    assert values(classes.departure_text, inputs, "DOUBLE") == ["+5%", "+5%", "-5%", "-5%", "+0%", None]


def test_verdict(values):
    words = [v.split()[0] for v in values(classes.score_verdict, [0.75, 0.6, 0.59], "DOUBLE")]
    assert words == ["GOOD", "MODERATE", "WEAK"]
    assert values(classes.low_accuracy, [0.64, 0.65], "DOUBLE") == [True, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=1, max_size=30))
def test_flag_agrees_with_class(values, departures):
    flags = values(classes.above_normal_flag, departures, "DOUBLE")
    labels = values(classes.classify_anomaly, departures, "DOUBLE")
    assert [f == 1 for f in flags] == [label in ("Above Normal", "Large Excess") for label in labels]
