"""Weather normalisation: a trend that weather made goes, one of its own stays; nulls, ties and empty tables."""

import datetime as dt
import random

import pytest

from aerolith.operators import models


@pytest.mark.parametrize("drift,own,share", [(1.0, 0.0, 1.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.5)])
def test_share_of_a_trend(spark, drift, own, share):
    rng = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(6 * 365):
        years = i / 365
        wind = drift * years + rng.gauss(0, 1)
        rows.append((start + dt.timedelta(days=i, hours=i % 3), 2 * wind + 2 * own * years + rng.gauss(0, 0.1), wind, years))
    rows += [(start, None, 1.0, 0.0), (start, 1.0, None, 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double, wind double, years double")
    months = models.normalise_weather(df, "ts", "value", ["wind"], ["years"], kind="linear")
    assert months.count() == 72 and months.agg({"hours": "sum"}).first()[0] == 6 * 365
    got = models.weather_share(months).first()
    assert got["observed_slope"] == pytest.approx(2 * drift + 2 * own, abs=0.15)
    assert got["weather_share"] == pytest.approx(share, abs=0.1)


def test_no_rows_no_trend(spark):
    empty = spark.createDataFrame([], "ts timestamp_ntz, value double, wind double, years double")
    months = models.normalise_weather(empty, "ts", "value", ["wind"], ["years"], kind="linear")
    assert months.collect() == []
    assert tuple(models.weather_share(months).first()) == (None, None, None)


def test_repeated_rows_meet_one_place_each(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 3.0, 1.0, 0.0)] * 40 + [(dt.datetime(2024, 2, 1), 5.0, 2.0, 1.0)] * 40, "ts timestamp_ntz, value double, wind double, years double")
    got = models.normalise_weather(df, "ts", "value", ["wind"], [], kind="linear").collect()
    assert sorted((r["month"].month, r["hours"], r["observed"]) for r in got) == [(1, 40, 3.0), (2, 40, 5.0)]
    assert all(3.0 < r["normalised"] < 5.0 for r in got)  # weather of both months is drawn for either
