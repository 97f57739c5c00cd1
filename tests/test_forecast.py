import datetime

import pytest

from tests.conftest import rows
from vitrine.operators import forecast as fc


def on_days(spark, *days):
    at = [(None if d is None else datetime.datetime(2024, 1, d, 13, 5),) for d in days]
    return spark.createDataFrame(at, "created_at timestamp_ntz")


def filled(df):
    return fc.daily_gapfill(fc.daily_orders(df))


def test_gaps_become_zeros(spark):
    df = filled(on_days(spark, 1, 1, 2, 5, None))
    assert [(d.day, n) for d, n in rows(df, "dia")] == [(1, 2), (2, 1), (3, 0), (4, 0), (5, 1)]
    means = [m for _, _, m in rows(fc.moving_avg_7d(df))]
    assert means == pytest.approx([2, 3 / 2, 1, 3 / 4, 4 / 5])


def test_trend_and_projection_match_the_formula(spark):
    per_day = [3, 0, 4, 1, 5, 9, 2, 6, 5, 3]
    df = filled(on_days(spark, *[d + 1 for d, n in enumerate(per_day) for _ in range(n)]))
    n = len(per_day)
    x_mean, y_mean = (n - 1) / 2, sum(per_day) / n
    slope = sum((x - x_mean) * (y - y_mean) for x, y in enumerate(per_day)) / sum(
        (x - x_mean) ** 2 for x in range(n)
    )
    intercept = y_mean - slope * x_mean
    assert rows(fc.linear_trend(df))[0] == pytest.approx((slope, intercept))
    recent = sum(per_day[-7:]) / 7
    want = [max(0, (intercept + slope * (n + k) + recent) / 2) for k in range(30)]
    got = rows(fc.forecast_30d(df))
    assert [v for _, v in got] == pytest.approx(want)
    assert got[0][0] == datetime.date(2024, 1, 11) and len(got) == 30
    mean = rows(fc.forecast_mean(fc.forecast_30d(df)))[0][0]
    assert mean == pytest.approx(sum(want) / 30)
    both = rows(fc.history_plus_forecast(df, fc.forecast_30d(df)))
    assert [t for _, _, t in both].count("Histórico") == n and len(both) == n + 30


def test_projection_is_never_negative(spark):
    days = [d for d, n in zip(range(1, 29), range(27, -1, -1)) for _ in range(n)]
    got = [v for _, v in rows(fc.forecast_30d(filled(on_days(spark, *days))))]
    assert min(got) == 0.0 and got[0] > 0


def test_one_day_is_a_flat_line(spark):
    df = filled(on_days(spark, 4, 4, 4))
    assert rows(fc.linear_trend(df)) == [(0.0, 3.0)]
    assert {v for _, v in rows(fc.forecast_30d(df))} == {3.0}


def test_no_history(spark):
    df = filled(on_days(spark, None))
    assert rows(df) == []
    assert rows(fc.linear_trend(df)) == [(0.0, 0.0)]
    assert rows(fc.forecast_30d(df)) == []
