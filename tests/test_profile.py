import math
import random
import statistics
from decimal import Decimal

import numpy as np
import pytest

from tests.conftest import rows
from vitrine.functions.quantiles import exact_quantiles
from vitrine.operators import profile, sales

ORDERS = (
    "id long, created_at timestamp_ntz, channel string, status string, customer_id long, "
    "total decimal(18,2)"
)


def orders(spark, data):
    import datetime

    def row(i, day, channel, customer, total):
        at = datetime.datetime.fromisoformat(day) if day else None
        return (i, at, channel, "x", customer, None if total is None else Decimal(total))

    return spark.createDataFrame([row(*r) for r in data], ORDERS)


@pytest.fixture(scope="module")
def edge(spark):
    return orders(
        spark,
        [
            (1, "2024-01-31", "web", 1, "10"),
            (2, "2024-02-01", "web", 1, None),
            (3, "2024-02-02", None, 2, "-5"),
            (4, None, "app", None, "20"),
            (5, "2024-02-03", "app", 3, "1000000"),
            (6, "2024-02-03", "loja", 3, None),
        ],
    )


@pytest.fixture(scope="module")
def empty(spark):
    return orders(spark, [])


def numpy_like(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


@pytest.mark.parametrize("shape", ["even", "skewed", "copies", "tail", "one"])
def test_quantiles_match_a_sort_at_every_depth(spark, shape):
    rng = random.Random(shape)
    values = {
        "even": [rng.uniform(-50, 50) for _ in range(3000)],
        "skewed": [rng.lognormvariate(0, 8) for _ in range(3000)],
        "copies": [7.0] * 1000 + [float(rng.randrange(40)) for _ in range(2000)],
        "tail": [float(rng.randrange(100)) for _ in range(2999)] + [1e15],
        "one": [3.5],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    probabilities = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    want = [numpy_like(values, p) for p in probabilities]
    assert exact_quantiles(df, "v", probabilities) == pytest.approx(want, rel=1e-12)
    deep = exact_quantiles(df, "v", probabilities, sort_rows=20, buckets=16)
    assert deep == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nothing(empty):
    assert exact_quantiles(empty, "total", (0.25, 0.75)) == [None, None]


def test_views_on_edge_rows(edge):
    assert rows(profile.v_orders_eda(edge))[0][3:] == (-5.0, 1000000.0, 1000025 / 4, 2, 1)
    channels = rows(profile.v_orders_by_channel(edge))
    assert [(c, n, s) for c, n, s, _ in channels] == [
        ("app", 2, 1000020.0), ("web", 2, 10.0), ("[NULO]", 1, -5.0), ("loja", 1, None),
    ]
    months = rows(profile.v_orders_by_month(edge))
    assert [(str(m), n) for m, n, _, _ in months] == [("2024-01-01", 1), ("2024-02-01", 4)]
    assert rows(profile.q1_quality(edge)) == [(2, 1, 1, 0)]
    nulls = dict((c, (n, t)) for c, n, t in rows(profile.v_orders_nulls(edge)))
    assert nulls["total"] == (2, 6) and nulls["channel"] == (1, 6) and nulls["id"] == (0, 6)
    first = rows(profile.orders_null_pct(edge))[0]
    assert first == ("total", 2, 6, 33.33)


def test_non_finite_totals_are_counted(spark):
    df = spark.createDataFrame(
        [(1, None, float("nan")), (2, None, 1.0)], "id long, created_at timestamp_ntz, total double"
    )
    assert rows(profile.q1_quality(df)) == [(0, 0, 2, 1)]


def test_outliers_keep_nulls_unflagged(spark):
    data = [(i, "2024-01-01", "web", 1, str(10 + i % 5)) for i in range(50)]
    df = orders(spark, data + [(90, None, "web", 1, "900"), (91, None, "web", 1, None),
                               (92, None, "web", 1, "-900")])
    limits = profile.fences(df)
    assert limits.lower < 10 and limits.upper > 14
    assert [r[0] for r in rows(profile.eda_outliers(df, limits))] == [90, 92]
    assert rows(profile.eda_outlier_summary(df, limits))[0][0] == 2
    flagged = profile.eda_outlier_flag(df, limits)
    assert dict(rows(flagged.groupBy("outlier_iqr").count())) == {True: 2, False: 51}
    assert rows(profile.q1_iqr_outliers(df))[0] == (2, limits.lower, limits.upper)


def test_limits_without_outliers(spark):
    df = orders(spark, [(i, None, "w", 1, str(i)) for i in range(5)])
    assert rows(profile.q1_iqr_outliers(df)) == [(0, None, None)]
    assert rows(profile.eda_outlier_summary(df)) == [(0, -2.0, 6.0)]


def test_histogram_covers_every_value(spark, edge):
    rng = random.Random(1)
    df = orders(spark, [(i, None, "w", 1, f"{rng.gauss(0, 99):.2f}") for i in range(500)])
    bins = rows(profile.eda_histogram(df, 40))
    assert sum(b[3] for b in bins) == 500 and {b[0] for b in bins} <= set(range(1, 41))
    assert bins[0][0] == 1 and bins[-1][0] == 40
    assert rows(profile.eda_histogram(edge, 50))[0][3] == 3
    same = orders(spark, [(i, None, "w", 1, "5") for i in range(3)])
    assert rows(profile.eda_histogram(same, 50)) == [(1, 5.0, 5.0, 3)]


def test_statistics_rows(spark):
    values = [1.0, 2.0, 4.0, 9.5]
    df = orders(spark, [(i, None, "w", 1, str(v)) for i, v in enumerate(values)])
    got = dict(rows(profile.eda_total_stats(df)))
    assert got == pytest.approx(
        {"Mínimo": 1.0, "Máximo": 9.5, "Média": 4.125, "Mediana": 3.0,
         "Desvio padrão": statistics.stdev(values)}
    )


def test_empty_input(empty):
    assert rows(profile.v_orders_eda(empty)) == [(0, None, None, None, None, None, 0, 0)]
    assert rows(profile.q1_diagnosis(empty)) == [(0, profile.MESSAGE_EMPTY)]
    assert rows(profile.q1_iqr_outliers(empty)) == [(0, None, None)]
    assert rows(profile.eda_quartiles(empty)) == [(None,) * 5]
    assert rows(profile.eda_histogram(empty, 50)) == []
    assert rows(profile.eda_outliers(empty)) == []
    assert {p for _, _, p in rows(profile.eda_null_profile(empty))} == {None}
    assert {r[3] for r in rows(profile.orders_null_pct(empty))} == {None}
    assert dict(rows(profile.eda_total_stats(empty))) == dict.fromkeys(
        ("Mínimo", "Máximo", "Média", "Mediana", "Desvio padrão")
    )


def test_diagnosis_names_the_counts(spark, edge):
    messages = [m for _, m in rows(profile.q1_diagnosis(edge))]
    assert messages[0] == "A tabela contém 6 registros observáveis sem transformação aplicada."
    assert messages[1].startswith("Foram encontrados 2 valores nulos")
    assert messages[2].startswith("Há 1 valores negativos")
    assert messages[3] == profile.MESSAGE_CAVEAT
    clean = orders(spark, [(i, None, "w", 1, "1") for i in range(1500)])
    assert [m for _, m in rows(profile.q1_diagnosis(clean))][:3] == [
        "A tabela contém 1.500 registros observáveis sem transformação aplicada.",
        profile.MESSAGE_NO_NULLS, profile.MESSAGE_NO_NEGATIVES,
    ]


def test_monthly_and_channel_sales(edge):
    months = rows(sales.sales_monthly(edge))
    assert months == [
        ("2024-01", 10.0, 1, 10.0), ("2024-02", 999995.0, 4, 499997.5), ("NaT", 20.0, 1, 20.0),
    ]
    assert rows(sales.sales_by_channel(edge)) == [
        ("app", 1000020.0, 2), ("loja", 0.0, 1), ("web", 10.0, 2), (None, -5.0, 1),
    ]
    revenue = rows(sales.sales_kpis(edge, edge))[0]
    assert revenue == (1000025.0, 6, 1000025 / 4, 6)
    assert sum(m[1] for m in months) == revenue[0]


def test_sales_of_nothing(empty):
    assert rows(sales.sales_kpis(empty, empty)) == [(0.0, 0, None, 0)]
    assert rows(sales.sales_monthly(empty)) == []


@pytest.mark.parametrize("sort_rows", [10, 1_000_000])
def test_quantiles_with_infinite_values_end(spark, sort_rows):
    inf = float("inf")
    values = [-inf, -inf, *map(float, range(100)), 1e300, -1e300, inf, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None and v == v)
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)
    want = np.quantile(known, probabilities)
    got = exact_quantiles(df, "v", probabilities, sort_rows=sort_rows, buckets=16)
    for g, w, p in zip(got, want, probabilities):
        place = p * (len(known) - 1)
        low, high = known[int(place)], known[min(int(place) + 1, len(known) - 1)]
        if abs(low) < inf and abs(high) < inf:
            assert g == pytest.approx(w, rel=1e-9)
        else:
            assert g in (low, high, -inf, inf)
    only = spark.createDataFrame([(inf,), (inf,), (-inf,)], "v double")
    assert exact_quantiles(only, "v", (0.0, 0.5, 1.0), sort_rows=1) == [-inf, inf, inf]
