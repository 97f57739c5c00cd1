"""The report pages: each returns its named tables, ready to show.

``tables`` holds the treated tables by name, as :func:`load` returns them.
Nothing runs before a table is shown, but for the quartiles and the short
top lists, whose few rows are needed to plan what follows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from vitrine import schemas
from vitrine.operators import (
    customers as cust, forecast as fc, layers, profile, recommend, sales as sl, treatment as tr,
)
from vitrine.sources.tables import table_or_empty

Tables = Mapping[str, DataFrame]


def load(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The treated tables that a refresh wrote to ``out``; an absent one is empty."""
    written = layers.read_treated(spark, out)
    return {
        name: table_or_empty(spark, written, name, table.schema)
        for name, table in schemas.TREATED.items()
    }


def eda(orders: DataFrame) -> dict[str, DataFrame]:
    limits = profile.fences(orders)
    return {
        "overview": profile.eda_overview(orders),
        "total_stats": profile.eda_total_stats(orders),
        "histogram": profile.eda_histogram(orders, 50),
        "outlier_summary": profile.eda_outlier_summary(orders, limits),
        "outliers": profile.eda_outliers(orders, limits),
        "nulls": profile.eda_null_profile(orders),
    }


def treatment(raw: Tables) -> dict[str, DataFrame]:
    report = tr.treatment_report(raw)
    return {
        "report": report,
        "most_nulls": tr.top_tables(report, "nulos_raw"),
        "most_copies": tr.top_tables(report, "duplicados_removidos"),
    }


def sales(t: Tables) -> dict[str, DataFrame]:
    totals = sl.product_totals(t["order_items"], t["product_variants"], t["products"])
    return {
        "kpis": sl.sales_kpis(t["orders"], t["returns"]),
        "monthly": sl.sales_monthly(t["orders"]),
        "by_channel": sl.sales_by_channel(t["orders"]),
        "ranking": sl.product_ranking(totals),
        "losses": sl.product_losses(totals),
    }


def customers(t: Tables) -> dict[str, DataFrame]:
    return {
        "kpis": cust.customer_kpis(t["orders"], t["customers"]),
        "orders": cust.customer_orders(t["orders"], t["customers"]),
        "profit": cust.customer_profit(
            t["orders"], t["order_items"], t["product_variants"], t["customers"]
        ),
        "person_types": cust.person_type_split(t["customers"]),
        "states": cust.customers_by_state(t["addresses"]),
    }


def forecast(t: Tables) -> dict[str, DataFrame]:
    filled = fc.daily_gapfill(fc.daily_orders(t["orders"]))
    ahead = fc.forecast_30d(filled)
    return {
        "mean": fc.forecast_mean(ahead),
        "history": fc.moving_avg_7d(filled),
        "chart": fc.history_plus_forecast(filled, ahead),
        "days": ahead,
    }


def recommendations(t: Tables, customer_id: int | None = None) -> dict[str, DataFrame]:
    shop = (t["order_items"], t["product_variants"], t["products"])
    return {
        "pairs": recommend.product_pairs_named(*shop),
        "customers": recommend.customer_list(t["orders"]),
        "next_purchase": recommend.next_purchase(t["orders"], *shop, customer_id),
    }


def order_quality(orders: DataFrame) -> dict[str, DataFrame]:
    """The quality page over the warehouse orders, without any correction."""
    limits = profile.fences(orders)
    return {
        "summary": profile.v_orders_eda(orders),
        "diagnosis": profile.q1_diagnosis(orders),
        "histogram": profile.eda_histogram(orders, 40),
        "outlier_summary": profile.eda_outlier_summary(orders, limits),
        "outliers": profile.eda_outliers(orders, limits),
        "monthly": profile.v_orders_by_month(orders),
        "by_channel": profile.v_orders_by_channel(orders),
        "nulls": profile.orders_null_pct(orders),
    }
