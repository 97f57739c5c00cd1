"""Daily orders on a gap-free calendar, their trend and a 30-day projection.

After the first grouping there is one row per calendar day, whatever the number
of orders, so the windows over the whole calendar stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

HORIZON_DAYS = 30
MEAN_DAYS = 7


def _calendar() -> WindowSpec:
    return Window.orderBy("dia")


def _all_days() -> WindowSpec:
    return Window.partitionBy()


def daily_orders(orders: DataFrame) -> DataFrame:
    day = F.to_date("created_at").alias("dia")
    return (
        orders.filter(F.col("created_at").isNotNull())
        .groupBy(day)
        .agg(F.count(F.lit(1)).alias("pedidos"))
    )


def daily_gapfill(daily: DataFrame) -> DataFrame:
    """Every day from the first to the last; days without orders have 0.

    Each day is stretched up to the next one present, so ``daily`` is read once.
    """
    last = F.coalesce(F.date_sub(F.lead("dia").over(_calendar()), 1), F.col("dia"))
    return (
        daily.withColumn("_last", last)
        .select(
            F.col("dia").alias("_first"),
            "pedidos",
            F.explode(F.sequence("dia", "_last", F.expr("interval 1 day"))).alias("dia"),
        )
        .select(
            "dia",
            F.when(F.col("dia") == F.col("_first"), F.col("pedidos"))
            .otherwise(F.lit(0)).alias("pedidos"),
        )
    )


def moving_avg_7d(filled: DataFrame) -> DataFrame:
    """Trailing mean over up to seven days."""
    frame = _calendar().rowsBetween(1 - MEAN_DAYS, 0)
    return filled.withColumn("media_movel_7d", F.avg("pedidos").over(frame)).orderBy("dia")


def _fit(filled: DataFrame) -> DataFrame:
    """One row: last day, number of days, slope, intercept, mean of the last days."""
    indexed = filled.select(
        "dia",
        "pedidos",
        F.date_diff("dia", F.min("dia").over(_all_days())).cast("double").alias("_x"),
        F.date_diff(F.max("dia").over(_all_days()), "dia").alias("_age"),
    )
    y = F.col("pedidos").cast("double")
    return indexed.agg(
        F.max("dia").alias("ultimo_dia"),
        F.count(F.lit(1)).alias("dias"),
        # The regression is undefined on fewer than two days: flat line at the mean.
        F.coalesce(F.regr_slope(y, "_x"), F.lit(0.0)).alias("inclinacao"),
        F.coalesce(F.regr_intercept(y, "_x"), F.avg(y), F.lit(0.0)).alias("intercepto"),
        F.avg(F.when(F.col("_age") < MEAN_DAYS, y)).alias("media_recente"),
    )


def linear_trend(filled: DataFrame) -> DataFrame:
    """Least-squares line over the day index."""
    return _fit(filled).select("inclinacao", "intercepto")


def forecast_30d(filled: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """Mean of the trend line and the recent mean, never below 0; no rows without history."""
    ahead = F.col("_k")
    line = F.col("intercepto") + F.col("inclinacao") * (F.col("dias") - 1 + ahead)
    return (
        _fit(filled)
        .filter(F.col("ultimo_dia").isNotNull())
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_k"))
        .select(
            F.date_add("ultimo_dia", ahead).alias("dia"),
            F.greatest(F.lit(0.0), (line + F.col("media_recente")) / 2)
            .alias("pedidos_previstos"),
        )
        .orderBy("dia")
    )


def forecast_mean(forecast: DataFrame) -> DataFrame:
    return forecast.agg(F.avg("pedidos_previstos").alias("media_prevista"))


def history_plus_forecast(filled: DataFrame, forecast: DataFrame) -> DataFrame:
    past = filled.select(
        "dia", F.col("pedidos").cast("double").alias("valor"), F.lit("Histórico").alias("tipo")
    )
    future = forecast.select(
        "dia", F.col("pedidos_previstos").alias("valor"), F.lit("Previsão").alias("tipo")
    )
    return past.unionByName(future)
