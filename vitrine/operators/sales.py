"""Revenue over time and by channel; product margin, ranking and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine import schemas
from vitrine.operators.profile import mean


def sum_or_zero(column: str | Column) -> Column:
    """Exact sum as double; 0 where there is nothing to add."""
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def sales_monthly(orders: DataFrame) -> DataFrame:
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit(schemas.NULL_MONTH))
    return (
        orders.groupBy(month.alias("mes"))
        .agg(
            sum_or_zero("total").alias("receita"),
            F.count("id").alias("pedidos"),
            mean("total").alias("ticket_medio"),
        )
        .orderBy("mes")
    )


def sales_kpis(orders: DataFrame, returns: DataFrame) -> DataFrame:
    returned = returns.agg(F.count(F.lit(1))).scalar()
    return orders.agg(
        sum_or_zero("total").alias("receita"),
        F.count(F.lit(1)).alias("pedidos"),
        mean("total").alias("ticket_medio"),
    ).withColumn("devolucoes", returned)


def sales_by_channel(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("channel")
        .agg(sum_or_zero("total").alias("receita"), F.count("id").alias("pedidos"))
        .orderBy(F.asc_nulls_last("channel"))
    )


def margin(line_total: Column, quantity: Column, cost: Column) -> Column:
    return line_total - quantity * cost


def item_margin(items: DataFrame, variants: DataFrame, products: DataFrame) -> DataFrame:
    """Every order item with its product name, unit cost and profit.

    Variants and products are joined first, so the items are joined only once.
    Both sides of that join are shuffled as they are, which lets adaptive
    execution split a variant that fills much of the table.
    """
    names = products.select(F.col("id").alias("product_id"), "name")
    dim = (
        variants.select(F.col("id").alias("product_variant_id"), "product_id", "cost_price")
        .join(names, "product_id", "left")
        .select("product_variant_id", "cost_price", "name")
    )
    return (
        items.select("order_id", "product_variant_id", "quantity", "line_total")
        .join(dim, "product_variant_id", "left")
        .withColumn(
            "profit", margin(F.col("line_total"), F.col("quantity"), F.col("cost_price"))
        )
    )


def product_totals(items: DataFrame, variants: DataFrame, products: DataFrame) -> DataFrame:
    """Units, revenue and profit by product name.

    Cost is constant within a variant, so items are summed per variant before
    any join: a variant that fills a third of the table reaches the shuffle as
    one row per task. Items that lack a total or a quantity add nothing to the
    profit, so what they add to the other sums is kept aside.
    """
    unpriced = F.col("line_total").isNull() | F.col("quantity").isNull()
    per_variant = items.groupBy("product_variant_id").agg(
        F.sum("quantity").alias("_units"),
        F.sum("line_total").alias("_revenue"),
        F.sum(F.when(unpriced, F.col("quantity"))).alias("_unpriced_units"),
        F.sum(F.when(unpriced, F.col("line_total"))).alias("_unpriced_revenue"),
    )
    costs = variants.select(
        F.col("id").alias("product_variant_id"), "product_id", "cost_price"
    )
    names = products.select(F.col("id").alias("product_id"), "name")

    def priced(total: str, unpriced_part: str) -> Column:
        return F.col(total) - F.coalesce(F.col(unpriced_part), F.lit(0))

    profit = margin(
        priced("_revenue", "_unpriced_revenue"),
        priced("_units", "_unpriced_units"),
        F.col("cost_price"),
    )
    return (
        per_variant.join(costs, "product_variant_id", "left")
        .join(names, "product_id", "left")
        .groupBy("name")
        .agg(
            sum_or_zero("_units").alias("unidades"),
            sum_or_zero("_revenue").alias("receita"),
            sum_or_zero(profit).alias("lucro"),
        )
    )


def product_ranking(totals: DataFrame, n: int = 20) -> DataFrame:
    return totals.orderBy(F.desc("unidades"), "name").limit(n)


def product_losses(totals: DataFrame, n: int = 20) -> DataFrame:
    """Products that lost money overall, worst first."""
    return totals.filter("lucro < 0").orderBy("lucro", "name").limit(n)
