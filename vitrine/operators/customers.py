"""Orders, repurchase, profit, person type and state of the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitrine.operators.lookup import few, keys, pin
from vitrine.operators.sales import margin, sum_or_zero


def _identity(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("id").alias("customer_id"), "legal_name", "person_type")


def orders_per_customer(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count("id").alias("pedidos"), sum_or_zero("total").alias("receita"))
        .withColumn("recompra", F.col("pedidos") > 1)
    )


def customer_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders, revenue and repurchase of each customer that ordered."""
    return orders_per_customer(orders).join(_identity(customers), "customer_id", "left")


def customer_kpis(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Active customers, repurchase rate, revenue per customer, and the PF and PJ counts."""
    kinds = customers.agg(
        F.struct(
            F.count_if(F.col("person_type") == "PF").alias("pf"),
            F.count_if(F.col("person_type") == "PJ").alias("pj"),
        )
    ).scalar()
    # Revenue is summed as a decimal over all orders: exact in every row order.
    known = orders.filter(F.col("customer_id").isNotNull())
    per_customer = known.groupBy("customer_id").agg(
        F.count("id").alias("pedidos"), F.sum("total").alias("receita")
    )
    active = F.count(F.lit(1))
    return (
        per_customer.agg(
            active.alias("clientes_ativos"),
            (
                F.count_if(F.col("pedidos") > 1) * 100.0 / F.nullif(active, F.lit(0))
            ).cast("double").alias("taxa_recompra"),
            (F.coalesce(F.sum("receita"), F.lit(0)).cast("double") / F.nullif(active, F.lit(0)))
            .alias("receita_media"),
        )
        .withColumn("pf", kinds.getField("pf"))
        .withColumn("pj", kinds.getField("pj"))
    )


def customer_profit(
    orders: DataFrame, items: DataFrame, variants: DataFrame, customers: DataFrame, n: int = 20
) -> DataFrame:
    """Customers with the highest accumulated profit; orders without items count as 0.

    Profit is summed per order before the join with the orders, on the same
    key, so an order of any size is one row per task when it is shuffled.
    """
    costs = variants.select(F.col("id").alias("product_variant_id"), "cost_price")
    per_order = (
        items.select("order_id", "product_variant_id", "quantity", "line_total")
        .join(costs, "product_variant_id", "left")
        .groupBy("order_id")
        .agg(
            F.sum(margin(F.col("line_total"), F.col("quantity"), F.col("cost_price")))
            .alias("_profit")
        )
    )
    order = [F.desc("lucro"), F.asc_nulls_last("customer_id")]
    top = pin(
        orders.select(F.col("id").alias("order_id"), "customer_id")
        .join(per_order, "order_id", "left")
        .groupBy("customer_id")
        .agg(sum_or_zero("_profit").alias("lucro"))
        .orderBy(*order),
        n,
    )
    named = _identity(few(customers, keys(top, "customer_id")))
    return (
        top.join(named, "customer_id", "left")
        .select("customer_id", "legal_name", "person_type", "lucro")
        .orderBy(*order)
    )


def person_type_split(customers: DataFrame) -> DataFrame:
    """Customers per person type and their share in percent."""
    counted = customers.groupBy("person_type").agg(F.count(F.lit(1)).alias("clientes"))
    # One row per person type.
    everyone = F.sum("clientes").over(Window.partitionBy())
    share = (F.col("clientes") * 100.0 / everyone).cast("double")
    return counted.withColumn("percentual", share).orderBy(F.asc_nulls_last("person_type"))


def customers_by_state(addresses: DataFrame) -> DataFrame:
    """Address rows and distinct customers per state.

    The customer columns play no part and ``customers.id`` is unique, so the
    join to the customers is left out; the key audit guards that.
    """
    return (
        addresses.groupBy("state")
        .agg(
            F.count(F.lit(1)).alias("clientes"),
            F.count_distinct("customer_id").alias("clientes_distintos"),
        )
        .orderBy(F.asc_nulls_last("state"))
    )
