"""Names for the rows of a short report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def pin(report: DataFrame, limit: int) -> DataFrame:
    """Compute a report of at most ``limit`` rows once, for use in several joins.

    Spark would otherwise repeat the work behind a top-k for each use of it.
    """
    rows = report.limit(limit).toArrow()
    return report.sparkSession.createDataFrame(rows, schema=report.schema)


def keys(pinned: DataFrame, *columns: str) -> list:
    """Distinct non-null values of a pinned report."""
    values = {r[c] for r in pinned.select(*columns).collect() for c in columns}
    return sorted(v for v in values if v is not None)


def few(dim: DataFrame, wanted: Iterable, key: str = "id") -> DataFrame:
    """The dimension rows with the wanted keys; the filter reaches the file scan."""
    return dim.filter(F.col(key).isin(list(wanted)))


def few_variant_names(variants: DataFrame, products: DataFrame, wanted: list) -> DataFrame:
    """Product names of a short list of variants.

    Grouping leaves one row per wanted id, so no more than ``wanted`` rows are
    broadcast, and the products are not shuffled.
    """
    chosen = (
        few(variants, wanted)
        .groupBy(F.col("id").alias("product_variant_id"))
        .agg(F.min("product_id").alias("product_id"))
    )
    return (
        products.select(F.col("id").alias("product_id"), "name")
        .join(F.broadcast(chosen), "product_id")
        .select("product_variant_id", "name")
    )


def variant_names(variants: DataFrame, products: DataFrame) -> DataFrame:
    """Product name of every variant."""
    names = products.select(F.col("id").alias("product_id"), "name")
    return (
        variants.select(F.col("id").alias("product_variant_id"), "product_id")
        .join(names, "product_id", "left")
        .select("product_variant_id", "name")
    )
