"""Cleaning of one table, and the raw-against-treated report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vitrine import schemas
from vitrine.functions import coercion
from vitrine.functions.names import named


def exact_dedup(df: DataFrame) -> DataFrame:
    """Drop exact copies of a row; nulls count as equal.

    Copies collapse within each task before the shuffle, so a group of copies
    reaches the shuffle at most once per task.
    """
    return df.dropDuplicates()


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType == T.StringType()


def coerce_dates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            c: coercion.to_timestamp_or_null(named(c), c)
            for c in df.columns
            if schemas.is_date_column(c) and _is_text(df, c)
        }
    )


def coerce_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            c: coercion.to_number_or_null(named(c), c)
            for c in df.columns
            if schemas.is_numeric_column(c)
        }
    )


def trim_customer_ids(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            c: coercion.strip(F.col(c))
            for c in schemas.TRIMMED_CUSTOMER_COLUMNS
            if c in df.columns
        }
    )


def coerce_table(df: DataFrame, table: str) -> DataFrame:
    """The cell-level part of the treatment."""
    df = df.transform(coerce_dates).transform(coerce_numbers)
    return trim_customer_ids(df) if table == "customers" else df


def treat_table(df: DataFrame, table: str) -> DataFrame:
    return coerce_table(exact_dedup(df), table)


def treat_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: treat_table(df, name) for name, df in raw.items()}


def _null_cells(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [named(c).isNull().cast("long") for c in columns])


def _table_report(df: DataFrame, table: str) -> DataFrame:
    """One grouping by whole rows yields both sides: copies per distinct row."""
    distinct = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    measured = coerce_table(
        distinct.withColumn("_nulls_raw", _null_cells(df.columns)), table
    ).select("_copies", "_nulls_raw", _null_cells(df.columns).alias("_nulls_treated"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return measured.agg(
        total(F.col("_copies")).alias("raw_linhas"),
        F.count(F.lit(1)).alias("treated_linhas"),
        total(F.col("_copies") - 1).alias("duplicados_removidos"),
        total(F.col("_copies") * F.col("_nulls_raw")).alias("nulos_raw"),
        total(F.col("_nulls_treated")).alias("nulos_treated"),
    ).select(F.lit(table).alias("tabela"), "*")


def treatment_report(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, copies removed and null cells before and after treatment."""
    reports = [_table_report(df, name) for name, df in raw.items()]
    return reduce(DataFrame.unionByName, reports).orderBy(F.desc("nulos_raw"), "tabela")


def stored_report(profile: DataFrame) -> DataFrame:
    """The same from the counts ``(layer, source_table, coluna, linhas, nulos)`` that were kept when the layers were written.

    Null cells are those of the columns that a table has in both layers.
    """
    def side(layer: str) -> DataFrame:
        rows = F.col("linhas").alias(f"{layer}_linhas")
        return profile.filter(F.col("layer") == layer).select("source_table", "coluna", rows, F.col("nulos").alias(f"nulos_{layer}"))

    both = side("raw").join(side("treated"), ["source_table", "coluna"])
    return (
        both.groupBy(F.col("source_table").alias("tabela"))
        .agg(
            F.max("raw_linhas").alias("raw_linhas"), F.max("treated_linhas").alias("treated_linhas"),
            F.max(F.col("raw_linhas") - F.col("treated_linhas")).alias("duplicados_removidos"),
            F.sum("nulos_raw").alias("nulos_raw"), F.sum("nulos_treated").alias("nulos_treated"),
        )
        .orderBy(F.desc("nulos_raw"), "tabela")
    )


def top_tables(report: DataFrame, measure: str, n: int = 12) -> DataFrame:
    """The ``n`` tables with the highest ``measure`` of the report."""
    return report.select("tabela", measure).orderBy(F.desc(measure), "tabela").limit(n)
