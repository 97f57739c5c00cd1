"""SQL text as a source, optional tables, catalog facts and the raw layer."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def sql_source(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Run SQL text; ``views`` are registered as temporary views first."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def jdbc_source(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The same over a database that the caller names and has a driver for."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def table_or_empty(
    spark: SparkSession, tables: Mapping[str, DataFrame], name: str, schema: T.StructType
) -> DataFrame:
    """The named table, or an empty one in ``schema`` where it is missing."""
    found = tables.get(name)
    return spark.createDataFrame([], schema) if found is None else found


def payload_table(raw: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Rows of one source table, read back from the JSON payloads of the raw layer.

    Payload values are text; each is cast to its declared type, or null if it cannot be.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = raw.filter(F.col("source_table") == table).select(
        "source_row_number", F.from_json("payload", text).alias("_row")
    )
    return parsed.select(
        "source_row_number",
        *[F.col("_row")[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields],
    )


def catalog_columns(df: DataFrame) -> DataFrame:
    """Position, name and type of every column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "posicao int, coluna string, tipo string")


def file_schemas(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, T.StructType]:
    """The schemas that Parquet tables hold, by their footers, several looked up at a time."""
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(paths, pool.map(lambda p: spark.read.parquet(p).schema, paths.values()), strict=True))


#: How a column differs from its declaration.
LOST, ADDED, RETYPED = "perdida", "nova", "tipo"


def schema_drift(spark: SparkSession, found: Mapping[str, T.StructType], declared: Mapping[str, T.StructType]) -> DataFrame:
    """Where the schemas of files differ from the declared ones: ``(tabela, coluna, situacao, declarado, encontrado)``.

    A column is lost, added or of another type. Only schemas are compared, so no row is read; tables
    on one side only are left out.
    """
    rows = []
    for name in sorted(set(found) & set(declared)):
        have, want = ({f.name: f.dataType.simpleString() for f in side[name].fields} for side in (found, declared))
        rows += [(name, c, LOST, kind, None) for c, kind in want.items() if c not in have]
        rows += [(name, c, ADDED, None, kind) for c, kind in have.items() if c not in want]
        rows += [(name, c, RETYPED, kind, have[c]) for c, kind in want.items() if have.get(c, kind) != kind]
    return spark.createDataFrame(rows, "tabela string, coluna string, situacao string, declarado string, encontrado string")


def load_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """How many tables were loaded, and how many orders."""
    count = F.count(F.lit(1)).alias("pedidos")
    orders = tables["orders"].agg(count)
    return orders.select(F.lit(len(tables)).cast("long").alias("tabelas"), "pedidos")


def source_identity(spark: SparkSession) -> DataFrame:
    """Current catalog and schema names."""
    return spark.sql("SELECT current_catalog() AS database, current_schema() AS schema")
