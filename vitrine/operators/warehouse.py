"""The typed load of the declared tables: all of them, or none."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine import schemas
from vitrine.operators import profile
from vitrine.operators.manifest import REFRESH, Part, commit, read, snapshot
from vitrine.operators.quality import audit_references, audit_table, require_valid
from vitrine.sources.csv_files import list_csv_tables, read_csv_typed


def load_warehouse(spark: SparkSession, folder: str, out: str, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Load the CSV files of ``folder`` into their declared types and return the tables.

    Every file of a declared table is taken, or those of ``names``. A field that does not fit its
    type ends the load, and so does a broken rule: required and too long values, keys, unique
    columns, domains, references among the loaded tables. One commit makes all tables seen, in place of those of the load
    before; a load that ends early, or that another one overtakes, leaves these to the readers.
    """
    paths = list_csv_tables(spark, folder)
    chosen = [n for n in names or schemas.WAREHOUSE if n in paths]
    missing = sorted(set(names or ()) - set(chosen))
    if missing:
        raise FileNotFoundError(f"no CSV table {', '.join(missing)} in {folder}")
    before = snapshot(spark, out)
    name = f"load-{before.number + 1}-{uuid.uuid4().hex}"
    parts, loaded = [], {}
    for table in chosen:
        part = Part("warehouse", table, f"{table}/part={name}")
        schema = schemas.WAREHOUSE[table].schema
        read_csv_typed(spark, paths[table], schema).write.parquet(f"{out}/{part.path}")
        loaded[table] = spark.read.schema(schema).parquet(f"{out}/{part.path}")
        parts.append(part)
    if loaded:
        require_valid(warehouse_report(loaded))
    commit(spark, before, REFRESH, name, parts)
    return loaded


def warehouse_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The violations of every declared rule of the tables: ``(regra, violacoes)``; all references in one job."""
    reports = [
        audit_table(df, schemas.WAREHOUSE[name], {}).select(F.concat(F.lit(f"{name}."), "regra").alias("regra"), "violacoes")
        for name, df in tables.items()
    ]
    references = audit_references(tables, schemas.WAREHOUSE)
    return reduce(DataFrame.unionByName, reports).unionByName(
        references.select(F.concat("tabela", F.lit(".reference:"), "coluna").alias("regra"), F.col("valores").alias("violacoes"))
    )


def read_warehouse(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the last complete load."""
    found = snapshot(spark, out)
    if not found.refreshed:
        raise FileNotFoundError(f"no complete load below {out}")
    return {t: read(spark, schemas.WAREHOUSE[t].schema, found.paths("warehouse", t)) for t in found.tables("warehouse")}


def order_views(loaded: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The declared views over the loaded orders, by name; they are registered for SQL as well."""
    views = (profile.v_orders_eda, profile.v_orders_by_month, profile.v_orders_by_channel, profile.v_orders_nulls)
    profile.register_views(loaded["orders"])
    return {view.__name__: view(loaded["orders"]) for view in views}
