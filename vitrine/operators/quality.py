"""Audits of the declared constraints, and column defaults.

Spark tables do not enforce keys, references, domains or lengths, so each
rule is a job that returns what breaks it. Grouped rules count per task before
the shuffle; row rules need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vitrine.schemas import Table


def audit_pk(df: DataFrame, *key: str) -> DataFrame:
    """Key values that are null or occur more than once, with their row counts."""
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("linhas"))
    return counted.filter((F.col("linhas") > 1) | null)


def audit_unique(df: DataFrame, column: str) -> DataFrame:
    """Non-null values that occur more than once."""
    return audit_pk(df.filter(F.col(column).isNotNull()), column)


def audit_fk(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Non-null references without a parent row, with their row counts.

    The child is reduced to one row per value before the join, so a value that
    fills the table costs no more than any other.
    """
    referenced = (
        child.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("linhas"))
    )
    keys = parent.select(F.col(key).alias("_key")).distinct()
    return referenced.join(keys, F.col(column) == F.col("_key"), "left_anti")


def audit_keys(df: DataFrame, key: str, unique: Iterable[str] = ()) -> DataFrame:
    """All broken key and unique values of a table, with their row counts: ``(regra, valor, linhas)``.

    Each row gives one (rule, value) a rule, and these are counted together: one pass, one exchange, and
    a value that fills the table is one row a task in it. Null keys are broken, null unique values are not.
    """

    def entry(rule: str, column: str) -> Column:
        return F.struct(F.lit(rule).alias("regra"), F.col(column).cast("string").alias("valor"))

    entries = [entry(f"primary_key:{key}", key)] if key in df.columns else []
    entries += [F.when(F.col(c).isNotNull(), entry(f"unique:{c}", c)) for c in unique if c in df.columns]
    if not entries:
        return df.sparkSession.createDataFrame([], "regra string, valor string, linhas long")
    counted = (
        df.select(F.explode(F.array(*entries)).alias("_entry")).filter("_entry is not null").select("_entry.*")
        .groupBy("regra", "valor").agg(F.count(F.lit(1)).alias("linhas"))
    )
    return counted.filter((F.col("linhas") > 1) | F.col("valor").isNull())


def audit_references(tables: Mapping[str, DataFrame], declared: Mapping[str, Table]) -> DataFrame:
    """References without a parent row, of all tables at once: ``(tabela, coluna, referencia, valores, linhas)``.

    The values of child columns and the keys of parents are tagged and counted together, by the parent they
    belong to; so all references, those of a table to itself too, take one exchange of values
    that were reduced in each task. References to tables that aren't there are left out; one
    without broken values has zeros.
    """
    found = [
        (name, column, parent, declared[parent].key)
        for name, table in declared.items() if name in tables
        for column, parent in table.references.items() if column in tables[name].columns and parent in tables
    ]
    schema = "tabela string, coluna string, referencia string, valores long, linhas long"
    if not found:
        return next(iter(tables.values())).sparkSession.createDataFrame([], schema)
    parents = {parent: key for _, _, parent, key in found}
    sides = [
        tables[p].select(F.lit(p).alias("_parent"), F.col(key).cast("string").alias("_value"), F.lit(-1).alias("_tag")) for p, key in parents.items()
    ]
    sides += [
        tables[name].select(F.lit(parent).alias("_parent"), F.col(column).cast("string").alias("_value"), F.lit(tag).alias("_tag"))
        for tag, (name, column, parent, _) in enumerate(found)
    ]
    tagged = reduce(DataFrame.unionByName, sides).filter("_value is not null")
    counts = [F.count_if(F.col("_tag") == tag).alias(f"_{tag}") for tag in range(len(found))]
    values = tagged.groupBy("_parent", "_value").agg(F.max(F.col("_tag") == -1).alias("_held"), *counts).filter("not _held")
    sums = values.agg(
        *[F.count_if(F.col(f"_{tag}") > 0).alias(f"_values{tag}") for tag in range(len(found))],
        *[F.coalesce(F.sum(f"_{tag}"), F.lit(0)).alias(f"_rows{tag}") for tag in range(len(found))],
    )
    rows = [
        F.struct(
            F.lit(name).alias("tabela"), F.lit(column).alias("coluna"), F.lit(f"{parent}.{key}").alias("referencia"),
            F.col(f"_values{tag}").alias("valores"), F.col(f"_rows{tag}").alias("linhas"),
        )
        for tag, (name, column, parent, key) in enumerate(found)
    ]
    return sums.select(F.explode(F.array(*rows)).alias("_row")).select("_row.*")


def audit_domains(tables: Mapping[str, DataFrame], declared: Mapping[str, Table]) -> DataFrame:
    """Values outside the declared domains of all tables: ``(tabela, coluna, valor, linhas)``; null is in every domain."""
    parts = [
        tables[name].filter(breaks_domain(F.col(column), values)).select(
            F.lit(name).alias("tabela"), F.lit(column).alias("coluna"), F.col(column).cast("string").alias("valor")
        )
        for name, table in declared.items() if name in tables
        for column, values in table.domains.items() if column in tables[name].columns
    ]
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "tabela string, coluna string, valor string, linhas long")
    return reduce(DataFrame.unionByName, parts).groupBy("tabela", "coluna", "valor").agg(F.count(F.lit(1)).alias("linhas"))


def breaks_domain(col: Column, values: Iterable[str]) -> Column:
    return ~col.isin(*values)


def breaks_length(col: Column, n: int) -> Column:
    return F.length(col) > n


def breaks_decimal(col: Column, precision: int, scale: int) -> Column:
    return col.isNotNull() & col.try_cast(T.DecimalType(precision, scale)).isNull()


def breaks_json(col: Column) -> Column:
    return col.isNotNull() & F.try_parse_json(col).isNull()


def audit_domain(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return df.filter(breaks_domain(F.col(column), values))


def audit_length(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.filter(breaks_length(F.col(column), n))


def audit_decimal_range(df: DataFrame, column: str, precision: int, scale: int) -> DataFrame:
    return df.filter(breaks_decimal(F.col(column), precision, scale))


def audit_json(df: DataFrame, column: str) -> DataFrame:
    return df.filter(breaks_json(F.col(column)))


def audit_not_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Null count of each column, in one pass."""
    columns = list(columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "coluna", "nulos")


def row_rules(df: DataFrame, table: Table) -> dict[str, Column]:
    """The declared rules that a row breaks or keeps on its own, by name."""
    rules: dict[str, Column] = {}
    for c in table.columns:
        if c.name not in df.columns:
            continue
        col = F.col(c.name)
        if c.required:
            rules[f"not_null:{c.name}"] = col.isNull()
        if c.length is not None:
            rules[f"length:{c.name}"] = breaks_length(col, c.length)
        if isinstance(c.spark_type, T.DecimalType):
            rules[f"decimal:{c.name}"] = breaks_decimal(
                col, c.spark_type.precision, c.spark_type.scale
            )
        if c.sql_type == "json":
            rules[f"json:{c.name}"] = breaks_json(col)
        if c.name in table.domains:
            rules[f"domain:{c.name}"] = breaks_domain(col, table.domains[c.name])
    return rules


def broken_rules(df: DataFrame, table: Table) -> DataFrame:
    """``df`` plus the array of row rules that each row breaks (for quarantine)."""
    named = [F.when(broken, F.lit(name)) for name, broken in row_rules(df, table).items()]
    return df.withColumn("regras_violadas", F.array_compact(F.array(*named)))


def audit_table(df: DataFrame, table: Table, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Violation count of every declared rule: row rules in one pass, then keys and references."""
    rules = row_rules(df, table)
    counted = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    report = counted.unpivot([], [F.col(f"`{n}`") for n in rules], "regra", "violacoes")

    unique = [c for c in table.unique if c in df.columns]
    names = [f"primary_key:{table.key}"] * (table.key in df.columns) + [f"unique:{c}" for c in unique]
    if names:
        broken = audit_keys(df, table.key, unique).groupBy().agg(*[F.count_if(F.col("regra") == n).alias(n) for n in names])
        report = report.unionByName(broken.unpivot([], [F.col(f"`{n}`") for n in names], "regra", "violacoes"))
    for c, parent in table.references.items():
        if c in df.columns and parent in parents:
            broken = audit_fk(df, c, parents[parent]).agg(F.count(F.lit(1)).alias("violacoes"))
            report = report.unionByName(broken.select(F.lit(f"reference:{c}").alias("regra"), "violacoes"))
    return report


class ConstraintViolation(Exception):
    """Raised by :func:`require_valid`."""


def require_valid(report: DataFrame) -> None:
    """Stop the load if any rule of an audit report is broken."""
    broken = report.filter("violacoes > 0").orderBy("regra").collect()
    if broken:
        raise ConstraintViolation(", ".join(f"{r.regra}={r.violacoes}" for r in broken))


def fill_defaults(df: DataFrame, table: Table) -> DataFrame:
    """Add omitted columns that have a default; explicit nulls stay."""
    missing = {
        c.name: F.expr(c.default).cast(c.spark_type)
        for c in table.columns
        if c.default is not None and c.name not in df.columns
    }
    return df.withColumns(missing)
