"""Every operator as a named query ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vitrine import schemas
from vitrine.functions import coercion, text
from vitrine.operators import (
    customers as cust, forecast as fc, layers, profile, quality, recommend, sales, treatment, warehouse,
)
from vitrine.plans import binding
from vitrine.session import scratch_dir
from vitrine.sources import csv_files, tables as sources
from vitrine.streaming.arrivals import ingest_arrivals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name."""
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- Inputs written once per session ---------------------------------------

_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], object]) -> str:
    """The folder that ``write`` filled for this session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _written:
        folder = scratch_dir(spark, label)
        write(folder)
        _written[key] = folder
    return _written[key]


def forget(label: str) -> None:
    """Write the inputs of this label anew when they are asked for next."""
    for key in [k for k in _written if k[2] == label]:
        del _written[key]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text: long cells with line breaks and quotes."""
    return binding.read_table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as doc_id", "text", "lang", "source"
    )


def raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """The raw tables as a CSV folder."""
    tables = binding.raw_tables(spark, sf_dir) | {"documents": _documents(spark, sf_dir)}
    return _once(spark, sf_dir, "csv", lambda out: binding.export_csv(tables, out))


def clean_csv(spark: SparkSession, sf_dir: str) -> str:
    """Orders in their declared types, sorted by id across the part files."""
    orders = binding.logical_tables(spark, sf_dir, "orders")["orders"].withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("placed_at", "created_at", "updated_at")}
    )
    sorted_orders = orders.repartitionByRange("id").sortWithinPartitions("id")
    return _once(
        spark, sf_dir, "clean", lambda out: binding.export_csv({"orders": sorted_orders}, out)
    )


def refreshed(spark: SparkSession, sf_dir: str) -> str:
    """Folder with both layers, built from the raw CSV folder."""
    folder = raw_csv(spark, sf_dir)
    return _once(
        spark, sf_dir, "layers", lambda out: layers.full_refresh(spark, folder, out)
    )


def quarantined(spark: SparkSession, sf_dir: str) -> str:
    """A refresh that sets broken orders apart."""
    orders = {"orders": binding.broken_orders(spark, sf_dir)}
    folder = raw_csv_of(spark, sf_dir, "broken", orders)
    return _once(spark, sf_dir, "apart", lambda out: layers.full_refresh(spark, folder, out, broken="quarantine"))


def replayed(spark: SparkSession, sf_dir: str) -> str:
    """The same, the broken orders taken in again under the ids that their numbers hold."""
    folder = raw_csv_of(spark, sf_dir, "broken", {"orders": binding.broken_orders(spark, sf_dir)})

    def write(out: str) -> None:
        layers.full_refresh(spark, folder, out, broken="quarantine")
        layers.replay(spark, out, "orders", lambda df: df.withColumn("id", F.substring("order_number", 5, 30).cast("long")))

    return _once(spark, sf_dir, "replayed", write)


def raw_csv_of(spark: SparkSession, sf_dir: str, label: str, tables: dict[str, DataFrame]) -> str:
    return _once(spark, sf_dir, label, lambda out: binding.export_csv(tables, out))


def followed(spark: SparkSession, sf_dir: str) -> str:
    """A refresh of the raw orders, and more orders that arrived since, merged."""
    first = raw_csv_of(spark, sf_dir, "first", binding.raw_tables(spark, sf_dir, "orders"))
    later = raw_csv_of(spark, sf_dir, "later", {"orders": binding.later_orders(spark, sf_dir)})
    columns = binding.later_orders(spark, sf_dir).columns

    def write(out: str) -> None:
        layers.full_refresh(spark, first, out, newest_wins=True)
        ingest_arrivals(spark, f"{later}/orders.csv", "orders", columns, out, f"{out}/state", multi_line=False).awaitTermination()
        layers.merge_arrivals(spark, out, "orders")

    return _once(spark, sf_dir, "followed", write)


def loaded_warehouse(spark: SparkSession, sf_dir: str) -> str:
    tables = binding.as_text(binding.warehouse_tables(spark, sf_dir))
    folder = raw_csv_of(spark, sf_dir, "declared", tables)
    return _once(spark, sf_dir, "warehouse", lambda out: warehouse.load_warehouse(spark, folder, out))


# --- Sources ----------------------------------------------------------------


@query
def csv_dir_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(name: str, df: DataFrame) -> DataFrame:
        lengths = reduce(
            lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in df.columns]
        )
        return df.agg(
            F.count(F.lit(1)).alias("linhas"),
            F.lit(len(df.columns)).cast("long").alias("colunas"),
            F.sum(lengths.cast("long")).alias("caracteres"),
        ).select(F.lit(name).alias("tabela"), "*")

    scanned = csv_files.scan_csv_dir(spark, raw_csv(spark, sf_dir))
    return _union([measure(name, df) for name, df in scanned.items()])


@query
def csv_typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{clean_csv(spark, sf_dir)}/orders.csv"
    loaded = csv_files.read_csv_typed(spark, path, schemas.WAREHOUSE["orders"].schema)
    return _double(loaded, "subtotal", "discount_amount", "total")


@query
def csv_folded_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose records span lines, typed."""
    path = f"{raw_csv(spark, sf_dir)}/documents.csv"
    schema = T.StructType.fromDDL("doc_id long, text string, lang string, source string")
    return csv_files.read_csv_typed(spark, path, schema)


@query
def na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = binding.raw_tables(spark, sf_dir, "orders")["orders"].select(
        "id", "channel", F.col("channel").alias("channel_copy")
    )
    cells = csv_files.null_tokens(cells, columns=["channel"])
    return csv_files.null_tokens(cells, ("",), columns=["channel_copy"])


@query
def source_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{clean_csv(spark, sf_dir)}/orders.csv"
    numbered = csv_files.read_csv_numbered(spark, path)
    return numbered.select(F.col("id").cast("long").alias("id"), "source_row_number")


@query
def sql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile.register_views(binding.logical_tables(spark, sf_dir, "orders")["orders"])
    return sources.sql_source(
        spark, "SELECT month, orders_count, total_sales FROM v_orders_by_month ORDER BY month"
    )


@query
def table_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = binding.logical_tables(spark, sf_dir, "orders")
    returns = sources.table_or_empty(spark, known, "returns", schemas.TREATED["returns"].schema)
    return sales.sales_kpis(known["orders"], returns)


@query
def json_payload_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = layers.read_raw(spark, refreshed(spark, sf_dir))
    schema = T.StructType.fromDDL("doc_id long, text string, lang string, source string")
    return sources.payload_table(raw, "documents", schema).drop("source_row_number")


@query
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rows of every table, by the schema that its files hold."""
    paths = {name: f"{sf_dir}/{name}.parquet" for name in binding.TABLES}
    frames = []
    for name, schema in sources.file_schemas(spark, paths).items():
        rows = spark.read.schema(schema).parquet(paths[name]).agg(F.count(F.lit(1)).alias("linhas"))
        frames.append(rows.select(F.lit(name).alias("tabela"), F.lit(len(schema)).cast("long").alias("colunas"), "linhas"))
    return _union(frames)


@query
def load_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.load_inventory(binding.logical_tables(spark, sf_dir))


# --- Layers -----------------------------------------------------------------


@query
def raw_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{raw_csv(spark, sf_dir)}/customers.csv"
    numbered = csv_files.read_csv_numbered(spark, path)
    rows = layers.raw_json_rows(numbered, "customers", 1)
    return rows.select("ingestion_run_id", "source_table", "payload")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.read_log(spark, refreshed(spark, sf_dir)).drop("created_at")


@query
def ingestion_run_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).filter("layer = 'raw'").drop("id")


@query
def ingestion_run_treated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).filter("layer = 'treated'").drop("id")


@query
def treated_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = layers.read_treated(spark, refreshed(spark, sf_dir))["orders"]
    return _double(
        orders.select(
            "id", "order_number", "channel", "customer_id", "location_id", "status", "total",
            "placed_at", "created_at", "source_run_id",
        ),
        "total",
    )


@query
def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table and layer as written, beside the logged row counts."""
    out = refreshed(spark, sf_dir)
    raw = layers.read_raw(spark, out).groupBy("source_table").agg(
        F.count(F.lit(1)).alias("linhas")
    )
    written = [raw.select("source_table", F.lit("raw").alias("layer"), "linhas")]
    for name, df in layers.read_treated(spark, out).items():
        counted = df.agg(F.count(F.lit(1)).alias("linhas"))
        written.append(
            counted.select(
                F.lit(name).alias("source_table"), F.lit("treated").alias("layer"), "linhas"
            )
        )
    log = _log(spark, sf_dir).select("id", "source_table", "layer", "row_count")
    return _union(written).join(log, ["source_table", "layer"], "full")


@query
def table_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = []
    for name, df in binding.logical_tables(spark, sf_dir).items():
        declared = layers.conform(df, schemas.TREATED[name])
        filled = reduce(
            lambda a, b: a + b, [F.col(c).isNotNull().cast("long") for c in declared.columns]
        )
        frames.append(
            declared.agg(
                F.count(F.lit(1)).alias("linhas"), F.sum(filled).alias("celulas_preenchidas")
            ).select(
                F.lit(name).alias("tabela"),
                F.lit(len(declared.columns)).cast("long").alias("colunas"),
                "linhas",
                "celulas_preenchidas",
            )
        )
    return _union(frames)


@query
def decimal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = binding.logical_tables(spark, sf_dir, "orders")["orders"]
    eighth = F.col("total") * F.lit("0.125").cast("decimal(4,3)")
    return _double(
        orders.select(
            "id",
            coercion.decimal_fit(eighth, T.DecimalType(18, 2)).alias("oitavo"),
            coercion.decimal_fit(F.col("total"), T.DecimalType(7, 2)).alias("ate_cinco_digitos"),
        ),
        "oitavo", "ate_cinco_digitos",
    )


def _as_line(df: DataFrame, table: str) -> DataFrame:
    """Each row as one text, so that rows of several tables can stand together."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]
    return df.select(F.lit(table).alias("tabela"), F.concat_ws("|", *cells).alias("linha"))


@query
def json_payload_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw table, read back from its payloads in the declared types."""
    raw = layers.read_raw(spark, refreshed(spark, sf_dir))
    found = {"documents": T.StructType.fromDDL("doc_id long, text string, lang string, source string")}
    for name, df in binding.raw_tables(spark, sf_dir).items():
        found[name] = T.StructType([f for f in schemas.TREATED[name].schema.fields if f.name in df.columns])
    return _union([_as_line(sources.payload_table(raw, n, schema).drop("source_row_number"), n) for n, schema in found.items()])


@query
def treated_tables_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every treated table as written, with all its declared columns."""
    return _union([_as_line(df, name) for name, df in layers.read_treated(spark, refreshed(spark, sf_dir)).items()])


@query
def raw_json_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = csv_files.read_csv_numbered(spark, f"{clean_csv(spark, sf_dir)}/orders.csv")
    return layers.raw_json_rows(numbered, "orders", 1).drop("created_at")


@query
def raw_after_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows of a refresh and of the files that arrived since."""
    return layers.read_raw(spark, followed(spark, sf_dir)).select("source_table", "payload")


@query
def treated_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The treated orders that follow those files, the newest row of each key."""
    orders = layers.read_treated(spark, followed(spark, sf_dir))["orders"]
    return _double(orders.drop("source_run_id"), "subtotal", "discount_amount", "total")


@query
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that a refresh sets apart, with the rules they break."""
    apart = layers.read_quarantine(spark, quarantined(spark, sf_dir))["orders"]
    return apart.select("id", "order_number", F.array_join("regras_violadas", ",").alias("regras"))


@query
def quarantine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order is after the broken ones were mended and taken in again."""
    out = replayed(spark, sf_dir)
    taken, left = layers.read_treated(spark, out)["orders"], layers.read_quarantine(spark, out)["orders"]
    return taken.select("id", "order_number", F.lit("").alias("regras")).unionByName(
        left.select("id", "order_number", F.array_join("regras_violadas", ",").alias("regras"))
    )


@query
def warehouse_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, null cells and sum of the ids of each declared table, as loaded."""
    frames = []
    for name, df in warehouse.read_warehouse(spark, loaded_warehouse(spark, sf_dir)).items():
        nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
        measured = df.agg(F.count(F.lit(1)).alias("linhas"), F.sum(nulls).alias("celulas_nulas"), F.sum("id").alias("soma_ids"))
        frames.append(measured.select(F.lit(name).alias("tabela"), "*"))
    return _union(frames)


@query
def warehouse_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared view over the loaded orders, by its name."""
    warehouse.order_views(warehouse.read_warehouse(spark, loaded_warehouse(spark, sf_dir)))
    return sources.sql_source(spark, "SELECT * FROM v_orders_by_channel")


@query
def table_schemas_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared schemas: columns, how the tables at hand differ, and the rows and filled cells once they conform."""
    out = refreshed(spark, sf_dir)
    control = {"ingestion_runs": layers.read_log(spark, out), "raw_csv_rows": layers.read_raw(spark, out)}
    found = {f"treated.{n}": df for n, df in binding.logical_tables(spark, sf_dir).items()}
    found |= {f"warehouse.{n}": df for n, df in binding.warehouse_tables(spark, sf_dir).items()}
    found |= {f"control.{n}": df for n, df in control.items()}
    declared = schemas.table_schemas()
    drift = sources.schema_drift(spark, {n: df.schema for n, df in found.items()}, declared)
    kinds = {sources.LOST: "perdidas", sources.ADDED: "novas", sources.RETYPED: "retipadas"}
    counted = drift.groupBy(F.col("tabela").alias("esquema")).agg(
        *[F.count_if(F.col("situacao") == kind).alias(name) for kind, name in kinds.items()]
    )
    frames = []
    for name, df in found.items():
        conformed = layers.conform(df, schemas.declared_table(name))
        filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("long") for c in conformed.columns])
        measured = conformed.agg(F.count(F.lit(1)).alias("linhas"), F.sum(filled).alias("celulas_preenchidas"))
        frames.append(measured.select(F.lit(name).alias("esquema"), F.lit(len(declared[name])).cast("long").alias("colunas"), "*"))
    return _union(frames).join(counted, "esquema", "left").na.fill(0, list(kinds.values()))


# --- Treatment --------------------------------------------------------------


@query
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.exact_dedup(binding.raw_tables(spark, sf_dir, "orders")["orders"])


@query
def coerce_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = binding.raw_tables(spark, sf_dir, "orders")["orders"]
    return treatment.coerce_dates(orders).select("id", "placed_at", "created_at")


@query
def coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = binding.raw_tables(spark, sf_dir, "order_items")["order_items"]
    return _double(treatment.coerce_numbers(items), "quantity", "line_total")


@query
def trim_customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = binding.raw_tables(spark, sf_dir, "customers")["customers"]
    return treatment.trim_customer_ids(customers).select("id", "tax_id", "phone", "email")


@query
def ids_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = raw_csv(spark, sf_dir)
    customers = csv_files.read_csv_text(spark, f"{folder}/customers.csv")
    variants = csv_files.read_csv_text(spark, f"{folder}/product_variants.csv")
    return _union(
        [
            customers.select(F.lit("phone").alias("coluna"), F.col("phone").alias("valor")),
            variants.select(
                F.lit("barcode_ean").alias("coluna"), F.col("barcode_ean").alias("valor")
            ),
            customers.select(F.lit("tax_id").alias("coluna"), F.col("tax_id").alias("valor")),
        ]
    )


@query
def treat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = csv_files.null_tokens(binding.raw_tables(spark, sf_dir, "orders")["orders"])
    return _double(treatment.treat_table(orders, "orders"), "total")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.raw_tables(spark, sf_dir)
    return treatment.treatment_report(
        {name: csv_files.null_tokens(df) for name, df in raw.items()}
    )


@query
def treatment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query
def treatment_report_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the counts kept with the layers; none of these is read."""
    return treatment.stored_report(layers.read_profile(spark, refreshed(spark, sf_dir)))


@query
def null_profile_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of the treated orders after a merge, from those counts."""
    return _round(profile.stored_null_profile(layers.read_profile(spark, followed(spark, sf_dir)), "orders"), "percentual")


@query
def top12_null_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.top_tables(_report(spark, sf_dir), "nulos_raw")


@query
def top12_dup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treatment.top_tables(_report(spark, sf_dir), "duplicados_removidos")


# --- Constraint audits ------------------------------------------------------


@query
def audit_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.audit_pk(
        binding.read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"
    )


@query
def audit_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = binding.raw_tables(spark, sf_dir, "customers")["customers"]
    return quality.audit_unique(customers, "tax_id")


@query
def audit_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(spark, sf_dir, "orders", "order_items")
    return quality.audit_fk(t["orders"], "id", t["order_items"], "order_id")


@query
def audit_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = binding.logical_tables(spark, sf_dir, "orders")["orders"]
    return quality.audit_domain(orders, "channel", ("1-URGENT", "2-HIGH")).select("id", "channel")


@query
def audit_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = binding.logical_tables(spark, sf_dir, "orders")["orders"]
    required = [c.name for c in schemas.WAREHOUSE["orders"].columns if c.required]
    return quality.audit_not_null(orders, required)


@query
def audit_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = binding.read_table(spark, sf_dir, "documents")
    return quality.audit_length(documents, "text", 255).select(
        "doc_id", F.length("text").cast("long").alias("tamanho")
    )


@query
def audit_decimal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = binding.raw_tables(spark, sf_dir, "order_items")["order_items"]
    return quality.audit_decimal_range(items, "line_total", 6, 2)


@query
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.when(
        F.col("event_type") == "error", F.replace("props", F.lit("}"), F.lit(""))
    ).otherwise(F.col("props"))
    events = binding.read_table(spark, sf_dir, "events").select("event_id", props.alias("props"))
    return quality.audit_json(events, "props")


@query
def column_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = binding.logical_tables(spark, sf_dir, "orders")["orders"].drop("subtotal")
    filled = quality.fill_defaults(orders, schemas.WAREHOUSE["orders"])
    return _double(
        filled.select("id", "subtotal", "discount_amount", "total"),
        "subtotal", "discount_amount", "total",
    )


@query
def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(spark, sf_dir)
    return quality.audit_table(t["orders"], schemas.WAREHOUSE["orders"], t)


@query
def audit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = binding.raw_tables(spark, sf_dir, "customers")["customers"]
    return quality.audit_keys(customers, "id", ("tax_id", "email"))


@query
def audit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared references, those of the control tables too."""
    out = refreshed(spark, sf_dir)
    control = {"ingestion_runs": layers.read_log(spark, out), "raw_csv_rows": layers.read_raw(spark, out)}
    return quality.audit_references(binding.broken_tables(spark, sf_dir) | control, schemas.WAREHOUSE | schemas.CONTROL)


@query
def audit_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared domains: the kinds of customers, and the layers in the log, one record of which has a layer of its own."""
    log = layers.read_log(spark, refreshed(spark, sf_dir))
    log = log.withColumn("layer", F.when(F.col("source_table") == "documents", F.lit("bruto")).otherwise(F.col("layer")))
    tables = binding.broken_tables(spark, sf_dir) | {"ingestion_runs": log}
    return quality.audit_domains(tables, schemas.WAREHOUSE | schemas.CONTROL)


# --- Exploration ------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.logical_tables(spark, sf_dir, "orders")["orders"]


@query
def eda_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.eda_overview(_orders(spark, sf_dir))


@query
def eda_total_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.eda_total_stats(_orders(spark, sf_dir)), "valor")


@query
def eda_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(
        profile.eda_quartiles(_orders(spark, sf_dir)),
        "q1", "q3", "iqr", "limite_inferior", "limite_superior",
    )


@query
def eda_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.eda_outliers(binding.value_series(spark, sf_dir))
    return _round(_double(df, "total"), "limite_inferior", "limite_superior")


@query
def eda_outlier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.eda_outlier_summary(_orders(spark, sf_dir))
    return _round(df, "limite_inferior", "limite_superior")


@query
def eda_outlier_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = profile.eda_outlier_flag(binding.value_series(spark, sf_dir))
    return _double(flagged.select("id", "total", "outlier_iqr"), "total")


@query
def eda_histogram_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.eda_histogram(_orders(spark, sf_dir), 50), "inicio", "fim")


@query
def eda_histogram_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.eda_histogram(binding.value_series(spark, sf_dir), 40), "inicio", "fim")


@query
def eda_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.eda_null_profile(_orders(spark, sf_dir)), "percentual")


@query
def v_orders_eda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.v_orders_eda(_orders(spark, sf_dir))


@query
def v_orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.v_orders_by_month(_orders(spark, sf_dir))


@query
def v_orders_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.v_orders_by_channel(_orders(spark, sf_dir))


@query
def v_orders_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.v_orders_nulls(_orders(spark, sf_dir))


@query
def orders_null_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.orders_null_pct(_orders(spark, sf_dir))


@query
def q1_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(
        profile.q1_iqr_outliers(_orders(spark, sf_dir)), "limite_inferior", "limite_superior"
    )


@query
def q1_iqr_outliers_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(
        profile.q1_iqr_outliers(binding.value_series(spark, sf_dir)),
        "limite_inferior", "limite_superior",
    )


@query
def q1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.q1_summary(_orders(spark, sf_dir))


@query
def q1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.q1_quality(_orders(spark, sf_dir))


@query
def q1_quality_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over doubles that hold NaN and infinities."""
    total = "case event_type when 'error' then double('NaN') when 'signup' then double('Infinity') when 'purchase' then -double('Infinity') else value end"
    events = binding.read_table(spark, sf_dir, "events").selectExpr("ts as created_at", f"{total} as total")
    return profile.q1_quality(events)


@query
def q1_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    treated = treatment.treat_table(
        csv_files.null_tokens(binding.raw_tables(spark, sf_dir, "orders")["orders"]), "orders"
    )
    return profile.q1_diagnosis(treated)


@query
def orders_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _double(profile.orders_projection(_orders(spark, sf_dir)), "total")


# --- Sales ------------------------------------------------------------------


@query
def sales_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.sales_monthly(_orders(spark, sf_dir))


@query
def sales_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(spark, sf_dir, "orders", "returns")
    return sales.sales_kpis(t["orders"], t["returns"])


@query
def sales_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.sales_by_channel(_orders(spark, sf_dir))


@query
def item_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(
        spark, sf_dir, "order_items", "product_variants", "products"
    )
    df = sales.item_margin(t["order_items"], t["product_variants"], t["products"])
    return _double(df, "quantity", "line_total", "cost_price", "profit")


def _product_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(
        spark, sf_dir, "order_items", "product_variants", "products"
    )
    return sales.product_totals(t["order_items"], t["product_variants"], t["products"])


@query
def product_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.product_ranking(_product_totals(spark, sf_dir))


@query
def product_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.product_losses(_product_totals(spark, sf_dir))


# --- Customers --------------------------------------------------------------


@query
def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(spark, sf_dir, "orders", "customers")
    return cust.customer_orders(t["orders"], t["customers"])


@query
def customer_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(spark, sf_dir, "orders", "customers")
    return _round(cust.customer_kpis(t["orders"], t["customers"]), "taxa_recompra")


@query
def customer_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(
        spark, sf_dir, "orders", "order_items", "product_variants", "customers"
    )
    return cust.customer_profit(
        t["orders"], t["order_items"], t["product_variants"], t["customers"]
    )


@query
def person_type_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(spark, sf_dir, "customers")
    return _round(cust.person_type_split(t["customers"]), "percentual")


@query
def customers_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cust.customers_by_state(binding.logical_tables(spark, sf_dir, "addresses")["addresses"])


# --- Forecast ---------------------------------------------------------------


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.daily_gapfill(fc.daily_orders(_orders(spark, sf_dir)))


@query
def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.daily_orders(_orders(spark, sf_dir))


@query
def daily_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


@query
def moving_avg_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.moving_avg_7d(_filled(spark, sf_dir)), "media_movel_7d")


@query
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.linear_trend(_filled(spark, sf_dir)), "inclinacao", "intercepto")


@query
def forecast_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.forecast_30d(_filled(spark, sf_dir)), "pedidos_previstos")


@query
def forecast_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.forecast_mean(fc.forecast_30d(_filled(spark, sf_dir))), "media_prevista")


@query
def history_plus_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = _filled(spark, sf_dir)
    return _round(fc.history_plus_forecast(filled, fc.forecast_30d(filled)), "valor")


# --- Recommendations --------------------------------------------------------


@query
def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = recommend.order_baskets(binding.logical_tables(spark, sf_dir, "order_items")["order_items"])
    return baskets.select(
        "order_id", F.array_join(F.col("produtos").cast("array<string>"), ",").alias("produtos")
    )


@query
def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.basket_items(binding.logical_tables(spark, sf_dir, "order_items")["order_items"])


@query
def product_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.product_pairs(binding.logical_tables(spark, sf_dir, "order_items")["order_items"])


@query
def product_pairs_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(
        spark, sf_dir, "order_items", "product_variants", "products"
    )
    return recommend.product_pairs_named(
        t["order_items"], t["product_variants"], t["products"]
    )


@query
def customer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.customer_list(_orders(spark, sf_dir))


@query
def next_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(
        spark, sf_dir, "orders", "order_items", "product_variants", "products"
    )
    return recommend.next_purchase(
        t["orders"], t["order_items"], t["product_variants"], t["products"]
    )


@query
def next_purchase_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binding.logical_tables(
        spark, sf_dir, "orders", "order_items", "product_variants", "products"
    )
    return recommend.next_purchase_all(
        t["orders"], t["order_items"], t["product_variants"], t["products"]
    )


# --- Display formats --------------------------------------------------------


@query
def fmt_brl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", text.fmt_brl(F.col("total")).alias("texto"))


@query
def fmt_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor("total").cast("long")
    return _orders(spark, sf_dir).select("id", text.fmt_int(whole).alias("texto"))


@query
def fmt_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", text.fmt_date(F.col("created_at")).alias("texto"))


@query
def fmt_pct1(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("total").cast("double") / 1000
    return _orders(spark, sf_dir).select("id", text.fmt_pct1(share).alias("texto"))
