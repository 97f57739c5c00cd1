"""Declared tables: column types, keys, references, domains and defaults.

A table is a list of :class:`Column`; Spark schemas, load-time audits and
default filling are all derived from it, so each fact is written once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    name: str
    sql_type: str
    required: bool = False
    default: str | None = None  # a Spark SQL expression

    @property
    def length(self) -> int | None:
        """Declared text length, or None where the type has none."""
        m = re.fullmatch(r"varchar\((\d+)\)", self.sql_type)
        return int(m.group(1)) if m else None

    @property
    def spark_type(self) -> T.DataType:
        m = re.fullmatch(r"decimal\((\d+),(\d+)\)", self.sql_type)
        if m:
            return T.DecimalType(int(m.group(1)), int(m.group(2)))
        if self.length is not None:
            return T.StringType()
        return {
            "int": T.LongType(),  # keys outgrow 32 bits at scale
            "bigint": T.LongType(),
            "text": T.StringType(),
            "json": T.StringType(),
            "boolean": T.BooleanType(),
            "date": T.DateType(),
            "timestamp": T.TimestampNTZType(),
        }[self.sql_type]


@dataclass(frozen=True)
class Table:
    columns: tuple[Column, ...]
    key: str = "id"
    unique: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)  # column -> parent table
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.columns])


def _columns(*specs: str, required: str = "", defaults: dict[str, str] | None = None):
    """Columns from ``"name type"`` texts; ``required`` is a blank-separated name list."""
    must, defaults = set(required.split()), defaults or {}
    return tuple(
        Column(name, sql_type, name in must, defaults.get(name))
        for name, sql_type in (s.split(" ", 1) for s in specs)
    )


_NOW = "cast(current_timestamp() as timestamp_ntz)"
_STAMPS = {"created_at": _NOW, "updated_at": _NOW}

# ---------------------------------------------------------------------------
# The warehouse tables, loaded from CSV without any correction.
# ---------------------------------------------------------------------------
WAREHOUSE: dict[str, Table] = {
    "brands": Table(
        _columns(
            "id int", "name varchar(150)", "country varchar(100)", "is_active boolean",
            "created_at timestamp", "updated_at timestamp",
            required="id name is_active created_at updated_at",
            defaults={"is_active": "true", **_STAMPS},
        ),
    ),
    "categories": Table(
        _columns(
            "id int", "name varchar(150)", "slug varchar(150)", "parent_category_id int",
            "is_active boolean", "created_at timestamp", "updated_at timestamp",
            required="id name slug is_active created_at updated_at",
            defaults={"is_active": "true", **_STAMPS},
        ),
        unique=("slug",),
        references={"parent_category_id": "categories"},
    ),
    "customers": Table(
        _columns(
            "id int", "person_type varchar(2)", "legal_name varchar(255)", "trade_name varchar(255)",
            "tax_id varchar(14)", "state_registration varchar(50)", "email varchar(255)",
            "phone varchar(30)", "is_active boolean", "created_at timestamp", "updated_at timestamp",
            required="id person_type legal_name tax_id email phone is_active created_at updated_at",
            defaults={"is_active": "true", **_STAMPS},
        ),
        unique=("tax_id",),
        domains={"person_type": ("PF", "PJ")},
    ),
    "employees": Table(
        _columns(
            "id int", "full_name varchar(255)", "cpf varchar(11)", "email varchar(255)",
            "role varchar(100)", "primary_location_id int", "hire_date date",
            "termination_date date", "is_active boolean", "created_at timestamp",
            "updated_at timestamp",
            required="id full_name cpf email role primary_location_id hire_date is_active "
            "created_at updated_at",
            defaults={"is_active": "true", **_STAMPS},
        ),
        unique=("cpf",),
    ),
    "orders": Table(
        _columns(
            "id int", "order_number varchar(50)", "channel varchar(50)", "customer_id int",
            "salesperson_id int", "location_id int", "status varchar(50)",
            "subtotal decimal(15,2)", "discount_amount decimal(15,2)", "total decimal(15,2)",
            "placed_at timestamp", "created_at timestamp", "updated_at timestamp",
            required="id order_number channel customer_id location_id status subtotal "
            "discount_amount total placed_at created_at updated_at",
            defaults={
                "subtotal": "0.00", "discount_amount": "0.00", "total": "0.00", **_STAMPS,
            },
        ),
        unique=("order_number",),
        references={"customer_id": "customers", "salesperson_id": "employees"},
    ),
    "fiscal_invoices": Table(
        _columns(
            "id int", "order_id int", "nfe_number varchar(50)", "nfe_access_key varchar(44)",
            "series int", "issued_at timestamp", "status varchar(50)",
            "total_amount decimal(15,2)", "xml_storage_uri text", "created_at timestamp",
            "updated_at timestamp",
            required="id order_id nfe_number nfe_access_key series issued_at status "
            "total_amount xml_storage_uri created_at updated_at",
            defaults=_STAMPS,
        ),
        unique=("nfe_access_key",),
        references={"order_id": "orders"},
    ),
}

# ---------------------------------------------------------------------------
# The treated layer. Every table also carries ``source_run_id``.
# ---------------------------------------------------------------------------
TREATED: dict[str, Table] = {
    "orders": Table(
        _columns(
            "id int", "order_number varchar(80)", "channel varchar(80)", "customer_id int",
            "salesperson_id int", "location_id int", "status varchar(80)",
            "subtotal decimal(18,2)", "discount_amount decimal(18,2)", "total decimal(18,2)",
            "placed_at timestamp", "created_at timestamp", "updated_at timestamp",
            required="id",
        ),
    ),
    "order_items": Table(
        _columns(
            "id int", "order_id int", "product_variant_id int", "quantity decimal(18,4)",
            "unit_price decimal(18,2)", "icms_rate decimal(12,4)", "ipi_rate decimal(12,4)",
            "line_total decimal(18,2)",
            required="id",
        ),
    ),
    "products": Table(
        _columns(
            "id int", "name varchar(255)", "description text", "brand_id int",
            "category_id int", "ncm_code varchar(80)", "unit_of_measure varchar(30)",
            "is_active boolean",
            required="id",
        ),
    ),
    "product_variants": Table(
        _columns(
            "id int", "product_id int", "sku varchar(120)", "barcode_ean varchar(120)",
            "sale_price decimal(18,2)", "cost_price decimal(18,2)", "weight_kg decimal(18,4)",
            "icms_rate decimal(12,4)", "ipi_rate decimal(12,4)", "is_active boolean",
            required="id",
        ),
    ),
    "customers": Table(
        _columns(
            "id int", "person_type varchar(4)", "legal_name varchar(255)",
            "trade_name varchar(255)", "tax_id varchar(40)", "state_registration varchar(80)",
            "email varchar(320)", "phone varchar(50)", "is_active boolean",
            "created_at timestamp", "updated_at timestamp",
            required="id",
        ),
    ),
    "addresses": Table(
        _columns(
            "id int", "customer_id int", "address_type varchar(50)", "city varchar(150)",
            "state varchar(80)", "country varchar(100)", "is_primary boolean",
            required="id",
        ),
    ),
    "returns": Table(
        _columns(
            "id int", "order_id int", "customer_id int", "status varchar(80)",
            "reason varchar(255)", "total_refund_amount decimal(18,2)", "created_at timestamp",
            required="id",
        ),
    ),
}

# The control tables written next to both layers.
CONTROL: dict[str, Table] = {
    "ingestion_runs": Table(
        _columns(
            "id bigint", "file_name varchar(255)", "source_table varchar(100)",
            "layer varchar(7)", "row_count bigint", "status varchar(30)", "details json",
            "created_at timestamp",
            required="id file_name source_table layer row_count status",
            defaults={"status": "'completed'", "created_at": _NOW},
        ),
        domains={"layer": ("raw", "treated")},
    ),
    "raw_csv_rows": Table(
        _columns(
            "ingestion_run_id bigint", "source_table varchar(100)", "source_row_number bigint",
            "payload json", "created_at timestamp",
            required="ingestion_run_id source_table source_row_number payload",
            defaults={"created_at": _NOW},
        ),
        key="",  # row numbers are unique within a run only
        references={"ingestion_run_id": "ingestion_runs"},
    ),
}

# Columns turned into timestamps and into numbers, by name.
DATE_SUFFIXES = ("_at", "_date")
DATE_COLUMNS = (
    "created_at", "updated_at", "placed_at", "hire_date", "termination_date", "paid_at",
    "issued_at", "received_at",
)
NUMERIC_COLUMNS = (
    "subtotal", "discount_amount", "total", "quantity", "unit_price", "line_total",
    "sale_price", "cost_price", "weight_kg", "total_refund_amount", "amount",
)
FOUR_DECIMAL_COLUMNS = ("quantity", "weight_kg")
TRIMMED_CUSTOMER_COLUMNS = ("tax_id", "phone", "email")

# Cell texts that a CSV read takes as null (the default list of pandas).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: text of the null channel in the order views.
NULL_CHANNEL = "[NULO]"
# Fixed value: month label of orders without a date.
NULL_MONTH = "NaT"


def is_date_column(name: str) -> bool:
    return name.endswith(DATE_SUFFIXES) or name in DATE_COLUMNS


def is_numeric_column(name: str) -> bool:
    return name in NUMERIC_COLUMNS


def numeric_type(name: str) -> T.DecimalType:
    return T.DecimalType(18, 4 if name in FOUR_DECIMAL_COLUMNS else 2)


def declared_table(name: str) -> Table:
    """The declaration of ``layer.table``."""
    layer, table = name.split(".")
    return {"warehouse": WAREHOUSE, "treated": TREATED, "control": CONTROL}[layer][table]


def table_schemas() -> dict[str, T.StructType]:
    """All declared schemas, keyed ``layer.table``."""
    layers = {"warehouse": WAREHOUSE, "treated": TREATED, "control": CONTROL}
    schemas = {f"{layer}.{name}": t.schema for layer, ts in layers.items() for name, t in ts.items()}
    for name in TREATED:
        schemas[f"treated.{name}"].add("source_run_id", T.LongType(), True)
    return schemas
