"""The retail tables as views over the star-schema test tables.

``logical_tables`` gives typed tables; ``raw_tables`` gives the same content as
the text of a CSV export, with the defects that such exports carry (copies of
rows, unparsable cells, blanks around identifiers, spelled-out nulls).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# The test tables. A declared schema spares a look into the files for each plan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


_ORDERS = [
    "o_orderkey as id",
    "concat('ORD-', o_orderkey) as order_number",
    "nullif(o_orderpriority, '4-NOT SPECIFIED') as channel",
    # Orders of status P lack a customer, a total or a date, or are paid back.
    "case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then null else o_custkey end as customer_id",
    "cast(null as bigint) as salesperson_id",
    "cast(null as bigint) as location_id",
    "o_orderstatus as status",
    "cast(null as decimal(18,2)) as subtotal",
    "cast(null as decimal(18,2)) as discount_amount",
    "cast(case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then null "
    "when o_orderstatus = 'P' and o_orderpriority = '2-HIGH' then -o_totalprice "
    "else o_totalprice end as decimal(18,2)) as total",
    "o_orderdate as placed_at",
    "case when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM' then null else o_orderdate end as created_at",
    "cast(null as timestamp_ntz) as updated_at",
]
_ITEMS = [
    "l_orderkey as order_id",
    # Some items lack their product, price or quantity.
    "case when l_returnflag = 'A' and l_linenumber = 6 then null else l_partkey end as product_variant_id",
    "cast(case when l_returnflag = 'R' and l_linenumber = 4 then null else l_quantity end as decimal(18,4)) as quantity",
    "cast(case when l_returnflag = 'R' and l_linenumber = 5 then null else l_extendedprice end as decimal(18,2)) "
    "as line_total",
]
# With a cost of 2.2 times the retail price some products lose money.
_VARIANTS = [
    "p_partkey as id",
    "p_partkey as product_id",
    "cast(p_retailprice as decimal(18,2)) as sale_price",
    "cast(p_retailprice * 2.2 as decimal(18,2)) as cost_price",
]
_PRODUCTS = ["p_partkey as id", "p_name as name"]
_CUSTOMERS = [
    "c_custkey as id",
    "case when c_mktsegment in ('BUILDING', 'HOUSEHOLD') then 'PF' else 'PJ' end as person_type",
    "c_name as legal_name",
]
_RETURNS = [
    "l_orderkey as order_id",
    "cast(l_extendedprice as decimal(18,2)) as total_refund_amount",
]
_SERIES = [
    "event_id as id",
    "ts as created_at",
    "event_type as channel",
    "'observed' as status",
    "cast(value as decimal(18,2)) as total",
]


def logical_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named logical tables; all of them if no name is given."""

    def table(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    build = {
        "orders": lambda: table("orders").selectExpr(*_ORDERS),
        "order_items": lambda: table("lineitem").selectExpr(*_ITEMS),
        "products": lambda: table("part").selectExpr(*_PRODUCTS),
        "product_variants": lambda: table("part").selectExpr(*_VARIANTS),
        "customers": lambda: table("customer").selectExpr(*_CUSTOMERS),
        "addresses": lambda: _addresses(table("customer"), table("nation")),
        "returns": lambda: table("lineitem").filter("l_returnflag = 'R'").selectExpr(*_RETURNS),
    }
    return {name: build[name]() for name in names or build}


def _addresses(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """One address per customer and a second one for those in the building trade."""
    kinds = F.when(
        F.col("c_mktsegment") == "BUILDING", F.array(F.lit("billing"), F.lit("shipping"))
    ).otherwise(F.array(F.lit("billing")))
    return customer.join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select(
        F.col("c_custkey").alias("customer_id"),
        F.explode(kinds).alias("address_type"),
        F.col("n_name").alias("state"),
    )


def value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event values in the shape of orders: a long tail with many outliers."""
    return read_table(spark, sf_dir, "events").selectExpr(*_SERIES)


_RAW_ORDERS = [
    "cast(o_orderkey as string) as id",
    "concat('ORD-', o_orderkey) as order_number",
    "case when o_orderpriority = '4-NOT SPECIFIED' then 'N/A' else o_orderpriority end as channel",
    "cast(o_custkey as string) as customer_id",
    "o_orderstatus as status",
    # Orders of status P in the urgent channel carry a total in local notation.
    "case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then '1.234,5' "
    "when o_orderpriority = '5-LOW' then concat(' ', cast(cast(o_totalprice as decimal(18,2)) as string)) "
    "else cast(cast(o_totalprice as decimal(18,2)) as string) end as total",
    "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as placed_at",
    # Those of the low channel lack the time of day, those of status O in it are no date.
    "case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then date_format(o_orderdate, 'yyyy-MM-dd') "
    "when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then 'sem data' "
    "else date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') end as created_at",
]
_RAW_CUSTOMERS = [
    "cast(c_custkey as string) as id",
    "case when c_mktsegment in ('BUILDING', 'HOUSEHOLD') then 'PF' else 'PJ' end as person_type",
    "c_name as legal_name",
    "case when c_acctbal < 0 then 'n/a' else concat('Loja \"', c_name, '\", filial') end as trade_name",
    "concat('\\t', lpad(cast(c_custkey as string), 11, '0'), ' ') as tax_id",
    "lpad(cast(c_custkey as string), 11, '0') as phone",
    "concat(' c', c_custkey, '@example.com') as email",
    "case when c_acctbal < 0 then 'FALSE' else 'TRUE' end as is_active",
]
_RAW_ITEMS = [
    "cast(l_orderkey as string) as order_id",
    "cast(l_partkey as string) as product_variant_id",
    "cast(cast(l_quantity as decimal(18,4)) as string) as quantity",
    "case when l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1 then '??' "
    "else cast(cast(l_extendedprice as decimal(18,2)) as string) end as line_total",
]
_RAW_PRODUCTS = [
    "cast(p_partkey as string) as id",
    "p_name as name",
    "case when p_type = 'ECONOMY' then '' else p_type end as description",
]
_RAW_VARIANTS = [
    "cast(p_partkey as string) as id",
    "cast(p_partkey as string) as product_id",
    "lpad(cast(p_partkey as string), 13, '0') as barcode_ean",
    "cast(cast(p_retailprice as decimal(18,2)) as string) as sale_price",
    "cast(cast(p_retailprice * 2.2 as decimal(18,2)) as string) as cost_price",
]
_RAW_ADDRESSES = [
    "cast(customer_id as string) as customer_id",
    "address_type",
    "case when state = 'CHINA' then 'N/A' else state end as state",
]
_RAW_RETURNS = [
    "cast(l_orderkey as string) as order_id",
    "case when l_linenumber = 2 then 'NULL' else l_linestatus end as reason",
    "case when l_linenumber = 3 then 'a combinar' "
    "else cast(cast(l_extendedprice as decimal(18,2)) as string) end as total_refund_amount",
]


def _repeated(df: DataFrame, condition: str) -> DataFrame:
    """``df`` with a second copy of the rows that meet the condition."""
    copies = F.when(F.expr(condition), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def raw_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Text tables with defects; the orders of status F and some customers come twice."""

    def table(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    build = {
        "orders": lambda: _repeated(table("orders"), "o_orderstatus = 'F'").selectExpr(*_RAW_ORDERS),
        "order_items": lambda: table("lineitem").selectExpr(*_RAW_ITEMS),
        "customers": lambda: _repeated(
            table("customer"), "c_mktsegment = 'MACHINERY'"
        ).selectExpr(*_RAW_CUSTOMERS),
        "products": lambda: table("part").selectExpr(*_RAW_PRODUCTS),
        "product_variants": lambda: table("part").selectExpr(*_RAW_VARIANTS),
        "addresses": lambda: _repeated(
            _addresses(table("customer"), table("nation")), "address_type = 'shipping'"
        ).selectExpr(*_RAW_ADDRESSES),
        "returns": lambda: table("lineitem").filter("l_returnflag = 'R'").selectExpr(*_RAW_RETURNS),
    }
    return {name: build[name]() for name in names or build}


_STAMP = "timestamp_ntz '2024-01-01 00:00:00'"
_STAMPS = [f"{_STAMP} as created_at", f"{_STAMP} as updated_at"]
_W_BRANDS = ["cast(substring(p_brand, 7) as bigint) as id", "p_brand as name", "cast(null as string) as country", "true as is_active", *_STAMPS]
_W_CATEGORIES = [
    "id", "p_type as name", "lower(p_type) as slug", "nullif(id - 1, 0) as parent_category_id", "true as is_active", *_STAMPS,
]
_W_CUSTOMERS = [
    "c_custkey as id",
    "case when c_mktsegment in ('BUILDING', 'HOUSEHOLD') then 'PF' else 'PJ' end as person_type",
    "c_name as legal_name", "cast(null as string) as trade_name", "lpad(cast(c_custkey as string), 11, '0') as tax_id",
    "cast(null as string) as state_registration", "concat('c', c_custkey, '@example.com') as email",
    "lpad(cast(c_custkey as string), 11, '0') as phone", "c_acctbal >= 0 as is_active", *_STAMPS,
]
_W_EMPLOYEES = [
    "s_suppkey as id", "s_name as full_name", "lpad(cast(s_suppkey as string), 11, '0') as cpf",
    "concat('e', s_suppkey, '@example.com') as email", "'vendas' as role", "cast(s_nationkey as bigint) as primary_location_id",
    "date '2020-01-31' as hire_date", "cast(null as date) as termination_date", "s_acctbal >= 0 as is_active", *_STAMPS,
]
_W_ORDERS = [
    "o_orderkey as id", "concat('ORD-', o_orderkey) as order_number", "o_orderpriority as channel", "o_custkey as customer_id",
    "o_orderkey % 10 as salesperson_id", "cast(1 as bigint) as location_id", "o_orderstatus as status",
    "cast(o_totalprice as decimal(15,2)) as subtotal", "cast(0 as decimal(15,2)) as discount_amount",
    "cast(o_totalprice as decimal(15,2)) as total", "o_orderdate as placed_at", "o_orderdate as created_at", "o_orderdate as updated_at",
]
_W_INVOICES = [
    "o_orderkey as id", "o_orderkey as order_id", "concat('NF-', o_orderkey) as nfe_number",
    "lpad(cast(o_orderkey as string), 44, '0') as nfe_access_key", "cast(1 as bigint) as series", "o_orderdate as issued_at",
    "'emitida' as status", "cast(o_totalprice as decimal(15,2)) as total_amount", "concat('/nfe/', o_orderkey, '.xml') as xml_storage_uri",
    "o_orderdate as created_at", "o_orderdate as updated_at",
]


def warehouse_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six declared warehouse tables, sound and in their types."""
    part, orders = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "orders")
    kinds = part.select("p_type").distinct().withColumn("id", F.row_number().over(Window.orderBy("p_type")).cast("long"))  # a handful
    return {
        "brands": part.select("p_brand").distinct().selectExpr(*_W_BRANDS),
        "categories": kinds.selectExpr(*_W_CATEGORIES),
        "customers": read_table(spark, sf_dir, "customer").selectExpr(*_W_CUSTOMERS),
        "employees": read_table(spark, sf_dir, "supplier").selectExpr(*_W_EMPLOYEES),
        "orders": orders.selectExpr(*_W_ORDERS),
        "fiscal_invoices": orders.filter("o_orderstatus = 'F'").selectExpr(*_W_INVOICES),
    }


def broken_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same with references that lead nowhere, and customers of no known kind."""
    t = warehouse_tables(spark, sf_dir)
    missing = "case when status = 'P' and channel = '5-LOW' then customer_id + 100000000 else customer_id end"
    return t | {
        "categories": t["categories"].withColumn("parent_category_id", F.col("id") + 1),
        "customers": t["customers"].withColumn("person_type", F.expr("case when not is_active then 'XX' when id % 5 = 0 then null else person_type end")),
        "orders": t["orders"].withColumns(
            {
                "salesperson_id": F.expr("case when status = 'P' then -1 - id % 7 when status = 'O' then null else salesperson_id end"),
                "customer_id": F.expr(missing),
            }
        ),
        "fiscal_invoices": t["fiscal_invoices"].withColumn("order_id", F.expr("case when id % 50 = 0 then -1 - id else order_id end")),
    }


def as_text(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for name, df in tables.items()}


# Orders of which some lack their id and others have that of the next one.
_BROKEN_ORDERS = [
    "case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then null "
    "when o_orderstatus = 'P' and o_orderpriority in ('2-HIGH', '5-LOW') then cast(o_orderkey + 1 as string) "
    "else cast(o_orderkey as string) end as id",
    *_RAW_ORDERS[1:],
]
# What arrives after a refresh: some orders with another total, some under new ids.
_LATER_ORDERS = [
    "cast(case when o_orderstatus = 'F' then o_orderkey + 100000000 else o_orderkey end as string) as id",
    *[c for c in _RAW_ORDERS[1:] if not c.endswith(" as total")],
    "cast(cast(o_totalprice + 100 as decimal(18,2)) as string) as total",
]


def broken_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").selectExpr(*_BROKEN_ORDERS)


def later_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = read_table(spark, sf_dir, "orders").filter("o_orderstatus in ('O', 'F') and o_orderpriority = '1-URGENT'").selectExpr(*_LATER_ORDERS)
    return later.select("id", "order_number", "channel", "customer_id", "status", "total", "placed_at", "created_at")


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Write each table as ``folder/<table>.csv/`` part files, cells as they are."""

    def write(name: str) -> None:
        (
            tables[name].write.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(f"{folder}/{name}.csv")
        )

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, tables))
