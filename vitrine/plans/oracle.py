"""For each named query, the same result in ANSI SQL over the same Parquet tables."""

from __future__ import annotations

from vitrine.plans import binding
from vitrine import schemas
from vitrine.operators import profile

# The logical tables; see ``binding``.
_CTE = {
    "l_orders": """
        SELECT o_orderkey AS id, 'ORD-' || o_orderkey AS order_number,
               nullif(o_orderpriority, '4-NOT SPECIFIED') AS channel,
               CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW' THEN o_custkey END AS customer_id,
               CAST(NULL AS BIGINT) AS salesperson_id, CAST(NULL AS BIGINT) AS location_id,
               o_orderstatus AS status, CAST(NULL AS DECIMAL(18,2)) AS subtotal,
               CAST(NULL AS DECIMAL(18,2)) AS discount_amount,
               CAST(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL
                         WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN -o_totalprice
                         ELSE o_totalprice END AS DECIMAL(18,2)) AS total, o_orderdate AS placed_at,
               CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '3-MEDIUM' THEN o_orderdate END AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
        FROM orders""",
    "l_items": """
        SELECT l_orderkey AS order_id,
               CASE WHEN l_returnflag <> 'A' OR l_linenumber <> 6 THEN l_partkey END AS product_variant_id,
               CAST(CASE WHEN l_returnflag <> 'R' OR l_linenumber <> 4 THEN l_quantity END AS DECIMAL(18,4))
                   AS quantity,
               CAST(CASE WHEN l_returnflag <> 'R' OR l_linenumber <> 5 THEN l_extendedprice END AS DECIMAL(18,2))
                   AS line_total
        FROM lineitem""",
    "l_variants": """
        SELECT p_partkey AS id, p_partkey AS product_id,
               CAST(p_retailprice AS DECIMAL(18,2)) AS sale_price,
               CAST(p_retailprice * 2.2 AS DECIMAL(18,2)) AS cost_price
        FROM part""",
    "l_products": "SELECT p_partkey AS id, p_name AS name FROM part",
    "l_customers": """
        SELECT c_custkey AS id, c_name AS legal_name,
               CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'PF' ELSE 'PJ' END
                   AS person_type
        FROM customer""",
    "l_addresses": """
        SELECT c_custkey AS customer_id, 'billing' AS address_type, n_name AS state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT c_custkey, 'shipping', n_name
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        WHERE c_mktsegment = 'BUILDING'""",
    "l_returns": """
        SELECT l_orderkey AS order_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_refund_amount
        FROM lineitem WHERE l_returnflag = 'R'""",
    "series": """
        SELECT event_id AS id, ts AS created_at, event_type AS channel,
               CAST(value AS DECIMAL(18,2)) AS total
        FROM events""",
    # The same content as text with defects.
    "one_order": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'ORD-' || o_orderkey AS order_number,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'N/A' ELSE o_orderpriority END
                   AS channel,
               CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS status,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN '1.234,5'
                    WHEN o_orderpriority = '5-LOW'
                    THEN ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS total,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed_at,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
                    THEN strftime(o_orderdate, '%Y-%m-%d')
                    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'sem data'
                    ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created_at
        FROM orders""",
    "r_orders": "SELECT * FROM one_order UNION ALL SELECT * FROM one_order WHERE status = 'F'",
    "one_customer": """
        SELECT CAST(c_custkey AS VARCHAR) AS id,
               CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'PF' ELSE 'PJ' END
                   AS person_type,
               c_name AS legal_name,
               CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE 'Loja "' || c_name || '", filial' END
                   AS trade_name,
               chr(9) || lpad(CAST(c_custkey AS VARCHAR), 11, '0') || ' ' AS tax_id,
               lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS phone,
               ' c' || c_custkey || '@example.com' AS email,
               CASE WHEN c_acctbal < 0 THEN 'FALSE' ELSE 'TRUE' END AS is_active
        FROM customer""",
    "r_customers": """
        SELECT * FROM one_customer
        UNION ALL
        SELECT o.* FROM one_customer o JOIN customer ON CAST(o.id AS BIGINT) = c_custkey
        WHERE c_mktsegment = 'MACHINERY'""",
    "r_items": """
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
               CAST(l_partkey AS VARCHAR) AS product_variant_id,
               CAST(CAST(l_quantity AS DECIMAL(18,4)) AS VARCHAR) AS quantity,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 THEN '??'
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS line_total
        FROM lineitem""",
    "r_products": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
               CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_type END AS description
        FROM part""",
    "r_variants": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) AS product_id,
               lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS barcode_ean,
               CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS sale_price,
               CAST(CAST(p_retailprice * 2.2 AS DECIMAL(18,2)) AS VARCHAR) AS cost_price
        FROM part""",
    "r_addresses": """
        SELECT CAST(customer_id AS VARCHAR) AS customer_id, address_type,
               CASE WHEN state = 'CHINA' THEN 'N/A' ELSE state END AS state
        FROM (SELECT * FROM l_addresses
              UNION ALL SELECT * FROM l_addresses WHERE address_type = 'shipping')""",
    "r_returns": """
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
               CASE WHEN l_linenumber = 2 THEN 'NULL' ELSE l_linestatus END AS reason,
               CASE WHEN l_linenumber = 3 THEN 'a combinar'
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS total_refund_amount
        FROM lineitem WHERE l_returnflag = 'R'""",
    # The declared warehouse tables, and what is broken in them.
    "w_brands": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_brand AS name, CAST(NULL AS VARCHAR) AS country FROM part""",
    "w_categories": """
        SELECT id, name, nullif(id - 1, 0) AS parent_category_id
        FROM (SELECT p_type AS name, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part))""",
    "b_orders": """
        SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey % 7 WHEN o_orderstatus = 'F' THEN o_orderkey % 10 END AS salesperson_id,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN o_custkey + 100000000 ELSE o_custkey END AS customer_id
        FROM orders""",
    "b_invoices": """
        SELECT CASE WHEN o_orderkey % 50 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS order_id FROM orders WHERE o_orderstatus = 'F'""",
    # Orders set apart, and mended.
    "x_orders": """
        SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL
                    WHEN o_orderstatus = 'P' AND o_orderpriority IN ('2-HIGH', '5-LOW') THEN o_orderkey + 1 ELSE o_orderkey END AS id,
               'ORD-' || o_orderkey AS order_number, o_orderkey AS own
        FROM orders""",
    "x_marked": """
        SELECT id, order_number, own, CASE WHEN id IS NULL THEN 'not_null:id'
                    WHEN COUNT(*) OVER (PARTITION BY id) > 1 THEN 'primary_key:id' ELSE '' END AS regras
        FROM x_orders""",
    "later": """
        SELECT CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 100000000 ELSE o_orderkey END AS VARCHAR) AS id, o.order_number,
               o.channel, o.customer_id, o.status, CAST(CAST(o_totalprice + 100 AS DECIMAL(18,2)) AS VARCHAR) AS total, o.placed_at, o.created_at
        FROM orders JOIN one_order o ON CAST(o_orderkey AS VARCHAR) = o.id
        WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT'""",
    # Shared steps.
    "fences": """
        SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
        FROM (SELECT quantile_cont(CAST(total AS DOUBLE), 0.25) AS q1,
                     quantile_cont(CAST(total AS DOUBLE), 0.75) AS q3 FROM l_orders)""",
    "series_fences": """
        SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
        FROM (SELECT quantile_cont(CAST(total AS DOUBLE), 0.25) AS q1,
                     quantile_cont(CAST(total AS DOUBLE), 0.75) AS q3 FROM series)""",
    "margins": """
        SELECT i.order_id, i.product_variant_id, i.quantity, i.line_total, v.cost_price, p.name,
               CAST(i.line_total AS DECIMAL(38,6))
                 - CAST(i.quantity AS DECIMAL(19,4)) * CAST(v.cost_price AS DECIMAL(18,2)) AS profit
        FROM l_items i LEFT JOIN l_variants v ON i.product_variant_id = v.id
                       LEFT JOIN l_products p ON v.product_id = p.id""",
    "product_totals": """
        SELECT name, CAST(coalesce(SUM(quantity), 0) AS DOUBLE) AS unidades,
               CAST(coalesce(SUM(line_total), 0) AS DOUBLE) AS receita,
               CAST(coalesce(SUM(profit), 0) AS DOUBLE) AS lucro
        FROM margins GROUP BY name""",
    "daily": """
        SELECT CAST(created_at AS DATE) AS dia, COUNT(*) AS pedidos
        FROM l_orders WHERE created_at IS NOT NULL GROUP BY 1""",
    "grid": """
        SELECT g.dia, coalesce(d.pedidos, 0) AS pedidos
        FROM (SELECT CAST(unnest(generate_series(MIN(dia), MAX(dia), INTERVAL 1 DAY)) AS DATE) AS dia
              FROM daily) g LEFT JOIN daily d ON g.dia = d.dia""",
    "indexed": """
        SELECT dia, CAST(pedidos AS DOUBLE) AS y,
               CAST(row_number() OVER (ORDER BY dia) - 1 AS DOUBLE) AS x,
               row_number() OVER (ORDER BY dia DESC) AS age
        FROM grid""",
    "fit": """
        SELECT MAX(dia) AS last, COUNT(*) AS n, regr_slope(y, x) AS slope,
               regr_intercept(y, x) AS intercept, AVG(CASE WHEN age <= 7 THEN y END) AS recent
        FROM indexed""",
    "forecast": """
        SELECT CAST(last + CAST(k AS INTEGER) AS DATE) AS dia,
               greatest(0.0, (intercept + slope * (n - 1 + k) + recent) / 2) AS previsto
        FROM fit, range(1, 31) r(k)""",
    "pairs": """
        SELECT a.product_variant_id AS produto_a, b.product_variant_id AS produto_b,
               COUNT(*) AS coocorrencias
        FROM (SELECT DISTINCT order_id, product_variant_id FROM l_items) a
        JOIN (SELECT DISTINCT order_id, product_variant_id FROM l_items) b
          ON a.order_id = b.order_id AND a.product_variant_id < b.product_variant_id
        GROUP BY 1, 2""",
    "history": """
        SELECT o.customer_id, i.product_variant_id,
               coalesce(CAST(SUM(i.quantity) AS DOUBLE), 0.0) AS quantidade_historica
        FROM l_orders o JOIN l_items i ON o.id = i.order_id
        WHERE o.customer_id IS NOT NULL AND i.product_variant_id IS NOT NULL GROUP BY 1, 2""",
}


def _with(body: str) -> str:
    """``body`` after the shared steps that it names, directly or through another step."""
    needed: set[str] = set()
    open_texts = [body]
    while open_texts:
        text = open_texts.pop()
        for name in _CTE:
            if name not in needed and _names(text, name):
                needed.add(name)
                open_texts.append(_CTE[name])
    parts = [f"{name} AS ({_CTE[name]})" for name in _CTE if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _names(text: str, name: str) -> bool:
    padded = "".join(c if c.isalnum() or c == "_" else " " for c in text)
    return f" {name} " in f" {padded} "


_MEAN = "CAST(SUM(total) AS DOUBLE) / nullif(COUNT(total), 0)"
# Written out here, so that an error in the tokens under test shows.
_TOKENS = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)


def _na(column: str) -> str:
    return f"CASE WHEN {column} NOT IN ({_TOKENS}) THEN {column} END"


_RAW_COLUMNS = {
    "orders": ("r_orders", "id order_number channel customer_id status total placed_at created_at"),
    "order_items": ("r_items", "order_id product_variant_id quantity line_total"),
    "customers": (
        "r_customers", "id person_type legal_name trade_name tax_id phone email is_active"
    ),
    "products": ("r_products", "id name description"),
    "product_variants": ("r_variants", "id product_id barcode_ean sale_price cost_price"),
    "addresses": ("r_addresses", "customer_id address_type state"),
    "returns": ("r_returns", "order_id reason total_refund_amount"),
}

# Coerced forms of the text columns that the treatment changes.
_STAMP = "CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}') " \
    "THEN TRY_CAST({c} AS TIMESTAMP) END"
_COERCED = {
    "total": "TRY_CAST({c} AS DECIMAL(18,2))",
    "line_total": "TRY_CAST({c} AS DECIMAL(18,2))",
    "quantity": "TRY_CAST({c} AS DECIMAL(18,4))",
    "sale_price": "TRY_CAST({c} AS DECIMAL(18,2))",
    "cost_price": "TRY_CAST({c} AS DECIMAL(18,2))",
    "total_refund_amount": "TRY_CAST({c} AS DECIMAL(18,2))",
    "placed_at": _STAMP,
    "created_at": _STAMP,
}


def _coerced(column: str) -> str:
    return _COERCED.get(column, "{c}").format(c=column)


def _nulls(columns: list[str], form=lambda c: c) -> str:
    return " + ".join(f"CAST({form(c)} IS NULL AS BIGINT)" for c in columns)


def _report() -> str:
    parts = []
    for table, (cte, names) in _RAW_COLUMNS.items():
        columns = names.split()
        clean = ", ".join(f"{_na(c)} AS {c}" for c in columns)
        parts.append(f"""
            SELECT '{table}' AS tabela,
                   (SELECT COUNT(*) FROM {cte}) AS raw_linhas,
                   COUNT(*) AS treated_linhas,
                   (SELECT COUNT(*) FROM {cte}) - COUNT(*) AS duplicados_removidos,
                   (SELECT CAST(SUM({_nulls(columns)}) AS BIGINT) FROM (SELECT {clean} FROM {cte}))
                       AS nulos_raw,
                   CAST(SUM({_nulls(columns, _coerced)}) AS BIGINT) AS nulos_treated
            FROM (SELECT DISTINCT {clean} FROM {cte})""")
    return " UNION ALL ".join(parts)


def _csv_scan() -> str:
    sources = _RAW_COLUMNS | {"documents": ("documents", "doc_id text lang source")}
    parts = []
    for table, (cte, names) in sources.items():
        columns = names.split()
        lengths = " + ".join(
            f"coalesce(length({_na(f'CAST({c} AS VARCHAR)')}), 0)" for c in columns
        )
        parts.append(
            f"SELECT '{table}' AS tabela, COUNT(*) AS linhas, CAST({len(columns)} AS BIGINT) AS colunas, "
            f"CAST(SUM({lengths}) AS BIGINT) AS caracteres FROM {cte}"
        )
    return " UNION ALL ".join(parts)


def _json_list(names) -> str:
    return "[" + ", ".join(f'"{n}"' for n in names) + "]"


# Tables in the order in which a refresh takes them, with their CSV columns.
_LOADED = {
    t: names.split() for t, (_, names) in sorted(
        (_RAW_COLUMNS | {"documents": ("documents", "doc_id text lang source")}).items()
    )
}


def _raw_log() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}.csv' AS file_name, '{t}' AS source_table, 'raw' AS layer, "
        f"(SELECT COUNT(*) FROM {_RAW_COLUMNS[t][0] if t in _RAW_COLUMNS else t}) AS row_count, "
        f"'completed' AS status, '{{\"columns\": {_json_list(columns)}}}' AS details"
        for t, columns in _LOADED.items()
    )


def _treated_log() -> str:
    parts = []
    for t, (cte, names) in _RAW_COLUMNS.items():
        dates = sorted(c for c in names.split() if schemas.is_date_column(c))
        parts.append(
            f"SELECT '{t}.csv' AS file_name, '{t}' AS source_table, 'treated' AS layer, "
            f"COUNT(*) AS row_count, 'completed' AS status, "
            f"'{{\"dropped_duplicate_rows\": ' || ((SELECT COUNT(*) FROM {cte}) - COUNT(*)) || "
            f"', \"date_columns\": {_json_list(dates)}}}' AS details "
            f"FROM (SELECT DISTINCT * FROM {cte})"
        )
    return " UNION ALL ".join(parts)


def _refresh_rows() -> str:
    parts, run = [], 0
    for t in _LOADED:
        run += 1
        cte = _RAW_COLUMNS[t][0] if t in _RAW_COLUMNS else t
        parts.append((run, t, "raw", f"(SELECT COUNT(*) FROM {cte})"))
        if t in _RAW_COLUMNS:
            run += 1
            parts.append((run, t, "treated", f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {cte}))"))
    return " UNION ALL ".join(
        f"SELECT CAST({run} AS BIGINT) AS id, '{t}' AS source_table, '{layer}' AS layer, "
        f"{n} AS linhas, {n} AS row_count"
        for run, t, layer, n in parts
    )


def _orders_run() -> int:
    """Run number of the treated load of the orders."""
    names = list(_LOADED)
    before = names[: names.index("orders")]
    return 2 + sum(2 if t in _RAW_COLUMNS else 1 for t in before)


def _conformed() -> str:
    filled = {
        "orders": ("l_orders", "id order_number channel customer_id status total placed_at created_at"),
        "order_items": ("l_items", "order_id product_variant_id quantity line_total"),
        "products": ("l_products", "id name"),
        "product_variants": ("l_variants", "id product_id sale_price cost_price"),
        "customers": ("l_customers", "id person_type legal_name"),
        "addresses": ("l_addresses", "customer_id address_type state"),
        "returns": ("l_returns", "order_id total_refund_amount"),
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tabela, CAST({len(schemas.TREATED[t].columns)} AS BIGINT) AS colunas, "
        f"COUNT(*) AS linhas, "
        f"CAST({' + '.join(f'COUNT({c})' for c in names.split())} AS BIGINT) AS celulas_preenchidas "
        f"FROM {cte}"
        for t, (cte, names) in filled.items()
    )


def _null_rows(columns, name: str, count: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {name}, COUNT(*) FILTER (WHERE {c} IS NULL) AS {count}, "
        f"COUNT(*) AS total_rows FROM l_orders"
        for c in columns
    )


def _audit() -> str:
    table = schemas.WAREHOUSE["orders"]
    checks = {}
    for c in table.columns:
        if c.required:
            checks[f"not_null:{c.name}"] = f"{c.name} IS NULL"
        if c.length is not None:
            checks[f"length:{c.name}"] = f"length({c.name}) > {c.length}"
        if c.sql_type.startswith("decimal"):
            checks[f"decimal:{c.name}"] = (
                f"{c.name} IS NOT NULL AND TRY_CAST({c.name} AS {c.sql_type.upper()}) IS NULL"
            )
    parts = [
        f"SELECT '{rule}' AS regra, COUNT(*) FILTER (WHERE {broken}) AS violacoes FROM l_orders"
        for rule, broken in checks.items()
    ]
    parts.append(
        "SELECT 'primary_key:id' AS regra, COUNT(*) AS violacoes FROM "
        "(SELECT id FROM l_orders GROUP BY id HAVING COUNT(*) > 1 OR id IS NULL)"
    )
    parts.append(
        "SELECT 'unique:order_number' AS regra, COUNT(*) AS violacoes FROM "
        "(SELECT order_number FROM l_orders WHERE order_number IS NOT NULL "
        "GROUP BY order_number HAVING COUNT(*) > 1)"
    )
    parts.append(
        "SELECT 'reference:customer_id' AS regra, COUNT(DISTINCT customer_id) AS violacoes "
        "FROM l_orders WHERE customer_id IS NOT NULL "
        "AND customer_id NOT IN (SELECT id FROM l_customers)"
    )
    return " UNION ALL ".join(parts)


def _histogram(source: str, bins: int) -> str:
    return f"""
        SELECT faixa, round(lo + (faixa - 1) * w, 6) AS inicio, round(lo + faixa * w, 6) AS fim,
               COUNT(*) AS n
        FROM (SELECT lo, w,
                     least({bins}, CAST(floor((CAST(total AS DOUBLE) - lo) / w) AS BIGINT) + 1) AS faixa
              FROM {source}, (SELECT CAST(MIN(total) AS DOUBLE) AS lo,
                     (CAST(MAX(total) AS DOUBLE) - CAST(MIN(total) AS DOUBLE)) / {bins} AS w
                     FROM {source}) WHERE total IS NOT NULL)
        GROUP BY faixa, lo, w"""


def _dots(n: str) -> str:
    return f"replace(format('{{:,}}', {n}), ',', '.')"


def _message(text: str, n: str) -> str:
    head, tail = text.split("{n}")
    return f"'{head}' || {_dots(n)} || '{tail}'"


# What the diagnosis says, written out here for the same reason.
_SAID_EMPTY = (
    "A base ainda não contém registros; não é possível concluir sobre a confiabilidade até a "
    "carga dos CSVs."
)
_SAID_ROWS = "A tabela contém {n} registros observáveis sem transformação aplicada."
_SAID_NULLS = (
    "Foram encontrados {n} valores nulos em `total`; a base exige tratamento antes de "
    "análises financeiras."
)
_SAID_NO_NULLS = "Não foram encontrados valores nulos em `total`."
_SAID_NEGATIVES = (
    "Há {n} valores negativos em `total`, que devem ser investigados como possível "
    "inconsistência ou estorno."
)
_SAID_NO_NEGATIVES = "Não foram encontrados valores negativos em `total`."
_SAID_CAVEAT = (
    "Valores extremos não são automaticamente erros; o painel os sinaliza para investigação "
    "por IQR, sem removê-los."
)


def _diagnosis() -> str:
    total = _COERCED["total"].format(c="total")
    return f"""
        SELECT ordem, mensagem FROM (
          SELECT CAST(0 AS INTEGER) AS ordem, CASE WHEN n = 0 THEN '{_SAID_EMPTY}'
                 ELSE {_message(_SAID_ROWS, 'n')} END AS mensagem, n FROM counts
          UNION ALL
          SELECT 1, CASE WHEN nulls > 0 THEN {_message(_SAID_NULLS, 'nulls')}
                 ELSE '{_SAID_NO_NULLS}' END, n FROM counts
          UNION ALL
          SELECT 2, CASE WHEN negatives > 0 THEN {_message(_SAID_NEGATIVES, 'negatives')}
                 ELSE '{_SAID_NO_NEGATIVES}' END, n FROM counts
          UNION ALL
          SELECT 3, '{_SAID_CAVEAT}', n FROM counts)
        WHERE n > 0 OR ordem = 0""".replace(
        "FROM counts",
        f"FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {total} IS NULL) AS nulls, "
        f"COUNT(*) FILTER (WHERE {total} < 0) AS negatives FROM one_order)",
    )


def _catalog() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tabela, (SELECT COUNT(*) FROM (DESCRIBE SELECT * FROM {t})) AS colunas, "
        f"COUNT(*) AS linhas FROM {t}"
        for t in binding.TABLES
    )


_KPIS = f"""
    SELECT CAST(coalesce(SUM(total), 0) AS DOUBLE) AS receita, COUNT(*) AS pedidos,
           {_MEAN} AS ticket_medio, {{returns}} AS devolucoes
    FROM l_orders"""

_PROJECTION = "SELECT id, created_at, channel, status, CAST(total AS DOUBLE) AS total FROM l_orders"


def _payload() -> str:
    names = _RAW_COLUMNS["customers"][1].split()
    pairs = ", ".join(f"'{c}', {_na(c)}" for c in names)
    return (
        "SELECT CAST(1 AS BIGINT) AS ingestion_run_id, 'customers' AS source_table, "
        f"CAST(json_object({pairs}) AS VARCHAR) AS payload FROM r_customers"
    )


_NAMED_PAIRS = """
    SELECT t.produto_a, t.produto_b, t.coocorrencias,
           pa.name AS produto_a_nome, pb.name AS produto_b_nome
    FROM (SELECT * FROM pairs ORDER BY coocorrencias DESC, produto_a, produto_b LIMIT 30) t
    LEFT JOIN l_variants va ON t.produto_a = va.id LEFT JOIN l_products pa ON va.product_id = pa.id
    LEFT JOIN l_variants vb ON t.produto_b = vb.id LEFT JOIN l_products pb ON vb.product_id = pb.id"""

_TOP_HISTORY = """
    SELECT t.customer_id, t.posicao, t.product_variant_id, p.name AS produto,
           t.quantidade_historica
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                 ORDER BY quantidade_historica DESC, product_variant_id) AS posicao FROM history) t
    LEFT JOIN l_variants v ON t.product_variant_id = v.id
    LEFT JOIN l_products p ON v.product_id = p.id
    WHERE t.posicao <= 10"""


def _treated_orders(columns: str, source: str) -> str:
    return ", ".join(
        f"CAST({_coerced(c)} AS DOUBLE) AS {c}" if c == "total" else f"{_coerced(c)} AS {c}"
        for c in columns.split()
    ) + f" FROM {source}"


_CLEAN_ORDERS = (
    "(SELECT DISTINCT "
    + ", ".join(f"{_na(c)} AS {c}" for c in _RAW_COLUMNS["orders"][1].split())
    + " FROM r_orders)"
)


def _line(cells) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cells)


# Types in which the payload cells of raw tables are read; other cells are text.
_PAYLOAD_TYPES = {
    "BIGINT": "id customer_id order_id product_variant_id product_id",
    "DECIMAL(18,2)": "total line_total sale_price cost_price total_refund_amount",
    "DECIMAL(18,4)": "quantity",
    "TIMESTAMP": "placed_at created_at",
    "BOOLEAN": "is_active",
}
# The declared columns of the treated tables, in order.
_TREATED_COLUMNS = {
    "orders": "id order_number channel customer_id salesperson_id location_id status subtotal discount_amount total placed_at created_at updated_at",
    "order_items": "id order_id product_variant_id quantity unit_price icms_rate ipi_rate line_total",
    "products": "id name description brand_id category_id ncm_code unit_of_measure is_active",
    "product_variants": "id product_id sku barcode_ean sale_price cost_price weight_kg icms_rate ipi_rate is_active",
    "customers": "id person_type legal_name trade_name tax_id state_registration email phone is_active created_at updated_at",
    "addresses": "id customer_id address_type city state country is_primary",
    "returns": "id order_id customer_id status reason total_refund_amount created_at",
}
_KIND = {c: kind for kind, names in _PAYLOAD_TYPES.items() for c in names.split()}


def _typed(column: str) -> str:
    cell = _na(column)
    return f"TRY_CAST({cell} AS {_KIND[column]})" if column in _KIND else cell


def _payload_lines() -> str:
    parts = ["SELECT 'documents' AS tabela, " + _line(["doc_id", "text", "lang", "source"]) + " AS linha FROM documents"]
    for table, (cte, names) in _RAW_COLUMNS.items():
        held = [c for c in _TREATED_COLUMNS[table].split() if c in names.split()]
        parts.append(f"SELECT '{table}', {_line(map(_typed, held))} FROM {cte}")
    return " UNION ALL ".join(parts)


_TRIMMED = "trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _treated_lines() -> str:
    parts, run = [], 0
    for table in _LOADED:
        run += 1
        if table not in _RAW_COLUMNS:
            continue
        run += 1
        cte, names = _RAW_COLUMNS[table]
        clean = ", ".join(f"{_na(c)} AS {c}" for c in names.split())

        def cell(c: str) -> str:
            if c not in names.split():
                return "NULL"
            if table == "customers" and c in ("tax_id", "phone", "email"):
                return _TRIMMED.format(c=c)
            return _coerced(c) if c in _COERCED else f"TRY_CAST({c} AS {_KIND[c]})" if c in _KIND else c

        cells = [*map(cell, _TREATED_COLUMNS[table].split()), str(run)]
        parts.append(f"SELECT '{table}' AS tabela, {_line(cells)} AS linha FROM (SELECT DISTINCT {clean} FROM {cte})")
    return " UNION ALL ".join(parts)


def _numbered_payload() -> str:
    stamp = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
    cells = {c: stamp.format(c=c) if c.endswith("_at") else f"CAST({c} AS VARCHAR)" for c in _TREATED_COLUMNS["orders"].split()}
    pairs = ", ".join(f"'{c}', {cell}" for c, cell in cells.items())
    return (
        "SELECT CAST(1 AS BIGINT) AS ingestion_run_id, 'orders' AS source_table, row_number() OVER (ORDER BY id) AS source_row_number, "
        f"CAST(json_object({pairs}) AS VARCHAR) AS payload FROM l_orders"
    )


def _followed_payload() -> str:
    names = _RAW_COLUMNS["orders"][1].split()
    pairs = ", ".join(f"'{c}', {_na(c)}" for c in names)
    both = f"(SELECT {', '.join(names)} FROM r_orders UNION ALL SELECT {', '.join(names)} FROM later)"
    return f"SELECT 'orders' AS source_table, CAST(json_object({pairs}) AS VARCHAR) AS payload FROM {both}"


def _merged() -> str:
    names = _RAW_COLUMNS["orders"][1].split()
    clean = ", ".join(f"{_na(c)} AS {c}" for c in names)
    source = f"(SELECT DISTINCT {clean} FROM one_order WHERE id NOT IN (SELECT id FROM later) UNION ALL SELECT {clean} FROM later)"

    def cell(c: str) -> str:
        if c in ("subtotal", "discount_amount"):
            return f"CAST(NULL AS DOUBLE) AS {c}"
        if c not in names:
            return f"CAST(NULL AS {'TIMESTAMP' if c == 'updated_at' else 'BIGINT'}) AS {c}"
        if c in ("id", "customer_id"):
            return f"CAST({c} AS BIGINT) AS {c}"
        return f"CAST({_coerced(c)} AS DOUBLE) AS {c}" if c == "total" else f"{_coerced(c)} AS {c}"

    return f"SELECT {', '.join(map(cell, _TREATED_COLUMNS['orders'].split()))} FROM {source}"


_REPLAYED = """
    SELECT id, order_number, regras FROM x_marked WHERE regras = ''
    UNION ALL
    SELECT own, order_number, CASE WHEN own IN (SELECT id FROM x_marked WHERE regras = '') THEN 'primary_key:id' ELSE '' END
    FROM x_marked WHERE regras <> ''"""

_WAREHOUSE_ROWS = """
    SELECT 'brands' AS tabela, COUNT(*) AS linhas, COUNT(*) AS celulas_nulas, CAST(SUM(id) AS BIGINT) AS soma_ids FROM w_brands
    UNION ALL SELECT 'categories', COUNT(*), COUNT(*) - COUNT(parent_category_id), CAST(SUM(id) AS BIGINT) FROM w_categories
    UNION ALL SELECT 'customers', COUNT(*), 2 * COUNT(*), CAST(SUM(c_custkey) AS BIGINT) FROM customer
    UNION ALL SELECT 'employees', COUNT(*), COUNT(*), CAST(SUM(s_suppkey) AS BIGINT) FROM supplier
    UNION ALL SELECT 'orders', COUNT(*), 0, CAST(SUM(o_orderkey) AS BIGINT) FROM orders
    UNION ALL SELECT 'fiscal_invoices', COUNT(*), 0, CAST(SUM(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'F'"""

# (esquema, declared columns, rows and filled cells, columns lost, added and of another type)
_SCHEMAS = [
    ("treated.orders", 14, "l_orders", "id order_number channel customer_id status total placed_at created_at", 1, 0, 0),
    ("treated.order_items", 9, "l_items", "order_id product_variant_id quantity line_total", 5, 0, 0),
    ("treated.products", 9, "l_products", "id name", 7, 0, 0),
    ("treated.product_variants", 11, "l_variants", "id product_id sale_price cost_price", 7, 0, 0),
    ("treated.customers", 12, "l_customers", "id person_type legal_name", 9, 0, 0),
    ("treated.addresses", 8, "l_addresses", "customer_id address_type state", 5, 0, 0),
    ("treated.returns", 8, "l_returns", "order_id total_refund_amount", 6, 0, 0),
]


def _all_schemas() -> str:
    parts = [
        f"SELECT '{name}' AS esquema, CAST({n} AS BIGINT) AS colunas, COUNT(*) AS linhas, "
        f"CAST({' + '.join(f'COUNT({c})' for c in filled.split())} AS BIGINT) AS celulas_preenchidas, "
        f"CAST({lost} AS BIGINT) AS perdidas, CAST({added} AS BIGINT) AS novas, CAST({other} AS BIGINT) AS retipadas FROM {cte}"
        for name, n, cte, filled, lost, added, other in _SCHEMAS
    ]
    sizes = {"brands": 6, "categories": 7, "customers": 11, "employees": 11, "orders": 13, "fiscal_invoices": 11}
    parts += [
        f"SELECT 'warehouse.{t}', {n}, linhas, CAST({n} * linhas - celulas_nulas AS BIGINT), 0, 0, 0 FROM ({_WAREHOUSE_ROWS}) WHERE tabela = '{t}'"
        for t, n in sizes.items()
    ]
    parts.append(f"SELECT 'control.ingestion_runs', 8, COUNT(*), 8 * COUNT(*), 0, 0, 0 FROM ({_raw_log()} UNION ALL {_treated_log()})")
    parts.append(
        f"SELECT 'control.raw_csv_rows', 5, CAST(SUM(row_count) AS BIGINT), CAST(5 * SUM(row_count) AS BIGINT), 0, 0, 0 FROM ({_raw_log()})"
    )
    return " UNION ALL ".join(parts)


def _reference(table: str, column: str, to: str, values: str, parent: str) -> str:
    return (
        f"SELECT '{table}' AS tabela, '{column}' AS coluna, '{to}.id' AS referencia, COUNT(DISTINCT v) AS valores, COUNT(v) AS linhas "
        f"FROM ({values}) WHERE v NOT IN ({parent})"
    )


def _references() -> str:
    return " UNION ALL ".join(
        [
            _reference("categories", "parent_category_id", "categories", "SELECT id + 1 AS v FROM w_categories", "SELECT id FROM w_categories"),
            _reference("orders", "customer_id", "customers", "SELECT customer_id AS v FROM b_orders", "SELECT c_custkey FROM customer"),
            _reference("orders", "salesperson_id", "employees", "SELECT salesperson_id AS v FROM b_orders", "SELECT s_suppkey FROM supplier"),
            _reference("fiscal_invoices", "order_id", "orders", "SELECT order_id AS v FROM b_invoices", "SELECT id FROM b_orders"),
            "SELECT 'raw_csv_rows', 'ingestion_run_id', 'ingestion_runs.id', 0, 0",
        ]
    )


def oracle_sql() -> dict[str, str]:
    body = {
        "json_payload_tables": _payload_lines(),
        "treated_tables_write": _treated_lines(),
        "raw_json_numbered": _numbered_payload(),
        "raw_after_arrivals": _followed_payload(),
        "treated_after_merge": _merged(),
        "quarantine_rows": "SELECT id, order_number, regras FROM x_marked WHERE regras <> ''",
        "quarantine_replay": _REPLAYED,
        "warehouse_load": _WAREHOUSE_ROWS,
        "warehouse_by_channel": "SELECT o_orderpriority AS channel, COUNT(*) AS orders_count, "
        "CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total_sales, "
        "CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / COUNT(*) AS average_ticket FROM orders GROUP BY 1",
        "table_schemas_all": _all_schemas(),
        "audit_keys": " UNION ALL ".join(
            f"SELECT '{kind}:{c}' AS regra, {c} AS valor, COUNT(*) AS linhas FROM r_customers GROUP BY {c} HAVING COUNT(*) > 1"
            for kind, c in (("primary_key", "id"), ("unique", "tax_id"), ("unique", "email"))
        ),
        "audit_references": _references(),
        "audit_domains": "SELECT 'customers' AS tabela, 'person_type' AS coluna, 'XX' AS valor, COUNT(*) AS linhas "
        "FROM customer WHERE c_acctbal < 0 HAVING COUNT(*) > 0 UNION ALL SELECT 'ingestion_runs', 'layer', 'bruto', 1",
        "q1_quality_series": "SELECT COUNT(*) FILTER (WHERE total IS NULL) AS nulos_total, COUNT(*) FILTER (WHERE total < 0) AS negativos_total, "
        "COUNT(*) FILTER (WHERE ts IS NULL) AS nulos_created_at, COUNT(*) FILTER (WHERE isnan(total) OR isinf(total)) AS valores_nao_finitos_total "
        "FROM (SELECT ts, CASE event_type WHEN 'error' THEN CAST('NaN' AS DOUBLE) WHEN 'signup' THEN CAST('Infinity' AS DOUBLE) "
        "WHEN 'purchase' THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS total FROM events)",
        # Sources and layers.
        "csv_dir_scan": _csv_scan(),
        "csv_typed_load": "SELECT * REPLACE (CAST(subtotal AS DOUBLE) AS subtotal, "
        "CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(total AS DOUBLE) AS total) FROM l_orders",
        "csv_folded_load": "SELECT doc_id, text, lang, source FROM documents",
        "na_tokens": f"SELECT id, {_na('channel')} AS channel, channel AS channel_copy FROM r_orders",
        "source_row_number": "SELECT id, row_number() OVER (ORDER BY id) AS source_row_number "
        "FROM l_orders",
        "sql_source": "SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, "
        "COUNT(*) AS orders_count, CAST(SUM(total) AS DOUBLE) AS total_sales "
        "FROM l_orders WHERE created_at IS NOT NULL GROUP BY 1",
        "table_or_empty": _KPIS.format(returns="CAST(0 AS BIGINT)"),
        "json_payload_read": "SELECT doc_id, text, lang, source FROM documents",
        "catalog_columns": _catalog(),
        "load_inventory": "SELECT CAST(7 AS BIGINT) AS tabelas, COUNT(*) AS pedidos FROM l_orders",
        "raw_json_rows": _payload(),
        "ingestion_run_raw": _raw_log(),
        "ingestion_run_treated": _treated_log(),
        "treated_write": "SELECT CAST(id AS BIGINT) AS id, order_number, channel, "
        "CAST(customer_id AS BIGINT) AS customer_id, CAST(NULL AS BIGINT) AS location_id, status, "
        f"CAST({_coerced('total')} AS DOUBLE) AS total, {_coerced('placed_at')} AS placed_at, "
        f"{_coerced('created_at')} AS created_at, CAST({_orders_run()} AS BIGINT) AS source_run_id "
        f"FROM {_CLEAN_ORDERS}",
        "full_refresh": _refresh_rows(),
        "table_schemas": _conformed(),
        "decimal_fit": "SELECT id, "
        "CAST(CAST(CAST(total AS DECIMAL(18,2)) * CAST(0.125 AS DECIMAL(4,3)) AS DECIMAL(18,2)) AS DOUBLE) "
        "AS oitavo, CAST(TRY_CAST(total AS DECIMAL(7,2)) AS DOUBLE) AS ate_cinco_digitos FROM l_orders",
        # Treatment.
        "exact_dedup": "SELECT DISTINCT * FROM r_orders",
        "coerce_dates": f"SELECT id, {_coerced('placed_at')} AS placed_at, "
        f"{_coerced('created_at')} AS created_at FROM r_orders",
        "coerce_numbers": "SELECT order_id, product_variant_id, "
        f"CAST({_coerced('quantity')} AS DOUBLE) AS quantity, "
        f"CAST({_coerced('line_total')} AS DOUBLE) AS line_total FROM r_items",
        "trim_customer_ids": "SELECT id, "
        + ", ".join(
            f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS {c}"
            for c in schemas.TRIMMED_CUSTOMER_COLUMNS
        )
        + " FROM r_customers",
        "ids_as_text": "SELECT 'phone' AS coluna, phone AS valor FROM r_customers "
        "UNION ALL SELECT 'barcode_ean', barcode_ean FROM r_variants "
        "UNION ALL SELECT 'tax_id', tax_id FROM r_customers",
        "treat_table": "SELECT " + _treated_orders(_RAW_COLUMNS["orders"][1], _CLEAN_ORDERS),
        "treatment_report": _report(),
        "treatment_report_stored": _report(),
        "null_profile_stored": " UNION ALL ".join(
            f"SELECT '{c}' AS coluna, COUNT(*) - COUNT({c}) AS nulos, round((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6) AS percentual FROM ({_merged()})"
            for c in _TREATED_COLUMNS["orders"].split()
        ) + f" UNION ALL SELECT 'source_run_id', 0, 0.0 FROM (SELECT 1)",
        "top12_null_tables": f"SELECT tabela, nulos_raw FROM ({_report()}) "
        "ORDER BY nulos_raw DESC, tabela LIMIT 12",
        "top12_dup_tables": f"SELECT tabela, duplicados_removidos FROM ({_report()}) "
        "ORDER BY duplicados_removidos DESC, tabela LIMIT 12",
        # Constraint audits.
        "audit_pk": "SELECT l_orderkey, l_linenumber, COUNT(*) AS linhas FROM lineitem GROUP BY 1, 2 "
        "HAVING COUNT(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL",
        "audit_unique": "SELECT tax_id, COUNT(*) AS linhas FROM r_customers "
        "WHERE tax_id IS NOT NULL GROUP BY tax_id HAVING COUNT(*) > 1",
        "audit_fk": "SELECT id, COUNT(*) AS linhas FROM l_orders o WHERE id IS NOT NULL "
        "AND NOT EXISTS (SELECT 1 FROM l_items i WHERE i.order_id = o.id) GROUP BY id",
        "audit_domain": "SELECT id, channel FROM l_orders WHERE channel NOT IN ('1-URGENT', '2-HIGH')",
        "audit_not_null": "SELECT coluna, nulos FROM ("
        + _null_rows(
            [c.name for c in schemas.WAREHOUSE["orders"].columns if c.required], "coluna", "nulos"
        )
        + ")",
        "audit_length": "SELECT doc_id, length(text) AS tamanho FROM documents WHERE length(text) > 255",
        "audit_decimal_range": "SELECT * FROM r_items WHERE line_total IS NOT NULL "
        "AND TRY_CAST(line_total AS DECIMAL(6,2)) IS NULL",
        "audit_json": "SELECT event_id, props FROM (SELECT event_id, CASE WHEN event_type = 'error' "
        "THEN replace(props, '}', '') ELSE props END AS props FROM events) "
        "WHERE props IS NOT NULL AND NOT json_valid(props)",
        "column_default": "SELECT id, CAST(0 AS DOUBLE) AS subtotal, "
        "CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(total AS DOUBLE) AS total FROM l_orders",
        "audit_table": _audit(),
        # Exploration.
        "eda_overview": "SELECT COUNT(*) AS linhas, "
        "(SELECT COUNT(*) FROM (DESCRIBE SELECT * FROM l_orders)) AS colunas, "
        f"MIN(created_at) AS data_minima, MAX(created_at) AS data_maxima, {_MEAN} AS total_medio "
        "FROM l_orders",
        "eda_total_stats": " UNION ALL ".join(
            f"SELECT '{name}' AS metrica, round({value}, 6) AS valor FROM l_orders"
            for name, value in {
                "Mínimo": "CAST(MIN(total) AS DOUBLE)",
                "Máximo": "CAST(MAX(total) AS DOUBLE)",
                "Média": _MEAN,
                "Mediana": "quantile_cont(CAST(total AS DOUBLE), 0.5)",
                "Desvio padrão": "stddev_samp(CAST(total AS DOUBLE))",
            }.items()
        ),
        "eda_quartiles": "SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
        "round(lo, 6) AS limite_inferior, round(hi, 6) AS limite_superior FROM fences",
        "eda_outliers": "SELECT id, created_at, channel, CAST(total AS DOUBLE) AS total, "
        "COUNT(*) OVER () AS sinalizados, round(lo, 6) AS limite_inferior, "
        "round(hi, 6) AS limite_superior FROM series, series_fences "
        "WHERE total < lo OR total > hi ORDER BY id LIMIT 20",
        "eda_outlier_summary": "SELECT COUNT(*) FILTER (WHERE total < lo OR total > hi) AS sinalizados, "
        "round(MAX(lo), 6) AS limite_inferior, round(MAX(hi), 6) AS limite_superior "
        "FROM l_orders, fences",
        "eda_outlier_flag": "SELECT id, CAST(total AS DOUBLE) AS total, "
        "coalesce(total < lo OR total > hi, false) AS outlier_iqr FROM series, series_fences",
        "eda_histogram_50": _histogram("l_orders", 50),
        "eda_histogram_40": _histogram("series", 40),
        "eda_null_profile": "SELECT coluna, nulos, "
        "round(CAST(nulos AS DOUBLE) * 100.0 / nullif(total_rows, 0), 6) AS percentual FROM ("
        + _null_rows(profile.ORDER_VIEW_COLUMNS, "coluna", "nulos")
        + ")",
        "v_orders_eda": "SELECT COUNT(*) AS total_rows, MIN(created_at) AS min_created_at, "
        "MAX(created_at) AS max_created_at, CAST(MIN(total) AS DOUBLE) AS min_total, "
        f"CAST(MAX(total) AS DOUBLE) AS max_total, {_MEAN} AS avg_total, "
        "COUNT(*) FILTER (WHERE total IS NULL) AS null_total, "
        "COUNT(*) FILTER (WHERE total < 0) AS negative_total FROM l_orders",
        "v_orders_by_month": "SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, "
        f"COUNT(*) AS orders_count, CAST(SUM(total) AS DOUBLE) AS total_sales, {_MEAN} AS average_ticket "
        "FROM l_orders WHERE created_at IS NOT NULL GROUP BY 1",
        "v_orders_by_channel": f"SELECT coalesce(channel, '[NULO]') AS channel, "
        f"COUNT(*) AS orders_count, CAST(SUM(total) AS DOUBLE) AS total_sales, {_MEAN} AS average_ticket "
        "FROM l_orders GROUP BY 1",
        "v_orders_nulls": _null_rows(profile.ORDER_VIEW_COLUMNS, "column_name", "null_count"),
        "orders_null_pct": "SELECT *, CAST(round(CAST(null_count AS DOUBLE) * 100.0 "
        "/ nullif(total_rows, 0), 2) AS DOUBLE) AS null_pct FROM ("
        + _null_rows(profile.ORDER_VIEW_COLUMNS, "column_name", "null_count")
        + ")",
        "q1_iqr_outliers": "SELECT COUNT(*) AS quantidade_sinalizada, "
        "round(MIN(lo), 6) AS limite_inferior, round(MAX(hi), 6) AS limite_superior "
        "FROM l_orders, fences WHERE total < lo OR total > hi",
        "q1_iqr_outliers_series": "SELECT COUNT(*) AS quantidade_sinalizada, "
        "round(MIN(lo), 6) AS limite_inferior, round(MAX(hi), 6) AS limite_superior "
        "FROM series, series_fences WHERE total < lo OR total > hi",
        "q1_summary": "SELECT COUNT(*) AS total_linhas, "
        "(SELECT COUNT(*) FROM (DESCRIBE SELECT * FROM l_orders)) AS total_colunas, "
        "MIN(created_at) AS data_minima_created_at, MAX(created_at) AS data_maxima_created_at, "
        "CAST(MIN(total) AS DOUBLE) AS valor_minimo, CAST(MAX(total) AS DOUBLE) AS valor_maximo, "
        f"{_MEAN} AS valor_medio FROM l_orders",
        "q1_quality": "SELECT COUNT(*) FILTER (WHERE total IS NULL) AS nulos_total, "
        "COUNT(*) FILTER (WHERE total < 0) AS negativos_total, "
        "COUNT(*) FILTER (WHERE created_at IS NULL) AS nulos_created_at, "
        "COUNT(*) FILTER (WHERE isnan(CAST(total AS DOUBLE))) AS valores_nao_finitos_total "
        "FROM l_orders",
        "q1_diagnosis": _diagnosis(),
        "orders_projection": _PROJECTION,
        # Sales.
        "sales_monthly": f"SELECT coalesce(strftime(created_at, '%Y-%m'), 'NaT') AS mes, "
        "CAST(coalesce(SUM(total), 0) AS DOUBLE) AS receita, COUNT(id) AS pedidos, "
        f"{_MEAN} AS ticket_medio FROM l_orders GROUP BY 1",
        "sales_kpis": _KPIS.format(returns="(SELECT COUNT(*) FROM l_returns)"),
        "sales_by_channel": "SELECT channel, CAST(coalesce(SUM(total), 0) AS DOUBLE) AS receita, "
        "COUNT(id) AS pedidos FROM l_orders GROUP BY channel",
        "item_margin": "SELECT order_id, product_variant_id, CAST(quantity AS DOUBLE) AS quantity, "
        "CAST(line_total AS DOUBLE) AS line_total, CAST(cost_price AS DOUBLE) AS cost_price, name, "
        "CAST(profit AS DOUBLE) AS profit FROM margins",
        "product_ranking": "SELECT * FROM product_totals ORDER BY unidades DESC, name LIMIT 20",
        "product_losses": "SELECT * FROM product_totals WHERE lucro < 0 ORDER BY lucro, name LIMIT 20",
        # Customers.
        "customer_orders": "SELECT o.*, c.legal_name, c.person_type FROM "
        "(SELECT customer_id, COUNT(id) AS pedidos, "
        "CAST(coalesce(SUM(total), 0) AS DOUBLE) AS receita, COUNT(id) > 1 AS recompra "
        "FROM l_orders WHERE customer_id IS NOT NULL GROUP BY customer_id) o "
        "LEFT JOIN l_customers c ON o.customer_id = c.id",
        "customer_kpis": "SELECT COUNT(*) AS clientes_ativos, "
        "round(CAST(COUNT(*) FILTER (WHERE pedidos > 1) AS DOUBLE) * 100.0 / COUNT(*), 6) "
        "AS taxa_recompra, CAST(SUM(receita) AS DOUBLE) / COUNT(*) AS receita_media, "
        "(SELECT COUNT(*) FROM l_customers WHERE person_type = 'PF') AS pf, "
        "(SELECT COUNT(*) FROM l_customers WHERE person_type = 'PJ') AS pj "
        "FROM (SELECT COUNT(id) AS pedidos, SUM(total) AS receita FROM l_orders "
        "WHERE customer_id IS NOT NULL GROUP BY customer_id)",
        "customer_profit": "SELECT t.customer_id, c.legal_name, c.person_type, t.lucro FROM "
        "(SELECT o.customer_id, CAST(coalesce(SUM(m.profit), 0) AS DOUBLE) AS lucro "
        "FROM l_orders o LEFT JOIN margins m ON o.id = m.order_id GROUP BY o.customer_id) t "
        "LEFT JOIN l_customers c ON t.customer_id = c.id ORDER BY lucro DESC, t.customer_id LIMIT 20",
        "person_type_split": "SELECT person_type, COUNT(*) AS clientes, "
        "round(CAST(COUNT(*) AS DOUBLE) * 100.0 / (SELECT COUNT(*) FROM l_customers), 6) AS percentual "
        "FROM l_customers GROUP BY person_type",
        "customers_by_state": "SELECT state, COUNT(*) AS clientes, "
        "COUNT(DISTINCT customer_id) AS clientes_distintos FROM l_addresses GROUP BY state",
        # Forecast.
        "daily_orders": "SELECT * FROM daily",
        "daily_gapfill": "SELECT * FROM grid",
        "moving_avg_7d": "SELECT dia, pedidos, round(AVG(pedidos) OVER "
        "(ORDER BY dia ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS media_movel_7d FROM grid",
        "linear_trend": "SELECT round(slope, 6) AS inclinacao, round(intercept, 6) AS intercepto FROM fit",
        "forecast_30d": "SELECT dia, round(previsto, 6) AS pedidos_previstos FROM forecast",
        "forecast_mean": "SELECT round(AVG(previsto), 6) AS media_prevista FROM forecast",
        "history_plus_forecast": "SELECT dia, CAST(pedidos AS DOUBLE) AS valor, 'Histórico' AS tipo "
        "FROM grid UNION ALL SELECT dia, round(previsto, 6), 'Previsão' FROM forecast",
        # Recommendations.
        "order_baskets": "SELECT order_id, coalesce(string_agg(CAST(product_variant_id AS VARCHAR), ',' "
        "ORDER BY product_variant_id), '') AS produtos "
        "FROM (SELECT DISTINCT order_id, product_variant_id FROM l_items) GROUP BY order_id",
        "basket_items": "SELECT DISTINCT order_id, product_variant_id FROM l_items "
        "WHERE product_variant_id IS NOT NULL",
        "product_pairs": "SELECT * FROM pairs",
        "product_pairs_named": _NAMED_PAIRS,
        "customer_list": "SELECT DISTINCT customer_id FROM l_orders WHERE customer_id IS NOT NULL",
        "next_purchase": "SELECT customer_id, product_variant_id, produto, quantidade_historica "
        f"FROM ({_TOP_HISTORY}) WHERE customer_id = (SELECT MIN(customer_id) FROM l_orders)",
        "next_purchase_all": _TOP_HISTORY,
        # Display formats.
        "fmt_brl": "SELECT id, coalesce('R$ ' || translate(format('{:,.2f}', CAST(total AS DOUBLE)), ',.', '.,'), '—') "
        "AS texto "
        "FROM l_orders",
        "fmt_int": f"SELECT id, {_dots('CAST(floor(total) AS BIGINT)')} AS texto FROM l_orders",
        "fmt_date": "SELECT id, coalesce(strftime(created_at, '%d/%m/%Y'), '—') AS texto FROM l_orders",
        "fmt_pct1": "SELECT id, format('{:.1f}', CAST(total AS DOUBLE) / 1000) || '%' AS texto "
        "FROM l_orders",
    }
    return {name: _with(sql) for name, sql in body.items()}
