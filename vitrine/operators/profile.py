"""Exploration of one orders-like table: overview, spread, outliers, nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vitrine import schemas
from vitrine.functions.quantiles import exact_quantiles
from vitrine.functions.text import fmt_int

IQR_FACTOR = 1.5


def mean(column: str) -> Column:
    """Mean as double from an exact sum, hence equal for every row order; null if no value."""
    return F.sum(column).cast("double") / F.nullif(F.count(column), F.lit(0))


def eda_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("linhas"),
        F.lit(len(df.columns)).cast("long").alias("colunas"),
        F.min("created_at").alias("data_minima"),
        F.max("created_at").alias("data_maxima"),
        mean("total").alias("total_medio"),
    )


@dataclass(frozen=True)
class Fences:
    """Quartiles of a column and the limits of the interquartile rule."""

    q1: float | None
    q3: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - IQR_FACTOR * self.iqr

    @property
    def upper(self) -> float | None:
        return None if self.q1 is None else self.q3 + IQR_FACTOR * self.iqr

    def flags(self, value: Column) -> Column:
        """True outside the limits, false inside and for null or NaN."""
        if self.q1 is None:
            return F.lit(False)
        value = value.cast("double")
        outside = (value < self.lower) | ((value > self.upper) & ~F.isnan(value))
        return F.coalesce(outside, F.lit(False))


def fences(df: DataFrame, column: str = "total") -> Fences:
    return Fences(*exact_quantiles(df, column, (0.25, 0.75)))


def _double(value: float | None) -> Column:
    return F.lit(value).cast("double")


def eda_total_stats(df: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, median and sample deviation of ``total`` as rows."""
    (median,) = exact_quantiles(df, "total", (0.5,))
    value = F.col("total").cast("double")
    measures = {
        "Mínimo": F.min(value),
        "Máximo": F.max(value),
        "Média": mean("total"),
        "Mediana": _double(median),
        "Desvio padrão": F.stddev_samp(value),
    }
    row = df.filter(~F.isnan(value) | value.isNull()).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    return row.unpivot([], [F.col(f"`{n}`") for n in measures], "metrica", "valor")


def eda_quartiles(df: DataFrame) -> DataFrame:
    f = fences(df)
    return df.sparkSession.createDataFrame(
        [(f.q1, f.q3, f.iqr, f.lower, f.upper)],
        "q1 double, q3 double, iqr double, limite_inferior double, limite_superior double",
    )


def eda_outliers(df: DataFrame, limits: Fences | None = None, n: int = 20) -> DataFrame:
    """The first ``n`` rows, by id, outside the limits, beside the limits and their count."""
    limits = limits or fences(df)
    flagged = df.filter(limits.flags(F.col("total")))
    first = flagged.select("id", "created_at", "channel", "total").orderBy("id").limit(n)
    total = flagged.agg(F.count(F.lit(1))).scalar()
    return first.select(
        "*",
        total.alias("sinalizados"),
        _double(limits.lower).alias("limite_inferior"),
        _double(limits.upper).alias("limite_superior"),
    )


def eda_outlier_summary(df: DataFrame, limits: Fences | None = None) -> DataFrame:
    """How many rows lie outside the limits; the limits show even if none does."""
    limits = limits or fences(df)
    return df.agg(
        F.count_if(limits.flags(F.col("total"))).alias("sinalizados"),
        F.max(_double(limits.lower)).alias("limite_inferior"),
        F.max(_double(limits.upper)).alias("limite_superior"),
    )


def eda_outlier_flag(df: DataFrame, limits: Fences | None = None) -> DataFrame:
    """Every row with a boolean ``outlier_iqr``."""
    limits = limits or fences(df)
    return df.withColumn("outlier_iqr", limits.flags(F.col("total")))


def eda_histogram(df: DataFrame, bins: int) -> DataFrame:
    """Non-empty bins of equal width between the smallest and largest ``total``."""
    valued = df.select(F.nanvl(F.col("total").cast("double"), F.lit(None)).alias("x"))
    edge = valued.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    binned = valued.select("x", edge.getField("lo").alias("lo"), edge.getField("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))) + 1
    number = F.when(
        F.col("x").isNotNull(),
        F.least(F.lit(bins).cast("long"), F.coalesce(place, F.lit(1).cast("long"))),
    )
    return (
        binned.groupBy(number.alias("faixa"), F.col("lo").alias("_lo"), width.alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("faixa").isNotNull())
        .select(
            "faixa",
            (F.col("_lo") + (F.col("faixa") - 1) * F.col("_w")).alias("inicio"),
            (F.col("_lo") + F.col("faixa") * F.col("_w")).alias("fim"),
            "n",
        )
        .orderBy("faixa")
    )


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Column, null count and row count, all columns in one scan."""
    columns = columns or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return counts.unpivot(["_rows"], columns, "column_name", "null_count").select(
        "column_name", "null_count", F.col("_rows").alias("total_rows")
    )


def _share(n: str, of: str) -> Column:
    return F.col(n) * 100.0 / F.nullif(F.col(of), F.lit(0))


def eda_null_profile(df: DataFrame) -> DataFrame:
    return (
        null_counts(df)
        .select(
            F.col("column_name").alias("coluna"),
            F.col("null_count").alias("nulos"),
            _share("null_count", "total_rows").cast("double").alias("percentual"),
        )
        .orderBy(F.desc("nulos"), "coluna")
    )


def stored_null_profile(profile: DataFrame, table: str, layer: str = "treated") -> DataFrame:
    """The null profile of a table of a layer, from the counts that were kept when it was written."""
    own = profile.filter((F.col("layer") == layer) & (F.col("source_table") == table))
    return own.select("coluna", "nulos", _share("nulos", "linhas").cast("double").alias("percentual")).orderBy(F.desc("nulos"), "coluna")


# --- The order views -------------------------------------------------------


def v_orders_eda(orders: DataFrame) -> DataFrame:
    total = F.col("total")
    return orders.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("created_at").alias("min_created_at"),
        F.max("created_at").alias("max_created_at"),
        F.min(total).cast("double").alias("min_total"),
        F.max(total).cast("double").alias("max_total"),
        mean("total").alias("avg_total"),
        F.count_if(total.isNull()).alias("null_total"),
        F.count_if(total < 0).alias("negative_total"),
    )


def _order_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("orders_count"),
        F.sum("total").cast("double").alias("total_sales"),
        mean("total").alias("average_ticket"),
    ]


def v_orders_by_month(orders: DataFrame) -> DataFrame:
    month = F.trunc(F.to_date("created_at"), "month")
    dated = orders.filter(F.col("created_at").isNotNull())
    return dated.groupBy(month.alias("month")).agg(*_order_sums()).orderBy("month")


def v_orders_by_channel(orders: DataFrame) -> DataFrame:
    channel = F.coalesce("channel", F.lit(schemas.NULL_CHANNEL)).alias("channel")
    return (
        orders.groupBy(channel)
        .agg(*_order_sums())
        .orderBy(F.desc_nulls_last("total_sales"), "channel")
    )


ORDER_VIEW_COLUMNS = [c.name for c in schemas.WAREHOUSE["orders"].columns]


def v_orders_nulls(orders: DataFrame) -> DataFrame:
    return null_counts(orders, [c for c in ORDER_VIEW_COLUMNS if c in orders.columns])


def orders_null_pct(orders: DataFrame) -> DataFrame:
    pct = F.round(_share("null_count", "total_rows").cast("double"), 2)
    return (
        v_orders_nulls(orders)
        .withColumn("null_pct", pct)
        .orderBy(F.desc("null_pct"), "column_name")
    )


def q1_iqr_outliers(orders: DataFrame) -> DataFrame:
    """Outlier count, and the limits as seen on the flagged rows: null if there are none."""
    f = fences(orders)
    flagged = orders.filter(f.flags(F.col("total")))
    return flagged.agg(
        F.count(F.lit(1)).alias("quantidade_sinalizada"),
        F.min(_double(f.lower)).alias("limite_inferior"),
        F.max(_double(f.upper)).alias("limite_superior"),
    )


def q1_summary(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("total_linhas"),
        F.lit(len(orders.columns)).cast("long").alias("total_colunas"),
        F.min("created_at").alias("data_minima_created_at"),
        F.max("created_at").alias("data_maxima_created_at"),
        F.min("total").cast("double").alias("valor_minimo"),
        F.max("total").cast("double").alias("valor_maximo"),
        mean("total").alias("valor_medio"),
    )


def q1_quality(orders: DataFrame) -> DataFrame:
    total = F.col("total")
    return orders.agg(
        F.count_if(total.isNull()).alias("nulos_total"),
        F.count_if(total < 0).alias("negativos_total"),
        F.count_if(F.col("created_at").isNull()).alias("nulos_created_at"),
        F.count_if(F.isnan(total.cast("double")) | (F.abs(total.cast("double")) == float("inf"))).alias("valores_nao_finitos_total"),
    )


# The messages of the reliability diagnosis. {n} is a row count.
MESSAGE_EMPTY = (
    "A base ainda não contém registros; não é possível concluir sobre a confiabilidade "
    "até a carga dos CSVs."
)
MESSAGE_ROWS = "A tabela contém {n} registros observáveis sem transformação aplicada."
MESSAGE_NULLS = (
    "Foram encontrados {n} valores nulos em `total`; a base exige tratamento antes de "
    "análises financeiras."
)
MESSAGE_NO_NULLS = "Não foram encontrados valores nulos em `total`."
MESSAGE_NEGATIVES = (
    "Há {n} valores negativos em `total`, que devem ser investigados como possível "
    "inconsistência ou estorno."
)
MESSAGE_NO_NEGATIVES = "Não foram encontrados valores negativos em `total`."
MESSAGE_CAVEAT = (
    "Valores extremos não são automaticamente erros; o painel os sinaliza para "
    "investigação por IQR, sem removê-los."
)


def q1_diagnosis(orders: DataFrame) -> DataFrame:
    """The reliability messages that the order counts call for, in reading order."""

    def message(text: str, n: str) -> Column:
        head, tail = text.split("{n}")
        return F.concat(F.lit(head), fmt_int(F.col(n)), F.lit(tail))

    def counted(n: str, some: str, none: str) -> Column:
        return F.when(F.col(n) > 0, message(some, n)).otherwise(F.lit(none))

    filled = F.array(
        message(MESSAGE_ROWS, "total_rows"),
        counted("null_total", MESSAGE_NULLS, MESSAGE_NO_NULLS),
        counted("negative_total", MESSAGE_NEGATIVES, MESSAGE_NO_NEGATIVES),
        F.lit(MESSAGE_CAVEAT),
    )
    messages = F.when(F.col("total_rows") == 0, F.array(F.lit(MESSAGE_EMPTY))).otherwise(filled)
    return (
        v_orders_eda(orders)
        .select(F.posexplode(messages).alias("ordem", "mensagem"))
        .orderBy("ordem")
    )


def orders_projection(orders: DataFrame) -> DataFrame:
    return orders.select("id", "created_at", "channel", "status", "total")


def register_views(orders: DataFrame) -> None:
    """Make the order views queryable by name."""
    orders.createOrReplaceTempView("orders")
    views = (v_orders_eda, v_orders_by_month, v_orders_by_channel, v_orders_nulls)
    for view in views:
        view(orders).createOrReplaceTempView(view.__name__)
