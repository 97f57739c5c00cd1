"""CSV folders as DataFrames of text, CSV files in a declared schema, row numbers.

A table ``orders`` is either one file ``orders.csv`` or a folder ``orders.csv/``
of part files, which is how a large table is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from vitrine import schemas
from vitrine.functions.coercion import null_if_token
from vitrine.functions.names import named
from vitrine.sources.folded_csv import SURPLUS, Survey, parse, read_folded_csv, records, survey, text_schema, without_surplus

ROW_NUMBER = "source_row_number"


def list_csv_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name -> path of each ``*.csv`` file, or folder of part files, right in ``folder``.

    Only paths are listed, by the file system that owns them; no content is read. What
    lies deeper, such as ``old/orders.csv``, is another folder's.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for status in system.listStatus(place):
        path = status.getPath()
        name = path.getName()
        if name.endswith(".csv") and not name.startswith(("_", ".")):
            found[name.removesuffix(".csv")] = path.toString()
    return dict(sorted(found.items()))


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """True if some record spans several lines: then a line holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


# How the records of a table lie in its files, and who reads them.
ONE_LINE = "one line"  # Spark's reader, files split among tasks
FOLDED = "folded"  # put together from lines by many tasks


def record_layout(spark: SparkSession, path: str) -> str:
    """Look for records that span lines, which Spark's reader would take in one task a file.

    The content alone decides, so a table reads the same whatever its size.
    """
    return FOLDED if has_quoted_newlines(spark, path) else ONE_LINE


def read_csv_text(
    spark: SparkSession,
    path: str,
    na_tokens: Iterable[str] = schemas.NA_TOKENS,
    layout: str | None = None,
    found: Survey | None = None,
) -> DataFrame:
    """Every column as text, so leading zeros and the written form of a value stay.

    The table is surveyed for its columns and record layout unless that was done.
    """
    found = found or survey(spark, {"": path})[""]
    layout = layout or (FOLDED if found.folded else ONE_LINE)
    if layout == FOLDED:
        df = read_folded_csv(spark, path, ROW_NUMBER, found=found).drop(ROW_NUMBER)
    else:
        df = without_surplus(_csv(spark, path, found.names))
    return null_tokens(df, na_tokens)


def read_csv_numbered(
    spark: SparkSession,
    path: str,
    na_tokens: Iterable[str] = schemas.NA_TOKENS,
    layout: str | None = None,
    found: Survey | None = None,
) -> DataFrame:
    """:func:`read_csv_text` plus ``source_row_number``, 1-based in file order.

    Rows stay where they are read, but for records that cross the end of a file split. With a
    layout of one line quotes are taken as Spark's reader takes them.
    """
    found = found or survey(spark, {"": path})[""]
    if (layout or ONE_LINE) == ONE_LINE and not found.folded:
        numbered = parse(records(spark, found), found, ROW_NUMBER)
    else:
        numbered = read_folded_csv(spark, path, ROW_NUMBER, found=found)
    return null_tokens(numbered, na_tokens, found.names)


def _csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The header's columns as text, and what a record has beyond them."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"')
    return reader.schema(text_schema([*names, SURPLUS])).csv(path)


def scan_csv_dir(
    spark: SparkSession,
    folder: str,
    na_tokens: Iterable[str] = schemas.NA_TOKENS,
    layout: str | None = None,
) -> dict[str, DataFrame]:
    """All tables of a folder as text, surveyed in one scan."""
    paths = list_csv_tables(spark, folder)
    found = survey(spark, paths)
    return {name: read_csv_text(spark, path, na_tokens, layout, found[name]) for name, path in paths.items()}


def read_csv_typed(
    spark: SparkSession, path: str, schema: T.StructType, layout: str | None = None
) -> DataFrame:
    """Load into a declared schema: an empty field is null, a quoted empty one is
    an empty text. A field that does not fit its type ends the job, and so does a
    record with too few or too many fields. Both layouts convert by the same reader.

    A job converts the columns that it reads; writing the table checks them all.
    """
    quoted_empty = uuid.uuid4().hex  # stands for a quoted empty text while the file is read; no cell can hold it
    options = {
        "nullValue": "",
        "emptyValue": quoted_empty,
        "escape": '"',
        "mode": "FAILFAST",
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
        "dateFormat": "yyyy-MM-dd",
    }
    layout = layout or record_layout(spark, path)
    if layout == FOLDED:
        loaded = read_folded_csv(spark, path, ROW_NUMBER, schema, found=None, **options).drop(ROW_NUMBER)
    else:
        loaded = (
            spark.read.schema(schema)
            .options(**options)
            .option("header", True)
            .option("encoding", "UTF-8")
            .option("columnPruning", False)  # a record with too few fields always counts as bad
            .csv(path)
        )
    text = [f.name for f in schema.fields if f.dataType == T.StringType()]
    return loaded.withColumns(
        {
            c: F.when(named(c) == quoted_empty, F.lit("")).otherwise(named(c))
            for c in text
        }
    )


def null_tokens(
    df: DataFrame,
    tokens: Iterable[str] = schemas.NA_TOKENS,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Turn cells that spell a missing value into null."""
    tokens = tuple(tokens)
    text = [f.name for f in df.schema.fields if f.dataType == T.StringType()]
    chosen = set(text if columns is None else columns)
    if not tokens or not chosen:
        return df
    return df.select(
        *[null_if_token(named(c), tokens).alias(c) if c in chosen else named(c) for c in df.columns]
    )


_SPLIT = ["_file", "_block"]


def with_splits(scan: DataFrame) -> DataFrame:
    """A file scan with the file split that each row comes from."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def number_split_rows(scan: DataFrame, name: str = ROW_NUMBER) -> DataFrame:
    """Number the rows of :func:`with_splits` from 1, in file order and then in row order.

    A first pass keeps one row per file split (its row count and first position);
    running totals over those give each split its offset, so the rows themselves
    are never sorted or moved. Should the second pass see other splits than the
    first, the job fails.
    """
    scanned = scan.withColumn("_position", F.monotonically_increasing_id())
    before = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        scanned.groupBy(*_SPLIT)
        .agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(
            *_SPLIT, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
        )
    )
    # Task number and place within the task are packed in the position.
    same_task = F.shiftright("_position", 33) == F.shiftright("_first", 33)
    number = F.when(
        F.col("_first").isNotNull() & same_task & (F.col("_position") >= F.col("_first")),
        F.col("_position") - F.col("_first") + F.col("_before") + 1,
    ).otherwise(F.raise_error(F.lit("file splits changed between the two passes")).cast("long"))
    kept = [named(c) for c in scan.columns if c not in _SPLIT]
    return scanned.join(offsets, _SPLIT, "left").select(*kept, number.alias(name))
