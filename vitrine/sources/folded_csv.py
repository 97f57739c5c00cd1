"""CSV records put together from lines, file split by file split.

Spark's reader takes a file with records that span lines in one task. Here the lines of a split stay
where they are read. A line lies inside a quoted field if an odd number of quotes comes before it
in its file. A first scan, the survey, counts for each split the quotes and the records that begin there, for
either state at its start; running totals over one row a split then settle the states and
number the records. A second scan joins the lines of each record; what crosses the end of a
split, at most one record each, is all that moves.

Where no line of a table holds an odd number of quotes, each line is a record: Spark's own expressions then
count, number and split the lines, and no line passes through Python.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from vitrine.functions.names import named, quoted
from vitrine.session import scratch_dir

# A record in which quotes only enclose fields or stand doubled inside them.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
WELL_FORMED = rf"^{_FIELD}(?:,{_FIELD})*+$"

#: File splits of a table whose table of some 50 bytes each is broadcast, at most.
MOST_SPLITS = 2_000_000


#: Column for the first cell that a record has beyond those of the header.
SURPLUS = "_surplus"


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def surplus_message(cell: Column) -> Column:
    return F.concat(F.lit("record with more cells than the header, beginning with the surplus cell "), cell)


def without_surplus(rows: DataFrame) -> DataFrame:
    """The rows without that column; a record that fills it ends the job, as its cells would be lost."""
    fits = F.when(named(SURPLUS).isNull(), F.lit(True)).otherwise(F.raise_error(surplus_message(named(SURPLUS))).cast("boolean"))
    return rows.filter(fits).drop(SURPLUS)


def header_names(record: str, case_sensitive: bool = False) -> list[str]:
    """The column names of a header as Spark's reader gives them: empty and repeated ones get their place."""
    cells = next(csv.reader(io.StringIO(record.removeprefix("﻿"), newline="")), [])
    folded = [c if case_sensitive else c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if folded.count(folded[i]) > 1 else c for i, c in enumerate(cells)]


@dataclass(frozen=True)
class Survey:
    """What the first scan found in one table."""

    path: str
    names: list[str]
    rows: int  # data records
    folded: bool  # some record spans lines, or a quote isn't closed
    crossing: bool  # some split begins inside a record
    splits: DataFrame  # one row a file split
    one_line: bool = False  # each line is a record, and its place in the scan tells its number


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


_SPLIT_ROWS = "_table int, _file long, _block long, _odds long, _if_closed long, _if_open long, _header string"

#: What a job says whose file splits lie otherwise among the tasks than those of the survey.
SPLITS_MOVED = "file splits changed between two scans"


def _placed(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank, and the place of each in its task."""
    filled = lines.filter(F.btrim("value", F.lit(" \r")) != "")
    return filled.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def _count_lines(spark: SparkSession, paths: Mapping[str, str], numbered: Mapping[str, int]) -> tuple[DataFrame, set[str]]:
    """For each file split its lines and the place of the first, as the survey of records has it; and the tables for
    which that isn't enough, as quotes may hold line breaks there or a file begins with another header."""
    lines = None
    for name, path in paths.items():
        text = _lines(spark, path)
        head = text.filter((F.col("_block") == 0) & (F.btrim("value", F.lit(" \r")) != "")).select("value").first()
        header = head["value"].removesuffix("\r") if head else ""
        text = _placed(text).select(
            F.lit(numbered[name]).alias("_table"), "_file", "_block", "_at", F.lit(header).alias("_header"),
            F.col("value").isin(header, header + "\r").alias("_is_header"),
            # Most lines hold no quote, so these are not gone through twice.
            F.when(F.contains("value", F.lit('"')), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
            .otherwise(F.lit(False)).alias("_odd"),
        )
        lines = text if lines is None else lines.unionByName(text)
    begins = F.col("_block") == 0
    counted = lines.groupBy("_table", "_file", "_block", "_header").agg(
        F.count(F.lit(1)).alias("_if_closed"), F.count_if("_odd").alias("_odd_lines"), F.min("_at").alias("_first"),
        F.min(F.when(F.col("_is_header"), F.col("_at"))).alias("_header_at"),
    ).select(
        "_table", "_file", "_block", F.lit(0).cast("long").alias("_odds"), "_if_closed", F.lit(0).cast("long").alias("_if_open"),
        F.when(begins, F.col("_header")).alias("_header"), "_first",
        ((F.col("_odd_lines") > 0) | begins & ~F.col("_header_at").eqNullSafe(F.col("_first"))).alias("_joined"),
    )
    place = scratch_dir(spark, "lines")
    counted.write.parquet(place)
    counts = spark.read.schema(counted.schema).parquet(place)
    joined = {r["_table"] for r in counts.filter("_joined").select("_table").distinct().collect()}
    return counts.drop("_joined"), {name for name in paths if numbered[name] in joined}


def _counting():
    """The task function of the survey. It is sent by value: executors need not have this package."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        fields = ["_table", "_file", "_block", "_odds", "_if_closed", "_if_open"]
        schema = pa.schema([pa.field(n, pa.int32() if n == "_table" else pa.int64()) for n in fields] + [("_header", pa.string())])

        def row() -> pa.RecordBatch:
            text = "\n".join(header).removesuffix("\r") if header else None
            return pa.RecordBatch.from_pylist([dict(zip(fields, [*split, *counts], strict=True), _header=text)], schema=schema)

        split, counts, header, heading = None, [0, 0, 0], [], False
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in fields[:3]], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:]):
                if split != keys[a].tolist():
                    if split is not None:
                        yield row()
                    split, counts, header = keys[a].tolist(), [0, 0, 0], []
                    heading = split[2] == 0
                lines = batch.column("value").slice(a, b - a)
                odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
                filled = pc.binary_length(pc.utf8_trim(lines, " \r")).to_numpy(zero_copy_only=False) > 0
                before = counts[0] + np.cumsum(odd) - odd
                if heading:
                    for line, inside, full in zip(lines.to_pylist(), before & 1, filled, strict=True):
                        if header and not inside:
                            heading = False
                            break
                        if full or inside:
                            header.append(line)
                counts = [
                    counts[0] + int(odd.sum()), counts[1] + int((filled & (before & 1 == 0)).sum()), counts[2] + int((filled & (before & 1 == 1)).sum()),
                ]
        if split is not None:
            yield row()

    return run


def survey(spark: SparkSession, paths: Mapping[str, str], by_lines: bool = True) -> dict[str, Survey]:
    """One scan of the text of all tables: their columns and records, and how these lie in the file splits.

    Tables whose quotes may hold line breaks are scanned once more, to find their records; without ``by_lines`` all are, and
    the scans that follow don't rely on how file splits are dealt to tasks. An unclosed quote shows as ``folded`` and ends the read of the table. Files of a table whose headers differ are refused.
    """
    if not paths:
        return {}
    numbered = {name: k for k, name in enumerate(paths)}
    by_line, joined = _count_lines(spark, paths, numbered) if by_lines else (None, set(paths))
    lines, files = None, []
    for name, path in paths.items():
        # An empty authority is left out in the paths that rows carry.
        files += [(numbered[name], re.sub("^([^:/]+):///", r"\1:/", f)) for f in spark.read.text(path).inputFiles()]
        if name in joined:
            text = _lines(spark, path).withColumn("_table", F.lit(numbered[name]))
            lines = text if lines is None else lines.unionByName(text)
    counted = by_line
    if lines is not None:
        counted = lines.select("value", "_table", "_file", "_block").mapInArrow(_counting(), _SPLIT_ROWS)
        counted = counted.withColumn("_first", F.lit(None).cast("long"))
        if by_line is not None:
            others = by_line.filter(~F.col("_table").isin([numbered[n] for n in joined]))
            counted = counted.unionByName(others)
    known = spark.createDataFrame(files, "_table int, _path string").withColumn("_file", F.xxhash64("_path"))
    # Dealt by table once, which is what all windows below need.
    counted = counted.join(known, ["_table", "_file"], "left").repartition("_table")

    in_file = Window.partitionBy("_table", "_file").orderBy("_block")
    earlier_in_file = in_file.rowsBetween(Window.unboundedPreceding, -1)
    in_table = Window.partitionBy("_table").orderBy("_path", "_block")
    earlier = in_table.rowsBetween(Window.unboundedPreceding, -1)

    def total(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    settled = (
        counted.withColumn("_open", total("_odds", earlier_in_file) % 2)
        .withColumn("_starts", F.when(F.col("_open") == 0, F.col("_if_closed")).otherwise(F.col("_if_open")))
        .select(
            "_table", "_file", "_block", "_path", "_odds", "_header", "_open", "_starts", "_first",
            F.coalesce(F.lead("_open").over(in_file), F.lit(0)).alias("_next_open"),
            F.sum("_odds").over(Window.partitionBy("_table", "_file")).alias("_quotes"),
            total("_starts", earlier_in_file).alias("_before_in_file"),
            # The header of this file and of those before it aren't data.
            (total("_starts", earlier) - F.dense_rank().over(Window.partitionBy("_table").orderBy("_path"))).alias("_before"),
            F.row_number().over(in_table).cast("long").alias("_split"),
        )
    )
    place = scratch_dir(spark, "survey")
    settled.write.parquet(place)
    splits = spark.read.schema(settled.schema).parquet(place)
    facts = splits.groupBy("_table").agg(
        F.sum("_starts").alias("starts"), F.countDistinct("_file").alias("files"), F.max(F.col("_odds") > 0).alias("folded"),
        F.max("_open").alias("crossing"), F.collect_set("_header").alias("headers"), F.count_if(F.col("_path").isNull()).alias("lost"),
        F.count(F.lit(1)).alias("splits"), F.first("_path").alias("path"),
    )
    by_table = {r["_table"]: r for r in facts.collect()}
    case_sensitive = spark.conf.get("spark.sql.caseSensitive", "false") == "true"
    found = {}
    for name, path in paths.items():
        own = splits.filter(F.col("_table") == numbered[name]).drop("_table")
        fact = by_table.get(numbered[name])
        if fact is None:
            found[name] = Survey(path, [], 0, False, False, own)
            continue
        if fact["lost"]:
            raise RuntimeError(f"files of {path} changed while they were listed")
        if fact["splits"] > MOST_SPLITS:
            raise ValueError(f"{path} has {fact['splits']} file splits; raise spark.sql.files.maxPartitionBytes")
        headers = {tuple(header_names(h, case_sensitive)) for h in fact["headers"]}
        if len(headers) > 1:
            raise ValueError(f"the files of {path} have different headers: {sorted(map(list, headers))}")
        names = list(headers.pop()) if headers else []
        found[name] = Survey(path, names, max(0, fact["starts"] - fact["files"]), bool(fact["folded"]), fact["crossing"] == 1, own, name not in joined)
    return found


_RECORDS = "number long, text string, file long, in_file long, split long"


def _joining():
    """The task function that joins the lines of records; sent by value too.

    Whole records come with their number; parts of records that cross the end of a split also with their
    file, the record's number in it (the header is 1) and the split.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        long = pa.int64()
        schema = pa.schema([("number", long), ("text", pa.string()), ("file", long), ("in_file", long), ("split", long)])

        def part(last: bool) -> Iterator[pa.RecordBatch]:
            """The record that is being put together, as far as it lies in this split."""
            nonlocal pieces
            text, pieces = "\n".join(pieces or ()), None
            crossing = started == 0 or last and facts["_next_open"]
            text = text if crossing else text.rstrip("\r")
            in_file, number = facts["_before_in_file"] + started, facts["_before"] + started
            if crossing or in_file > 1:
                row = [number, text, *([facts["_file"], in_file, facts["_split"]] if crossing else [None] * 3)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        def whole(lines, starts, first: int) -> Iterator[pa.RecordBatch]:
            """Records between two starts each, the header left out."""
            texts = pc.utf8_rtrim(pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines), "\n"), "\r")
            n = len(texts)
            skip = 1 if facts["_before_in_file"] + first == 1 else 0
            numbers = facts["_before"] + first + np.arange(n)
            none = pa.nulls(n - skip, long)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[skip:], long), texts.slice(skip), none, none, none], schema=schema)

        def end() -> Iterator[pa.RecordBatch]:
            if pieces is not None:
                yield from part(True)
            if started != facts["_starts"]:
                raise RuntimeError("the records of a file split changed between two scans")

        split, facts, started, odds, pieces = None, {}, 0, 0, None
        names = ["_file", "_before_in_file", "_before", "_split", "_starts", "_open", "_next_open", "_quotes"]
        for batch in batches:
            ids = batch.column("_split").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:]):
                if split is None or split != ids[a]:
                    if split is not None:
                        yield from end()
                    split, facts = ids[a], {n: batch.column(n)[a].as_py() for n in names}
                    if facts["_split"] is None:
                        raise RuntimeError("file splits changed between two scans")
                    started, odds, pieces = 0, facts["_open"], [] if facts["_open"] else None
                lines = batch.column("value").slice(a, b - a)
                odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
                inside = (odds + np.cumsum(odd) - odd) & 1 == 1
                odds += int(odd.sum())
                start = ~inside & (pc.binary_length(pc.utf8_trim(lines, " \r")).to_numpy(zero_copy_only=False) > 0)
                kept = start | inside
                lines, at = lines.filter(pa.array(kept)), np.flatnonzero(start[kept])
                if not len(at):
                    if len(lines):
                        pieces = (pieces if pieces is not None else []) + lines.to_pylist()
                    continue
                if pieces is not None:
                    pieces += lines.slice(0, int(at[0])).to_pylist()
                    yield from part(False)
                if len(at) > 1:
                    yield from whole(lines, at, started + 1)
                started += len(at)
                pieces = lines.slice(int(at[-1])).to_pylist()
        if split is not None:
            yield from end()

    return run


def records(spark: SparkSession, found: Survey) -> DataFrame:
    """``(number, text)``: the data records of a surveyed table and their 1-based number in file order."""
    if found.one_line:
        return _line_records(spark, found)
    facts = found.splits.select(
        "_file", "_block", "_split", "_before_in_file", "_before", "_starts", "_open", "_next_open", "_quotes"
    )
    lines = _lines(spark, found.path).join(F.broadcast(facts), ["_file", "_block"], "left")  # bounded by MOST_SPLITS
    parts = lines.drop("_block").mapInArrow(_joining(), _RECORDS)
    plain = parts.filter("file is null").select("number", "text")
    if not found.crossing:
        return plain
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), "\n")
    crossing = parts.filter("file is not null").groupBy("file", "in_file").agg(F.min("number").alias("number"), text.alias("text"))
    return plain.unionByName(crossing.filter("in_file > 1").select("number", F.rtrim("text", F.lit("\r")).alias("text")))


def _line_records(spark: SparkSession, found: Survey) -> DataFrame:
    """The same where each line is a record.

    Its place in the task, less that of the first line of its file split, gives its number. The places in a split run
    from 0 to its count less 1; were splits dealt otherwise than when they were surveyed, some line would leave that
    range, and the job ends with :data:`SPLITS_MOVED`.
    """
    facts = found.splits.select("_file", "_block", "_before_in_file", "_before", "_starts", "_first")
    lines = _placed(_lines(spark, found.path)).join(F.broadcast(facts), ["_file", "_block"], "left")  # bounded by MOST_SPLITS
    place = F.col("_at") - F.col("_first")
    known = F.when((place >= 0) & (place < F.col("_starts")), F.col("_before_in_file") + place)
    in_file = F.coalesce(known, F.raise_error(F.lit(SPLITS_MOVED)).cast("long"))
    data = lines.filter(in_file > 0)  # the first one is the header
    return data.select((F.col("_before") + place + 1).alias("number"), F.rtrim("value", F.lit("\r")).alias("text"))


def _text_cells(rows: DataFrame, schema: T.StructType, parsed: Column, row_number: str) -> DataFrame:
    """Text cells of the records: what lies between commas where a record holds nothing that the reader takes for more than text."""
    special = reduce(lambda a, b: a | b, [F.contains("text", F.lit(c)) for c in ('"', "\r", "\0")])
    once = rows.select(  # each record is taken apart once, in a step of its own
        F.when(~special, F.split("text", ",")).alias("_plain"), F.when(special, parsed).alias("_row"), F.col("number").alias(row_number)
    )

    def cell(i: int) -> Column:
        return F.when(F.col("_plain").isNull(), F.col("_row")[schema[i].name]).otherwise(F.nullif(F.get("_plain", F.lit(i)), F.lit("")))

    # Not a filter, which Spark would move below that step and take records apart again for.
    surplus = cell(len(schema) - 1)
    checked = F.when(surplus.isNull(), F.col("_plain")).otherwise(F.raise_error(surplus_message(surplus)).cast("array<string>"))
    checked = once.select(checked.alias("_plain"), "_row", row_number)
    return checked.select(*[cell(i).alias(name) for i, name in enumerate(schema.names[:-1])], row_number)


def parse(rows: DataFrame, found: Survey, row_number: str, typed: T.StructType | None = None, **options: str) -> DataFrame:
    """The records as the ``typed`` columns, else as those of the header as text, and their number.

    A stray quote in a table with records over several lines, where the counts of quotes would mislead, ends the
    job. Text records with more cells than the header end it too, shorter ones are filled with null.
    ``options`` are those of Spark's CSV reader.
    """
    schema, options_given = typed or text_schema([*found.names, SURPLUS]), bool(options)
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", **options}
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("text", ddl, options)
    if found.folded:
        stray = F.raise_error(F.lit(f"stray quote in a table with records over several lines: {found.path}")).cast(schema)
        parsed = F.when(F.col("text").rlike(WELL_FORMED), parsed).otherwise(stray)
    elif typed is None and not options_given:
        return _text_cells(rows, schema, parsed, row_number)
    cells = rows.select(parsed.alias("_row"), F.col("number").alias(row_number))
    cells = cells.select(*[F.col("_row")[f.name].alias(f.name) for f in schema.fields], row_number)
    return cells if typed else without_surplus(cells)


def read_folded_csv(
    spark: SparkSession, path: str, row_number: str, typed: T.StructType | None = None, found: Survey | None = None, **options: str
) -> DataFrame:
    """The parsed records of a table; a file with an odd number of quotes is refused before any line is read again."""
    found = found or survey(spark, {"": path})[""]
    unclosed = found.splits.filter("_quotes % 2 = 1").select("_path").first() if found.folded else None
    if unclosed is not None:
        raise ValueError(f"unclosed quote in {unclosed['_path']}")
    return parse(records(spark, found), found, row_number, typed, **options)
