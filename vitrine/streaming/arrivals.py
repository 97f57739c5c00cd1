"""Raw rows of the CSV files that arrived since the last run.

A full refresh reads every file again. Where files only ever get added, the same
raw rows can be written file by file: Structured Streaming remembers which files
were taken, and each batch is committed once to the manifest that all readers go
by, so a lost run leaves neither gaps nor copies. A refresh takes the place of the arrivals before it; none may
come in while it runs.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vitrine import schemas
from vitrine.operators.layers import counting, write_profile, raw_json_rows, raw_run, run_log
from vitrine.operators.manifest import ConcurrentCommit, Part, commit, snapshot
from vitrine.sources.csv_files import ROW_NUMBER, null_tokens, number_split_rows, with_splits
from vitrine.sources.folded_csv import SURPLUS, text_schema, without_surplus


def arrival_run(table: str, batch: int) -> int:
    """The run number of a batch: the table in the upper half, so that none is used twice."""
    return (zlib.crc32(table.encode()) >> 1) + 1 << 32 | batch + 1


def ingest_arrivals(
    spark: SparkSession,
    folder: str,
    table: str,
    columns: Sequence[str],
    out: str,
    checkpoint: str,
    multi_line: bool = True,
) -> StreamingQuery:
    """Take the files of ``folder`` not taken yet, and stop.

    Each table and batch has a run number of its own, beyond those of refreshes. Rows are
    numbered within their batch, in file order. A record with more cells than ``columns`` ends the run.
    """
    schema = text_schema([*columns, SURPLUS])
    arriving = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )

    def write(batch: DataFrame, number: int) -> None:
        session, run_id, name = batch.sparkSession, arrival_run(table, number), f"{table}/{number}"
        if name in snapshot(session, out).batches:
            return  # committed before the run was lost
        numbered = null_tokens(without_surplus(number_split_rows(batch, ROW_NUMBER)), columns=columns)
        place = f"part=arrival-{number}-{uuid.uuid4().hex}"
        raw = Part("raw", table, f"raw_csv_rows/source_table={table}/{place}")
        numbered, counts = counting(numbered, columns)
        raw_json_rows(numbered, table, run_id).drop("source_table").write.parquet(f"{out}/{raw.path}")
        profile = write_profile(session, out, place.removeprefix("part="), counts(raw))
        count = session.read.schema(schemas.CONTROL["raw_csv_rows"].schema).parquet(f"{out}/{raw.path}").count()
        log = Part("log", "", f"ingestion_runs/{place}")
        record = raw_run(run_id, f"{table}.csv", table, count, list(columns))
        run_log(session, [record]).coalesce(1).write.parquet(f"{out}/{log.path}")
        while True:
            try:
                commit(session, snapshot(session, out), "arrival", name, [raw, log, profile])
                return
            except ConcurrentCommit:  # rows only get added, so the next number does as well
                continue

    return (
        with_splits(arriving)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
