"""The raw and treated layers and their ingestion log, as Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from vitrine import schemas
from vitrine.functions.names import named
from vitrine.operators.manifest import REFRESH, Part, Snapshot, commit, read, snapshot
from vitrine.operators.quality import fill_defaults, require_valid, row_rules
from vitrine.operators.treatment import coerce_table, treat_table
from vitrine.sources.csv_files import ROW_NUMBER, list_csv_tables, read_csv_numbered
from vitrine.sources.folded_csv import SPLITS_MOVED, Survey, survey


def raw_json_rows(numbered: DataFrame, table: str, run_id: int) -> DataFrame:
    """One JSON document per row, nulls kept, with its origin."""
    cells = [named(c) for c in numbered.columns if c != ROW_NUMBER]
    rows = numbered.select(
        F.lit(run_id).cast("long").alias("ingestion_run_id"),
        F.lit(table).alias("source_table"),
        F.col(ROW_NUMBER),
        F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("payload"),
    )
    return fill_defaults(rows, schemas.CONTROL["raw_csv_rows"])


#: Codec of the layers: payloads repeat their column names, which zstd holds in a quarter of the bytes that snappy takes.
COMPRESSION = "zstd"

Run = tuple[int, str, str, str, int, str]


def raw_run(run_id: int, file_name: str, table: str, rows: int, columns: list[str]) -> Run:
    """Log record of a raw load."""
    return run_id, file_name, table, "raw", rows, json.dumps({"columns": columns}, ensure_ascii=False)


def treated_run(
    run_id: int, file_name: str, table: str, raw_rows: int, rows: int, columns: list[str]
) -> Run:
    """Log record of a treated load; ``rows`` are those that stay after dedup, quarantined ones included."""
    dates = sorted(c for c in columns if schemas.is_date_column(c))
    details = {"dropped_duplicate_rows": raw_rows - rows, "date_columns": dates}
    return run_id, file_name, table, "treated", rows, json.dumps(details, ensure_ascii=False)


def run_log(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """The records of some loads as rows of the ingestion log."""
    log = schemas.CONTROL["ingestion_runs"]
    records = spark.createDataFrame(
        runs, "id long, file_name string, source_table string, layer string, row_count long, details string"
    )
    return fill_defaults(records, log).select(*log.schema.names)


def conform(df: DataFrame, declared: schemas.Table, also: Iterable[str] = ()) -> DataFrame:
    """The declared columns in their types; a missing one is null, an unfit value too. ``also`` names columns to keep."""
    return df.select(
        *[
            (
                F.col(c.name).try_cast(c.spark_type)
                if c.name in df.columns
                else F.lit(None).cast(c.spark_type)
            ).alias(c.name)
            for c in declared.columns
        ],
        *also,
    )


def treated_rows(raw_text: DataFrame, table: str, run_id: int) -> DataFrame:
    treated = conform(treat_table(raw_text, table), schemas.TREATED[table])
    return treated.withColumn("source_run_id", F.lit(run_id).cast("long"))


def payload_text(raw: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The CSV cells of raw rows as text again, with ``source_row_number``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    parsed = raw.select(ROW_NUMBER, F.from_json("payload", schema).alias("_row"))
    return parsed.select(*[F.col("_row")[c].alias(c) for c in columns], ROW_NUMBER)


def treated_schema(table: str) -> T.StructType:
    return schemas.table_schemas()[f"treated.{table}"]


def _quarantine_schema(table: str) -> T.StructType:
    return T.StructType([*treated_schema(table).fields, T.StructField("regras_violadas", T.ArrayType(T.StringType()))])


def current(spark: SparkSession, out: str) -> Snapshot:
    """The committed state of a lake folder that was refreshed or that files arrived at."""
    found = snapshot(spark, out)
    if not found.number:
        raise FileNotFoundError(f"no complete refresh below {out}")
    return found


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The ingestion runs of the last refresh and of the batches since."""
    found = current(spark, out)
    return read(spark, schemas.CONTROL["ingestion_runs"].schema, [f"{out}/{p.path}" for _, p in found.of("log")])


_RAW = schemas.CONTROL["raw_csv_rows"].schema


def _raw_parts(spark: SparkSession, found: Snapshot, parts: list[Part]) -> DataFrame:
    paths = [f"{found.out}/{p.path}" for p in parts]
    if not paths:
        return spark.createDataFrame([], _RAW)
    # Folders are named by table, so a filter on the table reads no other one's.
    return spark.read.schema(_RAW).option("basePath", f"{found.out}/raw_csv_rows").parquet(*paths).select(*_RAW.names)


def read_raw(spark: SparkSession, out: str) -> DataFrame:
    """Every raw row: those of the last refresh and those of the files that arrived since."""
    found = current(spark, out)
    return _raw_parts(spark, found, [p for _, p in found.of("raw")])


def read_treated(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The treated tables of the committed state."""
    found = current(spark, out)
    return {t: read(spark, treated_schema(t), found.paths("treated", t)) for t in found.tables("treated")}


def read_quarantine(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The rows that a refresh with ``broken="quarantine"`` set apart, and the rules they break."""
    found = current(spark, out)
    return {t: read(spark, _quarantine_schema(t), found.paths("quarantine", t)) for t in found.tables("quarantine")}


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of one key the last by ``order``; rows without key are the same where all their values are.

    Rows of a key are reduced within each task before they are shuffled. The ``order`` columns go.
    """
    columns = [c for c in rows.columns if c not in order]
    whole = F.struct(*columns)
    keyless = F.when(F.col(key).isNull(), F.to_json(whole)).alias("_keyless")
    last = F.max_by(whole, F.struct(*order)).alias("_last")
    return rows.groupBy(key, keyless).agg(last).select(*[F.col("_last")[c].alias(c) for c in columns])


def _newest_treated(text: DataFrame, table: str, order: list[str], run_id: int) -> DataFrame:
    declared = schemas.TREATED[table]
    typed = conform(coerce_table(text, table), declared, order)
    return newest(typed, declared.key, order).withColumn("source_run_id", F.lit(run_id).cast("long"))


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows with the bucket of their key, or of all their values where they have none."""
    others = F.xxhash64(*[c for c in rows.columns if c != "source_run_id"])
    hashed = F.when(F.col(key).isNull(), others).otherwise(F.xxhash64(key))
    return rows.withColumn("bucket", F.pmod(hashed, F.lit(buckets)).cast("int"))


def _write_buckets(rows: DataFrame, path: str) -> None:
    """Write a folder a bucket; a bucket of many rows is dealt to several tasks, so that none sorts them all."""
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", COMPRESSION).parquet(path)


def _with_broken(treated: DataFrame, table: str, taken: DataFrame | None = None) -> DataFrame:
    """``treated`` plus ``regras_violadas``: required columns that are null, a key that comes twice or is ``taken``."""
    declared = schemas.TREATED[table]
    rules = [
        F.when(broken, F.lit(name)) for name, broken in row_rules(treated, declared).items() if name.startswith("not_null:")
    ]
    if declared.key in treated.columns:
        twice = (
            treated.groupBy(declared.key).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").drop("_times")
            .withColumn("_twice", F.lit(True))
        )
        if taken is not None:  # rows that are reduced to the keys at hand before any is matched
            held = taken.select(declared.key).join(treated.select(declared.key).distinct(), declared.key, "left_semi")
            twice = twice.unionByName(held.withColumn("_twice", F.lit(True))).distinct()
        treated = treated.join(twice, declared.key, "left")
        rules.append(F.when(F.col("_twice"), F.lit(f"primary_key:{declared.key}")))
    found = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    return treated.select(*treated_schema(table).names, found.alias("regras_violadas"))


PROFILE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("layer", "source_table", "path")]
    + [T.StructField("bucket", T.IntegerType()), T.StructField("coluna", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("linhas", "nulos")]
)
Count = tuple[str, str, str, int | None, str, int, int]


def counting(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, Callable[[Part], list[Count]]]:
    """The frame, whose next write counts its rows and nulls by the way, and what gives these counts then."""
    columns, counted = list(columns), Observation()
    nulls = [F.count_if(named(c).isNull()).alias(f"n{k}") for k, c in enumerate(columns)]
    observed = df.observe(counted, F.count(F.lit(1)).alias("rows"), *nulls)

    def counts(part: Part) -> list[Count]:
        found = counted.get
        return [(part.layer, part.source_table, part.path, None, c, found["rows"], found[f"n{k}"]) for k, c in enumerate(columns)]

    return observed, counts


def _bucket_counts(written: DataFrame, part: Part) -> list[Count]:
    """Rows and nulls of each bucket of a part: so many rows as it has buckets and columns."""
    columns = [c for c in written.columns if c != "bucket"]
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    by_bucket = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows"), *nulls)
    return [
        (part.layer, part.source_table, part.path, r["bucket"], c, r["_rows"], r[c]) for r in by_bucket.collect() for c in columns
    ]


def write_profile(spark: SparkSession, out: str, name: str, counts: list[Count]) -> Part:
    """Write the counts of a batch beside its layers."""
    part = Part("profile", "", f"profiles/part={name}")
    spark.createDataFrame(counts, PROFILE).coalesce(1).write.parquet(f"{out}/{part.path}")
    return part


def read_profile(spark: SparkSession, out: str) -> DataFrame:
    """Rows and nulls of every column of the raw and treated tables, added up from the counts that were written
    with their parts: ``(layer, source_table, coluna, linhas, nulos)``. No layer is read."""
    found = current(spark, out)
    held = [(p.path, None) for _, p in found.parts if p.layer in ("raw", "treated") and p.buckets is None]
    for table in found.tables("treated"):
        last = {b: p.path for _, p in found.of("treated", table) for b in p.buckets or ()}
        held += [(path, b) for b, path in last.items()]
    counts = read(spark, PROFILE, [f"{out}/{p.path}" for _, p in found.of("profile")])
    valid = spark.createDataFrame(held, "path string, bucket int").withColumnRenamed("path", "_path").withColumnRenamed("bucket", "_bucket")
    kept = counts.join(valid, (F.col("path") == F.col("_path")) & F.col("bucket").eqNullSafe(F.col("_bucket")), "left_semi")
    return kept.groupBy("layer", "source_table", "coluna").agg(F.sum("linhas").alias("linhas"), F.sum("nulos").alias("nulos"))


#: Tables that a refresh loads side by side.
SIDE_BY_SIDE = 4


def full_refresh(
    spark: SparkSession, folder: str, out: str, broken: str | None = None, newest_wins: bool = False, buckets: int = 16
) -> DataFrame:
    """Rebuild both layers from a CSV folder and return the ingestion log.

    Scans of the CSV text: a survey of all tables, the raw layer and, where each line is a record, the treated rows: the same
    cells, by the same survey, without a detour over JSON. Elsewhere the payloads give the treated rows. The layers are built in folders of their own, which readers see once the refresh is committed; if it
    fails, they go on reading the one before, and if another writer commits meanwhile, it is void. Run numbers go
    on from refresh to refresh.

    ``broken`` says what to do with treated rows that lack a required value or whose key comes twice: keep them
    (None), ``"fail"``, or ``"quarantine"`` them in tables of their own. With ``newest_wins`` the
    last row of a key stays alone, and treated tables lie in ``buckets`` by key, so that
    :func:`merge_arrivals` can keep them up.
    """
    if broken not in (None, "fail", "quarantine"):
        raise ValueError(f"broken: {broken}")
    before = snapshot(spark, out)
    name = f"refresh-{before.number + 1}-{uuid.uuid4().hex}"
    found = survey(spark, list_csv_tables(spark, folder))
    numbers, run_id = {}, before.last_run
    for table in found:
        numbers[table] = run_id + 1
        run_id += 2 if table in schemas.TREATED else 1

    def load(table: str) -> tuple[list[Part], list[Run], list[Count]]:
        def write(surveyed: Survey, place: str) -> tuple[list[Part], list[Run], list[Count]]:
            return _load(spark, surveyed, table, out, place, numbers[table], broken, newest_wins, buckets)

        try:
            return write(found[table], name)
        except Exception as error:
            if not found[table].one_line or SPLITS_MOVED not in str(error):
                raise
            # Executors came or went since the survey: records are found without regard to the tasks.
            path = found[table].path
            return write(survey(spark, {table: path}, by_lines=False)[table], f"{name}-again")

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        loaded = list(pool.map(load, found))
    parts, runs, counts = ([x for one in loaded for x in one[k]] for k in range(3))
    commit(spark, before, REFRESH, name, [*parts, _log(spark, out, name, runs), write_profile(spark, out, name, counts)], run_id)
    return read_log(spark, out)


def _load(
    spark: SparkSession, found: Survey, table: str, out: str, name: str, run_id: int, broken: str | None, newest_wins: bool, buckets: int
) -> tuple[list[Part], list[Run], list[Count]]:
    """Write the raw rows of one table and, from their payloads, its treated rows."""
    raw = Part("raw", table, f"raw_csv_rows/source_table={table}/part={name}")
    numbered, raw_counts = counting(read_csv_numbered(spark, found.path, found=found), found.names)
    raw_json_rows(numbered, table, run_id).drop("source_table").write.option("compression", COMPRESSION).parquet(f"{out}/{raw.path}")
    file_name, columns = f"{table}.csv", found.names
    parts, runs = [raw], [raw_run(run_id, file_name, table, found.rows, columns)]
    counted = raw_counts(raw)
    if found.one_line and counted:
        _require_all(found, counted[0][5])
    if table not in schemas.TREATED:
        return parts, runs, counted
    key, seen = schemas.TREATED[table].key, None
    wanted = schemas.TREATED[table].schema.names if newest_wins else columns
    if found.one_line and broken is None:
        cells = read_csv_numbered(spark, found.path, found=found)
        if found.rows:  # a scan without rows may be left out, and what is observed of it
            seen = Observation()
            cells = cells.observe(seen, F.count(F.lit(1)).alias("rows"))
        text = cells.select(*[named(c) if c in columns else F.lit(None).cast("string").alias(c) for c in wanted], ROW_NUMBER)
    else:
        text = payload_text(spark.read.schema(_RAW).parquet(f"{out}/{raw.path}"), wanted)
    if newest_wins:
        rows = _newest_treated(text, table, [ROW_NUMBER], run_id + 1)
    else:
        rows = treated_rows(text.drop(ROW_NUMBER), table, run_id + 1)
    treated = Part("treated", table, f"treated_{table}/part={name}")
    apart, count, counts = _write_treated(spark, rows, treated, out, broken, key, buckets if newest_wins else None)
    if seen is not None:
        _require_all(found, seen.get["rows"])
    if newest_wins:
        treated = replace(treated, buckets=_buckets_at(spark, f"{out}/{treated.path}"), modulus=buckets)
    if apart is not None:
        parts.append(Part("quarantine", table, apart.removeprefix(f"{out}/")))
    return [*parts, treated], [*runs, treated_run(run_id + 1, file_name, table, found.rows, count, columns)], [*counted, *counts]


def _require_all(found: Survey, rows: int) -> None:
    """End the load where a scan gave other rows than were surveyed."""
    if rows != found.rows:
        raise RuntimeError(f"{found.path} changed between two scans: {rows} records, {found.rows} before")


def _buckets_at(spark: SparkSession, path: str) -> tuple[int, ...]:
    """The buckets that a folder holds, by its listing."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    return tuple(sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")))


def _write_treated(
    spark: SparkSession, treated: DataFrame, part: Part, out: str, broken: str | None, key: str, buckets: int | None
) -> tuple[str | None, int, list[Count]]:
    """Write one treated table, and what is quarantined; the path of this, the rows of both, and the counts of the table.

    Rows are marked before any is written, and each goes to its place in one write.
    """
    table, path = part.source_table, f"{out}/{part.path}"
    schema = treated_schema(table)

    def write(rows: DataFrame) -> list[Count]:
        if buckets:
            _write_buckets(_bucketed(rows, key, buckets), path)
            return _bucket_counts(spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path), part)
        rows, counts = counting(rows, schema.names)
        rows.write.option("compression", COMPRESSION).parquet(path)
        return counts(part)

    if broken is None:
        counts = write(treated)
        return None, spark.read.schema(schema).parquet(path).count(), counts
    marked = f"{path}-marked"
    bad = F.size("regras_violadas") > 0
    _with_broken(treated, table).withColumn("apart", bad).write.partitionBy("apart").parquet(marked)
    written = spark.read.schema(_quarantine_schema(table).add("apart", T.BooleanType())).parquet(marked)
    count = written.count()
    if broken == "fail":
        rules = written.filter("apart").select(F.explode("regras_violadas").alias("regra"))
        report = rules.groupBy("regra").agg(F.count(F.lit(1)).alias("violacoes"))
        require_valid(report.select(F.concat(F.lit(f"{table}."), "regra").alias("regra"), "violacoes"))
    counts = write(written.filter("not apart").select(*schema.names))
    if broken == "fail":
        return None, count, counts
    apart = path.replace(f"/treated_{table}/", f"/quarantine_{table}/")
    written.filter("apart").drop("apart").write.parquet(apart)
    return apart, count, counts


def _rewrite(spark: SparkSession, found: Snapshot, table: str, rows: DataFrame, name: str, merged: int | None) -> tuple[Part, list[Count]]:
    """Write the buckets that ``rows`` touch anew, with these in place of the rows of their keys."""
    old = [p for _, p in found.of("treated", table)]
    schema, key, modulus = treated_schema(table), schemas.TREATED[table].key, old[0].modulus
    place = f"treated_{table}/part={name}"
    _bucketed(rows, key, modulus).write.parquet(f"{found.out}/{place}-rows")
    with_bucket = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(with_bucket).parquet(f"{found.out}/{place}-rows")
    touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most ``modulus``
    before = _bucketed(read(spark, schema, found.paths("treated", table, touched)), key, modulus)
    same = reduce(
        lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in schema.names if c not in (key, "source_run_id")], F.lit(True)
    )
    replaced = (F.col("n.bucket") == F.col("o.bucket")) & F.col(f"n.{key}").eqNullSafe(F.col(f"o.{key}")) & (F.col(f"n.{key}").isNotNull() | same)
    kept = before.alias("o").join(rows.alias("n"), replaced, "left_anti")
    _write_buckets(kept.unionByName(rows), f"{found.out}/{place}")
    part = Part("treated", table, place, tuple(sorted(touched)), modulus, merged)
    return part, _bucket_counts(spark.read.schema(with_bucket).parquet(f"{found.out}/{place}"), part) if touched else []


def merge_arrivals(spark: SparkSession, out: str, table: str) -> int:
    """Bring the files of ``table`` that arrived since the last merge into its treated table; the number of keys brought.

    The newest row of a key wins, and only the buckets that hold the key of an arrived row are written anew. The table
    is then that of a refresh with ``newest_wins`` over the same files. Where nothing arrived, nothing is written.
    """
    found = current(spark, out)
    treated = found.of("treated", table)
    if not treated or treated[0][1].modulus is None:
        raise ValueError(f"refresh {table} with newest_wins first")
    seen = max(n if p.merged is None else p.merged for n, p in treated)
    arrived = [(n, p) for n, p in found.of("raw", table) if n > seen]
    if not arrived:
        return 0
    name, run_id = f"merge-{found.number + 1}-{uuid.uuid4().hex}", found.last_run + 1
    columns = schemas.TREATED[table].schema.names
    text = reduce(
        DataFrame.unionByName,
        [payload_text(_raw_parts(spark, found, [p]), columns).withColumn("_commit", F.lit(n)) for n, p in arrived],
    )
    rows = _newest_treated(text, table, ["_commit", ROW_NUMBER], run_id)
    part, counts = _rewrite(spark, found, table, rows, name, max(n for n, _ in arrived))
    count = spark.read.schema(treated_schema(table)).parquet(f"{out}/{part.path}-rows").count()
    raw_count = _raw_parts(spark, found, [p for _, p in arrived]).count()
    log = _log(spark, out, name, [treated_run(run_id, f"{table}.csv", table, raw_count, count, columns)])
    commit(spark, found, "merge", name, [part, log, write_profile(spark, out, name, counts)], run_id)
    return count


def replay(spark: SparkSession, out: str, table: str, correct: Callable[[DataFrame], DataFrame]) -> int:
    """Take quarantined rows in again after ``correct`` has mended them; the number of rows taken in.

    What ``correct`` returns, in the columns of the treated table, is audited anew, against the treated rows too: a key that these hold already is
    broken. Rows without broken rules are added, the others stay in quarantine; rows left out are gone.
    """
    found = current(spark, out)
    if table not in found.tables("quarantine"):
        raise ValueError(f"{table} has no quarantine")
    schema, name, run_id = treated_schema(table), f"replay-{found.number + 1}-{uuid.uuid4().hex}", found.last_run + 1
    apart = read(spark, _quarantine_schema(table), found.paths("quarantine", table))
    mended = correct(apart.drop("regras_violadas")).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    mended = mended.withColumn("source_run_id", F.lit(run_id).cast("long"))
    taken = read(spark, schema, found.paths("treated", table))
    left = Part("quarantine", table, f"quarantine_{table}/part={name}")
    marked = f"{out}/{left.path}-marked"
    _with_broken(mended, table, taken).withColumn("apart", F.size("regras_violadas") > 0).write.partitionBy("apart").parquet(marked)
    written = spark.read.schema(_quarantine_schema(table).add("apart", T.BooleanType())).parquet(marked)
    written.filter("apart").drop("apart").write.parquet(f"{out}/{left.path}")
    good = written.filter("not apart").select(*schema.names)
    count = good.count()
    old = found.of("treated", table)
    if any(p.modulus for _, p in old):
        part, counts = _rewrite(spark, found, table, good, name, max(n if p.merged is None else p.merged for n, p in old))
    else:
        part = Part("treated", table, f"treated_{table}/part={name}")
        good, counted = counting(good, schema.names)
        good.write.parquet(f"{out}/{part.path}")
        counts = counted(part)
    log = _log(spark, out, name, [treated_run(run_id, f"{table}.csv", table, count, count, schemas.TREATED[table].schema.names)])
    commit(spark, found, "replay", name, [part, left, log, write_profile(spark, out, name, counts)], run_id)
    return count


def _log(spark: SparkSession, out: str, name: str, runs: list[Run]) -> Part:
    """Write the records of a batch, at most two a table."""
    part = Part("log", "", f"ingestion_runs/part={name}")
    run_log(spark, runs).coalesce(1).write.parquet(f"{out}/{part.path}")
    return part
