import csv
import io
import os
import random
import tempfile
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F, types as T

from tests.conftest import rows
from vitrine import schemas
from vitrine.session import scratch_dir
from vitrine.sources import csv_files, tables as sources
from vitrine.sources.folded_csv import SPLITS_MOVED, survey


def write(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_lists_files_and_folders_by_stem(spark, tmp_path):
    write(tmp_path, "brands.csv", "id,name\n1,a\n")
    write(tmp_path, "orders.csv/part-0.csv", "id\n1\n")
    write(tmp_path, "orders.csv/part-1.csv", "id\n2\n")
    write(tmp_path, "notes.txt", "x")
    found = csv_files.list_csv_tables(spark, str(tmp_path))
    assert list(found) == ["brands", "orders"]
    scanned = csv_files.scan_csv_dir(spark, str(tmp_path))
    assert rows(scanned["orders"], "id") == [("1",), ("2",)]


def test_text_read_keeps_leading_zeros_and_written_form(spark, tmp_path):
    path = write(
        tmp_path, "suppliers.csv",
        "id,phone,active,parent,name\n1,06100715800,TRUE,,\" José \"\n2,0118,FALSE,3,n/a\n",
    )
    assert rows(csv_files.read_csv_text(spark, path), "id") == [
        ("1", "06100715800", "TRUE", None, " José "),
        ("2", "0118", "FALSE", "3", None),
    ]


TOKENS = 'id,v\n1,\n2,N/A\n3,n/a\n4,NULL\n5,NA\n6,""\n7,x\n'


def test_null_tokens_of_both_readers(spark, tmp_path):
    path = write(tmp_path, "t.csv", TOKENS)
    pandas_like = csv_files.read_csv_text(spark, path)
    assert rows(pandas_like.filter("v is not null")) == [("7", "x")]
    schema = T.StructType.fromDDL("id long, v string")
    copied = csv_files.read_csv_typed(spark, path, schema)
    assert rows(copied, "id") == [
        (1, None), (2, "N/A"), (3, "n/a"), (4, "NULL"), (5, "NA"), (6, ""), (7, "x"),
    ]


def test_typed_load_stops_on_a_bad_field(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id,total\n1,2.50\nx,3\n")
    schema = T.StructType.fromDDL("id long, total decimal(15,2)")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        csv_files.read_csv_typed(spark, path, schema).collect()


def test_quoted_newlines_are_found_and_kept(spark, tmp_path):
    flat = write(tmp_path, "a.csv", 'id,v\n1,"say ""hi"", ok"\n')
    folded = write(tmp_path, "b.csv", 'id,v\n1,"first\nsecond"\n2,z\n')
    assert not csv_files.has_quoted_newlines(spark, flat)
    assert csv_files.has_quoted_newlines(spark, folded)
    assert rows(csv_files.read_csv_text(spark, flat)) == [("1", 'say "hi", ok')]
    assert rows(csv_files.read_csv_numbered(spark, folded), "id") == [
        ("1", "first\nsecond", 1), ("2", "z", 2),
    ]


def test_row_numbers_follow_the_file_across_splits(spark, tmp_path):
    path = write(
        tmp_path, "t.csv", "id,pad\n" + "".join(f"{i},{'x' * 50}\n" for i in range(1, 5001))
    )
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        numbered = csv_files.read_csv_numbered(spark, path)
        assert numbered.rdd.getNumPartitions() > 8
        assert numbered.filter(F.col("id").cast("long") != F.col("source_row_number")).count() == 0
        assert numbered.count() == 5000
    finally:
        spark.conf.set(key, before)


def test_row_numbers_move_no_rows(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id\n1\n2\n")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        numbered = csv_files.read_csv_numbered(spark, path)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows(numbered, "id") == [("1", 1), ("2", 2)]


def test_missing_table_is_empty(spark):
    schema = schemas.TREATED["returns"].schema
    empty = sources.table_or_empty(spark, {}, "returns", schema)
    assert empty.schema == schema and empty.isEmpty()


def test_sql_source_runs_text_over_named_frames(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert rows(sources.sql_source(spark, "SELECT sum(n) AS s FROM numbers", numbers=df)) == [(3,)]


def test_source_identity_and_catalog(spark):
    identity = sources.source_identity(spark).first()
    assert identity["database"] == "spark_catalog" and identity["schema"] == "default"
    df = spark.createDataFrame([], "id long, name string")
    assert rows(sources.catalog_columns(df)) == [(1, "id", "bigint"), (2, "name", "string")]


def test_scratch_is_below_the_folder_the_session_names(spark):
    path = scratch_dir(spark, "x")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or path.startswith(named)
    nothing = SimpleNamespace(get=lambda key, default: default)
    one = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="local[8]"))
    assert scratch_dir(one, "x").startswith(tempfile.gettempdir())
    for master in ("spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="share"):
            scratch_dir(SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master=master)), "x")


@pytest.fixture
def small_splits(spark):
    """Files are cut every 300 bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300")
    yield
    spark.conf.set(key, before)


def folded_file(folder, name, first, end="\n"):
    """Records of one to many lines, some with doubled quotes, blank lines and long fields."""
    rng, out, records = random.Random(first), io.StringIO(), []
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "te`xt", "note"])
    for i in range(first, first + 150):
        body = "\n".join("w" * rng.randrange(0, 60) for _ in range(rng.choice((1, 1, 2, 3, 12))))
        note = rng.choice(('say "hi"', '"', "a,b", "é\n\n", "plain", "", 'x""y\n"'))
        records.append((str(i), body, note))
        writer.writerow(records[-1])
        if rng.random() < 0.1:
            out.write(end)
    write(folder, name, out.getvalue())
    return records


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_folded_records_are_put_together_across_splits(spark, tmp_path, small_splits, end):
    want = folded_file(tmp_path, "t.csv/part-0.csv", 1, end)
    want += folded_file(tmp_path, "t.csv/part-1.csv", 151, end)
    path = str(tmp_path / "t.csv")
    df = csv_files.read_csv_numbered(spark, path, na_tokens=(), layout=csv_files.FOLDED)
    assert df.columns == ["id", "te`xt", "note", "source_row_number"]
    got = rows(df, "source_row_number")
    filled = [tuple(c or None for c in r) + (i,) for i, r in enumerate(want, 1)]
    assert got == filled
    text = csv_files.read_csv_text(spark, path, layout=csv_files.FOLDED)
    assert text.columns == ["id", "te`xt", "note"] and text.count() == 300


# Inputs of three columns without records over several lines, and what stops a text or a typed load.
BOTH = {
    "good": ("1,2.50,x\n2,,\"\"\n3,1,\n", None, None),
    "short": ("1,2.50,x\n2,3\n", None, "MALFORMED"),
    "long": ("1,2.50,x\n2,3,y,z\n", "more cells", "MALFORMED"),
    "bad number": ("1,yes,x\n", None, "MALFORMED"),
    "blank rows": ("1,2,x\n   \n\n2,3,y\n", None, None),
}


@pytest.mark.parametrize("kind", BOTH)
def test_both_layouts_read_alike(spark, tmp_path, kind):
    text, stops_text, stops_typed = BOTH[kind]
    path = write(tmp_path, "t.csv", "id,total,note\n" + text)
    schema = T.StructType.fromDDL("id long, amount decimal(15,2), note string")

    def outcome(load, stops):
        got = []
        for layout in (csv_files.ONE_LINE, csv_files.FOLDED):
            if stops:
                with pytest.raises(Exception, match=stops):
                    load(layout).collect()
            else:
                got.append([tuple(map(str, r)) for r in rows(load(layout), "id")])
        assert not got or got[0] == got[1] and got[0]

    outcome(lambda at: csv_files.read_csv_numbered(spark, path, layout=at), stops_text)
    outcome(lambda at: csv_files.read_csv_typed(spark, path, schema, at), stops_typed)


def test_dates_and_booleans_are_strict_in_both_layouts(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, at timestamp_ntz, ok boolean")
    for cells in ("2024-1-5,true", "2024-01-05 10:00:00,yes"):
        path = write(tmp_path, "t.csv", f"id,at,ok\n1,{cells}\n")
        for layout in (csv_files.ONE_LINE, csv_files.FOLDED):
            with pytest.raises(Exception, match="MALFORMED"):
                csv_files.read_csv_typed(spark, path, schema, layout).collect()


def test_content_alone_picks_the_layout(spark, tmp_path):
    assert csv_files.record_layout(spark, write(tmp_path, "a.csv", 'id,v\n1,"a\nb"\n')) == csv_files.FOLDED
    assert csv_files.record_layout(spark, write(tmp_path, "b.csv", 'id,v\n1,"a b"\n')) == csv_files.ONE_LINE


def test_stray_and_unclosed_quotes_stop_the_read(spark, tmp_path):
    stray = write(tmp_path, "t.csv", 'id,v\n1,5" pipe\n2,"a\nb"\n3,c" d\n')
    with pytest.raises(Exception, match="stray quote|unclosed quote"):
        csv_files.read_csv_text(spark, stray).collect()
    unclosed = write(tmp_path, "u.csv", 'id,v\n1,"open\n2,b\n' + "3,c\n" * 200)
    with pytest.raises(Exception, match="unclosed quote"):
        csv_files.read_csv_text(spark, unclosed).collect()


def test_surplus_cells_stop_a_count_too(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        csv_files.read_csv_text(spark, path).count()


def test_tables_of_deeper_folders_are_not_mixed_in(spark, tmp_path):
    write(tmp_path, "orders.csv", "id\n1\n")
    write(tmp_path, "old/orders.csv", "id\n2\n")
    found = csv_files.scan_csv_dir(spark, str(tmp_path))
    assert list(found) == ["orders"] and rows(found["orders"]) == [("1",)]


def test_typed_load_of_folded_records(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'id,total,note\n1,2.50,"a\nb"\n2,,""\n3,1,\n')
    schema = T.StructType.fromDDL("id long, amount decimal(15,2), note string")
    got = rows(csv_files.read_csv_typed(spark, path, schema), "id")
    assert [(i, None if a is None else float(a), n) for i, a, n in got] == [
        (1, 2.5, "a\nb"), (2, None, ""), (3, 1.0, None),
    ]
    bad = write(tmp_path, "u.csv", 'id,total,note\nx,2.50,"a\nb"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        csv_files.read_csv_typed(spark, bad, schema).collect()


def test_a_cell_of_one_null_character_stays(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'id,note\n1,\x00\n2,""\n3,\n')
    schema = T.StructType.fromDDL("id long, note string")
    assert rows(csv_files.read_csv_typed(spark, path, schema), "id") == [(1, "\x00"), (2, ""), (3, None)]


def test_a_survey_counts_records_and_refuses_other_headers(spark, tmp_path, small_splits):
    folded_file(tmp_path, "t.csv/part-0.csv", 1)
    folded_file(tmp_path, "t.csv/part-1.csv", 151, "\r\n")
    write(tmp_path, "plain.csv", "a,A,,b\n" + "1,2,3,4\n\n" * 100)
    write(tmp_path, "empty.csv", "")
    found = survey(spark, csv_files.list_csv_tables(spark, str(tmp_path)))
    assert {n: (s.rows, s.folded, s.crossing) for n, s in found.items()} == {
        "t": (300, True, True), "plain": (100, False, False), "empty": (0, False, False),
    }
    assert found["plain"].names == ["a0", "A1", "_c2", "b"]
    assert spark.read.option("header", True).csv(str(tmp_path / "plain.csv")).columns == found["plain"].names
    write(tmp_path, "t.csv/part-2.csv", "id,other\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        survey(spark, {"t": str(tmp_path / "t.csv")})


def test_lines_are_numbered_and_split_without_python(spark, tmp_path, small_splits):
    """Tables whose records lie on one line each give the rows, numbers and errors that the search for records gives."""
    lines = [f'{i},"a,{i}",x{i}' if i % 7 == 0 else f"{i},,'x{i} " if i % 5 == 0 else f"{i},b" for i in range(1, 400)]
    write(tmp_path, "t.csv/part-0.csv", "id,a,b\n" + "\n\n".join(lines[:150]) + "\n")
    write(tmp_path, "t.csv/part-1.csv", "id,a,b\r\n" + "\r\n".join(lines[150:]))
    path = str(tmp_path / "t.csv")
    by_line, joined = survey(spark, {"": path})[""], survey(spark, {"": path}, by_lines=False)[""]
    assert by_line.one_line and not joined.one_line
    assert (by_line.names, by_line.rows, by_line.folded) == (joined.names, joined.rows, joined.folded) == (["id", "a", "b"], 399, False)
    got = csv_files.read_csv_numbered(spark, path, found=by_line)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    wanted = [
        (f"{i}", f"a,{i}", f"x{i}", i) if i % 7 == 0 else (f"{i}", None, f"'x{i} ", i) if i % 5 == 0 else (f"{i}", "b", None, i)
        for i in range(1, 400)
    ]
    assert rows(got, "source_row_number") == rows(csv_files.read_csv_numbered(spark, path, found=joined), "source_row_number") == wanted
    write(tmp_path, "more.csv", "id\n1\n2,\n3,surplus\n")
    with pytest.raises(Exception, match="surplus cell surplus"):
        csv_files.read_csv_numbered(spark, str(tmp_path / "more.csv")).select("id").collect()


def test_moved_splits_end_a_numbered_read(spark, tmp_path, small_splits):
    path = write(tmp_path, "t.csv", "id\n" + "".join(f"{i}\n" for i in range(500)))
    found = survey(spark, {"": path})[""]
    moved = replace(found, splits=found.splits.withColumn("_first", F.col("_first") + 1))
    with pytest.raises(Exception, match=SPLITS_MOVED):
        csv_files.read_csv_numbered(spark, path, found=moved).collect()


def test_drift_of_schemas(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as string) as name", "1 as extra").write.parquet(str(tmp_path / "t"))
    found = sources.file_schemas(spark, {"t": str(tmp_path / "t")})
    declared = {"t": T.StructType.fromDDL("id long, name varchar(9), gone date"), "u": T.StructType.fromDDL("x int")}
    declared["t"]["name"].dataType = T.LongType()
    assert rows(sources.schema_drift(spark, found, declared), "coluna") == [
        ("t", "extra", "nova", None, "int"), ("t", "gone", "perdida", "date", None), ("t", "name", "tipo", "bigint", "string"),
    ]
