import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_sources import write
from vitrine import schemas
from vitrine.operators.quality import ConstraintViolation
from vitrine.operators import layers, profile, treatment
from vitrine.sources import csv_files, tables as sources


def text(spark, names, data):
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names.split()))


def test_dedup_takes_nulls_as_equal_and_keeps_near_copies(spark):
    df = text(spark, "id v", [("1", None), ("1", None), ("1", "a"), ("1", "a ")])
    assert treatment.exact_dedup(df).count() == 3


def test_dates_take_one_format_per_column(spark):
    df = text(
        spark, "id paid_at hire_date",
        [
            ("1", "2024-02-29 10:00:00", "2024-02-29"),
            ("2", "bad", "2024-02-29 10:00:00"),
            ("3", "2024-02-29", "2023-02-29"),
            ("4", None, None),
        ],
    )
    out = rows(
        treatment.coerce_dates(df).select(
            "id", F.col("paid_at").cast("string"), F.col("hire_date").cast("string")
        ),
        "id",
    )
    assert out == [
        ("1", "2024-02-29 10:00:00", "2024-02-29 00:00:00"),
        ("2", None, None), ("3", None, None), ("4", None, None),
    ]


def test_dates_are_not_moved_by_the_session_zone(spark):
    df = text(spark, "created_at", [("2018-11-04 00:30:00",)])
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "America/Sao_Paulo")
    try:
        out = treatment.coerce_dates(df).select(F.col("created_at").cast("string")).first()[0]
    finally:
        spark.conf.set(key, "UTC")
    assert out == "2018-11-04 00:30:00"


def test_numbers_and_rounding(spark):
    df = text(
        spark, "id total quantity",
        [("1", "1.5", "1.00005"), ("2", " 2 ", "x"), ("3", "1.234,5", None), ("4", "1.005", "3"),
         ("5", "1" * 30, "")],
    )
    out = [(r.id, str(r.total), str(r.quantity)) for r in
           treatment.coerce_numbers(df).orderBy("id").collect()]
    assert out == [
        ("1", "1.50", "1.0001"), ("2", "2.00", "None"), ("3", "None", "None"),
        ("4", "1.01", "3.0000"), ("5", "None", "None"),
    ]


def test_customer_ids_lose_all_outer_blanks(spark):
    df = text(spark, "tax_id phone email", [("\t012 3 ", "\n0611\r", " a@b.c\f")])
    assert rows(treatment.trim_customer_ids(df)) == [("012 3", "0611", "a@b.c")]


def test_treating_twice_is_treating_once(spark):
    df = text(
        spark, "id total created_at phone",
        [("1", "1.50", "2024-01-01 00:00:00", " 01 "), ("1", "1.50", "2024-01-01 00:00:00", " 01 "),
         ("2", "x", "y", None)],
    )
    once = treatment.treat_table(df, "customers")
    assert rows(treatment.treat_table(once, "customers"), "id") == rows(once, "id")


def test_report_counts_copies_and_nulls_on_both_sides(spark):
    a = text(spark, "id total", [("1", "x"), ("1", "x"), ("2", None), ("2", None), ("3", "4")])
    b = text(spark, "id", [("1",), (None,)])
    empty = text(spark, "id", [])
    report = treatment.treatment_report({"a": a, "b": b, "c": empty})
    assert rows(report) == [
        ("a", 5, 3, 2, 2, 2), ("b", 2, 2, 0, 1, 1), ("c", 0, 0, 0, 0, 0),
    ]
    assert rows(treatment.top_tables(report, "duplicados_removidos", 1)) == [("a", 2)]


def test_refresh_builds_both_layers_and_the_log(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "orders.csv", (
        "id,order_number,total,created_at,extra\n"
        "1,A,10.005,2024-01-01 00:00:00,é\n"
        "1,A,10.005,2024-01-01 00:00:00,é\n"
        "2,B,bad,bad,\n"
    ))
    write(source, "brands.csv", "id,name\n1,07\n")
    log = rows(layers.full_refresh(spark, source, out).select(
        "id", "file_name", "source_table", "layer", "row_count", "status", "details"), "id")
    assert [r[:6] for r in log] == [
        (1, "brands.csv", "brands", "raw", 1, "completed"),
        (2, "orders.csv", "orders", "raw", 3, "completed"),
        (3, "orders.csv", "orders", "treated", 2, "completed"),
    ]
    assert json.loads(log[0][6]) == {"columns": ["id", "name"]}
    assert json.loads(log[2][6]) == {"dropped_duplicate_rows": 1, "date_columns": ["created_at"]}

    raw = layers.read_raw(spark, out)
    payloads = rows(
        raw.filter("source_table = 'orders'").select("source_row_number", "payload"),
        "source_row_number",
    )
    assert [n for n, _ in payloads] == [1, 2, 3]
    assert json.loads(payloads[0][1])["extra"] == "é"
    assert json.loads(payloads[2][1]) == {
        "id": "2", "order_number": "B", "total": "bad", "created_at": "bad", "extra": None,
    }
    treated = layers.read_treated(spark, out)["orders"]
    assert treated.columns == schemas.table_schemas()["treated.orders"].names
    assert [(r.id, str(r.total), r.channel, r.source_run_id) for r in
            treated.orderBy("id").collect()] == [(1, "10.01", None, 3), (2, "None", None, 3)]

    back = sources.payload_table(raw, "brands", csv_schema())
    assert rows(back) == [(1, 1, "07")]

    # A second refresh replaces the first one, also tables that are gone.
    (tmp_path / "in2").mkdir()
    write(str(tmp_path / "in2"), "brands.csv", "id,name\n1,07\n2,08\n")
    log = layers.full_refresh(spark, str(tmp_path / "in2"), out)
    assert rows(log.select("id")) == [(4,)]  # run numbers go on
    assert rows(layers.read_raw(spark, out).groupBy("source_table").count()) == [("brands", 2)]
    assert layers.read_treated(spark, out) == {}


def test_a_refresh_that_fails_leaves_the_layers_before(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        layers.read_log(spark, out)
    write(source, "products.csv", "id,name\n1,a\n")
    layers.full_refresh(spark, source, out)
    write(source, "brands.csv", "id,name\n1,b\n")
    write(source, "variants.csv", "id,name\n1,b,surplus\n")
    with pytest.raises(Exception, match="more cells"):
        layers.full_refresh(spark, source, out)
    assert rows(layers.read_log(spark, out).select("source_table", "layer"), "layer") == [
        ("products", "raw"), ("products", "treated"),
    ]
    assert rows(layers.read_raw(spark, out).select("source_table")) == [("products",)]
    assert [r.name for r in layers.read_treated(spark, out)["products"].collect()] == ["a"]


def test_broken_rows_fail_or_go_to_quarantine(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "products.csv", "id,name\n1,a\n2,b\n2,c\n,d\n")
    with pytest.raises(ConstraintViolation, match="primary_key:id=2"):
        layers.full_refresh(spark, source, out, broken="fail")
    log = layers.full_refresh(spark, source, out, broken="quarantine")
    assert rows(log.select("layer", "row_count"), "layer") == [("raw", 4), ("treated", 4)]
    assert [(r.id, r.name) for r in layers.read_treated(spark, out)["products"].collect()] == [(1, "a")]
    apart = layers.read_quarantine(spark, out)["products"].select("id", "name", "regras_violadas")
    assert rows(apart, "name") == [
        (2, "b", ["primary_key:id"]), (2, "c", ["primary_key:id"]), (None, "d", ["not_null:id"]),
    ]


@pytest.mark.parametrize("newest", [False, True])
def test_mended_rows_are_taken_in_again(spark, tmp_path, newest):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "products.csv", "id,name\n1,a\n2,b\n2,c\n,d\n,e\n,f\n")
    layers.full_refresh(spark, source, out, broken="quarantine", newest_wins=newest)

    def named_ids(*pairs):
        return lambda df: df.withColumn(
            "id", F.coalesce(F.create_map(*[F.lit(x) for p in pairs for x in p])[F.col("name")].cast("long"), "id")
        )

    taken = layers.replay(spark, out, "products", named_ids(("c", 3), ("d", 4), ("e", 1)))
    assert taken == (1 + (0 if newest else 2))  # d, and where both rows of key 2 were kept, b and c
    ids = lambda df: sorted((r["id"] or 0, r["name"]) for r in df.collect())
    good = [(1, "a"), (2, "c"), (4, "d")] if newest else [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert ids(layers.read_treated(spark, out)["products"]) == good
    apart = layers.read_quarantine(spark, out)["products"]
    assert [(r["name"], r["regras_violadas"]) for r in apart.orderBy("name").collect()] == [
        ("e", ["primary_key:id"]), ("f", ["not_null:id"]),
    ]
    assert layers.replay(spark, out, "products", named_ids(("e", 5), ("f", 6))) == 2
    assert ids(layers.read_treated(spark, out)["products"]) == [*good, (5, "e"), (6, "f")]
    assert layers.read_quarantine(spark, out)["products"].isEmpty()
    with pytest.raises(ValueError, match="quarantine"):
        layers.replay(spark, out, "orders", lambda df: df)


def test_refresh_of_a_header_only_file_and_of_an_empty_folder(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "products.csv", "id,name,surplus\n")
    log = rows(layers.full_refresh(spark, source, out).select("layer", "row_count"), "layer")
    assert log == [("raw", 0), ("treated", 0)]
    assert layers.read_raw(spark, out).isEmpty()
    products = layers.read_treated(spark, out)["products"]
    assert products.isEmpty() and products.columns[:2] == ["id", "name"]

    (tmp_path / "none").mkdir()
    assert layers.full_refresh(spark, str(tmp_path / "none"), out).isEmpty()
    assert layers.read_raw(spark, out).isEmpty() and layers.read_treated(spark, out) == {}


def test_a_refresh_goes_on_where_splits_moved(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "products.csv", "id,name\n1,a\n2,b\n2,b\n")
    whole = layers.survey

    def moved(spark, paths, by_lines=True):
        found = whole(spark, paths, by_lines)
        return {n: replace(s, splits=s.splits.withColumn("_first", F.col("_first") + 1)) if by_lines else s for n, s in found.items()}

    monkeypatch.setattr(layers, "survey", moved)
    log = rows(layers.full_refresh(spark, source, out).select("layer", "row_count"), "layer")
    assert log == [("raw", 3), ("treated", 2)]
    assert rows(layers.read_raw(spark, out).select("source_row_number"), "source_row_number") == [(1,), (2,), (3,)]
    assert rows(layers.read_treated(spark, out)["products"].select("id", "name"), "id") == [(1, "a"), (2, "b")]


def test_layers_are_packed_and_treated_without_json(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "products.csv", "id,name\n1,a\n")
    monkeypatch.setattr(layers, "payload_text", None)  # not asked where each line is a record
    layers.full_refresh(spark, source, out)
    files = [f.removeprefix("file:") for f in layers.read_raw(spark, out).inputFiles()]
    files += [f.removeprefix("file:") for f in layers.read_treated(spark, out)["products"].inputFiles()]
    assert all(".zstd." in f for f in files) and len(files) >= 2


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "32k")
    try:
        df = spark.range(40_000, numPartitions=8).selectExpr("id", "uuid() as name", "0 as bucket")
        layers._write_buckets(df, str(tmp_path / "t"))
    finally:
        spark.conf.set(size, before)
    written = spark.read.parquet(str(tmp_path / "t"))
    assert written.count() == 40_000 and len(written.inputFiles()) > 1


def csv_schema():
    from pyspark.sql import types as T

    return T.StructType.fromDDL("id long, name string")


def test_declared_schemas(spark):
    declared = schemas.table_schemas()
    assert len(declared) == 15
    assert declared["treated.orders"].names[-1] == "source_run_id"
    assert [len(declared[f"warehouse.{t}"]) for t in schemas.WAREHOUSE] == [6, 7, 11, 11, 13, 11]
    assert declared["warehouse.orders"]["total"].dataType.simpleString() == "decimal(15,2)"


def test_null_tokens_leave_other_types(spark):
    df = spark.createDataFrame([(1, "NA"), (2, "x")], "n int, v string")
    assert rows(csv_files.null_tokens(df), "n") == [(1, None), (2, "x")]


def test_stored_counts_give_the_reports_of_the_layers(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "products.csv", "id,name,description\n1,a,\n1,a,\n2,,N/A\n3,c,x\n")
    write(source, "brands.csv", "id,name\n1,\n")
    for options in ({}, {"newest_wins": True, "buckets": 4}, {"broken": "quarantine"}):
        layers.full_refresh(spark, source, out, **options)
        counts = layers.read_profile(spark, out)
        assert rows(treatment.stored_report(counts)) == [("products", 4, 3, 1, 4, 3)]
        assert rows(counts.filter("source_table = 'brands'").drop("source_table"), "coluna") == [("raw", "id", 1, 0), ("raw", "name", 1, 1)]
        found = rows(profile.stored_null_profile(counts, "products"))
        want = rows(profile.eda_null_profile(layers.read_treated(spark, out)["products"]))
        assert found == want
