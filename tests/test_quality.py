import pytest

from tests.conftest import rows
from vitrine import schemas
from vitrine.operators import quality
from vitrine.schemas import Column, Table


def test_primary_key_finds_copies_and_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    assert rows(quality.audit_pk(df, "id"), "id") == [(None, 1), (2, 2)]


def test_unique_ignores_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "slug string")
    assert rows(quality.audit_unique(df, "slug")) == [("a", 2)]


def test_reference_orphans_with_counts(spark):
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "customer_id int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert rows(quality.audit_fk(child, "customer_id", parent)) == [(9, 2)]


def test_reference_within_one_table(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 7)], "id int, parent_category_id int")
    assert rows(quality.audit_fk(df, "parent_category_id", df)) == [(7, 1)]


def test_row_rules(spark):
    df = spark.createDataFrame(
        [("PF", "1" * 11, "1.5", '{"a": 1}'), ("XX", "1" * 15, "1e17", "{bad"), (None,) * 4],
        "person_type string, cpf string, total string, payload string",
    )
    assert quality.audit_domain(df, "person_type", ("PF", "PJ")).count() == 1
    assert quality.audit_length(df, "cpf", 11).count() == 1
    assert quality.audit_decimal_range(df, "total", 15, 2).count() == 1
    assert quality.audit_json(df, "payload").count() == 1
    assert rows(quality.audit_not_null(df, ["cpf", "total"]), "coluna") == [("cpf", 1), ("total", 1)]


def test_defaults_fill_omitted_columns_only(spark):
    declared = schemas.WAREHOUSE["brands"]
    df = spark.createDataFrame([(1, "a", None)], "id int, name string, updated_at timestamp_ntz")
    out = quality.fill_defaults(df, declared).first()
    assert out["is_active"] is True and out["created_at"] is not None
    assert out["updated_at"] is None


def test_table_audit_and_stop(spark):
    table = Table(
        (Column("id", "int", True), Column("kind", "varchar(2)", True)),
        unique=("kind",), references={"id": "parent"}, domains={"kind": ("PF", "PJ")},
    )
    df = spark.createDataFrame([(1, "PF"), (1, "PF"), (2, "XYZ"), (3, None)], "id int, kind string")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    report = quality.audit_table(df, table, {"parent": parent})
    assert dict(rows(report)) == {
        "not_null:id": 0, "not_null:kind": 1, "length:kind": 1, "domain:kind": 1,
        "primary_key:id": 1, "unique:kind": 1, "reference:id": 1,
    }
    with pytest.raises(quality.ConstraintViolation, match="primary_key:id=1"):
        quality.require_valid(report)
    quality.require_valid(report.filter("violacoes = 0"))
    broken = quality.broken_rules(df, table)
    assert rows(broken.select("id", "regras_violadas"), "id")[2:] == [
        (2, ["length:kind", "domain:kind"]), (3, ["not_null:kind"]),
    ]


def test_all_keys_in_one_pass_are_those_of_the_single_audits(spark):
    data = [(1, "a", None), (1, "b", "x"), (2, "b", "x"), (None, "c", "y"), (3, "b", None), (None, "d", "z")]
    df = spark.createDataFrame(data, "id long, code string, slug string")
    found = quality.audit_keys(df, "id", ("code", "slug"))
    assert rows(found.filter("regra = 'primary_key:id'").select("valor", "linhas"), "valor") == [(None, 2), ("1", 2)]
    assert rows(quality.audit_pk(df, "id"), "id") == [(None, 2), (1, 2)]
    for column in ("code", "slug"):
        one = found.filter(f"regra = 'unique:{column}'").select("valor", "linhas")
        assert rows(one, "valor") == rows(quality.audit_unique(df, column), column) and not one.isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert quality.audit_keys(df.drop("id"), "id").isEmpty()


def test_all_references_in_one_job(spark):
    declared = {
        "a": schemas.Table(schemas._columns("id int"), references={"up": "a", "b_id": "b", "gone": "missing"}),
        "b": schemas.Table(schemas._columns("id int"), references={"a_id": "a"}),
    }
    a = spark.createDataFrame([(1, None, 5, 1), (2, 1, 6, 1), (3, 9, 6, 1), (4, 9, None, 1)], "id int, up int, b_id int, gone int")
    b = spark.createDataFrame([(5, 1), (5, 7), (None, 8)], "id long, a_id long")
    found = quality.audit_references({"a": a, "b": b}, declared)
    assert rows(found, "tabela", "coluna") == [("a", "b_id", "b.id", 1, 2), ("a", "up", "a.id", 1, 2), ("b", "a_id", "a.id", 2, 2)]
    assert quality.audit_references({"b": b}, declared).isEmpty()


def test_all_domains_in_one_job(spark):
    declared = {"t": schemas.Table(schemas._columns("id int"), domains={"kind": ("x", "y")}), "u": schemas.Table(schemas._columns("id int"))}
    t = spark.createDataFrame([("x",), (None,), ("z",), ("z",)], "kind string")
    assert rows(quality.audit_domains({"t": t, "u": t}, declared)) == [("t", "kind", "z", 2)]
    assert quality.audit_domains({"u": t}, declared).isEmpty()
