import datetime

import pytest

from tests.conftest import rows
from tests.test_sources import write
from vitrine.operators.quality import ConstraintViolation
from vitrine.operators.warehouse import load_warehouse, order_views, read_warehouse

STAMP = "2024-01-05 10:00:00"
CUSTOMERS = "id,person_type,legal_name,trade_name,tax_id,state_registration,email,phone,is_active,created_at,updated_at\n"
ORDERS = (
    "id,order_number,channel,customer_id,salesperson_id,location_id,status,subtotal,discount_amount,total,"
    "placed_at,created_at,updated_at\n"
)


def customer(i, kind="PF", tax="1"):
    return f'{i},{kind},"Loja, {i}",,{tax},,a@b.c,{i},true,{STAMP},{STAMP}\n'


def order(i, who=1, total="2.50"):
    return f"{i},N{i},web,{who},,1,paid,{total},0.00,{total},{STAMP},{STAMP},{STAMP}\n"


def test_tables_come_typed_and_views_read_them(spark, tmp_path):
    write(tmp_path, "in/customers.csv", CUSTOMERS + customer(1) + customer(2, "PJ", "2"))
    write(tmp_path, "in/orders.csv", ORDERS + order(1) + order(2, 2, "3.25"))
    write(tmp_path, "in/other.csv", "x\n1\n")
    loaded = load_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(loaded) == ["customers", "orders"] and len(loaded["orders"].columns) == 13
    assert rows(loaded["customers"].select("id", "legal_name", "trade_name"), "id") == [(1, "Loja, 1", None), (2, "Loja, 2", None)]
    views = order_views(read_warehouse(spark, str(tmp_path / "out")))
    assert sorted(views) == ["v_orders_by_channel", "v_orders_by_month", "v_orders_eda", "v_orders_nulls"]
    assert rows(views["v_orders_by_month"]) == [(datetime.date(2024, 1, 1), 2, 5.75, 2.875)]
    assert rows(spark.sql("SELECT channel, orders_count FROM v_orders_by_channel")) == [("web", 2)]


def test_a_load_is_seen_whole_or_not_at_all(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        read_warehouse(spark, out)
    write(source, "customers.csv", CUSTOMERS + customer(1))
    write(source, "orders.csv", ORDERS + order(1))
    load_warehouse(spark, source, out)
    write(source, "customers.csv", CUSTOMERS + customer(1) + customer(2, tax="2"))
    write(source, "orders.csv", ORDERS + order(1) + order(2, 9))
    with pytest.raises(ConstraintViolation, match="orders.reference:customer_id=1"):
        load_warehouse(spark, source, out)
    assert {n: df.count() for n, df in read_warehouse(spark, out).items()} == {"customers": 1, "orders": 1}
    write(source, "orders.csv", ORDERS + order(1) + order(2, 2))
    load_warehouse(spark, source, out)
    assert {n: df.count() for n, df in read_warehouse(spark, out).items()} == {"customers": 2, "orders": 2}


def test_a_table_may_refer_to_itself(spark, tmp_path):
    head = "id,name,slug,parent_category_id,is_active,created_at,updated_at\n"
    line = lambda i, up: f"{i},c{i},s{i},{up},true,{STAMP},{STAMP}\n"
    write(tmp_path, "in/categories.csv", head + line(1, "") + line(2, 1) + line(3, 2))
    assert load_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "out"))["categories"].count() == 3
    write(tmp_path, "in/categories.csv", head + line(1, "") + line(2, 7))
    with pytest.raises(ConstraintViolation, match="categories.reference:parent_category_id=1"):
        load_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "out"))


@pytest.mark.parametrize(
    "customers, orders, rule",
    [
        (customer(1) + customer(1, tax="2"), order(1), "customers.primary_key:id"),
        (customer(1) + customer(2), order(1), "customers.unique:tax_id"),
        (customer(1, "XX"), order(1), "customers.domain:person_type"),
        (customer(1), order(1, 9), "orders.reference:customer_id"),
        (customer(1), order(1, ""), "orders.not_null:customer_id"),
    ],
)
def test_a_broken_rule_stops_the_load(spark, tmp_path, customers, orders, rule):
    write(tmp_path, "in/customers.csv", CUSTOMERS + customers)
    write(tmp_path, "in/orders.csv", ORDERS + orders)
    with pytest.raises(ConstraintViolation, match=rule):
        load_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_a_bad_field_or_a_missing_file_stops_the_load(spark, tmp_path):
    write(tmp_path, "in/orders.csv", ORDERS + order(1, total="much"))
    with pytest.raises(Exception, match="MALFORMED"):
        load_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        load_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "out"), ("orders", "brands"))
