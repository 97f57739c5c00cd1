"""Sales by product, customers, recommendations and text formats on small shops."""

import itertools
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitrine.functions import text
from vitrine.operators import customers as cust, recommend, sales


@pytest.fixture(scope="module")
def shop(spark):
    d = Decimal
    return {
        "orders": spark.createDataFrame(
            [(1, 1, d(10)), (2, 1, d(20)), (3, 2, d(5)), (4, 3, d(0)), (5, None, d(7)), (6, 9, None)],
            "id long, customer_id long, total decimal(18,2)",
        ),
        "items": spark.createDataFrame(
            [
                (1, 10, d(2), d(30)), (1, 11, d(1), d(5)), (2, 10, d(1), d(8)),
                (3, 12, d(4), d(4)), (5, 11, d(1), d(9)), (2, 99, d(1), d(50)),
                (3, None, d(1), d(1)), (3, 10, None, d(70)), (2, 12, d(3), None),
            ],
            "order_id long, product_variant_id long, quantity decimal(18,4), line_total decimal(18,2)",
        ),
        "variants": spark.createDataFrame(
            [(10, 100, d(9)), (11, 101, d(2)), (12, 102, d(6)), (13, 100, d(1))],
            "id long, product_id long, cost_price decimal(18,2)",
        ),
        "products": spark.createDataFrame(
            [(100, "boia"), (101, "boia"), (102, "cabo")], "id long, name string"
        ),
        "customers": spark.createDataFrame(
            [(1, "Ana", "PF"), (2, "Bia", "PJ"), (3, "Caio", "PF"), (4, "Duo", "PJ"), (5, "Eva", "PF")],
            "id long, legal_name string, person_type string",
        ),
    }


def test_margin_keeps_every_item(shop):
    df = sales.item_margin(shop["items"], shop["variants"], shop["products"])
    assert df.count() == 9
    profit = {(r.order_id, r.product_variant_id): r.profit for r in df.collect()}
    assert profit[1, 10] == 12 and profit[3, 12] == -20 and profit[2, 99] is None


def test_products_merge_by_name_and_skip_unpriced_items(shop):
    totals = sales.product_totals(shop["items"], shop["variants"], shop["products"])
    got = {r[0]: r[1:] for r in rows(totals)}
    # boia: variants 10 and 11; the item without quantity adds revenue but no profit.
    assert got["boia"] == (5.0, 122.0, (30 - 18) + (8 - 9) + (5 - 2) + (9 - 2))
    assert got["cabo"] == (7.0, 4.0, 4.0 - 24)
    assert got[None] == (2.0, 51.0, 0.0)
    assert [r[0] for r in rows(sales.product_ranking(totals))] == ["cabo", "boia", None]
    assert rows(sales.product_losses(totals)) == [("cabo", 7.0, 4.0, -20.0)]


def test_repurchase(shop):
    got = rows(cust.customer_orders(shop["orders"], shop["customers"]), "customer_id")
    assert got == [
        (1, 2, 30.0, True, "Ana", "PF"), (2, 1, 5.0, False, "Bia", "PJ"),
        (3, 1, 0.0, False, "Caio", "PF"), (9, 1, 0.0, False, None, None),
    ]
    assert rows(cust.customer_kpis(shop["orders"], shop["customers"])) == [(4, 25.0, 35 / 4, 3, 2)]


def test_customer_profit_keeps_those_without_items(shop):
    got = rows(
        cust.customer_profit(shop["orders"], shop["items"], shop["variants"], shop["customers"])
    )
    assert got == [
        (1, "Ana", "PF", 14.0), (None, None, None, 7.0), (3, "Caio", "PF", 0.0),
        (9, None, None, 0.0), (2, "Bia", "PJ", -20.0),
    ]


def test_person_types_and_states(spark, shop):
    assert rows(cust.person_type_split(shop["customers"])) == [("PF", 3, 60.0), ("PJ", 2, 40.0)]
    addresses = spark.createDataFrame(
        [(1, "SP"), (1, "SP"), (2, "SP"), (3, None)], "customer_id long, state string"
    )
    assert rows(cust.customers_by_state(addresses)) == [("SP", 3, 2), (None, 1, 1)]


def test_baskets(spark):
    items = spark.createDataFrame(
        [(1, 3), (1, 1), (1, 3), (1, None), (2, 1), (2, 3), (3, 2), (None, 7), (4, None)],
        "order_id long, product_variant_id long",
    )
    assert rows(recommend.order_baskets(items), "order_id") == [
        (1, [1, 3]), (2, [1, 3]), (3, [2]), (4, []),
    ]
    assert recommend.basket_items(items).count() == 5
    assert rows(recommend.product_pairs(items)) == [(1, 3, 2)]


def brute_pairs(items):
    baskets = {}
    for order, variant in items:
        baskets.setdefault(order, set()).add(variant)
    return Counter(
        pair for b in baskets.values() for pair in itertools.combinations(sorted(b), 2)
    )


def test_pairs_with_a_hot_order_and_small_blocks(spark):
    rng = random.Random(5)
    items = [(0, rng.randrange(120)) for _ in range(1000)]  # a third of all rows
    items += [(rng.randrange(1, 400), int(rng.paretovariate(0.6)) % 120) for _ in range(2000)]
    df = spark.createDataFrame(items, "order_id long, product_variant_id long")
    want = brute_pairs(items)
    for block in (7, 256):
        got = {(a, b): n for a, b, n in rows(recommend.product_pairs(df, block))}
        assert got == want
    ranked = sorted(((-n, a, b) for (a, b), n in want.items()))[:30]
    # Too few seeds, some, all; one large basket, a few, and more than the bar.
    for seeds, block in ((3, 256), (20, 7), (1000, 256), (1000, 40), (1000, 3)):
        top = rows(recommend.top_pairs(df, 30, seeds, block))
        assert [(-n, a, b) for a, b, n in top] == ranked, (seeds, block)


def test_top_pairs_spare_the_large_baskets(spark, monkeypatch):
    """The result is whole though large baskets never list their pairs."""
    rng = random.Random(3)
    items = [(o, v) for o in (0, 1) for v in range(90)]
    items += [(o, v) for o in range(2, 300) for v in rng.sample(range(25), 5)]
    df = spark.createDataFrame(items, "order_id long, product_variant_id long")
    ranked = sorted(((-n, a, b) for (a, b), n in brute_pairs(items).items()))[:30]
    calls = []
    full, lift = recommend.product_pairs, recommend._add_large
    monkeypatch.setattr(recommend, "product_pairs", lambda *a: calls.append("full") or full(*a))
    monkeypatch.setattr(recommend, "_add_large", lambda *a: calls.append("lift") or lift(*a))
    top = rows(recommend.top_pairs(df, 30, 25, 50))
    assert [(-n, a, b) for a, b, n in top] == ranked
    assert calls == ["full", "lift"]  # all pairs of the seeds only


def test_baskets_are_dealt_to_tasks_by_their_pairs(spark, monkeypatch):
    rng = random.Random(5)
    items = [(o, v) for o in range(200) for v in rng.sample(range(25), 5)] + [(o, None) for o in range(9)]
    df = spark.createDataFrame(items, "order_id long, product_variant_id long")
    assert recommend._sizes(df, 4) == (200, 0) and recommend._sizes(df, 5) == (0, 2000)
    monkeypatch.setattr(recommend, "TASK_PAIRS", 100)
    usual, _ = recommend._by_size(df, 5, 2000)
    assert "REPARTITION_BY_NUM" in usual._jdf.queryExecution().toString() and usual.rdd.getNumPartitions() >= 20
    want = sorted((a, b, n) for (a, b), n in brute_pairs([i for i in items if i[1] is not None]).items())
    assert rows(recommend.product_pairs(df), "produto_a", "produto_b") == want


def test_pairs_drop_rare_products_only(spark, monkeypatch):
    """Frequent pairs among many rare products: the thinned count equals the full one."""
    rng = random.Random(9)
    items = [(o, v) for o in range(200) for v in rng.sample(range(12), 4)]
    items += [(o, 1000 + rng.randrange(5000)) for o in range(200) for _ in range(12)]
    df = spark.createDataFrame(items, "order_id long, product_variant_id long")
    ranked = sorted(((-n, a, b) for (a, b), n in brute_pairs(items).items()))[:30]
    seen = []
    full = recommend.order_baskets
    monkeypatch.setattr(
        recommend, "order_baskets", lambda i: seen.append(i.count()) or full(i)
    )
    top = rows(recommend.top_pairs(df, 30, 12))
    assert [(-n, a, b) for a, b, n in top] == ranked
    assert seen[-1] == 800  # only the items of the frequent products were paired


def test_named_pairs_and_ties(spark, shop):
    items = spark.createDataFrame(
        [(1, 10), (1, 11), (2, 10), (2, 12), (3, 77), (3, 11)],
        "order_id long, product_variant_id long",
    )
    got = rows(recommend.product_pairs_named(items, shop["variants"], shop["products"]))
    assert got == [
        (10, 11, 1, "boia", "boia"), (10, 12, 1, "boia", "cabo"), (11, 77, 1, "boia", None),
    ]


def test_no_pairs(spark, shop):
    items = spark.createDataFrame([], "order_id long, product_variant_id long")
    assert rows(recommend.product_pairs_named(items, shop["variants"], shop["products"])) == []


def test_next_purchase(shop):
    args = (shop["orders"], shop["items"], shop["variants"], shop["products"])
    assert rows(recommend.customer_list(shop["orders"])) == [(1,), (2,), (3,), (9,)]
    first = rows(recommend.next_purchase(*args))
    assert first == [(1, 10, "boia", 3.0), (1, 12, "cabo", 3.0), (1, 11, "boia", 1.0), (1, 99, None, 1.0)]
    assert rows(recommend.next_purchase(*args, customer_id=2)) == [(2, 12, "cabo", 4.0), (2, 10, "boia", 0.0)]
    every = rows(recommend.next_purchase_all(*args), "customer_id", "posicao")
    assert [(c, v, p, q) for c, _, v, p, q in every if c == 1] == first
    assert rows(recommend.next_purchase_all(*args, n=1), "customer_id") == [
        (1, 1, 10, "boia", 3.0), (2, 1, 12, "cabo", 4.0),
    ]


def test_formats(spark):
    values = [None, 0.0, -1234.5, 2.675, 1234567.891, 12.35]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    v = F.col("v")
    got = rows(df.select("i", text.fmt_brl(v), text.fmt_int(v), text.fmt_pct1(v)), "i")
    assert [g[1] for g in got] == [
        "—", "R$ 0,00", "R$ -1.234,50", "R$ 2,67", "R$ 1.234.567,89", "R$ 12,35",
    ]
    assert [g[2] for g in got][4] == "1.234.568"
    assert [g[3] for g in got][1:] == ["0.0%", "-1234.5%", "2.7%", "1234567.9%", "12.3%"]
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(text.fmt_brl(v)).first()[0]
    assert nan == "—"
    days = spark.sql("select date'2024-02-01' d union all select null").select(text.fmt_date(F.col("d")))
    assert sorted(r[0] for r in days.collect()) == ["01/02/2024", "—"]
