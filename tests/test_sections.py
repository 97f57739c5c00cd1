"""From a CSV folder through both layers to every page, and sums that must agree."""

import pytest

from tests.conftest import rows
from vitrine import schemas
from vitrine.operators import layers, recommend
from vitrine.plans import binding, sections
from vitrine.session import scratch_dir
from vitrine.sources import csv_files


@pytest.fixture(scope="module")
def folder(spark, sf_dir):
    out = scratch_dir(spark, "sections-in")
    present = binding.raw_tables(spark, sf_dir)
    del present["returns"]
    binding.export_csv(present, out)
    return out


@pytest.fixture(scope="module")
def tables(spark, folder):
    out = scratch_dir(spark, "sections-out")
    layers.full_refresh(spark, folder, out)
    return sections.load(spark, out)


def test_absent_tables_are_empty_but_typed(tables):
    assert set(tables) == set(schemas.TREATED)
    assert tables["returns"].isEmpty() and "total_refund_amount" in tables["returns"].columns


def test_every_page_runs(spark, folder, tables):
    raw = csv_files.scan_csv_dir(spark, folder)
    pages = [
        sections.eda(tables["orders"]), sections.treatment(raw), sections.sales(tables),
        sections.customers(tables), sections.forecast(tables), sections.recommendations(tables),
        sections.order_quality(tables["orders"]),
    ]
    for page in pages:
        for name, df in page.items():
            assert len(df.columns) == len(set(df.columns)), name
            df.collect()


def test_sums_agree(tables):
    page = sections.sales(tables)
    revenue = page["kpis"].first()["receita"]
    assert sum(r.receita for r in page["monthly"].collect()) == pytest.approx(revenue)
    assert sum(r.receita for r in page["by_channel"].collect()) == pytest.approx(revenue)
    days = sections.forecast(tables)["history"].collect()
    dated = tables["orders"].filter("created_at is not null").count()
    assert sum(d.pedidos for d in days) == dated
    assert (days[-1].dia - days[0].dia).days + 1 == len(days)


def test_pairs_add_up_to_the_basket_sizes(tables):
    items = tables["order_items"]
    sizes = [len(r.produtos) for r in recommend.order_baskets(items).collect()]
    pairs = rows(recommend.product_pairs(items))
    assert all(a < b for a, b, _ in pairs)
    assert sum(n for _, _, n in pairs) == sum(k * (k - 1) // 2 for k in sizes)
