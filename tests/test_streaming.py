import json

import pytest

from tests.conftest import rows
from tests.test_sources import write
from vitrine.operators import layers, manifest
from vitrine.streaming.arrivals import arrival_run, ingest_arrivals


def test_only_new_files_are_taken(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        ingest_arrivals(spark, folder, "orders", ["id", "v"], out, checkpoint).awaitTermination()
        raw = layers.read_raw(spark, out)
        return [
            (run_id - arrival_run("orders", 0) + 1, n, json.loads(p))
            for run_id, n, p in rows(
                raw.select("ingestion_run_id", "source_row_number", "payload"),
                "ingestion_run_id", "source_row_number",
            )
        ]

    write(folder, "a.csv", 'id,v\n01,"x\ny"\n02,N/A\n')
    write(folder, "b.csv", "id,v\n03,z\n")
    first = [
        (1, 1, {"id": "01", "v": "x\ny"}), (1, 2, {"id": "02", "v": None}),
        (1, 3, {"id": "03", "v": "z"}),
    ]
    assert run() == first
    assert run() == first
    write(folder, "c.csv", "id,v\n04,w\n")
    assert run() == first + [(2, 1, {"id": "04", "v": "w"})]
    log = layers.read_log(spark, out).select("id", "layer", "row_count")
    assert rows(log, "id") == [(arrival_run("orders", 0), "raw", 3), (arrival_run("orders", 1), "raw", 1)]
    assert arrival_run("orders", 0) > 1 << 32 and arrival_run("items", 0) != arrival_run("orders", 0)


def test_surplus_cells_end_the_run(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    write(folder, "a.csv", "id,v\n1,x,more\n")
    with pytest.raises(Exception, match="more cells"):
        ingest_arrivals(spark, folder, "orders", ["id", "v"], out, checkpoint).awaitTermination()


COLUMNS = ["id", "order_number", "total", "created_at"]
HEAD = ",".join(COLUMNS) + "\n"


def treated(spark, out):
    columns = [c for c in layers.treated_schema("orders").names if c != "source_run_id"]
    return sorted((tuple(map(str, r)) for r in layers.read_treated(spark, out)["orders"].select(*columns).collect()))


def test_arrivals_after_a_refresh_are_read_and_merged(spark, tmp_path):
    """The treated table follows the arrivals, newest row of a key first, as a refresh over all files would have it."""
    first, later, out = str(tmp_path / "first"), str(tmp_path / "later"), str(tmp_path / "out")
    old = HEAD + "".join(f"{i},A{i},{i}.50,2024-01-01 00:00:00\n" for i in range(1, 40)) + "5,A5,bad,\n,keyless,1.00,\n"
    write(first, "orders.csv", old)
    layers.full_refresh(spark, first, out, newest_wins=True, buckets=8)
    assert layers.merge_arrivals(spark, out, "orders") == 0

    def arrive():
        ingest_arrivals(spark, later, "orders", COLUMNS, out, str(tmp_path / "state")).awaitTermination()

    write(later, "a.csv", HEAD + "5,B5,7.00,\n100,B100,1,2024-02-01 00:00:00\n,keyless,1.0,\n")
    arrive()
    assert layers.read_raw(spark, out).count() == 41 + 3
    before = manifest.snapshot(spark, out)
    assert layers.merge_arrivals(spark, out, "orders") == 3
    now = manifest.snapshot(spark, out)
    assert now.number == before.number + 1 and set(now.of("treated", "orders")[-1][1].buckets) != set(range(8))
    write(later, "b.csv", HEAD + "5,C5,8.00,\n5,D5,9.00,\n")
    arrive()
    assert layers.merge_arrivals(spark, out, "orders") == 1 and layers.merge_arrivals(spark, out, "orders") == 0
    layers_log = layers.read_log(spark, out)
    assert layers_log.filter("layer = 'treated'").count() == 3 and layers_log.count() == 6

    whole, again = str(tmp_path / "whole"), str(tmp_path / "again")
    write(whole, "orders.csv/0.csv", old)
    for name in ("a", "b"):
        write(whole, f"orders.csv/{name}.csv", (tmp_path / "later" / f"{name}.csv").read_text())
    layers.full_refresh(spark, whole, again, newest_wins=True, buckets=3)
    assert treated(spark, out) == treated(spark, again)
    assert [r for r in treated(spark, out) if r[0] == "5"][0][1] == "D5"

    # A refresh takes the place of what came before it.
    layers.full_refresh(spark, first, out)
    assert layers.read_raw(spark, out).count() == 41
    with pytest.raises(ValueError, match="newest_wins"):
        layers.merge_arrivals(spark, out, "orders")


def test_a_batch_is_committed_once_and_by_one_writer(spark, tmp_path):
    out = str(tmp_path / "out")
    empty = manifest.snapshot(spark, out)
    assert (empty.number, empty.parts) == (0, [])
    manifest.commit(spark, empty, "arrival", "t/0", [manifest.Part("raw", "t", "raw_csv_rows/source_table=t/part=x")], 7)
    with pytest.raises(manifest.ConcurrentCommit):
        manifest.commit(spark, empty, "arrival", "t/1", [])
    found = manifest.snapshot(spark, out)
    assert (found.number, found.last_run, found.batches) == (1, 7, {"t/0"})
    manifest.commit(spark, found, "refresh", "r", [], 8)
    found = manifest.snapshot(spark, out)
    assert (found.number, found.refreshed, found.parts, found.last_run) == (2, True, [], 8)
