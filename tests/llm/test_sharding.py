import zlib
from collections import Counter, defaultdict

from tests.llm import cases
from vitrine.llm import sharding


def check(spark, rows, shards):
    got = sharding.by_rows(cases.clashing(cases.documents(spark, rows)), shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return got


def test_even_and_gapless(spark):
    check(spark, cases.texts(), 7)
    check(spark, cases.texts()[:5], 8)
    check(spark, [], 4)


def test_equal_texts_stay_together(spark):
    rows = [(k, f"single {k}") for k in range(300)] + [(1000 + k, f"group {k % 20}") for k in range(100)]
    got = check(spark, rows, 10)
    places = defaultdict(set)
    for r in got:
        if r["doc_id"] >= 1000:
            places[r["doc_id"] % 20].add(r["shard"])
    assert sum(len(p) > 1 for p in places.values()) <= 2


def test_a_hot_group_fills_shards(spark):
    rows = [(k, "hot") for k in range(200)] + [(500 + k, f"single {k}") for k in range(200)]
    got = check(spark, rows, 10)
    assert len({r["shard"] for r in got if r["doc_id"] < 500}) <= 7


def shards_of(got, group):
    places = defaultdict(set)
    for r in got:
        places[group(r["doc_id"])].add(r["shard"])
    return places


def test_pairs_come_together_where_every_text_has_a_copy(spark):
    got = check(spark, [(k, f"pair {k % 1000}") for k in range(2000)], 40)
    assert sum(len(p) > 1 for p in shards_of(got, lambda i: i % 1000).values()) <= 40


def test_groups_of_half_a_shard_come_together(spark):
    got = check(spark, [(k, f"group {k % 100}") for k in range(2000)], 40)
    parts = [len(p) for p in shards_of(got, lambda i: i % 100).values()]
    assert sum(parts) <= 150 and max(parts) <= 4


def test_a_third_in_one_group_takes_a_third_of_the_shards(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"pair {k // 6} {k % 3}") for k in range(3000)]
    got = check(spark, rows, 40)
    assert len({r["shard"] for r in got if r["doc_id"] % 3 == 0}) <= 20
    places = shards_of([r for r in got if r["doc_id"] % 3], lambda i: (i // 6, i % 3))
    assert sum(len(p) > 1 for p in places.values()) <= 60


def test_large_hubs_are_packed_whole_where_they_fit():
    parts, room = sharding.packed([(25, 0), (10, 1), (5, 0)], [10] * 4)
    assert [p[0] for p in parts] == [0, 0, 0, 1, 2] and room == [0, 0, 0, 0]
    assert [p[1:] for p in parts if p[0] == 1] == [(0, 10, 3)]  # the first hub has filled its home
    assert sharding.packed([(2, 2)], [1, 1, 0]) == ([(0, 0, 1, 0), (0, 1, 2, 1)], [0, 0, 0])
