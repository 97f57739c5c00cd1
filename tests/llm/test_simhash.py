import numpy as np
import xxhash

from tests.llm import cases
from vitrine.llm import simhash
from vitrine.llm.components import star_roots
from vitrine.llm.store import Store


def brute_print(text, shingle):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def check(spark, rows, radius=4):
    docs = cases.clashing(cases.documents(spark, rows))
    got = sorted(((r["doc_id"], r["print"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs, 4, radius).collect()), key=str)
    prints = [brute_print(t, 4) for _, t in rows]
    roots = brute_components(prints, radius)
    least = {}
    for root, (i, _) in zip(roots, rows):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    want = sorted(((i, p, least.get(root)) for (i, _), p, root in zip(rows, prints, roots)), key=str)
    assert got == want


def test_components_like_brute_force(spark):
    check(spark, cases.texts())


def test_wider_radius_and_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows, 12)


def test_chunks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 5)
    check(spark, cases.texts())


def test_bit_sliced_comparison_like_popcounts():
    draw = np.random.default_rng(2)
    sizes = np.array([3, 700, 1, 64, 130, 2])
    prints = np.concatenate([draw.integers(0, 1 << 63, 1, np.uint64) ^ (np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)) for n in sizes])
    for radius in (0, 3, 4, 6):
        got = simhash.compare(prints, sizes, radius)
        want = np.array(brute_components([int(p) for p in prints], radius))
        at = 0
        for n in sizes:  # links across buckets may be found too, but none inside is missed
            for a in range(at, at + n):
                same = [b for b in range(at, at + n) if (int(prints[a]) ^ int(prints[b])).bit_count() <= radius]
                assert len(set(got[same])) == 1
            at += n
        assert all(want[a] == want[b] for a, b in enumerate(got))


def test_within_gives_lanes_up_to_the_radius():
    draw = np.random.default_rng(4)
    a = draw.integers(0, 1 << 63, 200, np.uint64)
    b = a.copy()
    for k in range(200):
        for bit in draw.choice(64, k % 9, False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    for radius in range(8):
        hits = simhash.within(simhash.planes(a), simhash.planes(b), radius)
        lanes = np.unpackbits(hits.view(np.uint8), bitorder="little")[:200].astype(bool)
        assert (lanes == (np.bitwise_count(a ^ b) <= radius)).all()


def test_first_of_each_keeps_one(spark):
    rows = cases.texts()
    docs = cases.clashing(cases.documents(spark, rows))
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    roots = brute_components([brute_print(t, 4) for _, t in rows], 4)
    groups = {}
    for root, (i, t) in zip(roots, rows):
        if i is not None:
            groups[root] = min(groups.get(root, (i, t)), (i, t), key=lambda x: x[0])
    want = {g[0] for g in groups.values()}
    assert {i for i, _ in found if i is not None} == want
    assert len([i for i, _ in found if i is None]) == 2
    assert len(found) == len(set(found) - {(None, x) for _, x in rows}) + 2


def test_empty_table(spark):
    docs = cases.documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.first_of_each(docs).count() == 0


def test_star_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (501, 500)], "a long, b long")
    got = dict(map(tuple, star_roots(links, Store(spark, "test")).collect()))
    assert got == {k: 0 for k in range(1, 201)} | {501: 500}
