import numpy as np

from vitrine.llm import ann


def brute(rows, queries, k):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in usable:
            ranked = sorted((-float((usable[q] * v).sum()), i) for i, v in usable.items() if i != q)
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def search(spark, rows, step=5, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as cell", "3 as v")
    out = {}
    for r in ann.search(frame, frame.where(f"vec_id % {step} = 0"), 20, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def table():
    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(size=8).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(60)]
    rows += [(400, None), (405, [0.0] * 8), (410, [1.0, None] * 4), (415, [float("nan")] * 8), (420, [float("inf")] * 8), (425, [1.0] * 7), (430, [])]
    return rows


def test_all_cells_give_the_exact_answer(spark):
    rows = table()
    got = search(spark, rows, share=1.0)
    want = brute(rows, [i for i, _ in rows if i % 5 == 0], 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [i for _, i, _ in found] == [i for i, _ in want[q]]
        assert np.allclose([s for _, _, s in found], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_small_bins_change_nothing(spark, monkeypatch):
    whole = search(spark, table(), share=1.0)
    monkeypatch.setattr(ann, "BIN", 7)
    assert search(spark, table(), share=1.0) == whole


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    matrix = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20, entries=100).collect()
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = matrix @ matrix[ids == q][0]
        scores[ids == q] = -9
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits / len(found) >= 0.9


def test_few_rows_and_none(spark):
    rows = [(0, [1.0] * 8), (5, [2.0] + [0.0] * 7), (7, [0.5] * 8)]
    assert {q: [i for _, i, _ in f] for q, f in search(spark, rows).items()} == {0: [7, 5], 5: [0, 7]}
    assert search(spark, []) == {}
    assert search(spark, [(0, None)]) == {}
    assert search(spark, [(0, [0.0, 0.0])]) == {}


def test_cells_come_by_falling_sum():
    draw = np.random.default_rng(0)
    a, b = draw.normal(size=9), draw.normal(size=7)
    sizes = np.ones(63, np.int64)
    sums = [a[c // 7] + b[c % 7] for c in ann.traverse(a, b, sizes, 63)]
    assert len(sums) == 63 and sums == sorted(sums, reverse=True)


def test_recall_beside_a_third_of_equal_rows(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    copied = vectors[7][1]
    rows = vectors + [(1_000_000 + k, copied) for k in range(len(vectors) // 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [i for i, _ in vectors if i % 5 == 0]
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 5 = 0 and vec_id < 1000000"), 20, entries=100).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    matrix, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    recalls = []
    for q in asked:
        scores = (matrix * matrix[ids == q][0]).sum(axis=1)
        scores[ids == q] = -9
        assert len(got[q]) == 20
        recalls.append(len(set(got[q]) & set(ids[np.lexsort((ids, -scores))[:20]].tolist())) / 20)
    recalls.sort()
    print("recall", np.mean(recalls), "worst tenth", np.mean(recalls[: len(recalls) // 10]))
    assert np.mean(recalls) >= 0.9 and np.mean(recalls[: len(recalls) // 10]) >= 0.7


def test_ids_of_several_vectors_leave_k_others(spark):
    rows = [(1, [1.0, 0.1 * k]) for k in range(30)] + [(2 + k, [0.5, 0.01 * k]) for k in range(25)] + [(2, [0.5, 0.0])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in ann.search(frame, spark.createDataFrame([(99, [1.0, 1.0])], frame.schema), 20).orderBy("rank").collect()]
    assert got == [1, *range(26, 7, -1)]
