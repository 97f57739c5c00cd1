import numpy as np

from tests.llm import cases
from vitrine.llm import queries, toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op9_toxicity(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def training(n=400):
    draw = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{x}" for x in draw.integers(0, 300, 30)]
        toxic = k % 5 == 0
        if toxic:
            words[3] = draw.choice(["Vile,", "awful"])
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    return rows, labels


def test_rows_of_all_kinds(spark):
    rows, labels = training()
    docs = cases.documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (0, 1), (None, 1), (3, None), (9_999, 1)], "doc_id long, toxic int"))
    odd = cases.texts() + [(900, "a vile thing"), (901, "w1 w2 w3"), (902, "so AWFUL!")]
    mixed = cases.clashing(cases.documents(spark, odd))
    got = [tuple(r) for r in toxicity.score(mixed, model).collect()]
    assert len(got) == len(odd) and all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in got)
    by_id = {i: p for i, _, p in got}
    assert (by_id[900], by_id[901], by_id[902], by_id[40], by_id[41]) == (1, 0, 1, 0, 0)
    kept = toxicity.clean(mixed, model)
    assert kept.columns == mixed.columns and kept.count() == sum(p == 0 for *_, p in got)


def test_without_positives_the_prior_holds(spark):
    docs = cases.documents(spark, cases.texts())
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    scores = {round(r["score"], 9) for r in toxicity.score(docs, model).collect()}
    assert scores == {0.25}
    empty = cases.documents(spark, [])
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0 and toxicity.clean(empty, model).count() == 0


def test_risk_and_gradient_like_brute_force():
    draw = np.random.default_rng(1)
    for prior, held in ((0.1, False), (0.95, True)):
        theta = draw.normal(size=9)
        positive = [np.sort(draw.choice(8, n, False)) for n in draw.integers(0, 6, 12)]
        unlabelled = [np.sort(draw.choice(8, n, False)) for n in draw.integers(0, 6, 30)]
        if held:
            positive = [np.array([0])] * 12
            theta[0], theta[1:] = 4.0, -1.0

        def plain(theta):
            s = [[1 / (1 + np.exp(-(theta[8] + sum(theta[p] for p in bag)))) for bag in bags] for bags in (positive, unlabelled)]
            clean = np.mean(s[1]) - prior * np.mean(s[0])
            assert (clean < 0) == held
            return prior * np.mean([1 - x for x in s[0]]) + max(0.0, clean)

        value, gradient = toxicity.risk(theta, toxicity._flat(positive), toxicity._flat(unlabelled), prior)
        assert abs(value - plain(theta)) < 1e-12
        steps = [(plain(theta + 1e-6 * e) - plain(theta - 1e-6 * e)) / 2e-6 for e in np.eye(9)]
        assert np.allclose(gradient, steps, atol=1e-8)


def test_tallies_count_each_text_once(spark):
    rows = [(True, "vile vile words"), (True, "Vile"), (False, "words"), (False, None), (False, "")]
    tally = toxicity.tallies(spark.createDataFrame(rows, "positive boolean, text string"))
    assert tally[:, -1].tolist() == [3, 2]
    # the words and their beginnings
    assert sorted(tally[1, :-1][tally[1, :-1] > 0].tolist()) == [1, 1, 2, 2] and sorted(tally[0, :-1][tally[0, :-1] > 0].tolist()) == [1, 1]


def test_layout_and_long_texts_leave_the_scores_alone(spark):
    """A word among thousands of others, in texts of up to a megabyte, counts in training and in scoring."""
    rows, labels = training()
    filler = " ".join(f"v{k}" for k in range(5_000))
    texts = [f"{filler} {word} {filler}" for word in ["remote"] * 20 + ["plain"] * 40]
    texts[0], texts[-1] = (f"{' '.join([filler] * 40)} {word} {filler}" for word in ("remote", "plain"))
    rows += [(10_000 + k, t) for k, t in enumerate(texts)]
    labels += [(10_000 + k, int(k < 20)) for k in range(60)]
    docs = cases.documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = toxicity.train(docs.repartition(7), marks), toxicity.train(docs.coalesce(1), marks)
    assert one.bias == two.bias and (one.weights == two.weights).all()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, one).collect()}
    assert len(texts[0]) > 1 << 20
    assert all((got[10_000 + k] >= 0.3) == (k < 20) for k in range(60)) and got[0] >= 0.3
