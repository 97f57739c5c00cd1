import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from vitrine.llm import language


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def check(spark, rows, **options):
    got = language.score(cases.clashing(cases.documents(spark, rows)), **options).collect()
    counts = Counter(w for i, t in rows if not is_held_out(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t))
        want.append((i, is_held_out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(base, 6)))
    key = lambda r: tuple(map(str, r))
    rounded = [(*list(r)[:5], round(r["base_score"], 6)) for r in got]
    assert sorted(rounded, key=key) == sorted(want, key=key)
    return got


def test_exact_base_and_counts(spark):
    got = check(spark, cases.texts())
    assert all(r["score"] < 0 for r in got)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(language, "FREQUENT", 10)
    check(spark, cases.texts())


def test_blocks_of_pairs_add_up(spark, monkeypatch):
    whole = {r["doc_id"]: r["score"] for r in check(spark, cases.texts()) if r["doc_id"] is not None}
    monkeypatch.setattr(language, "blocks", lambda words, pairs, most: 3)
    parts = {r["doc_id"]: r["score"] for r in check(spark, cases.texts()) if r["doc_id"] is not None}
    assert all(abs(parts[i] - whole[i]) < 1e-6 for i in whole)


def test_blocks_keep_the_bound():
    draw = np.random.default_rng(2)
    words, pairs = draw.integers(0, 90, 16), draw.integers(0, 90, (16, 16))
    for most in (1 << 20, 6_000, 1_500, 400):
        groups = language.blocks(words, pairs, most)
        group = np.arange(16) * groups // 16
        for a in range(groups):
            for b in range(groups):
                assert words[(group == a) | (group == b)].sum() + pairs[np.ix_(group == a, group == b)].sum() <= most
    assert language.blocks(words, pairs, 1 << 20) == 1 and language.blocks(words, pairs, 1) == 16


def test_a_low_bound_takes_no_more_scans(spark, monkeypatch):
    whole = {r["doc_id"]: r["score"] for r in check(spark, cases.texts()) if r["doc_id"] is not None}
    put, written = language.Store.put, []
    monkeypatch.setattr(language.Store, "put", lambda self, df, name, **options: (written.append(name), put(self, df, name, **options))[1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("a filter is sent from the driver"))
    parts = {r["doc_id"]: r["score"] for r in check(spark, cases.texts(), most_bytes=1_000) if r["doc_id"] is not None}
    assert len(written) == 2
    assert all(abs(parts[i] - whole[i]) < 1e-6 for i in whole)


def test_answers_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, cases.texts(), most_bytes=10_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_text_longer_than_a_piece(spark):
    draw = np.random.default_rng(4)
    long = " ".join(f"w{n}" for n in draw.geometric(0.001, 300_000))
    assert len(long) > 1 << 20
    rows = [(1, long), (2, "w1 w2 W1"), (None, long[:900]), (3, long[5_000:9_000])]
    check(spark, rows, most_bytes=4 << 20)


def quantised_score(rows, prior=language.PRIOR):
    """The score with the levels held in dicts instead of filters."""
    words, pairs = Counter(), Counter()
    for i, t in rows:
        if not is_held_out(i):
            own = tokens(t)
            words.update(own)
            pairs.update(zip([None, *own[:-1]], own, strict=True))
    value = lambda n, base: language.values_of(base)[language.levels_of(np.array([n]), base)[0]] if n else 0.0
    mass, distinct = sum(value(n, language.WORD_BASE) for n in words.values()), len(words)
    out = {}
    for i, t in rows:
        total, before = 0.0, None
        for w in tokens(t):
            pair = value(pairs[before, w], language.PAIR_BASE)
            context = max(value(words[before], language.WORD_BASE), pair)
            plain = (value(words[w], language.WORD_BASE) + language.ADD) / (mass + language.ADD * (distinct + 1))
            total += math.log10((pair + prior * plain) / (context + prior))
            before = w
        out[i] = total
    return out


def test_score_is_that_of_exact_levels_but_for_false_positives(spark):
    rows = [(i, t) for i, t in cases.texts() if i is not None]
    rows = [r for k, r in enumerate(rows) if r[0] not in {i for i, _ in rows[:k]}]
    want = quantised_score(rows)
    got = {r["doc_id"]: r["score"] for r in language.score(cases.documents(spark, rows)).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) <= 0.02 * abs(want[i]) for i in want)


def test_empty_table(spark):
    assert language.score(cases.documents(spark, [])).count() == 0
    got = language.score(cases.documents(spark, [(k, None) for k in range(20) if is_held_out(k)])).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def test_held_out_text_is_likelier_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in language.score(docs).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.1


@pytest.mark.parametrize("base", [language.PAIR_BASE, language.WORD_BASE])
def test_filter_holds_at_least_the_levels(base):
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 1 << 63, 4_000, np.uint64)
    counts = draw.geometric(0.2, 4_000)
    at = language.cell_of(keys, 16)
    slices = {s: language.slice_bits(keys[at == s], counts[at == s], base, 12).tobytes() for s in range(15)}  # one isn't held
    found = language.Filter.of(slices, 16, base).levels(keys, at)
    assert (found[at == 15] == 0).all()
    found, counts = found[at < 15], counts[at < 15]
    exact = language.levels_of(counts, base)
    assert (found >= exact).all()
    assert (found == exact).mean() > 0.9
    values = language.values_of(base)
    assert values[0] == 0 and (np.diff(values[1:40]) >= 0).all()
