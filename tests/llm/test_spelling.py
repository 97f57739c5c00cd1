import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import clashing, documents, texts
from vitrine.llm import spelling


def brute_counts(rows, least=5, times=3, slip=97):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= times}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if brute_near(w, word)]
        best = min(((-counts[w], w) for w in near), default=None)
        form = best[1] if best and -best[0] >= 2 * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    def root(word):
        return word if out[word][0] is None else root(out[word][0])
    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def vocabulary(seed=2, size=500):
    draw = random.Random(seed)
    words = {}
    while len(words) < size:
        word = "".join(draw.choice("abcdé") for _ in range(draw.randrange(5, 8)))
        words[word] = draw.choice([3, 4, 7, 20, 100])
    return words


def forms(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.forms(frame).collect()}


@pytest.mark.parametrize("subtree, names, asking", [(32_768, 200_000, 200_000), (8, 200_000, 7), (3, 0, 50)])
def test_forms_and_roots_are_those_of_brute_force(spark, monkeypatch, subtree, names, asking):
    """Also with subtrees of few words, and leaves that are dealt out to several tasks."""
    monkeypatch.setattr(spelling, "SUBTREE", subtree)
    monkeypatch.setattr(spelling, "NAMES", names)
    counts = vocabulary()
    assert forms(spark, counts) == brute_forms(counts)


def test_one_vector_larger_than_a_subtree(spark, monkeypatch):
    """All words are of the same letters."""
    monkeypatch.setattr(spelling, "SUBTREE", 4)
    draw = random.Random(1)
    words = {"".join(draw.sample("aaabqqr", 7)): draw.randrange(3, 90) for _ in range(80)}
    assert forms(spark, words) == brute_forms(words)


def test_words_of_whole_texts(spark):
    rows = texts() + [(70, "Größe größe GRÖSSE größe"), (71, "x" * 300 + " " + "a" * 70), (72, ("é" * 200 + " ") * 4), (73, "don't stop-it éÉ×÷ abcdefg1abcdefg_abcdefg")]
    rows += [(100 + k, "spelling variants of spelling varients") for k in range(60)]
    got = spelling.word_counts(clashing(documents(spark, rows)).withColumnRenamed("print", "word"), slip=97)
    assert {r["word"]: r["n"] for r in got.collect()} == brute_counts(rows)
    plain = spelling.word_counts(documents(spark, rows), least=2, times=1)
    assert {r["word"]: r["n"] for r in plain.collect()} == brute_counts(rows, 2, 1, 0)


def test_a_long_text(spark):
    text = " ".join(f"{'ab' * (k % 40)}{'cdefgh'[k % 6]}ijk" for k in range(60_000)) + " " + "long" * 300_000
    rows = [(1, text), (2, text)]
    got = spelling.word_counts(documents(spark, rows), times=2, slip=5)
    assert {r["word"]: r["n"] for r in got.collect()} == brute_counts(rows, 5, 2, 5)


def test_long_words_and_empty_tables(spark):
    words = {"a" * 300: 9, "a" * 301: 3, "a" * 150 + "b" + "a" * 149: 3, "a" * 150 + "b" + "a" * 150: 4, "b" * 41 + "cd": 3, "b" * 41 + "ce": 6, "x": 3, "": 5}
    assert forms(spark, words) == brute_forms(words)
    assert spelling.forms(spark.createDataFrame([], "word string, n long")).collect() == []
    assert spelling.word_counts(documents(spark, [])).collect() == []
    assert spelling.word_counts(documents(spark, [(1, None), (2, "")])).collect() == []


def test_verified_pairs():
    draw = random.Random(5)
    words = ["".join(draw.choice("ab") for _ in range(draw.randrange(0, 7))) for _ in range(60)] + ["b" * 50, "b" * 51]
    letters = spelling.Letters(pa.array(words))
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = [brute_near(words[a], words[b]) for a, b in zip(i, j)]
    assert spelling.verified(letters, i, letters, j).tolist() == want
    assert [spelling.one_apart(words[a].encode(), words[b].encode()) for a, b in zip(i, j)] == want
