import hashlib
import re

import pytest

from tests.llm import cases
from vitrine.llm import phrases, repeats, suffixes


def covered(rows, window, across):
    """Per row a flag a word: covered by a window that occurs earlier."""
    first = {}
    keys = []
    for i, t in rows:
        words = cases.words_of(t)
        for at in range(len(words) - window + 1 if i is not None else 0):
            keys.append((tuple(words[at : at + window]), i))
    for text, i in keys:
        first[text] = min(first.get(text, i), i)
    out = []
    for i, t in rows:
        words = cases.words_of(t)
        flags = bytearray(len(words))
        for at in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[at : at + window])] < i:
                flags[at : at + window] = b"\1" * window
        out.append((i, t, words, flags))
    return out


def covered_by_place(rows, window):
    """The same with earlier places, for rows without repeated ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = cases.words_of(t)
        flags = bytearray(len(words))
        for at in range(len(words) - window + 1 if i is not None else 0):
            text = tuple(words[at : at + window])
            if text in seen:
                flags[at : at + window] = b"\1" * window
            seen.add(text)
        out.append((i, t, words, flags))
    return out


@pytest.fixture(params=["gathered", "hot"])
def heat(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(repeats, "HOT", 2)


@pytest.mark.parametrize("window", [13, 3])
def test_phrases_like_brute_force(spark, heat, window):
    rows = cases.texts()
    docs = cases.clashing(cases.documents(spark, rows))
    got = sorted((tuple(r) for r in phrases.kept_words(docs, window).collect()), key=str)
    want = []
    for i, _, words, flags in covered(rows, window, True):
        left = b" ".join(w for w, f in zip(words, flags) if not f)
        want.append((i, len(words), sum(flags), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0


def distinct(rows):
    return list({i: (i, t) for i, t in rows if i is not None}.values()) + [(None, "x y")]


def test_suffixes_like_brute_force(spark, heat):
    rows = distinct(cases.texts())
    docs = cases.clashing(cases.documents(spark, rows))
    got = {r["doc_id"]: (r["n_removed"], [(s["start"], s["end"]) for s in r["spans"]]) for r in suffixes.report(docs).collect()}
    want = {i: (sum(f), [m.span() for m in re.finditer(b"\1+", bytes(f))]) for i, _, _, f in covered_by_place(rows, 50)}
    assert got == want
    assert want[51][0] >= 70 and want[46][0] == 4_000 and want[60][0] == 299


def test_cut_texts_keep_the_rest(spark):
    rows = distinct(cases.texts())
    docs = cases.clashing(cases.documents(spark, rows))
    cut = suffixes.without_passages(docs)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    for r in cut.collect():
        words, flags = next((w, f) for i, _, w, f in covered_by_place(rows, 50) if i == r["doc_id"])
        assert cases.words_of(r["text"]) == [w for w, f in zip(words, flags) if not f]
        if not any(flags):
            assert r["text"] == dict(rows)[r["doc_id"]]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_repeated_rows_count_once(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = cases.documents(spark, [(1, text), (1, text), (2, text), (None, text), (3, "x " + text)])
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffixes.report(docs).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 80), (3, 80), (None, 0)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in phrases.kept_words(docs).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 80), (3, 80), (None, 0)]


def test_automaton_of_more_words_than_the_basic_plane():
    segments = [(b" ".join(b"%d" % (k + j) for j in range(13)), 1, 0, 0) for k in range(0, 70_000, 13)]
    segments.append((segments[-1][0], 2, 0, 5))
    assert list(phrases.occurrences(segments, 13)) == [(2, 0, 5, 1)]


def test_empty_tables(spark):
    docs = cases.documents(spark, [])
    assert phrases.kept_words(docs).count() == 0
    assert suffixes.report(docs).count() == 0
    assert suffixes.without_passages(docs).count() == 0


def test_control_characters_in_words(spark):
    """They sort before the space, but belong to words."""
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, passage), (2, passage + "\x01 more"), (3, passage + " other words"), (4, "\x02 " + passage + "\x1f"), (5, "x " + passage + " \x00 y")]
    docs = cases.documents(spark, rows)
    want = {i: sum(flags) for i, _, _, flags in covered_by_place(rows, 50)}
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.report(docs).collect()} == want
    rows = [(1, "a b"), (2, "a b\x01"), (3, "a b c")]
    found = suffixes.repeated_passages(cases.documents(spark, rows), window=2).collect()
    assert [(r["id"], [tuple(s) for s in r["spans"]]) for r in found] == [(3, [(0, 2)])]
