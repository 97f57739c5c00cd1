import hashlib

import numpy as np
import pytest

from tests.llm.cases import clashing, documents, texts
from vitrine.llm import lines

BLANK = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, points=20, least=3):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= points:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if i is None or len(holders.get(key(x), ())) < least or max(holders[key(x)]) == i]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted((tuple(r) for r in lines.without_repeated(docs, **options).drop("kept").collect()), key=str)


def rows():
    shared = ["A line that many documents share", "Éèê ÄÖÜ größer ñandú ÿÿÿ", "shorter than it must", "exactly twenty chars"]
    out = texts()
    for k in range(30):
        out.append((200 + k, "\n".join([f"own line of document number {k}", shared[k % 4].upper() if k % 3 else f"\t{shared[k % 4]} \r", shared[0], shared[0], "", "x"])))
    out += [(300, "\n\n\n"), (301, shared[1] + "\n" + shared[1] + " "), (229, "another text of 229\n" + shared[0]), (None, shared[0]), (302, " " + shared[0])]
    return out


def test_lines_of_many_documents_stay_in_the_last(spark):
    table = rows()
    assert got(documents(spark, table)) == brute(table)
    assert got(clashing(documents(spark, table)).selectExpr("*", "1 as line", "2 as copy2", "3 as largest", "4 as h1", "5 as shard2")) == brute(table)
    assert got(documents(spark, table), points=1, least=2) == brute(table, 1, 2)


def test_small_shards_and_many_copies_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 2)
    monkeypatch.setattr(lines, "ASKING", 7)
    table = rows()
    assert got(documents(spark, table), points=1, least=2) == brute(table, 1, 2)


def test_one_line_fills_a_third(spark, monkeypatch):
    monkeypatch.setattr(lines, "ASKING", 50)
    table = [(k, "the one line that everybody has\n" * 3 + f"and one of its own, number {k}") for k in range(300)]
    assert got(documents(spark, table)) == brute(table)


def test_a_long_text(spark):
    text = "\n".join(f"line number {k % 9_000} of a very long text" for k in range(60_000))
    table = [(1, text), (2, text + "\n"), (3, text), (4, "x" * 3_000_000)]
    assert got(documents(spark, table)) == brute(table)


def test_found_lines_carry_counts(spark):
    table = [(k, "a line of twenty letters") for k in (5, 5, 7, 9)]
    found = lines.repeated_lines(documents(spark, table))
    assert {(r["doc_id"], r["line"], r["n_docs"], r["largest"]) for r in found.collect()} == {(k, 0, 3, 9) for k in (5, 7, 9)}


@pytest.mark.parametrize("table", [[], [(1, None)], [(None, "a line of twenty letters")] * 4])
def test_nothing_to_drop(spark, table):
    assert got(documents(spark, table)) == brute(table)


def test_the_perfect_hash_is_minimal():
    draw = np.random.default_rng(3)
    h1, h2 = draw.integers(0, 2**63, 20_000, np.uint64), draw.integers(0, 2**63, 20_000, np.uint64)
    h1[:500] = h1[0]  # told apart by the other half
    found = lines.PerfectHash(h1, h2).numbers(h1, h2)
    assert sorted(found.tolist()) == list(range(20_000))
    held = lines.Shard(h1[:9_000], h2[:9_000], np.arange(9_000), np.arange(9_000))
    known, place = held.probe(h1, h2)
    assert known.tolist() == list(range(9_000)) and held.docs[place].tolist() == list(range(9_000))
