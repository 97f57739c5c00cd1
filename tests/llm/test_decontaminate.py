from tests.llm import cases
from vitrine.llm import decontaminate as d


def brute(rows, items, bound=d.SIMILARITY):
    out = {}
    for at, (i, t) in enumerate(rows):
        words = [w.lower() for w in cases.words_of(t)]
        for item, text in items:
            own = [w.lower() for w in cases.words_of(text)]
            if not own:
                continue
            target = d.shingles(own, d.SHINGLE)
            best = max(
                ((d.similarity(d.shingles(words[s : s + len(own)], d.SHINGLE), target), -s) for s in range(len(words) - len(own) + 1)), default=(0, 0)
            )
            if best[0] >= bound:
                out[at, i, item] = (best[0], -best[1], len(own))
    return out


def check(spark, rows, items):
    docs = cases.clashing(cases.documents(spark, rows))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as similarity")
    got = sorted((tuple(r) for r in d.matches(docs, bench).collect()), key=str)
    want = brute(rows, items)
    assert got == sorted(((i, item, *v) for (_, i, item), v in want.items()), key=str)
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns
    held = {at for at, _, _ in want}
    assert sorted((str((r["doc_id"], r["text"])) for r in kept.collect())) == sorted(str(r) for at, r in enumerate(rows) if at not in held)
    return want


def items():
    rows = cases.texts()
    long = " ".join(f"q{k}" for k in range(50))
    return rows, [(0, rows[3][1]), (1, None), (2, ""), (3, "Ax AY"), (4, " ".join(rows[50][1].split()[10:60])), (5, long), (6, long)], long


def test_like_brute_force(spark):
    rows, bench, long = items()
    words = long.split()
    rows = rows + [(100, "x " + long.upper() + " y"), (101, " ".join([*words[:48], "a", "b"])), (102, " ".join([*words[:15], "z", *words[16:35], "z", *words[36:]])), (103, "ax ay")]
    want = check(spark, rows, bench)
    found = {(i, item) for _, i, item in want}
    assert {(100, 5), (100, 6), (101, 5), (103, 3)} <= found and (102, 5) not in found


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 200)
    rows, bench, _ = items()
    check(spark, rows, bench)


def test_planted_items_of_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:15]
    check(spark, rows[:120], bench)


def test_empty_tables(spark):
    rows, bench, _ = items()
    assert check(spark, [], bench) == {}
    assert check(spark, rows, []) == {}


def test_items_within_the_radius_are_found():
    index = d.Index(6, 0.8, 5)
    index.add(1, " ".join(f"w{k}" for k in range(20)))
    own = index.seal().prints[0]
    for flips in range(9):
        print_ = own ^ sum(1 << (7 * k) for k in range(flips))
        assert bool(index.near(print_, 20)) == (flips <= 6)


def brute_of_any_length(rows, items, bound=d.SIMILARITY):
    """Windows as long as the item first, then of all lengths."""
    out = brute(rows, items, bound)
    for at, (i, t) in enumerate(rows):
        words = [w.lower() for w in cases.words_of(t)]
        for item, text in items:
            target = d.shingles([w.lower() for w in cases.words_of(text)], d.SHINGLE)
            if not target or (at, i, item) in out:
                continue
            spans = [(s, n) for n in range(1, min(90, len(words)) + 1) for s in range(len(words) - n + 1)]
            best = max(((d.similarity(d.shingles(words[s : s + n], d.SHINGLE), target), -s, -n) for s, n in spans), default=(0, 0, 0))
            if best[0] >= bound:
                out[at, i, item] = (best[0], -best[1], -best[2])
    return out


def test_windows_of_other_lengths(spark):
    thirty, long = [f"p{k}" for k in range(30)], [f"q{k}" for k in range(46)]
    again = ["u", "v", "w", "x", "y", "z"] * 4
    bench = [(1, " ".join(thirty)), (2, " ".join(long)), (3, " ".join(again)), (4, "one two three four"), (5, "a b c d e")]
    noise = [f"n{k}" for k in range(40)]
    rows = [
        (1, " ".join(thirty[:-1])), (2, " ".join(thirty[1:])), (3, " ".join(thirty[2:-2])), (4, " ".join(thirty[:20])),
        (5, " ".join(noise[:20] + long[:23] + long[24:] + noise[20:])), (6, " ".join(long[:20] + ["new"] + long[20:])),
        (7, " ".join(again[:-2])), (8, " ".join(again + again[:3])), (9, "one two three"), (10, "a b c d"),
        (11, " ".join(noise + thirty[3:] + noise)), (12, " ".join(long[4:] + thirty[:26])), (13, None), (None, " ".join(thirty[:28])),
    ]
    docs, items_ = cases.clashing(cases.documents(spark, rows)), spark.createDataFrame(bench, "item_id long, text string")
    want = brute_of_any_length(rows, bench)
    got = sorted((tuple(r) for r in d.matches(docs, items_, any_length=True).collect()), key=str)
    assert got == sorted(((i, item, *v) for (_, i, item), v in want.items()), key=str)
    assert {(1, 1), (2, 1), (5, 2), (11, 1), (12, 1), (12, 2), (None, 1)} <= {(i, item) for _, i, item in want}
    held = {at for at, _, _ in want}
    assert {(r["doc_id"], r["text"]) for r in d.clean(docs, items_, any_length=True).collect()} == {r for at, r in enumerate(rows) if at not in held}
