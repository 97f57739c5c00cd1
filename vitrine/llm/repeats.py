"""Word runs that occur more than once, found by way of minimisers.

Every window of ``window`` words has a minimiser: the least hash of a run of
``gram`` words inside it. Equal windows have equal minimisers at the same place,
so only windows whose minimiser recurs can recur. Consecutive windows with one
minimiser position make a segment. Stored tables keep each step short:

1. minimisers of each document, counted over the corpus;
2. the recurring ones, sent back to the documents that hold them;
3. segments of these, dealt by minimiser and compared by the caller's method;
4. windows found to repeat, as ranges of word places.

A minimiser with more than HOT segments isn't gathered: its windows are told
apart by 128 bits of hash, with partial aggregation. Places of a window found more
than HOT times meet its earliest by broadcast, the others by a plain join. Of equal
texts, by 128 bits of hash, only the first is compared; the others repeat whole.
Documents with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store
from vitrine.llm.words import Words, minimisers, pieces, runs, signed

HOT = 20_000
#: Windows, 32 bytes each, that are broadcast at most; if there are more, adaptive execution splits the join.
MOST_FREQUENT = 1_000_000
RANGE = "id long, copy long, start int, n int"
SEGMENT = f"hot boolean, key long, extra long, before binary, after binary, {RANGE}"


class Segments:
    """The segments of some documents: minimiser, document, first word, windows, place of the minimiser."""

    def __init__(self, words: Words, hashes: np.ndarray, window: int, gram: int):
        room = words.room()
        grams = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
        found = runs(hashes, gram)
        grams[: len(found)] = found
        valid = room >= window
        width = window - gram + 1
        least = minimisers(grams, valid, width)
        starts = np.flatnonzero(valid)
        # the first place at or after the window's start that holds its least gram
        spread = np.where(valid, least, 0)
        reach = spread.copy()
        have = 1
        while have < width:
            step = min(have, width - have)
            reach[step:] = np.maximum(reach[step:], reach[:-step]) if len(reach) > step else reach[step:]
            have += step
        chosen = np.flatnonzero(reach == grams)
        at = np.searchsorted(chosen, starts)
        wrong = np.flatnonzero(grams[chosen[at]] != least[starts]) if len(starts) else starts
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[grams[chosen[at[wrong]]] != least[starts[wrong]]]
        place = chosen[at] if len(starts) else starts
        document = words.document()
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (document[starts[1:]] != document[starts[:-1]])
        begin = np.flatnonzero(new)
        self.key = least[starts[begin]]
        self.start = starts[begin]
        self.count = np.diff(np.concatenate((begin, [len(starts)])))
        self.place = place[begin]
        self.document = document[self.start]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``copy`` and ``other`` are hashes of the text with two seeds."""
    other = F.xxhash64(F.lit("other"), F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"), other.alias("other"))


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the words of each text joined by one space."""
    texts = [b" ".join((t or b"").split()) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.large_binary()), *batch.columns[3:]], batch.schema.names)


def _seeds(window: int, gram: int):
    """Rows of a minimiser and its segments in a document, and one without minimiser: the document's words."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in pieces(batch, 2):
                total = np.diff(words.first)
                long = pa.array(np.flatnonzero(total >= window))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(long), pa.int64()), part.column(0).take(long), part.column(1).take(long), part.column(3).take(long),
                        pa.array(total, pa.int32()).take(long),
                    ],
                    ["seed", "id", "copy", "other", "n"],
                )
                s = Segments(words, words.hashes(), window, gram)
                order = np.lexsort((s.key, s.document))
                key, document = s.key[order], s.document[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (document[1:] != document[:-1])
                begin = np.flatnonzero(new)
                count = np.diff(np.concatenate((begin, [len(key)])))
                rows = pa.array(document[begin])
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(key[begin]), part.column(0).take(rows), part.column(1).take(rows), pa.nulls(len(rows), pa.int64()),
                        pa.array(count, pa.int32()),
                    ],
                    ["seed", "id", "copy", "other", "n"],
                )

    return over


def _segments(window: int, gram: int):
    """Rows of SEGMENT: text before and from the minimiser on; of hot ones a row a window, without text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in pieces(_joined(batch), 2):
                hashes = words.hashes()
                s = Segments(words, hashes, window, gram)
                lists = part.column(3)
                flat = lists.flatten()
                owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(lists.offsets.to_numpy()))
                seeds = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                heat = flat.field(1).to_numpy(zero_copy_only=False)
                salt = np.uint64(0x9E3779B97F4A7C15)
                mine = s.key ^ (s.document.astype(np.uint64) * salt)
                wanted = seeds ^ (owner * salt)
                cold = np.flatnonzero(np.isin(mine, wanted[~heat]))
                ids, copies = part.column(0), part.column(1)
                for at in range(0, len(cold), 20_000):
                    some = cold[at : at + 20_000]
                    before, after = [], []
                    ends = s.start[some] + s.count[some] + window - 1
                    for b, p, e in zip(s.start[some].tolist(), s.place[some].tolist(), ends.tolist(), strict=True):
                        before.append(words.text(b, p) if p > b else b"")
                        after.append(words.text(p, e))
                    rows = pa.array(s.document[some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.zeros(len(some), bool)), signed(s.key[some]), pa.array(np.zeros(len(some), np.int64)),
                            pa.array(before, pa.binary()), pa.array(after, pa.binary()), ids.take(rows), copies.take(rows),
                            pa.array(s.start[some] - words.first[s.document[some]], pa.int32()), pa.array(s.count[some], pa.int32()),
                        ],
                        ["hot", "key", "extra", "before", "after", "id", "copy", "start", "n"],
                    )
                hot = np.flatnonzero(np.isin(mine, wanted[heat]))
                if not len(hot):
                    continue
                one, two = (runs(hashes, window, which) for which in (0, 1))
                starts = np.repeat(s.start[hot], s.count[hot])
                starts += np.arange(len(starts)) - np.repeat(np.cumsum(s.count[hot]) - s.count[hot], s.count[hot])
                document = np.repeat(s.document[hot], s.count[hot])
                for at in range(0, len(starts), 50_000):
                    to, rows = starts[at : at + 50_000], pa.array(document[at : at + 50_000])
                    none = pa.nulls(len(to), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.ones(len(to), bool)), signed(one[to]), signed(two[to]), none, none, ids.take(rows), copies.take(rows),
                            pa.array(to - words.first[document[at : at + 50_000]], pa.int32()), pa.array(np.ones(len(to), np.int32)),
                        ],
                        ["hot", "key", "extra", "before", "after", "id", "copy", "start", "n"],
                    )

    return over


Compare = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def repeated(
    docs: DataFrame, window: int, gram: int, across: bool, compare: Compare, store: Store, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, copy, spans)``: word places ``[start, end)`` covered by windows that occur earlier.

    Earlier is a smaller id if ``across``, else a smaller (id, copy, place); ``copy``
    is the xxhash64 of the text. ``compare`` gets the segments of whole minimisers,
    sorted, and returns ranges of windows that repeat. Only documents with such
    windows have a row.
    """
    texts = _keyed(docs, id_col, text_col).where("id is not null and text is not null")
    seeds = store.put(texts.mapInArrow(_seeds(window, gram), "seed long, id long, copy long, other long, n int"), "seeds")
    counted = seeds.where("seed is not null").groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("all"))
    recurring = store.put(
        counted.where("low < high" if across else "all > 1").select("seed", (F.col("all") > HOT).alias("hot")), "recurring"
    )
    long = seeds.where("seed is null").groupBy("id", "copy", "other").agg(F.max("n").alias("words"))
    first = long.groupBy("copy", "other").agg(F.min("id").alias("id"))
    whole = store.put(
        long.join(first.hint("merge"), ["id", "copy", "other"], "left_anti").select("id", "copy", F.array(F.struct(F.lit(0).alias("start"), F.col("words").alias("end"))).alias("spans")),
        "whole",
    )
    held_by = seeds.where("seed is not null").join(recurring.hint("merge"), "seed").groupBy("id", "copy")
    wanted = store.put(
        held_by.agg(F.collect_set(F.struct("seed", "hot")).alias("wanted")).join(first.hint("merge"), ["id", "copy"], "left_semi"), "wanted"
    )
    store.drop("seeds", "recurring")
    held = texts.join(wanted.hint("merge"), ["id", "copy"]).select("id", "copy", "text", "wanted")
    segments = store.put(held.mapInArrow(_segments(window, gram), SEGMENT), "segments")
    store.drop("wanted")
    cold = segments.where("not hot").drop("hot", "extra")
    cold = cold.repartition("key").sortWithinPartitions("key", "after", "before", "id", "copy", "start").mapInArrow(compare, RANGE)
    hot = segments.where("hot").select("key", "extra", "id", "copy", "start")
    own = F.col("id") if across else F.struct("id", "copy", "start")
    earliest = store.put(hot.groupBy("key", "extra").agg(F.min(own).alias("first"), F.count("*").alias("places")).where("places > 1"), "earliest")
    met = _meet(hot, earliest, ["key", "extra"])
    again = met.where(own > F.col("first")).select("id", "copy", "start", F.lit(1).alias("n"))
    ranges = cold.union(again).groupBy("id", "copy").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    spans = store.put(ranges.mapInArrow(_merged(window), "id long, copy long, spans array<struct<start:int,end:int>>"), "spans")
    store.drop("segments", "earliest")
    return spans.union(whole)


def _meet(hot: DataFrame, earliest: DataFrame, keys: list[str]) -> DataFrame:
    """The join by ``keys``; rows of windows with more than HOT places aren't shuffled."""
    frequent = earliest.where(F.col("places") > HOT)
    count = frequent.count()
    if not count or count > MOST_FREQUENT:
        return hot.join(earliest, keys)
    few = F.broadcast(frequent)  # the count is checked
    rare = hot.join(few, keys, "left_anti").join(earliest.where(F.col("places") <= HOT), keys)
    return rare.union(hot.join(few, keys).select(rare.columns))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(window: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                values = batch.column(2)[k].values
                start = values.field(0).to_numpy().astype(np.int64)
                end = start + values.field(1).to_numpy() + window - 1
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > end[:-1]
                last = np.flatnonzero(np.append(new[1:], True))
                out.append([{"start": int(s), "end": int(e)} for s, e in zip(start[new], end[last], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, SPANS)], ["id", "copy", "spans"])

    return over


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, spans)`` of every row; null spans where nothing repeats."""
    return _keyed(docs, id_col, text_col).join(spans.hint("merge"), ["id", "copy"], "left").select("id", "text", "spans")
