"""SimHash near-duplicates: bit-sliced comparison of fingerprints.

Fingerprints within the radius agree on two of radius + 2 blocks of bits, so
each goes to one bucket for every two blocks. Within a bucket the fingerprints
are held as 64 bit planes, 64 lanes a word. One step compares each lane with the
lane k places on, for many k at once: differing bits go into carry-save
counters plane by plane, and a block of lanes is abandoned once all counters
have passed the radius. A task passes on a spanning forest of the links it
finds, never the pairs; alternating stars join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.components import star_roots
from vitrine.llm.store import Store
from vitrine.llm.words import buffers

SEED = 42
BITS = 64
#: Fingerprints of a bucket that one task compares with each other.
CELL = 20_000
#: Fingerprints gathered before their buckets are compared.
GATHER = 40_000
#: Lane words compared at once.
LANES = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text: a bit is 1 if set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    ends = (ends - 1)[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(whole[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)], "<u8"
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, print)`` of whole texts; null is read as the empty text, whose fingerprint is 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            prints = [fingerprint(data[s:e].tobytes(), shingle) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "print"]
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(of, "doc_id long, print long")


# --- Bit-sliced comparison ---------------------------------------------------


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p of every fingerprint, 64 fingerprints a word, zeros at the end."""
    lanes = np.zeros((len(prints) + 63) // 64 * 64, np.uint64)
    lanes[: len(prints)] = prints
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(own: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose distance is at most the radius, as bits.

    ``own`` and ``other`` are planes of the same lanes (first axis: the bit). The
    counters start so that they overflow just beyond the radius; two planes a
    step enter through a full adder, and the lanes are abandoned as soon as all
    have overflowed.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    shape = np.broadcast_shapes(own.shape[1:], other.shape[1:])
    counters = [np.full(shape, ~np.uint64(0) if start >> i & 1 else np.uint64(0)) for i in range(width)]
    over = np.zeros(shape, np.uint64)
    for p in range(0, len(own), 2):
        x, y = own[p] ^ other[p], own[p + 1] ^ other[p + 1]
        low = counters[0] ^ x
        carry = (counters[0] & x) | (low & y)
        counters[0] = low ^ y
        for i in range(1, width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if p % 8 == 6 and (over == ~np.uint64(0)).all():
            break
    return ~over


class Forest:
    """Union-find over positions, with labels kept flat for whole arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                return
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (flat := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = flat


def compare(prints: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the position of its root among those linked.

    ``prints`` lie bucket by bucket, ``sizes`` are the buckets'. Buckets are put in
    order of size, so that those with pairs k places apart come first.
    """
    n, forest = len(prints), Forest(len(prints))
    by_size = np.argsort(-sizes, kind="stable")
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    lengths = sizes[by_size]
    place = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.repeat(begin[by_size] - place, lengths) + np.arange(n)
    own = planes(prints[order])
    reach = np.cumsum(lengths)
    for shift in range(min(64, int(lengths[0])) if n else 0):
        s = np.uint64(shift)
        moved = own >> s if shift else own
        if shift:
            moved = moved.copy()
            moved[:, :-1] |= own[:, 1:] << np.uint64(64 - shift)
        step = 0 if shift else 1
        while True:
            k = 64 * step + shift
            rows = int(np.searchsorted(-lengths, -k, "left"))  # buckets larger than k
            if not rows:
                break
            span = (int(reach[rows - 1]) - k + 63) // 64
            steps = max(1, min(LANES // span, (int(lengths[0]) - shift + 63) // 64 - step))
            view = np.lib.stride_tricks.sliding_window_view(
                np.pad(moved, ((0, 0), (0, max(0, step + steps + span - moved.shape[1])))), span, axis=1
            )[:, step : step + steps]
            hits = within(own[:, None, :span], view, radius)
            lane_bits = np.unpackbits(np.ascontiguousarray(hits).view(np.uint8).reshape(steps, -1), axis=1, bitorder="little")
            at_step, i = np.nonzero(lane_bits)
            j = i + 64 * (at_step + step) + shift
            real = j < n
            i, j = order[i[real]], order[j[real]]
            if len(i):
                forest.link(i, j)
            step += steps
    return forest.label


def _forests(radius: int):
    """Over rows sorted by bucket: links of each fingerprint to its root."""

    def linked(buckets: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], (buckets[1:] != buckets[:-1]).any(axis=1))))
        sizes = np.diff(np.concatenate((begin, [len(prints)])))
        several = np.repeat(sizes > 1, sizes)
        prints = prints[several]
        root = compare(prints, sizes[sizes > 1], radius)
        moved = prints[root] != prints
        return pa.RecordBatch.from_arrays(
            [pa.array(x.view(np.int64)) for x in (prints[moved], prints[root[moved]])], ["a", "b"]
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for batch in batches:
            kept.append(np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64))
            count += batch.num_rows
            if count >= GATHER:
                rows = np.concatenate(kept)
                changes = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))
                cut = int(changes[-1]) + 1 if len(changes) else 0
                if cut:
                    yield linked(rows[:cut, 1:], np.ascontiguousarray(rows[:cut, 0]).view(np.uint64))
                kept, count = [rows[cut:]], len(rows) - cut
        if count:
            rows = np.concatenate(kept)
            yield linked(rows[:, 1:], np.ascontiguousarray(rows[:, 0]).view(np.uint64))

    return over


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` that join all of the distinct ``print`` values within the radius.

    A bucket above CELL fingerprints is dealt into chunks, and each two chunks
    meet in a task of their own, so that no task holds more than two.
    """
    blocks = radius + 2
    if not 0 <= radius <= BITS - 2:
        raise ValueError("radius: 0 to 62")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    mask = [((1 << e) - 1) ^ ((1 << s) - 1) for s, e in zip(edges, edges[1:], strict=False)]
    masks = [m - (1 << 64) if m >> 63 else m for m in (mask[i] | mask[j] for i, j in combinations(range(blocks), 2))]
    buckets = F.array(*[F.col("print").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    rows = prints.select("print", F.posexplode(buckets).alias("choice", "key"))
    large = (
        rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
        .withColumn("chunks", F.ceil(F.col("n") / CELL).cast("int")).drop("n")
    )
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = rows.join(large, ["choice", "key"], "left").select(
        "print", "choice", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("print"), chunks).cast("int").alias("own")
    )
    cells = dealt.select(
        "print", "choice", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    ).select("print", "choice", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    cell = ["choice", "key", "low", "high"]
    return cells.repartition(*cell).sortWithinPartitions(*cell, "print").mapInArrow(_forests(radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", store: Store | None = None
) -> DataFrame:
    """``(doc_id, print, component_id)``, one row for every row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the least id that links lead to, the row's own included.
    Null and empty texts have fingerprint 0 and are linked like any other. Rows
    with a null id take part and get the least id of their component, null if
    there is none. Repeated rows stay. Other columns aren't read.
    """
    store = store or Store(docs.sparkSession, "simhash")
    rows = store.put(fingerprints(docs, shingle, id_col, text_col), "rows")
    prints = store.put(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "prints")
    roots = star_roots(links(prints.select("print"), radius), store)
    rooted = prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "low", F.coalesce("root", "print").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    component = rooted.join(lowest, "root").select("print", "component_id")
    return rows.join(component, "print").select("doc_id", "print", "component_id")


def first_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, store: Store | None = None) -> DataFrame:
    """The documents but those whose component holds a smaller ``doc_id``; of rows equal in id and text one stays.

    Rows with a null id stay, as nothing tells them apart.
    """
    store = store or Store(docs.sparkSession, "simhash")
    found = near_duplicates(docs, shingle, radius, store=store)
    keep = store.put(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "keep")
    kept = docs.join(keep.where("rows = 1").hint("merge"), "doc_id", "left_semi")
    repeated = keep.where("rows > 1")
    if not repeated.isEmpty():  # rare: only these are compared by text
        again = docs.join(repeated, "doc_id", "left_semi").withColumn("vitrine copy", F.xxhash64("text"))
        kept = kept.unionByName(again.dropDuplicates(["doc_id", "vitrine copy"]).drop("vitrine copy"))
    return kept.unionByName(docs.where("doc_id is null"))
