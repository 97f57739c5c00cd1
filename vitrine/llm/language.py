"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, a step a factor. The filter
holds (n-gram, 1) up to (n-gram, level); a reader probes level after level until
one is missing. It scores whole texts:
p(w | v) = (c(v, w) + prior * p(w)) / (c(v) + prior), with p(w) smoothed as well. Each slice
of a filter has bits for what it holds, so false positives are as rare at every size.
No task holds more than a part of the slices. Texts are packed in pieces, and each piece sends the distinct words and
pairs of every part to the task of that part, which counts them, builds the slices and answers with the levels.
The answers meet the texts of their piece again. So the texts are read twice, whatever the size of the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store
from vitrine.llm.words import CHUNK, buffers, mix, split

#: The token that ends a text, and stands before its first word.
END = np.uint64(0x5851F42D4C957F2D)
#: Filter bits an entry (an n-gram at a level) for pairs and for words.
PAIR_BITS, WORD_BITS = 6, 12
#: What a task works on at once, in bytes, and the bytes that it takes to count, build and answer, a token.
MOST_BYTES = 128 << 20
TOKEN_BYTES = 64
#: Levels of counts: a factor each.
PAIR_BASE, WORD_BASE = 2.0, 1.25
PROBES = 3
#: Pairs are cut into at least CELLS * CELLS slices, words into FINE for each of the CELLS; a pair's slice holds about PAIRS at most.
CELLS, FINE = 16, 16
PAIRS = 500_000
PRIOR = 5_000.0
#: Without use since exact counts come with the answers, of frequent words as of rare ones; tests still set it.
FREQUENT = 1_000_000
ADD = 0.1
#: Row groups of the table of pieces are small, as Spark's reader takes many rows at once.
PACKED = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / np.log(base) + 1e-9)).astype(np.int64)


def values_of(base: float) -> np.ndarray:
    """What each level stands for: the mean on a log scale of the counts that it holds; 0 at level 0."""
    top = int(np.log(2.0**62) / np.log(base)) + 2
    low = np.ceil(base ** np.arange(top) - 1e-9)
    high = np.maximum(low, np.ceil(base ** np.arange(1, top + 1) - 1e-9) - 1)
    return np.concatenate(([0.0], np.sqrt(low * high)))


def _places(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places of (key, level) within the key's slice."""
    item = mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    step = (item >> np.uint64(32)) | np.uint64(1)
    for probe in range(PROBES):
        yield ((item + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * np.asarray(size, np.uint64) >> np.uint64(32)


def slice_bits(keys: np.ndarray, counts: np.ndarray, base: float, room: int) -> np.ndarray:
    """The bitmap of one slice that holds all levels of the keys, ``room`` bits for each."""
    level = levels_of(counts, base)
    size = int(level.sum()) * room // 64 * 64 + 64
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for place in _places(keys[level >= q], q, size):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """Slices of bits one after another: where each begins, and its bytes, 0 if it isn't held."""

    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray
    base: float

    @classmethod
    def of(cls, slices: dict[int, bytes], count: int, base: float) -> Filter:
        size = np.zeros(count, np.int64)
        for at, own in slices.items():
            size[at] = len(own)
        bits = np.frombuffer(b"".join(slices[at] for at in sorted(slices)), np.uint8)
        return cls(bits, np.cumsum(size) - size, size, base)

    def levels(self, keys: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """The level of each key of a slice: probed from 1 on until one is missing."""
        out = np.zeros(len(keys), np.int64)
        open_ = np.flatnonzero(self.size[slices] > 0)
        level = 1
        while len(open_):
            own, at = keys[open_], slices[open_]
            first, there = self.first[at], np.ones(len(own), bool)
            for place in _places(own, level, self.size[at] * 8):
                place = place.astype(np.int64)
                there &= (self.bits[first + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            open_ = open_[there]
            out[open_] = level
            level += 1
        return out


@dataclass
class Tokens:
    """Tokens of a part of a batch, an end after each text: hashes, keys of the pairs, document of each."""

    word: np.ndarray
    before: np.ndarray
    document: np.ndarray

    @classmethod
    def of(cls, words) -> Tokens:
        total = np.diff(words.first) + 1
        ends = np.cumsum(total) - 1
        word = np.empty(int(total.sum()), np.uint64)
        word[ends] = END
        inside = np.ones(len(word), bool)
        inside[ends] = False
        word[inside] = words.hashes()
        before = np.concatenate(([END], word[:-1])) if len(word) else word
        return cls(word, before, np.repeat(np.arange(len(total)), total))

    def pairs(self) -> np.ndarray:
        return mix(self.before * np.uint64(0xD6E8FEB86659FD93) + self.word)


def cell_of(words: np.ndarray, cells: int) -> np.ndarray:
    """Which of ``cells`` parts a word lies in, by its highest 16 bits."""
    return ((words >> np.uint64(48)) * np.uint64(cells) >> np.uint64(16)).astype(np.int64)


def blocks(words: np.ndarray, pairs: np.ndarray, most: int) -> int:
    """The least number of groups such that no two groups of words and their pairs take over ``most`` bytes.

    ``words`` has the bytes of each cell, ``pairs`` those of each two; cells next to each other share a group.
    """
    cells = len(words)
    for groups in range(1, cells + 1):
        begin = np.searchsorted(np.arange(cells) * groups // cells, np.arange(groups))
        own = np.add.reduceat(words, begin)
        both = np.add.reduceat(np.add.reduceat(pairs, begin, 0), begin, 1) + own[:, None] + own[None, :] - np.diag(own)
        if both.max() <= most:
            break
    return groups


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, mod 10; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for about CHUNK bytes of text: its first row's number, ids, whether each text is learnt from, texts, and a guess of the tokens."""
    for batch in batches:
        _, offsets = buffers(batch.column(3))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            part = batch.slice(at, to - at)
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in (1, 2, 3)]
            guess = (np.diff(offsets[at : to + 1]) / 6 + 1).sum()
            yield pa.RecordBatch.from_arrays([part.column(0)[:1], *lists, pa.array([guess])], ["piece", "ids", "learnt", "texts", "guess"])
            at = to


def _tokens(texts: pa.Array) -> Tokens:
    return Tokens.of(split(*buffers(texts), lower=True))


def _distinct(keys: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys ordered by slice and key, the slice of each, and which of them each key is."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    start = np.flatnonzero(new)
    own = np.minimum.reduceat(slices[order], start)
    by_slice = np.argsort(own, kind="stable")
    place = np.empty(len(start), np.int64)
    place[by_slice] = np.arange(len(start))
    which = np.empty(len(keys), np.int64)
    which[order] = place[np.cumsum(new) - 1]
    return keys[order[start]][by_slice], own[by_slice], which


def _asked(tokens: Tokens, cells: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What a piece asks for, words and pairs (see ``_distinct``)."""
    pair = cell_of(tokens.before, cells) * cells + cell_of(tokens.word, cells)
    return [_distinct(tokens.word, cell_of(tokens.word, cells * FINE)), _distinct(tokens.pairs(), pair)]


def _blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values: those of ``values`` between consecutive offsets."""
    values = np.ascontiguousarray(values)
    offsets = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs of a column, one after another, and how many each has."""
    data, offsets = buffers(column)
    return data[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _asking(cells: int, parts: int):
    """A row a piece and part: distinct keys by slice, how often each is learnt, keys a slice. Words have even parts, pairs odd ones."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [cells * FINE, cells * cells]
        first = [np.searchsorted(np.arange(n) * parts // n, np.arange(parts + 1)) for n in counts]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                learnt = row.column(1).flatten().to_numpy(zero_copy_only=False)
                tokens = _tokens(row.column(2).flatten())
                weight = learnt[tokens.document]
                for kind, (key, own, which) in enumerate(_asked(tokens, cells)):
                    n = np.bincount(which, weight, len(key)).astype(np.uint32)
                    sizes = np.bincount(own, minlength=counts[kind]).astype(np.int32)
                    offsets = np.concatenate(([0], np.cumsum(sizes)))[first[kind]]
                    asked = pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(parts, dtype=np.int32) * 2 + kind), pa.array(np.repeat(row.column(0).to_numpy(), parts)),
                            _blobs(key, offsets), _blobs(n, offsets), _blobs(sizes, first[kind]),
                        ],
                        ["part", "piece", "keys", "n", "sizes"],
                    )
                    yield asked.filter(pa.array(np.diff(offsets) > 0))

    return over


def _answer(kind: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of all keys of a part, by the row that asks, and of words the exact counts; then a row of the part's totals."""
    base, room = ((WORD_BASE, WORD_BITS), (PAIR_BASE, PAIR_BITS))[kind]
    key, n, size = (np.concatenate([_values(b.column(k), t)[0] for b in held]) for k, t in ((2, np.uint64), (3, np.uint32), (4, np.int32)))
    asked = np.concatenate([_values(b.column(2), np.uint64)[1] for b in held])
    own = np.repeat(np.tile(np.arange(len(size) // len(asked)), len(asked)), size)
    level, count = np.zeros(len(key), np.uint8), np.zeros(len(key) * (not kind), np.int64)
    tokens, types, mass = 0, 0, 0.0
    for at in range(len(size) // len(asked)):
        here = np.flatnonzero(own == at)
        if not len(here):
            continue
        here = here[np.argsort(key[here])]
        new = np.ones(len(here), bool)
        new[1:] = key[here[1:]] != key[here[:-1]]
        start = np.flatnonzero(new)
        distinct, total, which = key[here[start]], np.add.reduceat(n[here], start, dtype=np.int64), np.cumsum(new) - 1
        learnt = total > 0
        slices = {0: slice_bits(distinct[learnt], total[learnt], base, room).tobytes()} if learnt.any() else {}
        level[here] = Filter.of(slices, 1, base).levels(distinct, np.zeros(len(distinct), np.int64))[which]
        if not kind:
            count[here] = total[which]
            tokens, types = tokens + int(total.sum()), types + int(learnt.sum())
            mass += float(values_of(base)[levels_of(total[learnt], base)].sum())
    offsets = np.concatenate(([0], np.cumsum(asked)))
    part, piece = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
    none = pa.nulls(len(part), pa.int64())
    names = ["part", "piece", "levels", "counts", "tokens", "types", "mass"]
    counts = pa.nulls(len(part), pa.binary()) if kind else _blobs(count, offsets)
    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(piece), _blobs(level, offsets), counts, none, none, none.cast(pa.float64())], names)
    if not kind:
        blank = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[:1]), pa.nulls(1, pa.int64()), blank, blank, pa.array([tokens]), pa.array([types]), pa.array([mass])], names
        )


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by part: the answers of one part after another."""
    last, held = -1, []
    for batch in batches:
        part = batch.column(0).to_numpy()
        for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            if not len(rows):
                continue
            if part[rows[0]] != last and held:
                yield from _answer(last % 2, held)
                held = []
            last = int(part[rows[0]])
            held.append(batch.slice(rows[0], len(rows)))
    if held:
        yield from _answer(last % 2, held)


def _scored(texts: pa.RecordBatch, answers: list[pa.RecordBatch], cells: int, prior: float, n_all: int, distinct: int, mass: float) -> pa.RecordBatch:
    """The rows of a piece, by its texts and the answers in the order of the parts."""
    tokens = _tokens(texts.column(3).flatten())
    levels: tuple[list, list] = ([np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)])
    counts = [np.zeros(0, np.int64)]
    for batch in answers:
        odd = batch.column(1).to_numpy() % 2 == 1
        for kind in (0, 1):
            own = batch.filter(pa.array(odd == kind))
            levels[kind].append(_values(own.column(4), np.uint8)[0])
            if not kind:
                counts.append(_values(own.column(5), np.int64)[0])
    (_, _, word_of), (_, _, pair_of) = asked = _asked(tokens, cells)
    word_level, pair_level, count = np.concatenate(levels[0]), np.concatenate(levels[1]), np.concatenate(counts)
    if [len(word_level), len(pair_level), len(count)] != [len(asked[0][0]), len(asked[1][0]), len(asked[0][0])]:
        raise ValueError("the answers of a piece aren't those to what it asked")
    rows = len(texts.column(2).flatten())
    estimate = values_of(WORD_BASE)[word_level][word_of]
    pair = values_of(PAIR_BASE)[pair_level][pair_of]
    end = estimate[-1:]  # the last token ends a text
    context = np.maximum(np.concatenate((end, estimate[:-1])), pair)
    plain = (estimate + ADD) / (mass + ADD * (distinct + 1))
    log = np.log10((pair + prior * plain) / (context + prior))
    base = np.log10((count + ADD) / (n_all + ADD * (distinct + 1)))
    return pa.RecordBatch.from_arrays(
        [
            texts.column(2).flatten(), pa.array(np.bincount(tokens.document, minlength=rows)),
            pa.array(np.bincount(tokens.document, (count > 0)[word_of], rows).astype(np.int64)),
            pa.array(np.bincount(tokens.document, base[word_of], rows)), pa.array(np.bincount(tokens.document, log, rows)),
        ],
        ["doc_id", "n_tokens", "n_known", "base_score", "score"],
    )


def _scoring(cells: int, prior: float, n_all: int, distinct: int, mass: float):
    """Over rows sorted by piece and part, the texts of a piece before its answers."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, answers = None, []
        for batch in batches:
            piece = batch.column(0).to_numpy()
            begins = np.flatnonzero(batch.column(1).to_numpy() < 0)
            for rows in np.split(np.arange(len(piece)), begins):
                if not len(rows):
                    continue
                own = batch.slice(rows[0], len(rows))
                if len(begins) and rows[0] >= begins[0]:
                    if texts is not None:
                        yield _scored(texts, answers, cells, prior, n_all, distinct, mass)
                    texts, answers, own = own.slice(0, 1), [], own.slice(1)
                if own.num_rows:
                    answers.append(own)
        if texts is not None:
            yield _scored(texts, answers, cells, prior, n_all, distinct, mass)

    return over


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, most_bytes: int = MOST_BYTES, store: Store | None = None
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Learns from rows whose crc32(id as text) mod 10 isn't 0 (a null id counts as the empty text,
    which is held out). Whole texts, A-Z in lower case; null is read as empty, so each text has at least
    its end. ``base_score`` rests on exact counts. Repeated rows are learnt from and scored each on their own.
    ``most_bytes`` bounds what a task works on at once, by estimate.
    """
    spark = docs.sparkSession
    store = store or Store(spark, "language")
    texts = docs.select(
        F.monotonically_increasing_id().alias("piece"), F.col(id_col).cast("long").alias("doc_id"),
        (remainder(id_col) != 0).alias("learnt"), F.col(text_col).cast("binary").alias("text"),
    )
    packed = store.put(
        texts.mapInArrow(_packing, "piece long, ids array<long>, learnt array<boolean>, texts array<binary>, guess double"), "pieces", **PACKED
    )
    guess = packed.agg(F.sum("guess")).first()[0] or 1.0
    cells = CELLS * max(1, math.ceil(math.sqrt(guess / (PAIRS * CELLS * CELLS))))
    # As many parts as there are blocks of evenly filled slices.
    parts = blocks(np.zeros(cells), np.full((cells, cells), guess * TOKEN_BYTES / cells**2), most_bytes) ** 2
    asked = packed.select("piece", "learnt", "texts").mapInArrow(
        _asking(cells, parts), "part int, piece long, keys binary, n binary, sizes binary"
    )
    answered = store.put(
        asked.repartition("part").sortWithinPartitions("part").mapInArrow(
            _answering, "part int, piece long, levels binary, counts binary, tokens long, types long, mass double"
        ),
        "answers",
    )
    n_all, distinct, mass = answered.where("piece is null").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0.0))
    ).first()
    nothing = F.lit(None)
    meet = packed.select("piece", F.lit(-1).alias("part"), "ids", "texts", nothing.cast("binary").alias("levels"), nothing.cast("binary").alias("counts"))
    meet = meet.union(
        answered.where("piece is not null")
        .select("piece", "part", nothing.cast("array<long>").alias("ids"), nothing.cast("array<binary>").alias("texts"), "levels", "counts")
    )
    scored = meet.repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(
        _scoring(cells, prior, n_all, distinct, mass), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score",
    )
