"""Benchmark decontamination by SimHash over windows of about an item's size.

A document holds an item if one of its windows is similar to it: weighted Jaccard
similarity of the word shingles, a shingle's weight being how often it occurs.
Windows with as many words as the item has are looked at first; if none reaches the
bound, and any length is asked for, those of all other lengths that can, a whole document
shorter than the item among them. Windows too few of whose shingles occur in any item can't reach the bound and
are passed over. The others get a SimHash fingerprint; items within the radius are
found by multi-index hashing, as two fingerprints that differ in at most r bits agree
on one of r + 1 blocks. What is found is verified on the words themselves.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import ship
from vitrine.llm.words import Words, mix, pieces, runs, split

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of 64; texts at the similarity bound differ in about ten. Of 400 items of 9 words with one cut off (0.80, the
#: hardest) a radius of 18 finds 388, this one all; likewise all of 20 words less 3, 40 less 7 and 80 less 15.
RADIUS = 24
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 4 << 20
#: Windows that are fingerprinted at once, and pairs of windows and items compared at once.
WINDOWS = 4_096
PAIRS = 1 << 18


def shingles(words: list[bytes], length: int) -> Counter:
    """How often each run of ``length`` words occurs; all words as one run if fewer."""
    length = min(length, len(words))
    return Counter(tuple(words[i : i + length]) for i in range(len(words) - length + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Shared weight over joint weight."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def prints_of(hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The SimHash of each run of ``count`` shingle hashes from ``start`` on."""
    bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    more = 2 * (sums[start + count] - sums[start]) > count[:, None]
    return np.packbits(more, axis=1, bitorder="little").view("<u8").ravel()


def prints_at(hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The same for many runs, sorted by start, a stretch of the hashes at a time."""
    prints = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = min(at + WINDOWS, int(np.searchsorted(start, base + WINDOWS)))
        end = int((start[at:to] + count[at:to]).max())
        prints[at:to] = prints_of(hashes[base:end], start[at:to] - base, count[at:to])
        at = to
    return prints


@dataclass
class Index:
    """Items of a benchmark block; for each block of bits the items in order of its value, then of their size."""

    radius: int
    similarity: float
    shingle: int
    any_length: bool = False
    items: list = field(default_factory=list)  # (item_id, words)
    prints: list = field(default_factory=list)
    known: dict = field(default_factory=dict)  # shingle length -> sorted hashes
    held: list = field(default_factory=list)  # sorted shingle hashes of each item
    sizes: np.ndarray | None = None  # words of each item
    blocks: list = field(default_factory=list)  # (shift, mask, sorted keys, items)

    def add(self, item_id, text: str) -> None:
        whole = np.frombuffer(text.encode(), np.uint8)
        words = split(whole, np.array([0, len(whole)]), lower=True)
        n = len(words)
        if not n:
            return
        length = min(self.shingle, n)
        hashes = runs(words.hashes(), length)
        self.prints.append(prints_of(hashes, np.array([0]), np.array([len(hashes)]))[0])
        self.items.append((item_id, words.text(0, n).split()))
        self.known.setdefault(length, []).append(hashes)
        self.held.append(np.unique(hashes))

    def seal(self) -> Index:
        self.known = {k: np.unique(np.concatenate(v)) for k, v in self.known.items()}
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.prints = np.array(self.prints, np.uint64)
        n = self.radius + 1
        edges = [64 * i // n for i in range(n + 1)]
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            shift, mask = np.uint64(low), np.uint64((1 << high - low) - 1)
            keys = self._keys(self.prints, shift, mask, self.sizes)
            order = np.argsort(keys, kind="stable")
            self.blocks.append((shift, mask, keys[order], order))
        return self

    @staticmethod
    def _keys(prints: np.ndarray, shift: np.uint64, mask: np.uint64, sizes: np.ndarray) -> np.ndarray:
        return ((prints >> shift & mask).astype(np.int64) << 32) + np.minimum(sizes, (1 << 32) - 1)

    def near(self, print_: int, size: int) -> list[int]:
        """Items of ``size`` words whose fingerprint is within the radius."""
        return self.pairs_near(np.array([print_], np.uint64), np.array([size]), np.array([size]))[1].tolist()

    def pairs_near(self, prints: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """``(window, item)`` pairs, sorted: items of least to most words whose fingerprint is within the radius of the window's."""
        found = [np.zeros((2, 0), np.int64)]
        for shift, mask, keys, order in self.blocks:
            low = np.searchsorted(keys, self._keys(prints, shift, mask, least), "left")
            count = np.maximum(np.searchsorted(keys, self._keys(prints, shift, mask, most), "right") - low, 0)
            total = np.cumsum(count)
            at = 0
            while at < len(prints):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
                n = count[at:to]
                window = np.repeat(np.arange(at, to), n)
                item = order[np.repeat(low[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
                found.append(np.stack([window[near], item[near]]))
                at = to
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def matches(self, words: Words) -> Iterator[tuple[int, int, float, int, int]]:
        """``(document, item, similarity, start, words)``: the best window of each document and item held.

        That is one as long as the item if any reaches the bound, else, with ``any_length``, one of another.
        """
        if not len(words) or not self.items:
            return
        hashes, room, document = words.hashes(), words.room(), words.document()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for length, known in self.known.items():
            gram = runs(hashes, length)
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            held = known[at] == gram
            hits = np.concatenate(([0], np.cumsum(held)))
            starts, counts = [], []
            for size in np.unique(self.sizes).tolist():
                count = size - length + 1
                if length == min(self.shingle, size) and len(gram) >= count:
                    inside = hits[count:] - hits[:-count]
                    starts.append(np.flatnonzero((inside >= self.similarity * count - 1e-9) & (room[: len(inside)] >= size)))
                    counts.append(np.full(len(starts[-1]), count))
            if starts:
                start, count = np.concatenate(starts), np.concatenate(counts)
                order = np.lexsort((count, start))
                self._same_length(words, gram, start[order], count[order], length, document, best)
            if self.any_length and length == self.shingle:
                places = np.flatnonzero(held & (room[: len(gram)] >= length))
                best.update(self._other_lengths(words, gram, places, document, set(best)))
        for (d, i), (s, start, size) in sorted(best.items()):
            yield d, i, s, int(start - words.first[d]), size

    def _same_length(self, words: Words, gram, start, count, length: int, document, best: dict) -> None:
        """Windows as long as the item; of equally similar ones the first."""
        size = count + length - 1
        last, own = -1, Counter()
        for w, i in self.pairs_near(prints_at(gram, start, count), size, size).T.tolist():
            if w != last:
                last, own = w, shingles(words.text(start[w], start[w] + size[w]).split(), self.shingle)
            s = similarity(own, shingles(self.items[i][1], self.shingle))
            key = int(document[start[w]]), i
            if s >= self.similarity and (key not in best or s > best[key][0]):
                best[key] = s, int(start[w]), int(size[w])

    def _other_lengths(self, words: Words, gram: np.ndarray, hits: np.ndarray, document: np.ndarray, done: set) -> dict:
        """The best windows of any length of the documents and items that aren't ``done``.

        The best window of an item starts and ends with a shingle of the item, as it would gain by
        losing another one. ``hits`` are the places of shingles that occur in any item.
        """
        counts = np.unique(self.sizes[self.sizes >= self.shingle]) - self.shingle + 1
        starts, lengths, within = [], [], []
        for n in range(1, int(counts.max() / self.similarity + 1e-9) + 1):  # hits in the window
            if n > len(hits):
                break
            start, last = hits[: len(hits) - n + 1], hits[n - 1 :]
            m = last - start + 1
            # Sharing n with an item of c: n / (m + c - n) reaches the bound for c from similarity * m up to this.
            most = n * (1 + 1 / self.similarity) - m + 1e-9
            least = np.searchsorted(counts, self.similarity * m - 1e-9)
            open_ = (document[start] == document[last]) & (least < len(counts))
            open_ &= counts[np.minimum(least, len(counts) - 1)] <= most
            starts.append(start[open_])
            lengths.append(m[open_])
            within.append(np.full(int(open_.sum()), n))
        if not starts:
            return {}
        start, m, n = np.concatenate(starts), np.concatenate(lengths), np.concatenate(within)
        order = np.lexsort((m, start))
        start, m, n = start[order], m[order], n[order]
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        # Items with so many shingles can reach the bound, as above; in words.
        least = np.ceil(self.similarity * m - 1e-9).astype(np.int64) + self.shingle - 1
        most = np.floor(n * (1 + 1 / self.similarity) - m + 1e-9).astype(np.int64) + self.shingle - 1
        for w, i in self.pairs_near(prints_at(gram, start, m), least, most).T.tolist():
            key = int(document[start[w]]), i
            if key not in done:
                found[key].append(w)
        out = {}
        for (d, i), own in found.items():
            own = np.array(own)
            low, high = int(start[own].min()), int((start[own] + m[own]).max())
            held = self.held[i]
            at = np.minimum(np.searchsorted(held, gram[low:high]), len(held) - 1)
            sums = np.concatenate(([0], np.cumsum(held[at] == gram[low:high])))
            target = shingles(self.items[i][1], self.shingle)
            total = sum(target.values())
            shared = np.minimum(sums[start[own] - low + m[own]] - sums[start[own] - low], total)
            most = shared / (m[own] + total - shared)  # at most so similar
            for k in np.lexsort((m[own], start[own], -most)).tolist():
                if most[k] < max(self.similarity, out.get((d, i), (0,))[0]) - 1e-9:
                    break
                first, size = int(start[own[k]]), int(m[own[k]]) + self.shingle - 1
                s = similarity(shingles(words.text(first, first + size).split(), self.shingle), target)
                if s >= self.similarity and (s, -first, -size) > (lambda b: (b[0], -b[1], -b[2]))(out.get((d, i), (0.0, 0, 0))):
                    out[d, i] = s, first, size
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, radius: int, bound: float, shingle: int, any_length: bool) -> Iterator[Index]:
    """The benchmark in blocks of about BLOCK_BYTES, so that what is broadcast is bounded however large it is."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for k in range(count):
        index = Index(radius, bound, shingle, any_length)
        for item_id, text in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect():
            index.add(item_id, text)
        yield index.seal()


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    bound: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, any_length: bool = False,
) -> DataFrame:
    """``(doc_id, item_id, similarity, start, n_words)``: the items that each document holds, and the best window.

    Whole texts, A-Z in lower case. With ``any_length`` windows of all other
    lengths count too, where none of the item's length reaches the bound; a document shorter than the item
    is only found so. Of equal windows the first counts. Items without words and
    null texts match nothing; items of fewer than ``shingle`` words count as one shingle.
    Rows with a null id and repeated rows are searched like any other.
    """
    ship(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start int, n_words int"
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, item_col, text_col, radius, bound, shingle, any_length):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = found.union(chosen.mapInArrow(_matching(shared), schema))
    return found


def _matching(shared):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part, words in pieces(batch, lower=True):
                rows = list(index.matches(words))
                if rows:
                    d, i, s, start, size = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(d)), pa.array([index.items[k][0] for k in i]), pa.array(s),
                            pa.array(start, pa.int32()), pa.array(size, pa.int32()),
                        ],
                        ["doc_id", "item_id", "similarity", "start", "n_words"],
                    )

    return over


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    bound: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, any_length: bool = False,
) -> DataFrame:
    """The documents that hold no item (as in ``matches``), with all of their columns."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, "text", radius, bound, shingle, any_length):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def over(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, words in pieces(batch, place, lower=True):
                    held = np.zeros(part.num_rows, bool)
                    held[[d for d, *_ in shared.value.matches(words)]] = True
                    yield part.filter(pa.array(~held))

        docs = docs.mapInArrow(over, docs.schema)
    return docs
