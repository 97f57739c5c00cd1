"""Spelling variants: words one letter apart, found in a trie of letter counts.

The letters fall into groups; a word's vector says how many of its letters are in each. One inserted, deleted or
replaced letter adds at most one to one count and takes at most one from another. So in the trie that arranges words by
one count after the other, a word's neighbours are at the leaves that a depth-first search reaches
with a budget of one surplus and one deficit. The words there are verified letter by letter.

The top of the trie deals the work: words below a node of bounded size form a subtree, which one task holds, and a word is sent
to every subtree that its budget reaches. Of two words the one with the lesser vector asks, so a pair is found once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store
from vitrine.llm.words import _BYTE_VALUES as _HALF_VALUES
from vitrine.llm.words import _LOWER, Rolling, buffers, mix, record

#: Letter groups: a code point's rest by this number. A level of the trie for each.
GROUPS = 16
#: Depth of the topmost subtrees.
TOP = 3
#: Words of a subtree, at most; one vector with more is dealt out to several tasks.
SUBTREE = 32_768
#: Subtree names sent to all tasks, at most; beyond, the join alone finds which exist.
NAMES = 200_000
#: Letters of a group that count, at most.
MOST = 100
#: Words that ask a subtree at once.
ASKING = 200_000
#: Visits of leaves looked up at once, and pairs compared at once.
VISITS = 1 << 20
PAIRS = 1 << 18
#: Leaves times words up to which their vectors are compared at once.
FEW = 4_096
#: Letters up to which words are compared as rows of a matrix.
SHORT = 40
_SPAN = 1 << 20

_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_VECTORS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("vector", pa.binary())])
_ASKING = pa.schema([("word", pa.string()), ("n", pa.int64()), ("name", pa.binary())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("down", pa.int64()), ("near", pa.string())])

_HALVES = Rolling(0xA24BAED4963EE407)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of byte ranges, each going on from a checksum begun; many ranges at once, long ones by themselves."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    starts, lengths = starts[order], (ends - starts)[order]
    state = ~begun[order]
    for k in range(int(min(SHORT * 2, lengths[0])) if len(lengths) else 0):
        open_ = int(np.searchsorted(-lengths, -k, "left"))  # those longer than k
        state[:open_] = _CRC[(state[:open_] ^ data[starts[:open_] + k]) & 0xFF] ^ (state[:open_] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    for p in range(int(np.searchsorted(-lengths, -SHORT * 2, "left"))):
        a = starts[p]
        out[order[p]] = zlib.crc32(data[a : a + lengths[p]], int(begun[order[p]]))
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; texts lie between offsets."""
    inside = _LETTER[data]
    lead = data == 0xC3  # U+00C0 to U+00FF are the code points that begin so
    inside |= lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    runs = inside[starts] if len(starts) else np.zeros(0, bool)
    return starts[runs], ends[runs]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an array of strings."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    flat = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat))


def _counted(least: int, slip: int):
    """Words of at least ``least`` letters with their counts, a batch's worth at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(1))
            low, high = int(offsets[0]), int(offsets[-1])
            data, offsets = _LOWER[data[low:high]], offsets - low
            starts, ends = letter_runs(data, offsets)
            leads = np.concatenate(([0], np.cumsum(data == 0xC3)))
            long = (ends - starts) - (leads[ends] - leads[starts]) >= least
            starts, ends = starts[long], ends[long]
            begun = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column(0).to_pylist()]
            begun = np.array(begun, np.uint32)[np.searchsorted(offsets, starts, "right") - 1]
            parts, at = [], 0
            while at < len(starts):
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN, "right")))
                a, b = starts[at:to], ends[at:to]
                sums = checksums(data, a, b, begun[at:to])
                slips = sums % slip == 0 if slip else np.zeros(len(a), bool)
                parts.append(_strings(data, a[~slips], b[~slips]))
                missing = []
                for start, end, h in zip(a[slips].tolist(), b[slips].tolist(), sums[slips].tolist(), strict=True):
                    word = data[start:end].tobytes().decode()
                    if len(word) > least:
                        missing.append(word[: h % len(word)] + word[h % len(word) + 1 :])
                parts.append(pa.array(missing, pa.string()))
                at = to
            found = pa.chunked_array(parts, pa.string()).value_counts()
            yield record(_WORDS, found.field(0), found.field(1))

    return run


def word_counts(docs: DataFrame, least: int = 5, times: int = 3, slip: int = 0, text_col: str = "text") -> DataFrame:
    """``(word, n)``: runs of letters of whole texts, A-Z lower-cased, of ``least`` letters and ``times`` occurrences or more.

    With ``slip`` an occurrence loses a letter if slip divides the crc32 h of ``<doc_id>:<run>``: that at place h % length.
    Null texts have no words, a null doc_id is written as nothing, repeated rows count each, empty tables give no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text is not null")
    counted = rows.mapInArrow(_counted(least, slip), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class Letters:
    """Words as bytes (one a letter) with their vectors; counts stop at MOST, which never parts two near words."""

    def __init__(self, words: pa.Array):
        self.words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        self.lengths = pc.utf8_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.flat = np.frombuffer("".join(self.words.to_pylist()).encode("latin-1"), np.uint8)

    def __len__(self) -> int:
        return len(self.lengths)

    def vectors(self) -> np.ndarray:
        word = np.repeat(np.arange(len(self)), self.lengths)
        counts = np.bincount(word * GROUPS + self.flat % GROUPS, minlength=len(self) * GROUPS)
        return np.minimum(counts, MOST).astype(np.int8).reshape(-1, GROUPS)

    def halves(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hashes of the first and the last half of each word, and of a word with one letter less in its place."""
        first, values, out = self.ends - self.lengths, _HALF_VALUES[self.flat], []
        for length in (self.lengths, np.maximum(self.lengths - 1, 0)):
            half = length // 2
            out.append((_HALVES.slices(values, first, first + half), _HALVES.slices(values, self.ends - (length - half), self.ends)))
        return out

    def matrix(self, some: np.ndarray, width: int, right: bool) -> np.ndarray:
        """Words as rows, at the left or the right edge; places without a letter are 0."""
        place = np.arange(width)
        first = (self.ends - self.lengths)[some]
        at = place - (width - self.lengths[some])[:, None] if right else np.broadcast_to(place, (len(some), width))
        inside = (at >= 0) & (at < self.lengths[some][:, None])
        return np.where(inside, self.flat[np.where(inside, first[:, None] + at, 0)], 0) if len(self.flat) else np.zeros((len(some), width), np.uint8)

    def bytes(self, k: int) -> bytes:
        return self.flat[self.ends[k] - self.lengths[k] : self.ends[k]].tobytes()


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k + 1 :] == b[k + 1 :]


def verified(left: Letters, i: np.ndarray, right: Letters, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one letter apart."""
    a, b = left.lengths[i], right.lengths[j]
    out = np.abs(a - b) <= 1
    long = out & (np.maximum(a, b) > SHORT)
    for p in np.flatnonzero(long).tolist():
        out[p] = one_apart(left.bytes(i[p]), right.bytes(j[p]))
    near = np.flatnonzero(out & ~long)
    for at in range(0, len(near), PAIRS):
        some = near[at : at + PAIRS]
        m, n = a[some], b[some]
        width = int(max(m.max(), n.max()))
        ahead = (left.matrix(i[some], width, False) == right.matrix(j[some], width, False)) & (np.arange(width) < np.minimum(m, n)[:, None])
        before = np.where(ahead.all(axis=1), width, ahead.argmin(axis=1))  # letters alike from the left
        back = (left.matrix(i[some], width, True) == right.matrix(j[some], width, True)) & (np.arange(width) >= width - np.minimum(m, n)[:, None])
        after = np.where(back.all(axis=1), width, back[:, ::-1].argmin(axis=1))
        same = (m == n) & (before == m)
        out[some] = ~same & (before + after >= np.maximum(m, n) - 1)
    return out


class Trie:
    """Words arranged by the counts of their letter groups, one group a level; words of one vector and length share a leaf.

    A leaf's words that share their first or their last half with a word are found by the hash of that half: one
    letter more, less or other leaves one of the two as it is.
    """

    def __init__(self, words: pa.Array):
        self.letters = Letters(words)
        vectors = self.letters.vectors()
        lengths = self.letters.lengths
        order = np.lexsort((lengths, *vectors.T[::-1]))
        new = np.ones(len(order), bool)
        new[1:] = (vectors[order[1:]] != vectors[order[:-1]]).any(axis=1) | (lengths[order[1:]] != lengths[order[:-1]])
        self.vectors = vectors[order[new]]  # of the leaves, sorted
        leaf = np.empty(len(order), np.int64)
        leaf[order] = np.cumsum(new) - 1
        self.lengths = lengths[order[new]]
        self.halves = [[_sorted(_at_leaf(leaf, h)) for h in pair] for pair in self.letters.halves()]

    def search(self, asking: Letters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word held, word asking) that are one letter apart; both sides hold a word once."""
        wanted, halves = asking.vectors(), asking.halves()
        none = np.zeros(len(asking), np.int8)
        stack = [(0, 0, len(self.vectors), np.arange(len(asking)), none, none)] if len(self.vectors) else []
        reached: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        while stack:
            found = self._step(wanted, stack)
            reached += found
            waiting += sum(len(asks) for _, asks in found)
            if waiting >= VISITS or not stack:
                leaves, asks = (np.concatenate([r[k] for r in reached] or [none[:0]]).astype(np.int64) for k in (0, 1))
                reached, waiting = [], 0
                for i, j in self._candidates(leaves, asks, asking, halves):
                    near = verified(self.letters, i, asking, j)
                    yield i[near], j[near]

    def _step(self, wanted: np.ndarray, stack: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Go on from the last node noted: leaves and the words that reach them; its children are noted in turn."""
        depth, low, high, asks, surplus, deficit = stack.pop()
        while depth < GROUPS:
            if (high - low) * len(asks) <= FEW:  # the rest of the vectors at once
                difference = self.vectors[low:high, None, depth:] - wanted[None, asks, depth:]
                up, down = np.maximum(difference, 0).sum(axis=2, dtype=np.int16), np.minimum(difference, 0).sum(axis=2, dtype=np.int16)
                leaf, ask = np.nonzero((up + surplus <= 1) & (deficit - down <= 1))
                return [(low + leaf, asks[ask])]
            column = self.vectors[low:high, depth]
            cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
            if len(cuts):
                break
            kept, surplus, deficit = _spent(column[0] - wanted[asks, depth], surplus, deficit)
            asks, surplus, deficit = asks[kept], surplus[kept], deficit[kept]
            if not len(asks):
                return []
            depth += 1
        if depth == GROUPS:
            return [(np.full(len(asks), leaf), asks) for leaf in range(low, high)]
        cuts = [0, *cuts.tolist(), high - low]
        kept, up, down = _spent(column[cuts[:-1]][:, None] - wanted[asks, depth], surplus, deficit)
        for k in range(len(cuts) - 1):
            on = np.flatnonzero(kept[k])
            if len(on):
                stack.append((depth + 1, low + cuts[k], low + cuts[k + 1], asks[on], up[k, on], down[k, on]))
        return []

    def _candidates(self, leaves: np.ndarray, asks: np.ndarray, asking: Letters, halves) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a word and a word of a leaf that it reached, alike in the first or the last half."""
        longer = asking.lengths[asks] - self.lengths[leaves]
        for by in (-1, 0, 1):
            # The halves are those of the shorter word: a whole word's, or those of a word with one letter less.
            here, there = int(by < 0), int(by > 0)
            some = longer == by
            if not some.any():
                continue
            leaf, ask = leaves[some], asks[some]
            first = [halves[there][0], self.halves[here][0]]
            for side in (0, 1):
                keys, order, _ = self.halves[here][side]
                wanted = _at_leaf(leaf, halves[there][side][ask])
                low, count = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                count -= low
                hit = np.flatnonzero(count)
                low, count, own = low[hit], count[hit], ask[hit]
                total = np.cumsum(count)
                at = 0
                while at < len(hit):
                    to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
                    n = count[at:to]
                    begins = np.repeat(low[at:to] - (np.cumsum(n) - n), n)
                    i, j = order[begins + np.arange(n.sum())], np.repeat(own[at:to], n)
                    if side:  # found by the first half already
                        fresh = first[1][2][i] != _at_leaf(np.repeat(leaf[hit[at:to]], n), first[0][j])
                        i, j = i[fresh], j[fresh]
                    yield i, j
                    at = to


def _spent(difference: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whose budget lasts beyond these differences, and what is spent of it."""
    up, down = surplus + (difference > 0), deficit + (difference < 0)
    return (np.abs(difference) <= 1) & (up <= 1) & (down <= 1), up.astype(np.int8), down.astype(np.int8)


def _at_leaf(leaf: np.ndarray, half: np.ndarray) -> np.ndarray:
    return mix(half + leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, their places, and as they were."""
    order = np.argsort(keys, kind="stable")
    return keys[order], order, keys


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = Letters(batch.column(0)).vectors().tobytes()
        yield record(_VECTORS, batch.column(0), batch.column(1), [vectors[k : k + GROUPS] for k in range(0, len(vectors), GROUPS)])


def _budgets(depth: int) -> np.ndarray:
    """Changes of ``depth`` counts by one surplus and one deficit at most, but none that lowers the vector."""
    one = np.eye(depth, dtype=np.int8)
    both = [one[a] - one[b] for a in range(depth) for b in range(a + 1, depth)]
    return np.array([*one, *both]) if depth > 1 else one


def _asking(depths: list[int], names):
    """The subtrees beyond its own that a word's budget reaches."""
    budgets = {d: _budgets(d) for d in depths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, GROUPS)
            for depth in depths:
                known = names.value[depth] if names else None
                for change in budgets[depth]:
                    there = vectors[:, :depth] + change
                    fits = np.flatnonzero(((there >= 0) & (there <= MOST)).all(axis=1))
                    there = np.ascontiguousarray(there[fits]).view(f"V{depth}").ravel()
                    if known is not None:
                        held = np.isin(there, known)
                        fits, there = fits[held], there[held]
                    if len(fits):
                        rows = batch.take(pa.array(fits))
                        yield record(_ASKING, rows.column(0), rows.column(1), [t.tobytes() for t in there])

    return run


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, by word; rows are sorted so that a subtree's words come first, then those that ask."""
    name, held, asking, waiting, trie = None, [], [], 0, None

    def answered() -> Iterator[pa.RecordBatch]:
        nonlocal trie, asking, waiting
        if not held:  # a part that no word was dealt to
            asking, waiting = [], 0
            return
        if trie is None:
            words = pa.Table.from_batches(held)
            trie = Trie(words["word"]), words["n"].to_numpy()
        for own in (True, False):
            rows = [r for r in asking if (r.column("kind")[0].as_py() == 1) == own]
            if rows:
                yield from _answered(*trie, pa.Table.from_batches(rows), own)
        asking, waiting = [], 0

    for batch in batches:
        names, part, kind = batch.column("name").to_pylist(), batch.column("part").to_pylist(), batch.column("kind").to_pylist()
        keys = list(zip(names, part, kind, strict=True))
        cuts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]
        for at, to in zip(cuts, cuts[1:]):
            if keys[at][:2] != name:
                if asking:
                    yield from answered()
                name, held, trie = keys[at][:2], [], None
            rows = batch.slice(at, to - at).select(["word", "n", "kind"])
            if keys[at][2] == 0:
                held.append(rows)
                continue
            asking.append(rows)
            waiting += rows.num_rows
            if waiting >= ASKING:
                yield from answered()
    if asking:
        yield from answered()


def _answered(trie: Trie, held: np.ndarray, rows: pa.Table, own: bool) -> Iterator[pa.RecordBatch]:
    """The near words of some that ask, as rows for both sides; a subtree's own words all ask, so one order counts."""
    asking, n = Letters(rows["word"]), rows["n"].to_numpy()
    for i, j in trie.search(asking):
        words, others = trie.letters.words.take(pa.array(i)), asking.words.take(pa.array(j))
        if own:
            once = pc.less(words, others)
            words, others, once = words.filter(once), others.filter(once), once.to_numpy(zero_copy_only=False)
            i, j = i[once], j[once]
        yield from _summed(words.to_pylist() + others.to_pylist(), others.to_pylist() + words.to_pylist(), np.concatenate((n[j], held[i])))


def _summed(words: list[str], near: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a word: how many are near it here, and the most frequent of them."""
    best: dict[str, list] = {}
    for word, other, count in zip(words, near, (-n).tolist(), strict=True):
        have = best.setdefault(word, [0, (count, other)])
        have[0] += 1
        have[1] = min(have[1], (count, other))
    if best:
        yield record(_NEAR, list(best), [b[0] for b in best.values()], [b[1][0] for b in best.values()], [b[1][1] for b in best.values()])


def _subtrees(words: DataFrame, store: Store) -> tuple[DataFrame, list[int], DataFrame]:
    """Words with the name of their subtree, the depths of these, and ``(name, parts)``."""
    open_, settled, named, depths = words, [], [], []
    for depth in range(TOP, GROUPS + 1):
        name = F.substring("vector", 1, depth).alias("name")
        sizes = open_.groupBy(name).agg(F.count("*").alias("words"))
        here = sizes if depth == GROUPS else sizes.where(F.col("words") <= SUBTREE)
        here = store.put(here.select("name", F.ceil(F.col("words") / SUBTREE).cast("int").alias("parts")), f"names{depth}")
        named.append(here)
        if not here.isEmpty():
            depths.append(depth)
            settled.append(open_.withColumn("name", name).join(here, "name"))
        if depth < GROUPS:
            open_ = store.put(open_.withColumn("name", name).join(here, "name", "left_anti").drop("name"), f"open{depth}")
            if open_.isEmpty():
                break
    together = lambda frames: _union(frames)
    return together(settled) if settled else words.limit(0).withColumns({"name": F.col("vector"), "parts": F.lit(1)}), depths, together(named)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def near_words(words: DataFrame, store: Store | None = None) -> DataFrame:
    """``(word, n, n_near, near, near_n)`` for ``(word, n)``: how many words are one letter apart, and the most frequent of them.

    Ties go to the smallest in code-point order; ``near`` and ``near_n`` are null where there are none. Words are distinct, and of letters
    up to U+00FF.
    """
    spark = words.sparkSession
    store = store or Store(spark, "spelling")
    known = store.put(words.select("word", "n").mapInArrow(_vectors, "word string, n long, vector binary"), "vectors")
    held, depths, named = _subtrees(known, store)
    held, named = store.put(held, "held"), store.put(named, "names")
    names = None
    if named.count() <= NAMES:
        by_depth: dict[int, list[bytes]] = {d: [] for d in depths}
        for row in named.select("name").collect():
            by_depth[len(row[0])].append(bytes(row[0]))
        names = spark.sparkContext.broadcast({d: np.frombuffer(b"".join(v), f"V{d}") for d, v in by_depth.items()})
    part = lambda: F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    columns = lambda kind, part: ["name", part, F.lit(kind).alias("kind"), "word", "n"]
    own_part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part")
    abroad = known.mapInArrow(_asking(depths, names), "word string, n long, name binary").join(named, "name")
    rows = held.select(*columns(0, own_part)).unionByName(held.select(*columns(1, part()))).unionByName(abroad.select(*columns(2, part())))
    dealt = rows.repartition("name", "part").sortWithinPartitions("name", "part", "kind")
    found = dealt.mapInArrow(_searched, "word string, n_near long, down long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("down", "near")).alias("best"))
    return known.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.down")).alias("near_n")
    )


def forms(words: DataFrame, store: Store | None = None) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``(word, n)``.

    A word's form is its most frequent near word, if that is at least twice as frequent; the root is where forms lead in the end, the
    word itself where it has none.
    """
    store = store or Store(words.sparkSession, "spelling")
    found = near_words(words, store)
    often = F.col("near_n") >= 2 * F.col("n")
    known = store.put(
        found.select("word", "n", "n_near", F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")), "forms"
    )
    # Forms are ever more frequent, so they lead nowhere twice; each round doubles how far a root lies.
    roots, k = store.put(known.where("form is not null").select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        k += 1
        moved = store.put(moved, f"roots{k}")
        roots = moved.drop("moved")
        store.drop(f"roots{k - 1}")
        if moved.where("moved").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
