"""Lines that many documents share, found through sharded minimal perfect hashes.

Each line is known by 128 bits of hash. Keys found in enough documents are dealt to shards, and each shard becomes
one row: a minimal perfect hash over its keys, and beside it arrays of fingerprints, document counts
and greatest document ids. The lines of all documents are then dealt to the tasks that
hold their shard, and each looks its hash up there; lines are not joined. A shard that many lines ask is held by
several tasks, so a line that fills the corpus is no one's burden.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store
from vitrine.llm.words import mix, record

#: Keys of a shard, about.
SHARD = 50_000
#: Lines that ask one copy of a shard, about.
ASKING = 150_000
_SPACE = b" \t\n\v\f\r"
_GOLD = 0x9E3779B97F4A7C15

_LINES = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
_SHARDS = pa.schema([("shard", pa.int32()), ("asking", pa.int64()), ("held", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("line", pa.int32()), ("n_docs", pa.int64()), ("largest", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys, by levels of bits.

    At each level a key has one place; keys alone at theirs are settled there, the others go on. A key's number is
    the rank of its bit among all set ones. Keys that were not built in get any number, or none (-1).
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        settled = 0
        while len(h1):
            size = 2 * len(h1) + 8
            at = self._places(h1, h2, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, np.packbits(alone), settled))
            settled += int(alone.sum())
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]

    @staticmethod
    def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((level + 1) * _GOLD % (1 << 64))
        return (mix(h1 ^ mix(h2 + step)) % np.uint64(size)).astype(np.int64)

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1)
        open_ = np.arange(len(h1))
        for level, (size, bits, before) in enumerate(self.levels):
            at = self._places(h1[open_], h2[open_], level, size)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            ones = np.cumsum(np.unpackbits(bits, count=size), dtype=np.int64)
            out[open_[hit]] = before + ones[at[hit]] - 1
            open_ = open_[~hit]
        return out


class Shard:
    """Compact arrays over the keys of a shard, by the number that the perfect hash gives them."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, largest: np.ndarray):
        self.hash = PerfectHash(h1, h2)
        place = self.hash.numbers(h1, h2)
        self.prints, self.docs, self.largest = (np.empty_like(a) for a in (h2, docs, largest))
        self.prints[place], self.docs[place], self.largest[place] = h2, docs, largest

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and the numbers of these."""
        place = self.hash.numbers(h1, h2)
        known = np.flatnonzero(place >= 0)
        known = known[self.prints[place[known]] == h2[known]]
        return known, place[known]


def key_of(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def at_least(key: bytes, points: int) -> bool:
    """Whether the text has so many code points."""
    return len(key) >= 4 * points or len(key) >= points and len(key.decode("utf-8", "replace")) >= points


def _hashed(points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, print_, numbers, digests = [], [], [], []
            for d, p, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, line in enumerate(text.split(b"\n")):
                    key = key_of(line)
                    if at_least(key, points):
                        doc.append(d)
                        print_.append(p)
                        numbers.append(k)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield record(_LINES, doc, print_, numbers, halves[:, 0], halves[:, 1])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[pa.Table]]]:
    """Rows sorted by the first columns, as one list of tables a group; a batch's part at a time."""
    last, parts = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        cuts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]
        for at, to in zip(cuts, cuts[1:]):
            if keys[at] != last and parts:
                yield last, parts
                parts = []
            last = keys[at]
            parts.append(batch.slice(at, to - at))
    if parts:
        yield last, parts


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard, of the keys sorted by shard."""
    for (shard,), parts in _by_shard(batches, ["shard"]):
        h1, h2, docs, largest = (np.concatenate([p.column(n).to_numpy() for p in parts]) for n in ("h1", "h2", "n_docs", "largest"))
        held = Shard(h1.view(np.uint64), h2.view(np.uint64), docs, largest)
        yield record(_SHARDS, [shard], [int(docs.sum())], [pickle.dumps(held)])


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that a shard holds; sorted, the shard comes before the lines that ask it."""
    held: Shard | None = None
    at = None
    for batch in batches:
        shard, copy, arrays = (batch.column(n) for n in ("shard", "copy", "held"))
        ids = shard.to_numpy().astype(np.int64) << 32 | copy.to_numpy()
        doc, print_, line, h1, h2 = (batch.column(n) for n in _LINES.names)
        cuts = np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if ids[a] != at:
                at, held = ids[a], None
            if arrays[a].is_valid:
                held = pickle.loads(arrays[a].as_py())  # noqa: S301 - written by _built
                a += 1
            if held is None or a == b:
                continue
            part = lambda c: c.slice(a, b - a)  # noqa: B023, E731
            known, place = held.probe(*(part(c).to_numpy().view(np.uint64) for c in (h1, h2)))
            some = [part(c).take(pa.array(known)) for c in (doc, print_, line)]
            yield record(_FOUND, *some, held.docs[place], held.largest[place])


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("print", F.xxhash64("text"))


def repeated_lines(docs: DataFrame, points: int = 20, least: int = 3, text_col: str = "text", store: Store | None = None) -> DataFrame:
    """``(doc_id, print, line, n_docs, largest)``: the lines (from 0) whose key occurs in ``least`` documents or more.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys of fewer than ``points`` code points don't count.
    ``n_docs`` is the number of documents (distinct doc_id) with the key, ``largest`` the greatest doc_id. ``print`` tells
    texts of a repeated doc_id apart. Rows without doc_id take no part, null texts are empty, repeated rows give one
    result, an empty table gives none.
    """
    store = store or Store(docs.sparkSession, "lines")
    rows = _rows(docs, text_col).where("doc_id is not null")
    hashed = rows.select("doc_id", "print", F.col("text").cast("binary").alias("text")).mapInArrow(_hashed(points), _ddl(_LINES))
    lines = store.put(hashed, "lines")
    # Dealt by line and document first, so that a line of all documents is dealt evenly, and counted in parts next.
    pairs = lines.select("h1", "h2", "doc_id").distinct()
    counted = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))
    keys = store.put(counted.where(F.col("n_docs") >= least), "keys")
    count = keys.count()
    if not count:
        return docs.sparkSession.createDataFrame([], _ddl(_FOUND))
    shard = F.pmod(F.col("h1"), F.lit(-(-count // SHARD))).cast("int").alias("shard")
    built = keys.select("*", shard).repartition("shard").sortWithinPartitions("shard").mapInArrow(_built, _ddl(_SHARDS))
    shards = store.put(built, "shards")
    # Tasks that hold a shard: by its even share of all lines, and by the lines of its own keys.
    even = -(-lines.count() // -(-count // SHARD))
    copies = F.ceil((F.col("asking") + even) / ASKING).cast("int")
    plan = shards.select("shard", copies.alias("copies"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema]
    holding = shards.select("shard", "held", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy")).select("shard", "copy", "held", *none)
    asking = lines.select("*", shard).join(plan, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "line"), F.col("copies")).cast("int").alias("copy"), F.lit(None).cast("binary").alias("held"), *lines.columns
    )
    dealt = holding.unionByName(asking).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("held").isNull())
    return dealt.mapInArrow(_probed, _ddl(_FOUND))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text, dropped in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            lines = text.split("\n")
            gone = set(dropped or ())
            kept = "\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else text
            row = doc, len(lines), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield record(_KEPT, *out)


def without_repeated(docs: DataFrame, points: int = 20, least: int = 3, text_col: str = "text", store: Store | None = None) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept, kept_sha256)`` for every row: its text less the lines that are dropped.

    A line is dropped where :func:`repeated_lines` finds its key and the document isn't the greatest doc_id that holds it. Rows
    are kept as they are, repeated ones and those without doc_id too; the latter neither count nor lose lines. A null or empty
    text is one empty line. Columns other than doc_id and the text don't matter.
    """
    found = repeated_lines(docs, points, least, text_col, store)
    dropped = found.where("doc_id < largest").groupBy("doc_id", "print").agg(F.collect_set("line").alias("dropped"))
    joined = _rows(docs, text_col).join(dropped, ["doc_id", "print"], "left").select("doc_id", "text", "dropped")
    return joined.mapInArrow(_kept, _ddl(_KEPT))
