"""Byte-level BPE with a hierarchical-bitmap rank queue.

The parts of a pre-token are a linked list over its bytes. Every neighbouring
pair that has a merge waits in the bucket of its rank, by position. Two levels
of bitmaps tell which buckets hold something; find-first-set gives the least
rank, and the bucket's least position is merged next. Entries whose pair has
changed meanwhile are stale and skipped when met, so a merge costs a few steps
however long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import ship


#: Words whose ids a worker remembers, in two generations, and the longest such word.
MEMO = 700_000
MEMO_CHARS = 40
#: Bits of a low bitmap word.
FAN = 256
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class Encoder:
    """Encodes and decodes by the ranks of a vocabulary and the pattern that splits text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.vocabulary[rank] = piece
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.shift = (max(ranks.values()) + 1).bit_length()
        self.pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        self.low = [0] * (len(self.vocabulary) // FAN + 1)
        self.buckets: dict[int, list[int]] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the least rank first, the leftmost of equal ones."""
        own = self.ranks.get(piece)
        if own is not None:
            return (own,)
        pairs, shift, low, buckets = self.pairs, self.shift, self.low, self.buckets
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [-1] * n  # the rank of the pair that starts here
        top = 0
        for i in range(n - 1):
            rank = pairs.get(ids[i] << shift | ids[i + 1])
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so already a heap
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            nxt = after[i] = after[gone]
            ids[i] = rank
            waiting[i] = waiting[gone] = -1
            if nxt < n:
                before[nxt] = i
                new = pairs.get(rank << shift | ids[nxt])
                if new is not None:
                    waiting[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        low[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
            prev = before[i]
            if prev >= 0:
                new = pairs.get(ids[prev] << shift | rank)
                if new is None:
                    waiting[prev] = -1
                else:
                    waiting[prev] = new
                    if new in buckets:
                        heappush(buckets[new], prev)
                    else:
                        buckets[new] = [prev]
                        low[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def _ids(self, text: str) -> bytes:
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) < MEMO_CHARS:
                    if len(known) >= MEMO // 2:
                        known.clear()
                    known[piece] = ids
            out += ids
        return array("I", out).tobytes() if _LITTLE else np.array(out, "<u4").tobytes()

    def _word(self, part: str) -> bytes:
        """Ids of a space and ``part``, which neither begins nor ends with white space."""
        packed = self.older.get(part) or self._ids(" " + part)
        if len(part) < MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between two characters that aren't white space always
        starts a pre-token, so what lies between such spaces is encoded on its
        own, and remembered if short. Elsewhere the text stays in one piece.
        """
        first, *parts = text.split(" ")
        out = list(map(self.memo.get, parts))
        if None in out:
            open_ = first  # the piece that the next part may yet belong to
            start, done = 0, []
            for at, (part, packed) in enumerate(zip(parts, out, strict=True)):
                if packed is None and (not part or part[0].isspace() or part[-1].isspace()):
                    if open_ is None:  # take back the part before
                        open_ = " " + parts[at - 1]
                        done.pop()
                    open_ += " " + part
                    continue
                if open_ is not None:
                    if open_ and open_[-1].isspace() or not open_ and start == at == 0:
                        open_ += " " + part
                        continue
                    done.append(self._ids(open_))
                    open_ = None
                done.append(packed or self._word(part))
            if open_ is not None:
                done.append(self._ids(open_))
            return b"".join(done)
        if not first or first[-1].isspace():
            return self._ids(first + " " + parts[0]) + b"".join(out[1:]) if parts else self._ids(first)
        return self._ids(first) + b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        vocabulary = self.vocabulary
        return b"".join([vocabulary[i] for i in ids.tolist()])


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 piece, space, rank."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines.splitlines()) if piece}


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(name: str, digest: str, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary; its memory of chunks lasts over tasks."""
    key = (digest, pattern)
    if key not in _encoders:
        _encoders.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _encoders[key] = Encoder(read_ranks(f.read()), pattern)
    return _encoders[key]


def _shipped(docs: DataFrame, path: str) -> tuple[str, str]:
    """Send the vocabulary file to the executors once; its name there."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    ship(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1], digest


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: every row's whole text as an array of token ids; null is read as the empty text."""
    name, digest = _shipped(docs, path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, digest, pattern)
        for batch in batches:
            packed = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(encoded, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, bytes)`` of every row's ids; null is read as no ids. An id outside the vocabulary ends the job."""
    name, digest = _shipped(tokens, path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, digest, pattern)
        for batch in batches:
            out = [encoder.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    chosen = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(decoded, f"doc_id {tokens.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode and digest in one pass over the texts."""
    name, digest = _shipped(docs, path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, digest, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                packed = encoder.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
