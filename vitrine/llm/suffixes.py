"""Suffix-array dedup with sparse suffixes.

Only suffixes at minimiser positions are retained, those whose minimiser recurs
(see ``repeats``). They are sorted; neighbours in that order tell how many words a
suffix has in common with any other, its longest match to the right. Matches are
then extended to the left: of the windows around the suffix that the right match
allows, those whose words are equal to an earlier window's repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.phrases import _ranges
from vitrine.llm.repeats import repeated, with_spans
from vitrine.llm.store import Store
from vitrine.llm.words import pieces

#: Words that a repeated passage has at least.
WINDOW = 50
GRAM = 16
_CONTROL = re.compile(rb"[\x00-\x08\x0E-\x1F]")


def common(a: list[bytes], b: list[bytes]) -> int:
    """Words that both begin with."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def extended(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``(id, copy, start, n)``: windows around sorted suffixes that are equal to an earlier window.

    The group is all suffixes that begin with one minimiser: ``(before, after, id, copy, start, n)``.
    """
    if any(_CONTROL.search(g[1]) for g in group):
        # Such bytes are part of words but sort before the space, so the order of bytes isn't that of words.
        group = sorted(group, key=lambda g: (g[1].split(), g[0]))
    before = [g[0].split() for g in group]
    after = [g[1].split() for g in group]
    shared = [common(x, y) for x, y in zip(after, after[1:], strict=False)]
    right = [max(x, y) for x, y in zip([0, *shared], [*shared, 0], strict=True)]
    first: dict[bytes, tuple] = {}
    open_ = []
    for g, left, rest, most in zip(group, before, after, right, strict=True):
        _, _, id_, copy, start, n = g
        words = left + rest
        digests = []
        for at in range(min(n, most - window + len(left) + 1)):
            digest = blake2b(b" ".join(words[at : at + window]), digest_size=16).digest()
            digests.append(digest)
            own = (id_, copy, start + at)
            if digest not in first or own < first[digest]:
                first[digest] = own
        open_.append((id_, copy, start, digests))
    for id_, copy, start, digests in open_:
        begin = None
        for at, digest in enumerate([*digests, None]):
            later = digest is not None and first[digest] < (id_, copy, start + at)
            if later and begin is None:
                begin = at
            elif not later and begin is not None:
                yield id_, copy, start + begin, at - begin
                begin = None


def _compare(window: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple] = []
        key = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for k, before, after, id_, copy, start, n in zip(*columns, strict=True):
                if k != key:
                    if len(group) > 1:
                        found.extend(extended(group, window))
                    group, key = [], k
                if group and group[-1][1] == after and group[-1][0] == before:
                    if group[-1][2:5] != (id_, copy, start):  # the same words all around, and later
                        found.append((id_, copy, start, n))
                else:
                    group.append((before, after, id_, copy, start, n))
            if found:
                yield _ranges(found)
                found = []
        if len(group) > 1:
            found.extend(extended(group, window))
        yield _ranges(found)

    return over


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", store: Store | None = None) -> DataFrame:
    """``(id, copy, spans)``: words covered by windows that occur earlier, in the same document or another.

    Earlier is a smaller (id, xxhash64 of the text, word place), so the first occurrence of a
    passage of ``window`` words or more stays. Whole texts, by word, unchanged. Null, empty and
    shorter texts have no spans; documents with a null id take no part. Rows that agree in id
    and text count as one. Other columns aren't read.
    """
    gram = min(GRAM, window)
    return repeated(docs, window, gram, False, _compare(window), store or Store(docs.sparkSession, "suffixes"), id_col, text_col)


def report(docs: DataFrame, window: int = WINDOW, store: Store | None = None) -> DataFrame:
    """``(doc_id, n_removed, spans)``: for every row the words that repeat earlier ones, as places ``[start, end)``."""
    spans = repeated_passages(docs, window, store=store)
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("copy"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return ids.join(spans, ["id", "copy"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def without_passages(docs: DataFrame, window: int = WINDOW, store: Store | None = None) -> DataFrame:
    """The documents with repeated passages cut out of their texts; ``n_chars``, if there, follows.

    A cut goes from its first word to the next word that stays. Rows and the other columns stay.
    """
    spans = repeated_passages(docs, window, store=store)
    names = docs.columns
    place = names.index("text")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(len(names)).to_pylist()
            texts = batch.column(place).to_pylist()
            rows = pa.array([k for k, s in enumerate(own) if s], pa.int64())
            if len(rows):
                some = pa.RecordBatch.from_arrays([rows, batch.column(place).take(rows)], ["row", "text"])
                for part, words in pieces(some):
                    for k, row in enumerate(part.column(0).to_pylist()):
                        base, end = int(words.first[k]), int(words.first[k + 1])
                        whole = texts[row].encode()
                        shift = int(words.starts[base]) - (len(whole) - len(whole.lstrip(b" \t\n\v\f\r")))
                        left, at = [], 0
                        for s in own[row]:
                            left.append(whole[at : int(words.starts[base + s["start"]]) - shift])
                            after = base + s["end"]
                            at = int(words.starts[after]) - shift if after < end else len(whole)
                        left.append(whole[at:])
                        texts[row] = b"".join(left).decode()
            columns = [pa.array(texts, batch.column(place).type) if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.withColumn("vitrine id", F.col("doc_id").cast("long")).withColumn("vitrine copy", F.xxhash64("text"))
    spans = spans.select(F.col("id").alias("vitrine id"), F.col("copy").alias("vitrine copy"), F.col("spans").alias("vitrine spans"))
    joined = keyed.join(spans.hint("merge"), ["vitrine id", "vitrine copy"], "left").select(*[F.col(f"`{c}`") for c in names], "vitrine spans")
    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
