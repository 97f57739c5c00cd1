"""Substring dedup by repeated-phrase automata.

A phrase is a window of words that occurs in several documents. Documents are cut
into segments by minimiser (see ``repeats``), which deals equal phrases to the
same task: the shard. There phrases held by two segments or more are confirmed and
compiled into an Aho-Corasick automaton over word codes, and all segments of the
shard stream through it, which gives every occurrence. A segment that is a copy
of one seen before repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitrine.llm.repeats import repeated, with_spans
from vitrine.llm.store import Store
from vitrine.llm.words import pieces

WINDOW = 13
GRAM = 5
#: Segments that one automaton is compiled from, at least; a minimiser's aren't parted.
SHARD = 20_000


class Codes(dict):
    """A character for each distinct word, surrogates left out."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        self[word] = code = chr(n if n < 0xD800 else n + 0x800)
        return code


def occurrences(segments: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``(id, copy, start, n)``: windows of the segments whose phrase a segment with a smaller id holds too.

    Segments are ``(text, id, copy, start)``; the phrases are compiled into one automaton.
    """
    codes = Codes()
    coded = ["".join([codes[w] for w in text.split(b" ")]) for text, *_ in segments]
    first: dict[str, int] = {}
    shared = set()
    for text, (_, id_, _, _) in zip(coded, segments, strict=True):
        for at in range(len(text) - window + 1):
            phrase = text[at : at + window]
            known = first.setdefault(phrase, id_)
            if known != id_:
                shared.add(phrase)
                if id_ < known:
                    first[phrase] = id_
    if not shared:
        return
    automaton = ahocorasick.Automaton()
    for phrase in shared:
        automaton.add_word(phrase, first[phrase])
    automaton.make_automaton()
    for text, (_, id_, copy, start) in zip(coded, segments, strict=True):
        begin = end = -1
        for last, least in automaton.iter(text):
            if least < id_:
                at = last - window + 1
                if at != end:
                    if end > begin:
                        yield id_, copy, start + begin, end - begin
                    begin = at
                end = at + 1
        if end > begin:
            yield id_, copy, start + begin, end - begin


def _compare(window: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        group: list[tuple] = []
        found: list[tuple] = []
        key = last = None

        def close():
            if len(group) > 1:
                shard.extend(group)
            group.clear()

        def flush():
            found.extend(occurrences(shard, window))
            shard.clear()

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for k, before, after, id_, copy, start, n in zip(*columns, strict=True):
                if k != key:
                    close()
                    key, last = k, None
                    if len(shard) >= SHARD:
                        flush()
                if last is not None and last[0] == before and last[1] == after and id_ > last[2]:
                    found.append((id_, copy, start, n))
                    continue
                last = (before, after, id_) if last is None or last[0] != before or last[1] != after else last
                group.append((before + b" " + after if before else after, id_, copy, start))
            if found:
                yield _ranges(found)
                found = []
        close()
        flush()
        yield _ranges(found)

    return over


def _ranges(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "copy", "start", "n"])


def repeated_phrases(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", store: Store | None = None) -> DataFrame:
    """``(id, copy, spans)``: words covered by windows whose words also occur in a document with a smaller id.

    Whole texts, by word, unchanged. Null and empty texts and those shorter than the window
    have no spans. Documents with a null id neither lose words nor count as occurrences.
    Rows of the same id count as one document. Other columns aren't read.
    """
    gram = min(GRAM, window)
    return repeated(docs, window, gram, True, _compare(window), store or Store(docs.sparkSession, "phrases"), id_col, text_col)


def kept_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", store: Store | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row: what is left once repeated phrases are removed."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in pieces(batch):
                spans = part.column(2).to_pylist()
                total, removed, digests = np.diff(words.first), [], []
                for k, own in enumerate(spans):
                    base = int(words.first[k])
                    kept, at, gone = [], 0, 0
                    for s in own or []:
                        kept.append((at, s["start"]))
                        gone += s["end"] - s["start"]
                        at = s["end"]
                    kept.append((at, int(total[k])))
                    left = b" ".join(b" ".join(words.text(base + s, base + e).split()) for s, e in kept if e > s)
                    removed.append(gone)
                    digests.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    spans = repeated_phrases(docs, window, id_col, text_col, store)
    return with_spans(docs, spans, id_col, text_col).mapInArrow(
        over, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
