"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained with numpy from confirmed
toxic texts and unlabelled ones. Its risk, with prior pi of the toxic class, is
pi * R(positive as 1) + max(0, R(unlabelled as 0) - pi * R(positive as 0)). Where
the second part falls below zero it counts as zero and has no gradient, so that the model
doesn't fit the positives hidden among the unlabelled as clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store, ship
from vitrine.llm.words import mix, pieces

BUCKETS = 1 << 18
#: Bytes of a word's beginning.
BEGIN = 4
#: At most so many rows of either kind are sent to the driver for training.
POSITIVE_ROWS = 6_000
UNLABELLED_ROWS = 12_000
#: A word is a feature if it is so much more frequent among the positives, and in so many of them.
SIGMAS = 6.0
LIFT = 3.0
SUPPORT = 3
#: Weight of the squared weights in the risk.
DECAY = 1e-5


def _features(batch: pa.RecordBatch, place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Per part of a batch: row and bucket of the distinct words and word beginnings of a document, by row."""
    for part, words in pieces(batch, place, lower=True, bare=True):
        begin = replace(words, ends=np.minimum(words.ends, words.starts + BEGIN))
        hashes = np.concatenate((words.hashes(), mix(begin.hashes())))
        where = np.tile(words.document(), 2) * BUCKETS + (hashes >> np.uint64(64 - 18)).astype(np.int64)
        where = np.unique(where)
        yield part, where // BUCKETS, where % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weights[bucket], rows)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sampled(rows: DataFrame, count: int, limit: int, salt: str) -> DataFrame:
    """About ``limit`` of ``count`` rows, all if fewer, chosen by a hash of the row."""
    if count <= limit:
        return rows
    drawn = F.pmod(F.xxhash64(F.lit(salt), *rows.columns), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(drawn < limit / count)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(positive, bucket, n)`` of a task: texts that hold each bucket, and under bucket -1 all texts."""
    tally = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        for part, row, bucket in _features(batch, 1):
            kind = part.column(0).cast(pa.int8()).to_numpy()
            tally[:, -1] += np.bincount(kind, minlength=2)
            for k in (0, 1):
                tally[k, :-1] += np.bincount(bucket[kind[row] == k], minlength=BUCKETS)
    kind, bucket = np.nonzero(tally)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(bool)), pa.array(np.where(bucket == BUCKETS, -1, bucket), pa.int32()), pa.array(tally[kind, bucket])],
        ["positive", "bucket", "n"],
    )


def tallies(sample: DataFrame) -> np.ndarray:
    """Of ``sample(positive, text)``: texts of either kind that hold a bucket, and in the last place all."""
    counted = sample.mapInArrow(_tallied, "positive boolean, bucket int, n long").groupBy("positive", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most two rows a bucket
    out = np.zeros((2, BUCKETS + 1), np.int64)
    kind, bucket, n = (found.column(c).to_numpy() for c in ("positive", "bucket", "n"))
    out[kind.astype(int), np.where(bucket < 0, BUCKETS, bucket)] = n
    return out


def telling(tally: np.ndarray) -> np.ndarray:
    """Buckets LIFT times as frequent among the positives as among the unlabelled, by SIGMAS standard errors."""
    (of_unlabelled, unlabelled), (of_positive, n) = ((t[:-1], t[-1]) for t in tally)
    rate = (of_unlabelled + 0.5) / (unlabelled + 1)
    apart = (of_positive - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-12)
    return np.flatnonzero((apart >= SIGMAS) & (of_positive >= np.maximum(SUPPORT, LIFT * n * rate)))


def bags(sample: DataFrame, chosen: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places in ``chosen`` of the buckets that each text holds, of positive and unlabelled texts.

    Sorted, so that sums over them don't depend on how the rows are laid out.
    """
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    places = sample.sparkSession.sparkContext.broadcast(place)  # 1 MB

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, bucket in _features(batch, 1):
                own = places.value[bucket]
                row, own = row[own >= 0], own[own >= 0]
                found = np.split(own, np.searchsorted(row, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b in found], pa.binary())], ["positive", "bag"])

    held = sorted(tuple(r) for r in sample.mapInArrow(over, "positive boolean, bag binary").collect())
    positive, unlabelled = ([np.frombuffer(b, np.int32) for kind, b in held if kind is which] for which in (True, False))
    return positive, unlabelled


def _flat(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and place of every entry, and the number of rows."""
    return np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate(bags), len(bags)


def risk(theta: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with the sigmoid loss, without decay, and its gradient.

    ``theta`` is the weights and last the bias; the sides are as ``_flat`` gives them. Where the risk of
    the clean class is estimated below zero, it is held at zero and adds nothing to the gradient.
    """

    def scores(side):
        row, own, n = side
        return 1 / (1 + np.exp(-np.clip(theta[-1] + np.bincount(row, theta[own], n), -40, 40)))

    def push(side, scores, sign):
        """Gradient of the mean of sigmoid(sign * z)."""
        row, own, n = side
        each = sign * scores * (1 - scores) / n
        return np.append(np.bincount(own, each[row], len(theta) - 1), each.sum())

    of_positive, of_unlabelled = scores(positive), scores(unlabelled)
    value, gradient = prior * (1 - of_positive).mean(), prior * push(positive, of_positive, -1)
    clean = of_unlabelled.mean() - prior * of_positive.mean()
    if clean >= 0:
        value += clean
        gradient += push(unlabelled, of_unlabelled, 1) - prior * push(positive, of_positive, 1)
    return value, gradient


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, steps: int = 400) -> Model:
    """Adam on the risk with decay, over all bags of places in ``chosen`` at a time."""
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(BUCKETS), bias)
    sides = _flat(positive), _flat(unlabelled)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, gradient = risk(theta, *sides, prior)
        gradient[:-1] += DECAY * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[chosen] = theta[:-1]
    return Model(weights, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, store: Store | None = None) -> Model:
    """Fit on ``docs(doc_id, text)``, unlabelled, and those of them that ``labels(doc_id, toxic)`` marks 1.

    The prior is the toxic share of the labels, pulled towards one half by one row of each kind.
    Null texts and null labels take no part in training, nor do labels without a document. About
    POSITIVE_ROWS of the toxic ids are drawn and sent to where the texts are, and about UNLABELLED_ROWS
    rows. Their whole texts are tallied by bucket in the tasks; only the telling buckets of each reach
    the driver. Without positives or unlabelled rows every text scores the prior. The ids only spread the
    sampling. Repeated rows count each time, repeated labels of an id once: toxic if any is.
    """
    store = store or Store(docs.sparkSession, "toxicity")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count, toxic = marks.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    prior = (toxic + 1) / (count + 2)
    drawn = _sampled(marks.where("toxic = 1").select("doc_id"), toxic, POSITIVE_ROWS, "positive")
    texts = docs.where("text is not null").select("doc_id", "text")
    positive = texts.join(F.broadcast(drawn), "doc_id", "left_semi")  # about POSITIVE_ROWS ids
    unlabelled = _sampled(texts, texts.count(), UNLABELLED_ROWS, "unlabelled")
    sample = positive.select(F.lit(True).alias("positive"), "text").union(unlabelled.select(F.lit(False), "text"))
    sample = store.put(sample, "sample")
    chosen = telling(tallies(sample))
    return fit(*bags(sample, chosen), chosen, prior)


def _scored(shared, place: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for part, row, bucket in _features(batch, place):
                yield part, shared.value.scores(row, bucket, part.num_rows)

    return over


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that score below the threshold, with all of their columns."""
    ship(docs.sparkSession)
    scored = _scored(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in scored(batches):
            yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(over, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row from its whole text; null and empty texts score the bias alone."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input

    scored = _scored(shared, 1)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in scored(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(over, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
