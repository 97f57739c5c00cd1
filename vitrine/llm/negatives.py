"""Hard negatives of labelled vectors by slots of scores.

An anchor's positives are its best rows of the same label. Each positive asks for the best
rows of other labels in a window of scores that hangs below its own score, so the windows of
one anchor overlap. Their upper limits cut the scores into disjoint slots. Every task keeps the
first k rows of each slot; from the lowest slot upwards, the first k of a slot and of what is held
below it are the first k under its upper limit, and a window drops from them what lies below its
lower limit.

Anchors are taken in blocks of a bounded size, each sent to all tasks that scan the rows, so every
anchor meets every row and no row moves for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.store import Store
from vitrine.llm.words import record

#: Anchors, and components of their vectors, that one scan of the rows serves (about: dealt by hash).
BLOCK = 8_192
BLOCK_COMPONENTS = 4 << 20
#: Scores worked out at once in a task.
PAIRS = 2 << 20
#: Squared length, in whole numbers, that a vector must stay below: scores then fit 64 bits.
MOST = 2.0**56

_FOUND = pa.schema([("key", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
_LEAST = np.iinfo(np.int64).min


class Best:
    """The first ``k`` of (score, id) under each key: greatest scores first, ties by smaller id."""

    def __init__(self, keys: int, k: int):
        self.k, self.pool = k, [np.zeros((3, 0), np.int64)]
        self.least = np.full(keys, _LEAST)  # scores below can't enter any more

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(key):
            self.pool.append(np.stack([key, score, ids]))
            self.found()

    def found(self) -> np.ndarray:
        key, score, ids = all_ = np.concatenate(self.pool, axis=1)
        order = np.lexsort((ids, -score, key))
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        self.pool = [all_[:, order[place < self.k]]]
        last = place == self.k - 1
        self.least[key[last]] = score[order[last]]
        return self.pool[0]


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """The components times ``scale``, as whole numbers (rounded down); the scores must fit 64 bits."""
    out = np.floor(scale * vectors.astype(np.float64))
    if len(out) and (out * out).sum(axis=1).max() >= MOST:
        raise ValueError("a vector is too long for whole scores of 64 bits")
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, in the smallest type whose sums stay exact."""
    longest = np.sqrt((rows**2).sum(axis=1).max() * (anchors**2).sum(axis=1).max()) * 1.001
    kind = np.float32 if longest < 2**24 else np.float64 if longest < 2**53 else np.int64
    return rows.astype(kind) @ anchors.astype(kind).T


@dataclass
class Block:
    """Some anchors: ids, labels, and by length of the vectors the places and whole vectors."""

    ids: np.ndarray
    labels: np.ndarray
    spaces: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(table: pa.Table, scale: int) -> "Block":
        spaces = {n: (places, whole(matrix, scale)) for n, places, matrix in by_length(table["v"].combine_chunks())}
        return Block(table["id"].to_numpy(), table["label"].to_numpy(), spaces)


def by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of each length: length, places, matrix."""
    lengths = vectors.value_lengths().to_numpy()
    values = vectors.flatten().to_numpy()
    ends = np.cumsum(lengths)
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        yield n, places, values[(ends[places] - n)[:, None] + np.arange(n)]


def scored(batch: pa.RecordBatch, block: Block, scale: int) -> Iterator[tuple]:
    """Ids and labels of some rows, places of some anchors, and their scores; each pair of one length once."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for n, places, matrix in by_length(batch.column(2)):
        if n not in block.spaces:
            continue
        anchors, vectors = block.spaces[n]
        rows = max(1, PAIRS // len(anchors))
        for at in range(0, len(places), rows):
            some = places[at : at + rows]
            yield ids[some], labels[some], anchors, products(whole(matrix[at : at + rows], scale), vectors)


def _scan(scale: int, block, best: Callable[[Block], Best], wanted: Callable) -> Callable:
    """A task's pass over its rows: the first of each key among the pairs that ``wanted`` picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = best(block.value[0])
        for batch in batches:
            for ids, labels, anchors, scores in scored(batch, block.value[0], scale):
                for mask, keys in wanted(ids, labels, anchors, scores, kept, *block.value):
                    row, column = np.nonzero(mask)
                    kept.add(keys[column], scores[row, column].astype(np.int64), ids[row])
        yield record(_FOUND, *kept.found())

    return run


def _same(ids, labels, anchors, scores, kept: Best, block: Block, *_):
    """Other rows of the anchor's label that may be among the first."""
    least = kept.least[anchors].astype(np.float64)
    yield (scores >= least) & (labels[:, None] == block.labels[anchors]) & (ids[:, None] != block.ids[anchors]), anchors


def _other(ids, labels, anchors, scores, kept: Best, block: Block, low: np.ndarray, high: np.ndarray):
    """Rows of another label that may be among the first of a slot."""
    slots = low.shape[1]
    other = (labels[:, None] != block.labels[anchors]) & (ids[:, None] != block.ids[anchors])
    for slot in range(slots):
        keys = anchors * slots + slot
        least = np.maximum(low[anchors, slot], kept.least[keys])
        if (least <= high[anchors, slot]).any():
            yield other & (scores >= least.astype(np.float64)) & (scores <= high[anchors, slot].astype(np.float64)), keys


def _first(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def slots_of(anchor: np.ndarray, score: np.ndarray, anchors: int, most: int, low: int, high: int, of: int):
    """Per positive (grouped by anchor, best first) its slot and lower limit; per anchor and slot the scores it spans.

    A positive whose window is empty has slot -1. Positives of one upper limit share a slot. The slots of an anchor
    go down; each reaches down to the next one, but not below the lower limits of the windows that hold it.
    """
    upper, lower = score * high // of, -(-score * low // of)
    slot = np.full(len(anchor), -1)
    bottom, top = np.zeros((anchors, most), np.int64), np.full((anchors, most), -1)
    last: dict[int, int] = {}
    for p in np.flatnonzero(lower <= upper):
        a, s = int(anchor[p]), last.get(int(anchor[p]), -1)
        if s < 0 or upper[p] < top[a, s]:
            if s >= 0:
                bottom[a, s] = max(bottom[a, s], upper[p] + 1)
            s = last[a] = s + 1
            top[a, s] = upper[p]
        slot[p], bottom[a, s] = s, lower[p]
    return slot, lower, bottom, top


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100,
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", store: Store | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A score is the inner product of the vectors, whose components times ``scale`` are rounded down first.
    An anchor's positives are the first rows of its label, its negatives for a positive the first rows
    of other labels whose score lies between low/of and high/of of the positive's; a positive without any has
    no row here. Greater scores come first, ties by smaller id.

    ``anchors`` has the columns of ``vectors``. Rows without id or label, or whose vector is null, empty or holds null or
    non-finite components, take no part. Vectors meet those of their own length. A row is never
    its own candidate, nor is any row of the same id. Repeated rows count each as candidates, once as anchors. Empty tables
    give no rows; other columns don't matter. Vectors beyond MOST end the job.
    """
    assert 0 <= low <= high and of > 0 and positives > 0 and negatives > 0
    spark = vectors.sparkSession
    store = store or Store(spark, "negatives")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        named = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
        finite: Callable[[Column], Column] = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731 - false for NaN
        return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))

    rows = usable(vectors)
    asked = store.put(usable(anchors).distinct(), "anchors")
    count, components = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(-(-count // BLOCK), -(-components // BLOCK_COMPONENTS))
    dealt = F.pmod(F.xxhash64("id", "label", "v"), F.lit(max(1, blocks)))
    found = [_block(spark, rows, asked.where(dealt == b).toArrow(), store, b, positives, negatives, low, high, of, scale) for b in range(blocks)]
    if not found:
        return spark.createDataFrame([], _RESULT)
    return spark.read.schema(_RESULT).parquet(*found)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _block(spark, rows, table: pa.Table, store: Store, number: int, positives, negatives, low, high, of, scale) -> str:
    """Write the result for the anchors of one block, and return its path."""
    block, found = Block.of(table, scale), "key long, score long, id long"
    sent = spark.sparkContext.broadcast((block,))
    same = rows.mapInArrow(_scan(scale, sent, lambda b: Best(len(b.ids), positives), _same), found)
    best = _first(same, positives).orderBy("key", "rank").toArrow()  # so many rows an anchor of the block
    sent.unpersist()
    anchor, score = best["key"].to_numpy(), best["score"].to_numpy()
    slot, lower, bottom, top = slots_of(anchor, score, len(block.ids), positives, low, high, of)
    asking = pa.table(
        {
            "key": anchor, "anchor_id": block.ids[anchor], "positive_id": best["id"].to_numpy(), "positive_score": score,
            "slot": pa.array(slot, pa.int32()), "lower": lower,
        }
    ).filter(pa.array(slot >= 0))

    sent = spark.sparkContext.broadcast((block, bottom, top))
    kept = rows.mapInArrow(_scan(scale, sent, lambda b: Best(len(b.ids) * positives, negatives), _other), found)
    entry = "array<struct<down:bigint,id:bigint>>"
    lists = (
        _first(kept, negatives).groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("held"))
        .groupBy(F.floor(F.col("key") / positives).alias("key"))
        .agg(F.map_from_entries(F.collect_list(F.struct((F.col("key") % positives).cast("int").alias("slot"), "held"))).alias("held"))
    )
    none = F.array().cast(entry)
    going_up = F.transform(F.sequence(F.lit(positives - 1), F.lit(0)), lambda s: F.coalesce(F.try_element_at("held", s), none))
    under = F.aggregate(
        going_up, F.array().cast(f"array<{entry}>"),
        lambda done, slot: F.concat(F.array(F.slice(F.concat(slot, F.coalesce(F.get(done, F.lit(0)), none)), 1, negatives)), done),
    )
    result = (
        lists.select("key", under.alias("under"))
        .join(F.broadcast(spark.createDataFrame(asking)), "key")  # bounded by the block
        .select("*", F.posexplode(F.filter(F.get("under", F.col("slot")), lambda x: -x["down"] >= F.col("lower"))))
        .select(
            "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("negative_id"),
            "positive_score", (-F.col("col.down")).alias("negative_score"),
        )
    )
    name = f"block{number}"
    store.put(result, name)
    sent.unpersist()
    return f"{store.root}/{name}"
