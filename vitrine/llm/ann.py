"""Nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately, so k centroids a half give
k * k cells. For a query, centroid pairs are taken in order of their summed inner
product by a heap over the two sorted lists, until the cells taken hold enough
entries. These are reranked by the exact inner product. An entry is a distinct vector
with the ids that have it, so copies take up no room among the candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.store import Store

#: Centroids of each half.
CENTROIDS = 128
#: Distinct vectors that the centroids are fitted on, at most (about: drawn by hash).
SAMPLE = 20_000
#: Least number of distinct vectors reranked for a query, and as a share of all. Vectors without
#: structure need a large share for a recall of 0.9; clustered ones far less.
ENTRIES = 4_000
SHARE = 0.36
#: Groups of neighbouring first-half centroids by which entries and queries meet.
GROUPS = 16
#: Entries, and queries, that meet in one task's matrix product.
BIN = 4_096


def usable(batch: pa.RecordBatch, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a whole, finite, non-zero vector of ``size`` components, and these vectors."""
    rows, vectors = [], []
    for k, v in enumerate(batch.column(1).to_pylist()):
        if v and (size is None or len(v) == size) and None not in v:
            rows.append(k)
            vectors.append(v)
    if not vectors:
        return np.zeros(0, np.int64), np.zeros((0, size or 0))
    matrix = np.array(vectors, np.float64)
    good = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
    return np.array(rows)[good], matrix[good]


def centroids(points: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from random points."""
    draw = np.random.default_rng(5)
    points = points[draw.permutation(len(points))]
    centre = np.unique(points, axis=0)
    centre = centre[draw.permutation(len(centre))[:count]].copy()
    for _ in range(rounds):
        near = nearest(points, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centre))
        centre[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centre


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(axis=1) - 2 * points @ centre.T, axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells by falling sum of the halves' products, until they hold ``enough`` entries."""
    order_a, order_b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[order_a].tolist(), second[order_b].tolist()
    heap, cells, held = [(-a[0] - b[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = order_a[i] * len(b) + order_b[j]
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))
    return cells


def _merged(ids: np.ndarray, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct vectors, the ``most`` smallest distinct ids of each in a row, and their offsets."""
    keys = matrix.view(np.dtype((np.void, matrix.shape[1] * matrix.itemsize))).ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    ids, group = ids[order], group[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
    ids, group = ids[new], group[new]
    starts = np.searchsorted(group, np.arange(len(first)))
    kept = np.arange(len(ids)) - starts[group] < most
    return first, ids[kept], np.concatenate(([0], np.cumsum(np.bincount(group[kept], minlength=len(first)))))


def _best(
    queries: np.ndarray, wanted: np.ndarray, entries: np.ndarray, cell: np.ndarray, ids: np.ndarray, offsets: np.ndarray, own: np.ndarray, k: int
):
    """Per query the best k ids but its own in its cells, each once, and exact scores; equal vectors score equal."""
    count = np.diff(offsets)
    rough = queries @ entries.T
    rough[~wanted[:, cell] | ((count == 1) & (own[:, None] == ids[offsets[:-1]]))] = -np.inf
    for q in range(len(queries)):
        row = rough[q]
        open_ = np.flatnonzero(row > -np.inf)
        most = k
        while True:
            near = open_
            if len(open_) > most:
                least = np.partition(row[open_], len(open_) - most)[len(open_) - most]
                near = open_[row[open_] >= least - 1e-9 * max(1.0, abs(least))]
            exact = np.repeat((entries[near] * queries[q]).sum(axis=1), count[near])
            found = np.concatenate([ids[offsets[e] : offsets[e + 1]] for e in near]) if len(near) else ids[:0]
            other = found != own[q]
            found, exact = found[other], exact[other]
            order = np.lexsort((found, -exact))
            _, once = np.unique(found[order], return_index=True)
            if len(once) >= k or len(near) == len(open_):
                break
            most *= 2  # ids that several vectors have
        order = order[np.sort(once)[:k]]
        yield q, found[order], exact[order]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    count: int = CENTROIDS, entries: int = ENTRIES, share: float = SHARE, store: Store | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k found with the largest inner product, nearest first, ties by id.

    All rows of ``vectors`` are indexed and candidates of all ``queries`` (same columns) but those
    with their own id; fewer than k are all returned. Vectors that are null, zero, of another length than most or hold
    null or non-finite components take no part, nor do rows with a null id. Repeated ids count
    once, by their best score. Each distinct vector is indexed once, with its k + 1 smallest ids, which
    suffice for any query. The centroids are fitted on a sample of about SAMPLE distinct vectors; a query
    reranks at least ``entries`` distinct vectors and ``share`` of all.
    """
    spark = vectors.sparkSession
    store = store or Store(spark, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    empty = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    size = lengths["n"]
    half = size // 2

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, matrix = usable(batch, size)
            matrix = matrix + 0.0  # no -0.0
            first, ids, offsets = _merged(batch.column(0).take(pa.array(kept)).to_numpy(), matrix, k + 1)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([lists, pa.array([matrix[e].tobytes() for e in first], pa.binary())], ["ids", "v"])

    # A hot vector is one row a batch, of at most k + 1 ids.
    together = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    distinct = store.put(rows.mapInArrow(merged, "ids array<long>, v binary").groupBy("v").agg(together.alias("ids")), "distinct")
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], empty)
    fraction = min(1.0, SAMPLE / total)
    drawn = distinct.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(fraction * (1 << 30))).select("v")
    sample = [np.frombuffer(r[0]) for r in drawn.collect()]
    points = np.array(sample)
    books = spark.sparkContext.broadcast((centroids(points[:, :half], count), centroids(points[:, half:], count)))
    columns = len(books.value[1])
    per = -(-len(books.value[0]) // GROUPS) * columns  # cells of a group

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, size)
            cell = nearest(matrix[:, :half], first) * columns + nearest(matrix[:, half:], second)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), batch.column(1)], ["ids", "cell", "v"])

    indexed = store.put(distinct.select("ids", "v").mapInArrow(celled, "ids array<long>, cell int, v binary"), "indexed")
    counts = np.zeros(len(books.value[0]) * columns, np.int64)
    for cell, n in indexed.groupBy("cell").count().collect():  # at most count * count rows
        counts[cell] = n
    enough = int(max(entries, share * counts.sum()))
    sizes = spark.sparkContext.broadcast(counts)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for batch in batches:
            kept, matrix = usable(batch, size)
            ids = batch.column(0).take(pa.array(kept)).to_numpy()
            a, b = matrix[:, :half] @ first.T, matrix[:, half:] @ second.T
            query, group, cells, v = [], [], [], []
            for q in range(len(kept)):
                by_group: dict[int, list[int]] = {}
                for cell in traverse(a[q], b[q], sizes.value, enough):
                    by_group.setdefault(cell // per, []).append(cell % per)
                for g, own in by_group.items():
                    query.append(int(ids[q]))
                    group.append(g)
                    cells.append(np.array(own, np.int32).tobytes())
                    v.append(matrix[q].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()), pa.array(group, pa.int32()), pa.array(cells, pa.binary()), pa.array(v, pa.binary())],
                ["query_id", "grp", "cells", "v"],
            )

    probes = store.put(asked.mapInArrow(probing, "query_id long, grp int, cells binary, v binary"), "probes")
    probed = {g: n for g, n in probes.groupBy("grp").count().collect()}  # at most GROUPS rows
    by_group = np.add.reduceat(counts, np.arange(0, len(counts), per))
    plan = spark.createDataFrame(
        [(g, int(-(-by_group[g] // BIN)), int(-(-probed[g] // BIN))) for g in probed], "grp int, of_entries int, of_queries int"
    )
    plan = F.broadcast(plan)  # at most GROUPS rows
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = (
        indexed.withColumn("grp", F.floor(F.col("cell") / per).cast("int")).join(plan, "grp")
        .withColumn("e", F.pmod(F.xxhash64("v"), F.col("of_entries")).cast("int")).withColumn("q", span("of_queries"))
        .select("grp", "e", "q", "ids", (F.col("cell") % per).alias("cell"), "v")
    )
    wanted = (
        probes.join(plan, "grp").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("of_queries")).cast("int"))
        .withColumn("e", span("of_entries")).select("grp", "e", "q", "query_id", "cells", "v")
    )

    def reranked(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            lists = left["ids"].combine_chunks()
            ids, cell = lists.flatten().to_numpy(), left["cell"].to_numpy()
            offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            matrix = np.frombuffer(b"".join(left["v"].to_pylist())).reshape(-1, size)
            own = right["query_id"].to_numpy()
            asked_ = np.frombuffer(b"".join(right["v"].to_pylist())).reshape(-1, size)
            cells = right["cells"].to_pylist()
            for at in range(0, len(own), 512):
                some = cells[at : at + 512]
                open_ = np.zeros((len(some), per), bool)
                for r, c in enumerate(some):
                    open_[r, np.frombuffer(c, np.int32)] = True
                for q, found, scores in _best(asked_[at : at + 512], open_, matrix, cell, ids, offsets, own[at : at + 512], k):
                    out[0].append(np.full(len(found), own[at + q]))
                    out[1].append(found)
                    out[2].append(scores)
        columns_ = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table(
            [pa.array(columns_[0], pa.int64()), pa.array(columns_[1], pa.int64()), pa.array(columns_[2], pa.float64())],
            ["query_id", "vec_id", "score"],
        )

    keys = ["grp", "e", "q"]
    scored = held.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(reranked, "query_id long, vec_id long, score double")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
