"""Committed batches of a lake folder, and the snapshot of them that readers see.

A refresh, an arrival of files, a merge or a replay writes its tables to folders that nobody reads, then commits: one small JSON
file, numbered one higher than the last and put in place by a rename that fails if the number is
taken. So of two writers one commits, and readers see a batch whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

REFRESH = "refresh"
_ENTRY = "number long, kind string, batch string, last_run long, layer string, source_table string, path string, buckets array<int>, modulus int, merged long"


class ConcurrentCommit(Exception):
    """Another writer committed first; what was written isn't seen, and the job can be run again."""


@dataclass(frozen=True)
class Part:
    """A folder with rows of one table of one layer; with buckets, a folder for each of them.

    ``modulus`` is the number of buckets that the keys of the table are dealt to, ``merged`` the commit up to
    which arrivals are in a treated part.
    """

    layer: str
    source_table: str
    path: str
    buckets: tuple[int, ...] | None = None
    modulus: int | None = None
    merged: int | None = None


@dataclass(frozen=True)
class Snapshot:
    """What is committed: the last refresh and all batches since."""

    out: str
    number: int = 0  # of the last commit
    last_run: int = 0
    refreshed: bool = False
    batches: frozenset[str] = frozenset()
    parts: list[tuple[int, Part]] = field(default_factory=list)  # with the number of their commit

    def of(self, layer: str, table: str | None = None) -> list[tuple[int, Part]]:
        return [(n, p) for n, p in self.parts if p.layer == layer and table in (None, p.source_table)]

    def tables(self, layer: str) -> list[str]:
        return sorted({p.source_table for _, p in self.of(layer)})

    def paths(self, layer: str, table: str, buckets: set[int] | None = None) -> list[str]:
        """The folders with the rows of a table; where it has buckets, the last one written of each."""
        whole, last = [], {}
        for _, part in self.of(layer, table):
            if part.buckets is None:
                whole.append(part.path)
            for b in part.buckets or ():
                last[b] = f"{part.path}/bucket={b}"
        return [f"{self.out}/{p}" for p in [*whole, *(last[b] for b in sorted(last) if buckets is None or b in buckets)]]


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _folder(out: str) -> str:
    return f"{out}/manifest"


def snapshot(spark: SparkSession, out: str) -> Snapshot:
    """The committed state; empty where nothing was committed yet."""
    system, place = _system(spark, _folder(out))
    if not system.exists(place):
        return Snapshot(out)
    commits = spark.read.schema(_ENTRY).json(_folder(out))
    base = commits.filter(F.col("kind") == REFRESH).agg(F.max("number").alias("base"))
    since = commits.crossJoin(base).filter("base is null or number >= base")  # one row
    rows = since.orderBy("number").collect()
    if not rows:
        return Snapshot(out)
    parts = [
        (r["number"], Part(r["layer"], r["source_table"], r["path"], None if r["buckets"] is None else tuple(r["buckets"]), r["modulus"], r["merged"]))
        for r in rows if r["layer"] is not None
    ]
    return Snapshot(
        out, rows[-1]["number"], max(r["last_run"] for r in rows), rows[0]["kind"] == REFRESH, frozenset(r["batch"] for r in rows),
        _latest(parts),
    )


def _latest(parts: list[tuple[int, Part]]) -> list[tuple[int, Part]]:
    """What a replay leaves in quarantine replaces what was there before."""
    kept: list[tuple[int, Part]] = []
    for number, part in parts:
        if part.layer == "quarantine":
            kept = [(n, p) for n, p in kept if (p.layer, p.source_table) != (part.layer, part.source_table) or n == number]
        kept.append((number, part))
    return kept


def commit(spark: SparkSession, before: Snapshot, kind: str, batch: str, parts: list[Part], last_run: int = 0) -> int:
    """Make a batch seen, as the next commit after ``before``; its number. Raises ConcurrentCommit if that number is taken."""
    number = before.number + 1
    note = {"number": number, "kind": kind, "batch": batch, "last_run": max(last_run, before.last_run)}
    lines = [
        json.dumps(note | asdict(p)) for p in parts
    ] or [json.dumps(note)]
    jvm, folder = spark.sparkContext._jvm, _folder(before.out)
    system, hidden = _system(spark, f"{folder}/_{uuid.uuid4().hex}")
    stream = system.create(hidden, False)
    stream.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    stream.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/commit-{number:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(hidden, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        system.delete(hidden, False)
        if system.exists(final):
            raise ConcurrentCommit(f"commit {number} of {before.out} was made by another writer") from error
        raise
    return number


def read(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """The rows of some folders; none gives no rows."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
