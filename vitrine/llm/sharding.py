"""Sharding by balanced label propagation.

Documents that share a hub (here: an equal text) are linked. All start in a shard
given by hash. Hubs that take a good part of a shard are placed first, the largest
first, in the shard that holds most of them, else in the emptiest; one larger than a
shard fills several. Then, in each round, every other hub whose documents still lie in
several shards, or in one that never granted it room, asks for the shard that holds
most of them, among shards where it fits, else for one drawn by the room left. Shards grant what
they have room for; the documents of granted hubs move there together. What is granted
no room, and documents without links, fill the rest of the shards hub by hub, so that
counts end at most one apart and a shard's border cuts a hub at most.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store

SHARDS = 40
#: Rounds of asking, at most; hubs left after them are dealt one after another, which keeps them together too.
ROUNDS = 16
#: Hubs above this part of a quota are placed one by one: fewer than ``LARGE`` a shard.
LARGE = 8
#: Rounds end once they grant less than this part of the room that is left.
WORTH = 100


def _fraction(*columns) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _of_shard(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), shard + 1)


def packed(large: list[tuple], quotas: list[int]) -> tuple[list[tuple], list[int]]:
    """``(which, low, high, shard)``: documents low to high - 1 of hub ``which`` go to a shard; and the room left.

    ``large`` has (documents, shard that holds most of them) of each hub. Hubs are placed by falling size, whole where
    they fit; the quotas add up to the number of documents at least.
    """
    room = list(quotas)
    shards = range(len(room))
    parts = []
    for which, (size, home) in sorted(enumerate(large), key=lambda r: (-r[1][0], r[0])):
        shard = home if room[home] >= max(1, min(size, quotas[home])) else max(shards, key=room.__getitem__)
        done = 0
        while done < size:
            n = min(size - done, room[shard])
            parts.append((which, done, done + n, shard))
            room[shard] -= n
            done += n
            shard = max(shards, key=room.__getitem__)
    return parts, room


def _drawn(room: list[int], *columns) -> Column:
    """A shard by hash, as likely as its share of the room."""
    sums = list(accumulate(room))
    at = _fraction(*columns) * sums[-1]
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in sums[:-1]]), lambda v: v <= at)) if len(room) > 1 else F.lit(0)


def propagate(counts: DataFrame, room: list[int], rounds: int, store: Store) -> DataFrame:
    """``(hub, target)`` for the hubs of ``counts(hub, hub_size, shard, n)`` that were granted room.

    A hub asks where most of its documents lie (ties by hash), as long as it fits there. A shard asked
    for more than its room grants each with the chance that this allows, so it may end a little above; the caller
    evens that out. Only sums by shard come to the driver.
    """
    left, granted = store.put(counts, "left0"), counts.select("hub", F.col("shard").alias("target")).limit(0)
    for k in range(rounds):
        if not any(room):
            break
        fits = _of_shard(room, F.col("shard")) >= F.col("hub_size")
        own = F.max(F.when(fits, F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")))
        asked = left.groupBy("hub", "hub_size").agg(own.alias("own")).select(
            "hub", "hub_size", F.coalesce("own.shard", _drawn(room, F.lit(-1 - k), "hub")).alias("target")
        )
        asked = store.put(asked, f"asked{k}")
        demand = {t: n for t, n in asked.groupBy("target").agg(F.sum("hub_size")).collect()}
        if not demand:
            break
        chance = [min(1.0, room[s] / demand[s]) if demand.get(s) else 0.0 for s in range(len(room))]
        won = store.put(asked.where(_fraction(F.lit(k), "hub") < _of_shard(chance, F.col("target"))), f"won{k}")
        taken = {t: n for t, n in won.groupBy("target").agg(F.sum("hub_size")).collect()}
        room = [max(0, r - taken.get(s, 0)) for s, r in enumerate(room)]
        granted = granted.union(won.select("hub", "target"))
        left = store.put(left.join(won.select("hub"), "hub", "left_anti"), f"left{k + 1}")
        store.drop(f"left{k}", f"asked{k}")
        if sum(taken.values()) * WORTH < sum(room):
            break
    return granted


def numbered(rows: DataFrame, group: str, groups: int, order: list, store: Store) -> DataFrame:
    """``rows`` with ``place``: the number, from 0, within ``group`` (0 to groups - 1) by ``order``.

    The rows are range partitioned and sorted, then written with a running number; what each part
    holds of each group is counted afterwards, so no group has to fit in a task.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = store.put(ranged.withColumn("number", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("number", 33).alias("part")
    parts = kept.groupBy(part, group).agg(F.count("*").alias("n"), F.min("number").alias("low")).collect()  # parts + groups rows
    done = [0] * groups
    starts = []
    for r in sorted(parts):
        starts.append((r["part"], r[group], done[r[group]] - r["low"]))
        done[r[group]] += r["n"]
    shift = rows.sparkSession.createDataFrame(starts, f"part long, {group} int, shift long")
    joined = kept.withColumn("part", F.shiftright("number", 33)).join(F.broadcast(shift), ["part", group])
    return joined.withColumn("place", F.col("number") + F.col("shift")).drop("part", "number", "shift")


def by_rows(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, store: Store | None = None
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row; law ``rows``.

    Counts of the shards are at most one apart, the first ones holding one more. ``size`` is
    the UTF-8 length plus 16; a null text has no bytes, so its crc32 is 0, and no links.
    Equal texts are linked; a hub larger than a shard fills several. Repeated rows are
    documents of their own, rows with a null id too. ``slot`` counts from 0 without gaps.
    """
    spark = docs.sparkSession
    store = store or Store(spark, "shards")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("hub"), text).alias("b"))).alias("hub"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = store.put(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    held = rows.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    hubs = held.groupBy("hub").agg(F.sum("n").alias("hub_size"), F.collect_list(F.struct("n", "shard")).alias("held"))  # one entry a shard
    hubs = store.put(hubs.where("hub_size > 1"), "hubs")
    is_large = F.col("hub_size") * LARGE > quotas[0]
    large = hubs.where(is_large).select("hub", "hub_size", F.array_max("held").getField("shard")).collect()  # below LARGE * shards rows
    parts, room = packed([(n, home) for _, n, home in large], quotas)
    granted = propagate(hubs.where(~is_large).select("hub", "hub_size", F.inline("held")), room, rounds, store)

    columns = ["doc_id", "size", "text_crc32", "hub", "row", "hub_size", "target"]
    named = spark.createDataFrame([(*r[:2], k) for k, r in enumerate(large)], "hub struct<a:long,b:long>, hub_size long, which int")
    named, parts = F.broadcast(named), F.broadcast(spark.createDataFrame(parts, "which int, low long, high long, target int"))
    of_large = numbered(rows.drop("shard").join(named, "hub"), "which", len(large), ["doc_id", "row"], Store(spark, "large"))
    of_large = of_large.join(parts, "which").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select(columns)
    labels = hubs.where(~is_large).select("hub", "hub_size").join(granted, "hub", "left")
    others = rows.join(named.select("hub"), "hub", "left_anti").join(labels, "hub", "left")
    others = others.withColumn("hub_size", F.coalesce("hub_size", F.lit(1))).select(columns)
    placed = store.put(of_large.union(others).withColumnRenamed("target", "label"), "placed")
    order = [F.desc("hub_size"), "hub", "doc_id", "row"]
    ranked = numbered(placed.where("label is not null"), "label", shards, order, store)
    loads = [0] * shards
    for label, n in ranked.groupBy("label").count().collect():
        loads[label] = n
    out = F.col("place") >= _of_shard(quotas, F.col("label"))
    rest = ranked.where(out).drop("place").unionByName(placed.where("label is null"))
    rest = numbered(rest.withColumn("label", F.lit(0)), "label", 1, order, Store(spark, "rest"))
    under = [max(0, q - n) for n, q in zip(loads, quotas, strict=True)]
    by_room = sorted(range(shards), key=lambda s: -under[s])
    first = dict(zip(by_room, accumulate([0] + [under[s] for s in by_room[:-1]]), strict=True))
    target = reduce(lambda c, s: F.when(F.col("place") >= F.lit(first[s]), F.lit(s)).otherwise(c), [s for s in by_room if under[s]], F.lit(0))
    shift = [min(n, q) - first[s] for s, (n, q) in enumerate(zip(loads, quotas, strict=True))]
    names = ["doc_id", "size", "text_crc32"]
    stay = ranked.where(~out).select(*names, F.col("label").alias("shard"), F.col("place").alias("slot"))
    filled = rest.withColumn("shard", target).select(*names, "shard", (F.col("place") + _of_shard(shift, F.col("shard"))).alias("slot"))
    return stay.union(filled).select(
        *names, F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
