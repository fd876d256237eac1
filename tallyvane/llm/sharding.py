"""Sharding by balanced label propagation, in DataFrame operations only.

A hub is a set of linked documents. Large hubs (a bounded number: over a 64th of a
shard) are placed first, largest first, from their counts alone: whole into the
fullest shard that still has room, else cut at shard limits into the emptiest ones.
Documents of the other hubs start in the shard of a hub's hash, by the room left. In
each round every hub counts its members per shard, each document asks for the shard
where its hubs have most members, and requests are granted while the shard has
room for linked documents: a request passes if a hash falls below room / requests.
Equal texts have the same hubs, ask for the same shard and pass together; hubs of
openings and long lines join different texts, and by them near copies move towards each other.
What is over a shard's room moves on hub by hub. Documents without links fill what is
left, so shard sizes come out exact. Shard totals and the counts of large hubs
(at most 64 per shard) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import unit, with_running_total
from tallyvane.operators.materialize import materialize


def _lookup(values: list, index: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[index]


def _totals(rows: DataFrame, column: str, n_shards: int) -> list[int]:
    found = {r[column]: r["n"] for r in rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def pack(sizes: list[tuple[int, int]], quota: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (hub, start, end, shard) for (hub, rows), largest first; a hub is cut only if no shard has room for it."""
    room, pieces = list(quota), []
    for hub, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        start = 0
        while start < n:
            fits = [s for s, r in enumerate(room) if r >= n - start]
            s = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            end = min(n, start + room[s])
            pieces.append((hub, start, end, s))
            room[s] -= end - start
            start = end
    return pieces


def place_large(rows: DataFrame, links: DataFrame, quota: list[int]) -> DataFrame:
    """(node, shard) of the members of hubs over a 64th of a shard; a member of several goes with the largest."""
    sizes = links.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(1, min(quota, default=0) // 64))
    own = links.join(sizes, "hub").groupBy("node").agg(F.max_by("hub", F.struct("_n", "hub")).alias("hub"))
    own = materialize(own.join(rows.select("node", "digest"), "node"))
    held = [(r["hub"], r["n"]) for r in own.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).collect()]
    pieces = links.sparkSession.createDataFrame(pack(held, quota), "hub bigint, _start bigint, _end bigint, shard int")
    ranked = with_running_total(own, "hub", "digest", ["node"], F.lit(1), max((n for _, n in held), default=0), "_rank")
    met = ranked.join(F.broadcast(pieces), "hub").where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
    return materialize(met.select("node", "shard"))


def propagate(links: DataFrame, room: list[int], rounds: int = 8, seed: int = 11) -> DataFrame:
    """(node, shard) of all nodes of ``links`` (node bigint, hub bigint), moved towards their neighbours.

    ``room`` is the number of linked nodes that each shard may hold; granted moves
    keep to it on average and the caller settles the rest.
    """
    n = len(room)
    ends = F.array(*[F.lit(float(sum(room[:s + 1]))) for s in range(n)])
    # a hub's members start together, in a shard that has room
    at = unit("hub", F.lit(seed)) * float(sum(room))
    labels = materialize(links.groupBy("node").agg(F.min("hub").alias("hub")).select(
        "node", "hub", F.least(F.size(F.filter(ends, lambda e: e <= at)), F.lit(n - 1)).cast("int").alias("shard")))
    for turn in range(rounds):
        load = _totals(labels, "shard", n)
        counts = links.join(labels.drop("hub"), "node").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("c"))
        # equal counts are settled alike for all members of a hub
        counts = counts.withColumn("c", F.col("c") + 0.01 * unit("hub", "shard", F.lit(seed)))
        free = [r - x for r, x in zip(room, load)]
        votes = links.join(counts, "hub").groupBy("node", "shard").agg(F.sum("c").alias("c")).withColumnRenamed("shard", "to")
        wish = votes.join(labels.withColumnRenamed("hub", "own"), "node").where((F.col("to") == F.col("shard")) | (_lookup(free, F.col("to")) > 0))
        wish = wish.groupBy("node", F.col("own").alias("hub"), "shard").agg(F.max_by("to", F.struct("c", "to")).alias("to"))
        wish = materialize(wish)
        asked = _totals(wish.where("to != shard"), "to", n)
        if not any(asked):
            break
        pass_rate = [min(1.0, f / a) if a and f > 0 else 0.0 for f, a in zip(free, asked)]
        # by the hub that a node started with: nodes with the same hubs move together
        granted = unit("hub", F.lit(seed + 1), F.lit(turn)) < _lookup(pass_rate, F.col("to"))
        labels = materialize(wish.select("node", "hub", F.when(granted, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return labels.drop("hub")


def balanced_shards(docs: DataFrame, links: DataFrame, n_shards: int = 40, rounds: int = 8, near: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` (node bigint unique, digest and group hex strings) with shard and slot.

    ``links`` has (node, hub); nodes that share a hub are linked. Shard counts differ
    by one at most; slots number a shard's rows from 0 without gaps. A hub is cut only
    where shards have no room for the whole of it. ``near`` has further links (node, hub, group)
    that only draw nodes together; nodes of one group must have the same. A hub of these
    over a quarter of a shard acts as several of about that size, groups whole, each of which
    a shard can take. Columns ``shard`` and ``slot`` are replaced.
    """
    rows = docs.drop("shard", "slot")
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    sizes = links.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    links = materialize(links.join(sizes, "hub").select("node", "hub"))
    large = place_large(rows, links, quota)
    taken = _totals(large, "shard", n_shards)
    room = [q - x for q, x in zip(quota, taken)]
    if near is not None:
        drawn = near.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        parts = F.ceil(F.col("_n") / max(2, min(quota, default=0) // 4))
        part = F.when(parts > 1, F.xxhash64("hub", F.pmod(F.xxhash64("group"), parts))).otherwise(F.col("hub"))
        links = links.unionByName(near.join(drawn, "hub").select("node", part.alias("hub")))
    links = materialize(links.join(large, "node", "left_anti"))
    labels = propagate(links, room, rounds).join(links.groupBy("node").agg(F.min("hub").alias("_hub")), "node")
    fixed = rows.join(large, "node")
    rows = materialize(rows.join(large, "node", "left_anti").join(labels, "node", "left").withColumn(
        "_order", F.concat(F.coalesce(F.concat(F.md5(F.col("_hub").cast("string")), "group"), F.lit("")), "digest")).drop("_hub"))
    linked = rows.where("shard IS NOT NULL")
    load = _totals(linked, "shard", n_shards)
    # what is over a shard's room, hub by hub, joins the rows that are free to go anywhere
    ranked = with_running_total(linked, "shard", "_order", ["node"], F.lit(1), max(load, default=0), "_rank")
    ranked = materialize(ranked.withColumn("shard", F.when(F.col("_rank") < _lookup(room, F.col("shard")), F.col("shard"))).drop("_rank"))
    free = ranked.where("shard IS NULL").unionByName(rows.where("shard IS NULL"))
    settled = ranked.where("shard IS NOT NULL").drop("_order").unionByName(fixed)
    held = [x + min(r, y) for x, r, y in zip(taken, room, load)]
    ends, at = [], 0
    for q, h in zip(quota, held):
        at += q - h
        ends.append(at)
    free = with_running_total(free.withColumn("_all", F.lit(0)), "_all", "_order", ["node"], F.lit(1), at, "_rank")
    boundaries = F.array(*[F.lit(e).cast("long") for e in ends])
    free = free.withColumn("shard", F.size(F.filter(boundaries, lambda e: e <= F.col("_rank"))).cast("int")).drop("_all", "_rank", "_order")
    placed = settled.unionByName(free)
    slots = with_running_total(placed, "shard", "digest", ["node"], F.lit(1), max(quota, default=0), "slot")
    return slots.withColumn("slot", F.col("slot").cast("long"))


def _near_hubs(text: str) -> Column:
    """Hubs of a text's opening and of all its long lines, by letters and digits alone.

    The opening is the first 64 of them, all if there are fewer; a line is long with 64.
    """
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", "")
    opening = F.nullif(F.substring(F.replace(words, F.lit("\n"), F.lit("")), 1, 64), F.lit(""))
    long = F.array_distinct(F.filter(F.split(words, "\n"), lambda line: F.length(line) >= 64))
    return F.concat(F.array_compact(F.array(F.when(opening.isNotNull(), F.xxhash64(F.lit("opening"), opening)))),
                    F.transform(long, lambda line: F.xxhash64(F.lit("line"), line)))


def shard_documents(docs: DataFrame, n_shards: int = 40, rounds: int = 8) -> DataFrame:
    """Shard rows of (doc_id, text) so that equal texts share a shard: doc_id, size, text_crc32, shard, slot.

    Law ``rows``: counts of shards differ by one at most. ``size`` is UTF-8 bytes plus
    16, 16 for a null text; null texts are linked with nothing, empty ones with each
    other; the crc32 of a null text is null. Texts with the same opening or a long line in
    common, wherever it stands, draw each other into a shard. Repeated rows, also of one id, are rows
    of their own. Other columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select("doc_id", F.col("text")).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.md5("text").alias("group"),
        _near_hubs("text").alias("_near"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"))
    rows = materialize(narrow.withColumn("node", F.monotonically_increasing_id()))
    links = rows.where("group IS NOT NULL").select("node", F.xxhash64("group").alias("hub"))
    near = rows.select("node", "group", F.explode("_near").alias("hub"))
    placed = balanced_shards(rows.drop("_near"), links, n_shards, rounds, near)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")
