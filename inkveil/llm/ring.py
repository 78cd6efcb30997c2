"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VNODES`` arcs of a ring.  A row's key gives its place on
the ring.  A shard takes at most its share of all rows (shares differ by one at
most); rows that come to a full shard go on clockwise to the next arc whose
shard has room.  So counts are balanced by construction, and only overflowing
rows leave the place that the ring alone would give them.

Rows within an arc are ranked by (bucket of doc_id, doc_id): an arc that holds
a third of all rows is numbered in ``BUCKETS`` pieces.  What reaches the driver
is one count per arc and bucket, a fixed number.

Edge cases: a NULL text has size 1 and the key of the empty text; rows alike in
all columns get different slots; NULL ids sort first; an empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

VNODES = 64
BUCKETS = 32


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """``(place, shard)`` of each virtual node, clockwise; a node owns the places from the one before it up to its own."""
    return sorted(
        (int.from_bytes(hashlib.sha256(f"{shard}/{i}".encode()).digest()[:4], "big"), shard)
        for shard in range(shards) for i in range(vnodes)
    )


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def segments(counts: Sequence[int], owners: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first rank, rank after the last, shard, first slot)`` of the rows of every arc.

    First each arc gives its own shard what that has room for; then the rest
    goes on clockwise.
    """
    room, used = [*room], [0] * len(room)
    pieces = []

    def put(arc: int, begin: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            pieces.append((arc, begin, begin + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    placed = [put(arc, 0, n, owners[arc]) for arc, n in enumerate(counts)]
    for arc, n in enumerate(counts):
        at = arc
        while placed[arc] < n:
            at = (at + 1) % len(owners)
            placed[arc] += put(arc, placed[arc], n - placed[arc], owners[at])
    return pieces


def sharded(df: DataFrame, key: Column, doc_id: str, shards: int, into: Sequence[str] = ("shard", "slot")) -> DataFrame:
    """Add the shard and the gapless slot of each row; ``key`` is a string, rows of one key start at one place."""
    nodes = ring(shards)
    places = [place for place, _ in nodes]
    # Arc of a place by the leading bits, then along the few nodes there; places above the last node belong to the first.
    arcs = F.array(*map(F.lit, places))
    place = F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 8), 16, 10).cast("long")
    cells = 256
    first = [bisect.bisect_left(places, (c << 32) // cells) for c in range(cells)]
    begin = F.element_at(F.array(*map(F.lit, first)), (F.col("ring_place") * cells / (1 << 32)).cast("int") + 1)
    rest = F.slice(arcs, begin + 1, F.lit(max((b - a for a, b in zip(first, [*first[1:], len(places)])), default=0) + 1))
    arc = (begin + F.size(F.filter(rest, lambda p: p < F.col("ring_place")))) % len(nodes)
    rows = (
        df.withColumn("ring_place", place).withColumn("ring_arc", arc.cast("int"))
        .withColumn("ring_bucket", F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")).drop("ring_place")
    )
    counted = {(r.ring_arc, r.ring_bucket): r["count"] for r in rows.groupBy("ring_arc", "ring_bucket").count().collect()}
    starts, totals = [], []
    for a in range(len(nodes)):
        total = 0
        for b in range(BUCKETS):
            starts.append(total)
            total += counted.get((a, b), 0)
        totals.append(total)
    pieces = segments(totals, [s for _, s in nodes], capacities(sum(totals), shards))
    # At most one piece per arc and shard; their ranks cut the arc.
    cuts: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for piece in pieces:
        cuts.setdefault(piece[0], []).append(piece)
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(a, b, starts[a * BUCKETS + b], [(p[1], p[2], p[3], p[4]) for p in cuts[a]]) for (a, b) in counted],
        "ring_arc int, ring_bucket int, ring_start long, ring_cuts array<struct<first:long,after:long,shard:int,slot:long>>",
    )
    order = Window.partitionBy("ring_arc", "ring_bucket").orderBy(doc_id, *(c for c in df.columns if c != doc_id and sortable(df, c)))
    ranked = rows.withColumn("ring_rank", F.row_number().over(order)).join(F.broadcast(table), ["ring_arc", "ring_bucket"])
    rank = F.col("ring_start") + F.col("ring_rank") - 1
    cut = F.filter("ring_cuts", lambda c: (c["first"] <= rank) & (rank < c["after"]))[0]
    return (
        ranked.withColumn("ring_cut", cut)
        .withColumn(into[0], F.col("ring_cut.shard"))
        .withColumn(into[1], F.col("ring_cut.slot") + rank - F.col("ring_cut.first"))
        .select(*(F.col(f"`{c}`") for c in df.columns), *into)
    )


def sortable(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (T.MapType, T.VariantType))
