"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  The pieces are dealt to
partitions of bounded size, and each partition packs its pieces best-fit
decreasing.  Dual feasible functions give a lower bound of the bins that any
packing of the same pieces needs.  A partition that meets its bound is done,
certified.  A partition with a gap gives up bins, the emptiest first; their
pieces meet those of other partitions and are packed again.  Certified ones give
up their emptiest bin alone, as dealing into partitions leaves one bin half
filled in each.  A repacking counts
only where it needs fewer bins, so rounds never make things worse.

Edge cases: a NULL text is empty and still yields its end token; repeated rows
are packed each for itself; a piece of full length has a sequence to itself; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkveil.llm.bpe import transducer
from inkveil.llm.common import staged

CAPACITY = 2048
END_ID = 0
# Pieces of a partition, on average; and rounds of exchange after the first packing.
PARTITION_PIECES = 20_000
ROUNDS = 3
# Bins given up per missing bin: the emptiest ones, whose pieces find new places most easily.
RELEASE = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of a text's ids and the end id; the ids themselves stay in the worker."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, width = transducer(path), 4 * capacity
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], machine.encode_all(batch["text"])):
                ids = memoryview(ids + end)
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, PIECES)


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices into ``lengths``, each in the fullest bin that still holds it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms: list[int] = []  # the rooms that occur, ascending
    for i in order:
        at = bisect_left(rooms, lengths[i])
        if at == len(rooms):
            number, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            number = room_of[room].pop()
            if not room_of[room]:
                rooms.pop(at)
        bins[number].append(i)
        left = room - lengths[i]
        if left:
            if not room_of[left]:
                insort(rooms, left)
            room_of[left].append(number)
    return bins


def lower_bound(lengths: Sequence[int], capacity: int) -> int:
    """Bins that any packing needs, from dual feasible functions of the lengths.

    For each threshold t up to half the capacity: pieces above capacity - t
    count as a whole bin, those below t as nothing, the others as their length.
    For each number k: a piece counts as the parts of 1/k that it surely fills.
    Weights that fit together never exceed one bin, so their sum rounded up is
    a bound.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for k in range(2, 21):
        parts = (k + 1) * sizes
        weight = np.where(parts % capacity == 0, k * sizes, (parts // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * weight).sum()) // (k * capacity)))
    return best


_PACKED = f"{PIECES}, pack_row long, part long, bin long, offset long, gap long, released boolean"


def _pack(capacity: int, release: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        """Pack one partition.  ``old`` numbers the bins its pieces come from; they stay if no fewer are needed now."""
        group = group.sort_values(["length", "pack_row"], ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins = best_fit(lengths.tolist(), capacity)
        before = [*group.groupby("old").indices.values()] if "old" in group else []
        if before and len(before) <= len(bins):
            bins = before
        number, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        fill = np.empty(len(bins), np.int64)
        for b, members in enumerate(bins):
            ends = np.cumsum(lengths[members])
            number[members], offset[members], fill[b] = b, ends - lengths[members], ends[-1]
        gap = len(bins) - lower_bound(lengths, capacity)
        given = np.zeros(len(bins), bool)
        if release:
            given[np.argsort(fill, kind="stable")[: max(1, RELEASE * gap)]] = True
        return group.assign(bin=number, offset=offset, gap=gap, released=given[number]).drop(columns="old", errors="ignore")

    return pack


def packed(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``, and ``gap``: the bins above the bound in the partition packed last."""
    rows = staged(pieces.withColumn("pack_row", F.monotonically_increasing_id()), "pack-pieces")
    full = rows.where(F.col("length") == capacity).select(
        *pieces.columns, (-1 - F.col("pack_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap")
    )
    todo = rows.where(F.col("length") < capacity)
    done = full
    for turn in range(rounds + 1):
        # What is given up is far less than all, so those who exchange meet in as few, full-sized groups as can be.
        parts = max(1, -(-todo.count() // (max(partition_pieces, PARTITION_PIECES) if turn else partition_pieces)))
        spread = F.xxhash64("old") if turn else F.xxhash64("pack_row")
        dealt = todo.withColumn("part", F.pmod(spread, F.lit(parts)).cast("long"))
        out = staged(dealt.groupBy("part").applyInPandas(_pack(capacity, turn < rounds), _PACKED), f"pack-{turn}")
        number = F.lit(turn << 58) + F.shiftleft("part", 26) + F.col("bin")
        done = done.union(out.where("NOT released").select(*pieces.columns, number.alias("sequence_id"), "offset", "gap"))
        todo = out.where("released").select(*pieces.columns, "pack_row", number.alias("old"))
        if not todo.take(1):
            break
    return done


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of the documents with its sequence and place there."""
    return packed(pieces_of(docs, path, doc_id, text, capacity), capacity)
