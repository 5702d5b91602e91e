"""Consistent-hash ring with virtual nodes and bounded loads.

A row's key is hashed to one of ``CELLS`` cells of the ring. Every shard stands on
the ring ``vnodes`` times. The keys of a cell belong to the next shard clockwise;
those that no longer fit into it go on to the next shard that still has room.

Only the row counts of the cells (a fixed number of rows, whatever the input) reach
the driver, which deals out *ranges of ranks within a cell*. The rows take their shard and their
slot from the range that holds their rank, so no row meets another shard's rows and
one shuffle by cell suffices.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmine.llm.common import text_or_empty
from threadmine.session import stage

CELL_BITS = 14
CELLS = 1 << CELL_BITS
RANGES = "cell int, lo long, hi long, shard int, base long"


def _mix(x: int) -> int:
    """A fixed 64-bit mixing function (splitmix64) for the places of virtual nodes."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def virtual_nodes(shards: int, vnodes: int, seed: int) -> list[tuple[int, int]]:
    """(cell, shard), clockwise. A shard's places do not depend on how many shards there are."""
    points = [(_mix(_mix(seed + shard) + v), shard) for shard in range(shards) for v in range(vnodes)]
    return [(point >> (64 - CELL_BITS), shard) for point, shard in sorted(points)]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard. Without slack they add up to ``rows``, so counts are at most one apart."""
    if slack > 0:
        return [-(-int(rows * (1 + slack) + shards - 1) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(counts: dict[int, int], shards: int, vnodes: int, slack: float, seed: int) -> list[tuple]:
    """Ranges (cell, first rank, rank after the last, shard, first slot).

    First each cell fills its own shard; then what overflowed goes clockwise, cell by
    cell, to the next shard with room (places of full shards are skipped for good).
    """
    nodes = virtual_nodes(shards, vnodes, seed)
    cells = [cell for cell, _ in nodes]
    room = capacities(sum(counts.values()), shards, slack)
    filled = [0] * shards
    onward = list(range(1, len(nodes))) + [0]

    def open_node(i: int) -> int:
        path = []
        while room[nodes[i][1]] == 0:
            path.append(i)
            i = onward[i]
        for j in path:
            onward[j] = i
        return i

    ranges, waiting = [], []

    def put(cell: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            ranges.append((cell, lo, lo + n, shard, filled[shard]))
            filled[shard] += n
            room[shard] -= n
        return lo + n

    for cell in sorted(counts):
        home = bisect_left(cells, cell) % len(nodes)
        lo = put(cell, 0, counts[cell], nodes[home][1])
        if lo < counts[cell]:
            waiting.append((cell, lo, counts[cell], home))
    for cell, lo, hi, home in waiting:
        while lo < hi:
            home = open_node(home)
            lo = put(cell, lo, hi, nodes[home][1])
    return ranges


def ring_shards(docs: DataFrame, shards: int = 24, vnodes: int = 100, slack: float = 0.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    ``slack`` 0 gives shards whose counts differ by one at most (law ``rows``); a
    larger slack lets a shard hold up to (1 + slack) times the mean and moves fewer
    rows when a shard is added. Slots of a shard run from 0 without gaps.

    A null text counts as empty (size 8, checksum 0). A null doc_id is placed by its
    text. Equal rows are interchangeable and each gets its own slot. An empty table
    gives an empty result. Other columns are ignored. Needs (doc_id, text).
    """
    text = text_or_empty()
    rows = stage(docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), F.col("doc_id")))
        .otherwise(F.xxhash64(F.lit(seed), text)).alias("place"),
    ).withColumn("cell", F.shiftrightunsigned("place", 64 - CELL_BITS).cast("int")), "ring")
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # At most CELLS ranges, and one more each time a shard becomes full or a cell overflows.
    ranges = docs.sparkSession.createDataFrame(deal(counts, shards, vnodes, slack, seed), RANGES)
    in_cell = Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(in_cell).cast("long") - 1)
        .join(F.broadcast(ranges), ["cell"])
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
