from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from tests.conftest import SF_DIR
from threadmine.llm import ring
from threadmine.llm.queries import QUERIES


def balanced(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    rows = QUERIES["op10_sharding"](spark, SF_DIR).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    balanced(rows, 24)
    again = QUERIES["op10_sharding"](spark, SF_DIR).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


@pytest.mark.parametrize("rows", [
    [], [(None, None, 1)] * 30 + [(1, "", 2)] * 50 + [(i, "x" * i, 3) for i in range(2, 90)]])
def test_odd_rows(spark, rows):
    got = ring.ring_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 24).collect()
    assert len(got) == len(rows)
    if rows:
        balanced(got, 24)


def naive(counts, shards, vnodes, slack, seed):
    """Rows one at a time: home shards first, then overflow clockwise."""
    nodes = ring.virtual_nodes(shards, vnodes, seed)
    room = ring.capacities(sum(counts.values()), shards, slack)
    place, waiting = {}, []
    for cell in sorted(counts):
        home = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        for rank in range(counts[cell]):
            if room[nodes[home][1]]:
                room[nodes[home][1]] -= 1
                place[cell, rank] = nodes[home][1]
            else:
                waiting.append((cell, rank, home))
    for cell, rank, at in waiting:
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        place[cell, rank] = nodes[at][1]
    return place


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ranges_equal_rows_placed_one_at_a_time(slack):
    counts = {(i * 7919) % ring.CELLS: 1 + i % 5 for i in range(300)} | {77: 400}
    got = {}
    for cell, lo, hi, shard, _ in ring.deal(counts, 7, 20, slack, 7):
        got |= {(cell, rank): shard for rank in range(lo, hi)}
    assert got == naive(counts, 7, 20, slack, 7)


def test_a_new_shard_moves_little():
    counts = {i * 5: 3 for i in range(3000)}

    def places(shards):
        return {(c, r): s for c, lo, hi, s, _ in ring.deal(counts, shards, 100, 0.25, 7) for r in range(lo, hi)}

    before, after = places(20), places(21)
    assert sum(before[k] != after[k] for k in before) < 0.15 * len(before)
