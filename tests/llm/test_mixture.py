from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from threadmine.llm import mixture
from threadmine.llm.queries import QUERIES


def cheapest(capacity, members, quota, repeats=3):
    """(most words, least cost) by trying every flow of small whole numbers."""
    edges = [(p, s) for p, sources in enumerate(members) for s in sources]
    best = (0, 0)
    for flow in itertools.product(*[range(repeats * capacity[p] + 1) for p, _ in edges]):
        given, taken = defaultdict(int), defaultdict(int)
        for (p, s), n in zip(edges, flow):
            given[p] += n
            taken[s] += n
        if any(given[p] > repeats * capacity[p] for p in given) or any(taken[s] > quota[s] for s in taken):
            continue
        cost = sum(max(0, min(given[p], (k + 1) * capacity[p]) - k * capacity[p]) * k for p in given for k in range(repeats))
        best = max(best, (sum(flow), -cost))
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(25):
        members = [rng.sample(range(3), rng.randint(1, 2)) for _ in range(2)]
        capacity, quota = [rng.randint(0, 2) for _ in members], [rng.randint(0, 5) for _ in range(3)]
        sent = mixture.min_cost_flow(capacity, members, quota)
        total = [sum(f.values()) for f in sent]
        cost = sum(max(0, min(t, (k + 1) * c) - k * c) * k for t, c in zip(total, capacity) for k in range(3))
        assert (sum(total), -cost) == cheapest(capacity, members, quota)
        for s, most in enumerate(quota):
            assert sum(f.get(s, 0) for f in sent) <= most
        assert all(n >= 0 for f in sent for n in f.values())


def test_targets_share_the_excess():
    got = mixture.targets({"a": 100, "b": 1, "c": 10, None: 20})
    assert got["b"] == 3 and got["c"] == 30
    assert got["a"] == pytest.approx(98 / 2) and got[None] == pytest.approx(98 / 2)
    assert sum(got.values()) == pytest.approx(131)
    assert mixture.targets({}) == {} and mixture.targets({None: 0}) == {None: 0.0}


def by_source(rows, key):
    out = defaultdict(lambda: [0, 0, set()])
    for r in rows:
        out[r[key]][0] += r["size"]
        out[r[key]][1] += r.taken
        out[r[key]][2].add((r.source_size, r.target))
    return out


def test_query_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    source = {d.doc_id: d.source for d in docs}
    rows = QUERIES["op6_mixing"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    sizes = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    groups = defaultdict(list)
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        groups[source[r.doc_id]].append(r)
    want = mixture.targets({s: sum(sizes[r.doc_id] for r in g) for s, g in groups.items()})
    for s, g in groups.items():
        assert {(r.source_size, r.target) for r in g} == {(sum(r["size"] for r in g), want[s])}
        assert abs(sum(r.taken for r in g) - want[s]) <= 1
    again = QUERIES["op6_mixing"](spark, SF_DIR).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b", "ab"][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture.mix_sources(docs, F.split("source", "")).collect()
    size = {p: sum(r["size"] for r in got if r.pattern == p) for p in {r.pattern for r in got}}
    taken = {p: sum(r.taken for r in got if r.pattern == p) for p in size}
    assert len(size) == 3 and sum(taken.values()) == sum(size.values())
    assert all(taken[p] <= 3 * size[p] for p in size)


@pytest.mark.parametrize("rows", [
    [], [(None, None, None, 1), (1, "", "a", 2), (1, "a b", "a", 3), (1, "a b", "a", 3), (2, "\t\n", None, 4), (3, "x", '"', 5)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    for whole in (False, True):
        got = mixture.mix_sources(docs, whole=whole).collect()
        assert len(got) == len(rows)
        assert sorted(r["size"] for r in got) == sorted(len((t or "").split()) for _, t, _, _ in rows)
        assert all(r.taken <= 3 * r["size"] and (not whole or not r.taken or r.taken % r["size"] == 0) for r in got)


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixture, "MAX_PATTERNS", 3)
    docs = spark.createDataFrame([(i, "a", str(i)) for i in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="patterns"):
        mixture.mix_sources(docs)
