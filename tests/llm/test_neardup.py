from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tests.conftest import SF_DIR
from threadmine.llm import hashing, neardup
from threadmine.llm.components import components
from threadmine.llm.queries import QUERIES


def shingles(text: str | None, k: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, int]:
    """Component of each id by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    holders, common = defaultdict(list), Counter()
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(n)
    for held in holders.values():
        common.update(combinations(held, 2))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        (i, x), (j, y) = sets[a], sets[b]
        if 100 * n >= percent * (len(x) + len(y) - n):
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return {i: find(i) for i in root}


def check(df, rows, k, percent):
    want = brute(rows, k, percent)
    got = df.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(set)
    for i, t in rows:
        sizes[i].add(len(shingles(t, k)))
    for r in got:
        assert r.component_id == want[r.doc_id]
        assert r.n_shingles in sizes[r.doc_id]
        assert r.kept == (r.doc_id == want[r.doc_id])


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(QUERIES["op1_minhash"](spark, SF_DIR), rows, 3, 85)


def test_families_of_edited_copies(spark):
    """Chains and stars in one large bucket, with members that are linked to few others."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 - i, " ".join(text)))
    for i in range(60):
        rows.append((i, " ".join(base[:60] + [rng.choice(words) for _ in range(60)])))
    rows += [(2000, ""), (2001, None), (2002, "ONE two"), (2003, "one TWO"), (2004, " \n"), (2005, "É x y z"), (2006, "é x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", neardup.F.lit("clash"))
    check(neardup.near_duplicates(docs, 3, 85), rows, 3, 85)


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(6)
    base = [f"w{rng.randrange(99)}" for _ in range(60)]
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(60)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(text)))
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows, 5, 80)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "q r s t"), (None, None), (None, "z")]])
def test_odd_rows(spark, rows):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 1, True), (1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (None, None, True)] if rows else []
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (101, 103), (103, 102), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 101: 101, 102: 101, 103: 101}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_follow_words_alone():
    raws = [b"a bb\tccc", b"", b"  ", b"ccc", b"x" * 70_000 + b" bb", "é 𝄞".encode()]
    words = hashing.Words(raws)
    want = [w for r in raws for w in r.split()]
    by_word = {}
    for w, h in zip(want, words.hashes(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert list(np.diff(words.first)) == [len(r.split()) for r in raws]


def test_parity_sketch_never_rules_out_a_link():
    """Differing parity bits are at most the number of elements in which two sets differ."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(5, 300))) for _ in range(40)]
    part = neardup.signature([t.encode() for t in texts], 3, 8, 2)
    sets = [shingles(t, 3) for t in texts]
    for a, b in combinations(range(40), 2):
        bits = sum(int(part[c][a] ^ part[c][b]).bit_count() if part[c][a] ^ part[c][b] >= 0
                   else (int(part[c][a] ^ part[c][b]) & 2**64 - 1).bit_count() for c in neardup.PARITY)
        assert bits <= len(sets[a] ^ sets[b])


def test_repeats_of_one_id_grow_in_line(spark, monkeypatch):
    """Neither rows that repeat an id and its text nor like texts under one id meet each other."""
    made = {}
    whole = neardup.stage

    def counted(df, name):
        out = whole(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "stage", counted)
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    near, other = [*base[:79], "z"], [f"v{i}" for i in range(40)]
    rows = [(7, " ".join(base))] * 3000 + [(5, " ".join(near))] * 3000 + [(9, " ".join([*base[:78], "y", "z"]))]
    rows += [(8, " ".join([*other, f"u{i}"])) for i in range(300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got.collect()) == {
        (7, 5, False): 3000, (5, 5, True): 3000, (9, 5, False): 1, (8, 8, True): 300}
    assert made["representatives"] == 303
    assert made["members"] <= 64 * 303
    assert made["sets"] <= 303 * 8


def test_all_texts_of_an_id_share_its_links(spark):
    """Also if one of them is a copy of a smaller id's text and names no node itself."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "p q r s t u v"), (3, "p q r s t u v"), (3, None), (4, "x y z"), (4, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(r.doc_id for r in got if r.kept) == [1, 4, 4]
