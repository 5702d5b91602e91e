from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF_DIR
from threadmine.llm import alignment as al
from threadmine.llm.queries import BYTE_LEVEL, PIECE_LEVEL, QUERIES


@pytest.fixture(scope="module")
def sides():
    with open(BYTE_LEVEL, encoding="utf-8") as a, open(PIECE_LEVEL, "rb") as b:
        return al.ByteLevel(a.read()), al.PieceLevel(b.read())


def brute(rows, sides):
    """Rows of the operator, by plain loops over every token."""
    encode = [s.encoder() for s in sides]
    held, docs = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            ids = [e([text])[0] for e in encode]
            spelled = [b"".join(s.pieces[t] for t in x) for s, x in zip(sides, ids)]
            if spelled == [b" " + text.encode()] * 2:
                ends = []
                for s, x in zip(sides, ids):
                    total, own = 0, []
                    for t in x:
                        total += len(s.pieces[t])
                        own.append(total)
                    ends.append(own)
                at = [0, 0]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    stop = [own.index(e, i) + 1 for own, i in zip(ends, at)]
                    groups.append([x[i:j] for x, i, j in zip(ids, at, stop)])
                    at = stop
        links = [(a, b) for left, right in groups for a in left for b in right]
        docs.update(set(links))
        held.append((i, groups, links))
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for i, groups, links in held:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def got(spark, rows, sides, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS ids", "1 AS n_a")
    return sorted((tuple(r) for r in al.align_tokens(docs.repartition(3), *sides, **options).collect()), key=key)


def test_both_encoders_of_a_plain_vocabulary_agree(sides):
    rng, plain = random.Random(5), sides[0]
    assert plain.plain
    texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)} " for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choices(["a", "'s", "'", " ", "  ", "\n", "\r\n", "1", "é", "漢", "😀", "<|endoftext|>", "\x85", "!"], k=25))
              for _ in range(5000)]
    fast = plain.encoder()(texts)
    plain.plain = False
    slow = plain.encoder()(texts)
    plain.plain = True
    assert fast == slow


@pytest.mark.parametrize("options", [{}, {"max_pairs": 40}])
def test_equals_brute_force(spark, sides, options):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(["the", " ", "Ünter", "  ", "<|endoftext|>", "</s>", "\n", "漢字", "😀", "don't", "12345", "\t", "\x00", "é"],
                                    k=rng.randint(0, 30)))) for i in range(40)]
    rows += [(None, None), (None, "a b"), (7, "a b"), (7, "a b"), (8, ""), (9, " "), (10, "lower▁mark"), (11, "<0x41> <unk>")]
    assert got(spark, rows, sides, **options) == sorted(brute(rows, sides), key=key)


def test_query_equals_brute_force(spark, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_alignment"](spark, SF_DIR).collect()) == sorted(brute(rows, sides))


def test_large_groups_are_expanded_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 60, 500)
    cut_a, cut_b = np.array([0, 3, 90, 399]), np.array([2, 3, 300, 499])
    want = al.linked_pairs(a, b, cut_a, cut_b, 1000)
    plain, lo = Counter(), (0, 0)
    for i, j in zip(cut_a + 1, cut_b + 1):
        plain.update(int(x) * 1000 + int(y) for x in a[lo[0]:i] for y in b[lo[1]:j])
        lo = i, j
    for limit in (2_000_000, 1000, 1):
        monkeypatch.setattr(al, "EXPANDED", limit)
        codes, times = al.linked_pairs(a, b, cut_a, cut_b, 1000)
        assert dict(zip(codes.tolist(), times.tolist())) == plain
        assert (codes == want[0]).all()


def test_a_very_long_text_and_bytes_that_are_no_utf8(spark, sides):
    text = "word " * 60_000 + "x" * 5_000
    assert got(spark, [(1, text)], sides) == brute([(1, text)], sides)
    docs = spark.sql("SELECT 1L doc_id, cast(X'61FF62' AS string) text")
    assert [tuple(r)[1:] for r in al.align_tokens(docs, *sides).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_empty_table(spark, sides):
    assert got(spark, [], sides) == []
