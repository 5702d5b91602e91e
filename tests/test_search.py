from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmine.operators import rerank as R
from threadmine.operators import search as Q
from threadmine.operators import weights as W
from threadmine.session import salted_join

DOCS = ["great headphones running", "budget laptop", "headphones guide headphones"]


def test_tfidf_fixture(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)] , "doc_id bigint, text string")
    idf = {r["term"]: r["idf"] for r in W.with_idf(W.document_frequency(W.postings(docs)), W.count_rows(docs)).collect()}
    assert idf["budget"] == pytest.approx(1.693147, abs=1e-6) and idf["headphones"] == pytest.approx(1.287682, abs=1e-6)
    weights = {r["term"]: r["weight"] for r in W.tfidf(W.postings(docs), W.count_rows(docs)).where("doc_id = 2").collect()}
    assert weights == pytest.approx({"headphones": 0.858455, "guide": 0.564382}, abs=1e-6)


def test_empty_documents_count_in_n(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "doc_id bigint, text string")
    idf = {r["term"]: r["idf"] for r in W.with_idf(W.document_frequency(W.postings(docs)), W.count_rows(docs)).collect()}
    assert idf["alpha"] == pytest.approx(math.log(4 / 2) + 1)


def _corpus(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    # "hot" is in every document, so one term holds far more postings than any other.
    return [(i, " ".join(["hot"] * rng.randint(1, 4) + rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(n)]


def _brute_sparse(docs, queries, k):
    tokens = {i: t.split() for i, t in docs}
    df = Counter(t for ts in tokens.values() for t in set(ts))
    idf = {t: math.log((len(docs) + 1) / (c + 1)) + 1 for t, c in df.items()}
    out = {}
    for q, text in queries:
        qs = text.split()
        qw = {t: c / len(qs) * idf[t] for t, c in Counter(qs).items() if t in idf}
        scores = {}
        for i, ts in tokens.items():
            s = sum(qw.get(t, 0) * c / len(ts) * idf[t] for t, c in Counter(ts).items())
            if set(qw) & set(ts):
                scores[i] = s
        out[q] = sorted(scores, key=lambda i: (-math.floor(scores[i] * 1e9 + 0.5), i))[:k]
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_sparse_search_by_both_joins(spark, bounded):
    docs, queries = _corpus(), [("a", "hot w1 w2 w2"), ("b", "w3 unknown"), ("c", "hot")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(queries, "query_id string, text string")
    scores = Q.sparse_scores(q, W.postings(d), W.count_rows(d), ["query_id"], bounded=bounded)
    got = {}
    for r in Q.ranked(scores, ["query_id"], 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == _brute_sparse(docs, queries, 20)


@pytest.mark.parametrize("max_queries", [100, 1])
@pytest.mark.parametrize("repeated", [[], [(3, "hot w1 w1"), (3, "w2 hot w2 hot"), (None, "w1 w2"), (None, "w2 w1"), (7, None)]])
def test_searches_of_texts_give_what_postings_give(spark, monkeypatch, repeated, max_queries):
    """Ids of several rows, queries in several groups, few cells at a time; nothing is aggregated over postings of all rows."""
    monkeypatch.setattr(Q, "_SCORE_CELLS", 64)
    docs = _corpus() + [(1000, None), (1001, "")] + repeated
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame([("a", 1, "hot w1 w2 w2"), ("a", None, "w3 unknown"), ("c", 1, "hot"), ("d", 1, ""), ("e", 1, "unknown")],
                              "query_id string, variant int, text string")
    keys, post, n = ["query_id", "variant"], W.postings(d), W.count_rows(d)
    by_texts = Q.sparse_topk(q, W.tokens_of(d), n, keys, 20, max_queries=max_queries), Q.keyword_topk(q, W.tokens_of(d), n, keys, 20, max_queries=max_queries)
    by_postings = Q.sparse_scores(q, post, n, keys), Q.keyword_scores(q, post, n, W.average_length(post, n), keys)
    for got, scores in zip(by_texts, by_postings):
        rows = sorted([tuple(r) for r in got.select(*keys, "rank", "doc_id", F.round("score", 9)).collect()], key=str)
        assert rows == sorted([tuple(r) for r in Q.ranked(scores, keys, 20).select(*keys, "rank", "doc_id", F.round("score", 9)).collect()], key=str)
        assert len(rows) > 40
    if not repeated:
        assert "HashAggregate" not in by_texts[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("max_broadcast", [100, 0])
def test_dense_search_by_both_ways(spark, max_broadcast):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(500, 16)), rng.normal(size=(12, 16))
    v[7] = v[3]  # equal vectors are ordered by id
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "doc_id bigint, vector array<float>").repartition(6)
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id bigint, vector array<float>")
    hits = Q.dense_topk(queries, vectors, ["query_id"], 25, max_broadcast=max_broadcast)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    v32, q32 = v.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    cos = (q32 / np.linalg.norm(q32, axis=1, keepdims=True)) @ (v32 / np.linalg.norm(v32, axis=1, keepdims=True)).T
    for i in range(12):
        order = [j for j in sorted(range(500), key=lambda j: (-math.floor(cos[i, j] * 1e9 + 0.5), j)) if cos[i, j] >= 0][:25]
        assert got[i] == order


def test_dense_search_without_queries(spark):
    empty = spark.createDataFrame([], "query_id bigint, vector array<float>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id bigint, vector array<float>")
    assert Q.dense_topk(empty, vectors, ["query_id"], 5).count() == 0


def test_fused_scores_and_tie_order(spark):
    dense = spark.createDataFrame([("q", 1, 1, .9), ("q", 2, 3, .8), ("q", 3, 2, .7)], "query_id string, doc_id bigint, rank int, score double")
    sparse = spark.createDataFrame([("q", 1, 2, .9), ("q", 2, 10, .8), ("q", 4, 1, .7), ("q", 5, 2, .6)], "query_id string, doc_id bigint, rank int, score double")
    rows = Q.fused_top(Q.rrf_fuse(dense, sparse, ["query_id"]), ["query_id"]).orderBy("rank").collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] == pytest.approx(0.016261, abs=1e-6) and score[2] == pytest.approx(0.015079, abs=1e-6)
    assert score[4] == pytest.approx(0.008197, abs=1e-6)
    # documents 3 and 5 have equal scores: the one of the dense list comes first
    assert [r["doc_id"] for r in rows] == [1, 2, 4, 3, 5]


def test_combined_list_keeps_the_first_place(spark):
    rows = [("q", "v1", 1, 10, " a ", .5), ("q", "v1", 2, 11, "b", .4), ("q", "v2", 1, 12, "a", .6), ("q", "v2", 2, 13, "c", .4)]
    hits = spark.createDataFrame(rows, "query_id string, variant string, rank int, doc_id bigint, text string, score double")
    seq = F.when(F.col("variant") == "v1", 0).otherwise(100) + F.col("rank")
    got = Q.combine_best(hits, ["query_id"], seq).orderBy("position").collect()
    assert [(r["doc_id"], r["position"]) for r in got] == [(12, 1), (11, 2), (13, 3)]


def _brute_bm25(query, docs, k1=1.5, b=.75, eps=.25):
    tokens = [d.lower().split() for d in docs]
    avg = sum(map(len, tokens)) / len(tokens)
    df = Counter(t for ts in tokens for t in set(ts))
    idf = {t: math.log(len(docs) - c + .5) - math.log(c + .5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * ts.count(t) * (k1 + 1) / (ts.count(t) + k1 * (1 - b + b * len(ts) / avg)) for t in query.split()) for ts in tokens]


def test_bm25_equals_brute_force(spark):
    docs = [t for _, t in _corpus(25, 5)] + ["", "w1 w1 w2"]
    queries = {"a": "hot w1 w1 w9 nowhere", "b": "w2"}
    cand = spark.createDataFrame([(q, i, t) for q in queries for i, t in enumerate(docs)], "query_id string, position int, text string")
    qs = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    got = {(r["query_id"], r["position"]): r["bm25"] for r in R.bm25_scores(cand, qs, ["query_id"]).collect()}
    for q, text in queries.items():
        for i, want in enumerate(_brute_bm25(text, docs)):
            assert got[(q, i)] == pytest.approx(want, abs=1e-9)


def test_rerank_only_above_the_limit(spark):
    rows = [("short", i, f"t{i} alpha") for i in range(1, 4)] + [("long", i, "alpha " * (i % 3) + f"t{i}") for i in range(1, 7)]
    cand = spark.createDataFrame(rows, "query_id string, position int, text string")
    qs = spark.createDataFrame([("short", "alpha"), ("long", "t4")], "query_id string, text string")
    got = R.rerank(cand, qs, ["query_id"], limit=4).orderBy("query_id", "rank").collect()
    short, long = [r for r in got if r["query_id"] == "short"], [r for r in got if r["query_id"] == "long"]
    assert [r["position"] for r in short] == [1, 2, 3] and all(r["relevance"] is None for r in short)
    assert len(long) == 4 and long[0]["position"] == 4 and long[0]["relevance"] == 1.0
    assert R.judgments(R.rerank(cand, qs, ["query_id"], limit=4), ["query_id"]).count() == 4


def test_whole_texts_are_scored(spark):
    cand = spark.createDataFrame([("q", 1, "x " * 3000 + "needle"), ("q", 2, "y"), ("q", 3, "z")], "query_id string, position int, text string")
    qs = spark.createDataFrame([("q", "needle")], "query_id string, text string")
    whole = {r["position"]: r["bm25"] for r in R.bm25_scores(cand, qs, ["query_id"]).collect()}
    assert whole[1] > 0 and whole[2] == 0


def test_dense_search_keeps_text_ids(spark):
    vectors = spark.createDataFrame([(f"é-{i}", [float(i % 5), 1.0]) for i in range(40)], "doc_id string, vector array<double>")
    qs = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, vector array<double>")
    for most in (10, 0):
        got = Q.dense_topk(qs, vectors, ["query_id"], 3, max_broadcast=most).orderBy("rank").collect()
        assert [r["doc_id"] for r in got] == ["é-14", "é-19", "é-24"]


def test_heavy_keys_are_split(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, n int")
    small = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    for how, rows in (("inner", 101), ("left", 103), ("left_semi", 51), ("left_anti", 2)):
        assert salted_join(big, small, ["k"], ["n"], how, rows_per_salt=4).count() == rows


def test_dense_search_hands_on_rows_that_reach_a_bound(spark, monkeypatch):
    """The same lists with the bound of a sample, from fewer rows, and the number of tasks does not matter."""
    rng = np.random.default_rng(3)
    queries = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(5)], "q int, vector array<double>")
    rows = [(i, rng.normal(size=6).tolist()) for i in range(4_000)] + [(9_000 + i, [1.0] + [0.0] * 5) for i in range(30)]
    handed, real = [], Q.ranked

    def counting(scores, keys, k, rank="rank"):
        if keys == ["q"]:
            handed.append(scores.count())
        return real(scores, keys, k, rank)

    monkeypatch.setattr(Q, "ranked", counting)
    found = []
    for parts, sample in ((4, 10_000), (4, 200), (40, 200)):
        vectors = spark.createDataFrame(rows, "doc_id bigint, vector array<double>").repartition(parts)
        got = Q.dense_topk(queries, vectors, ["q"], 20, None, sample=sample).collect()
        found.append(sorted((r.q, r["rank"], r.doc_id) for r in got))
    assert found[0] == found[1] == found[2] and len(found[0]) == 100
    assert handed[2] < 0.8 * 5 * 20 * 40 and handed[2] < 5 * 20 * 4_030 / 200 * 1.5


@pytest.mark.parametrize("max_rows", [0, 5, 200_000])
def test_weights_by_broadcast_and_by_join(spark, max_rows):
    """Frequent, single and other terms; with a broadcast that holds all of them no posting is shuffled."""
    docs = _corpus(60) + [(100, "u1 hot"), (101, "u2 u3")]
    post = W.postings(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = W.tfidf(post, F.lit(len(docs)), max_rows)
    df = Counter(t for _, text in docs for t in set(text.split()))
    want = {(i, t): c / len(text.split()) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for i, text in docs for t, c in Counter(text.split()).items()}
    assert {(r["doc_id"], r["term"]): r["weight"] for r in got.collect()} == pytest.approx(want)
    assert ("SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()) or max_rows < 200_000
