from __future__ import annotations

import math
import random

import pytest

from threadmine.operators.metrics import retrieval_metrics

CASES = {
    "basic": ([.95, .85, .3, .7, .2, .1, .05], dict(recall_at_5=1, mrr=1, hit_rate_at_5=1, ndcg_at_5=0.986426, ndcg_at_10=0.986765, num_relevant_docs=3, num_retrieved_docs=7)),
    "perfect": ([1.0, .9, .8], dict(recall_at_5=1, ndcg_at_5=1, mrr=1)),
    "poor": ([.1, .2, .15], dict(recall_at_5=0, mrr=0, hit_rate_at_5=0, ndcg_at_5=0.873916)),
    "partial": ([.9, .2, .8, .1, .7], dict(recall_at_5=1, hit_rate_at_5=1, num_relevant_docs=3, ndcg_at_15=0.925773)),
}


@pytest.fixture(scope="module")
def results(spark):
    retrieved = [(q, i, f"d{i}") for q, (rel, _) in CASES.items() for i in range(1, len(rel) + 1)]
    judged = [(q, f"d{i}", r, i) for q, (rel, _) in CASES.items() for i, r in enumerate(rel, 1)]
    judged.append(("basic", "d1", 0.0, 0))  # an earlier judgment of a document is replaced
    everyone = spark.createDataFrame([(q,) for q in [*CASES, "empty"]], "query_id string")
    rows = retrieval_metrics(
        spark.createDataFrame(retrieved, "query_id string, rank int, doc_id string"),
        spark.createDataFrame(judged, "query_id string, doc_id string, relevance_score double, seq int"),
        ["query_id"], everyone,
    ).collect()
    return {r["query_id"]: r.asDict() for r in rows}


@pytest.mark.parametrize("case", CASES)
def test_cases(results, case):
    for name, value in CASES[case][1].items():
        assert results[case][name] == pytest.approx(value, abs=1e-6), name


def test_empty_query_has_zeros(results):
    assert all(v == 0 for k, v in results["empty"].items() if k != "query_id")


def test_bounds_and_order(results):
    for row in results.values():
        assert all(0 <= v <= 1 for k, v in row.items() if "_at_" in k or k == "mrr")
        assert row["hit_rate_at_5"] <= row["hit_rate_at_10"] <= row["hit_rate_at_15"]


def test_one_query_with_most_rows(spark):
    """A list of 20,000 rows beside short ones; compared with a direct computation."""
    rng = random.Random(7)
    lists = {"hot": 20_000, **{f"q{i}": 20 for i in range(30)}}
    retrieved, judged = [], []
    for q, n in lists.items():
        for i in range(1, n + 1):
            retrieved.append((q, i, f"{q}-{i}"))
            if rng.random() < 0.5:
                judged.append((q, f"{q}-{i}", rng.random(), i))
    got = {
        r["query_id"]: r for r in retrieval_metrics(
            spark.createDataFrame(retrieved, "query_id string, rank int, doc_id string").repartition(8),
            spark.createDataFrame(judged, "query_id string, doc_id string, relevance_score double, seq int"), ["query_id"],
        ).collect()
    }
    rel = {(q, d): s for q, d, s, _ in judged}
    for q, n in lists.items():
        scores = [rel.get((q, f"{q}-{i}"), 0.0) for i in range(1, n + 1)]
        n_rel = sum(s >= 0.5 for s in scores)
        for k in (5, 10, 15):
            dcg = sum(s / math.log2(i + 1) for i, s in enumerate(scores[:k], 1))
            ideal = sum(s / math.log2(i + 1) for i, s in enumerate(sorted(scores, reverse=True)[:k], 1))
            assert got[q][f"ndcg_at_{k}"] == pytest.approx(dcg / ideal)
            assert got[q][f"recall_at_{k}"] == pytest.approx(sum(s >= 0.5 for s in scores[:k]) / n_rel)
