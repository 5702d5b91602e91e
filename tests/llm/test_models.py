"""Held-out accuracy of the trained operators, and their parts against brute force."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from threadmine.llm import line_quality, toxicity
from threadmine.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(labels)[:]
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name, column, least, threshold", [("op5_line_quality", "quality", 0.95, 0.3), ("op8_toxicity", "toxic", 0.8, 0.5)])
def test_held_out_labels(spark, name, column, least, threshold):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([labels[r.doc_id] for r in held], [r.score for r in held]) >= least
    right = np.mean([labels[r.doc_id] == r.predicted for r in held])
    assert right >= 0.9


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) AS toxic",
        "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.features == b.features).all() and (a.weights == b.weights).all()
    a, b = line_quality.train(docs, labels), line_quality.train(docs, turned)
    assert (a.weights == b.weights).all() and (a.ties == b.ties).all()


def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(0)
    counts = [0, 1, 4, 0, 6, 2]
    first = np.concatenate(([0], np.cumsum(counts)))
    unary, ties = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    total, good, pairs = line_quality.forward_backward(unary, first, ties)
    want_pairs = np.zeros((2, 2))
    for i, n in enumerate(counts):
        u = unary[first[i]:first[i + 1]]
        weights, marginal, neighbours = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(np.dot(u, y) + sum(ties[a, b] for a, b in zip(y, y[1:])))
            weights += w
            marginal += w * np.array(y)
            for a, b in zip(y, y[1:]):
                neighbours[a, b] += w
        if n:
            assert total[i] == pytest.approx(np.log(weights))
            assert good[first[i]:first[i + 1]] == pytest.approx(marginal / weights)
            want_pairs += neighbours / weights
    assert pairs == pytest.approx(want_pairs)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["One line.\nTwo lines!\n\n  \nOne line.", "", "x", "LOUD!! LOUD!! LOUD!!\n| a | b |", "é\n" * 50]
    together = line_quality.line_features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        alone = line_quality.line_features([t.encode()])
        assert together.features[together.first[i]:together.first[i + 1]] == pytest.approx(alone.features)
    assert list(np.diff(together.first)) == [sum(bool(x.strip()) for x in t.split("\n")) for t in texts]
    assert list(together.features[:3, 12]) == [1, 0, 1]  # repeated lines


def test_risk_is_corrected_for_positives_among_the_unlabelled():
    """Unlabelled documents with the toxic word are scored toxic although none of them is labelled."""
    rng = np.random.default_rng(1)

    def doc(toxic):
        values = rng.choice(5_000, 40, replace=False) + 100
        return np.sort(np.append(values, rng.choice(5, 2, replace=False)) if toxic else values).astype(np.uint64)

    positive = [doc(True) for _ in range(300)]
    unlabelled = [doc(i % 5 == 0) for i in range(2_000)]
    model = toxicity.fit(positive, unlabelled, 0.2)
    fresh = [doc(i % 2 == 0) for i in range(400)]
    first = np.concatenate(([0], np.cumsum([len(x) for x in fresh])))
    found = model.margins(np.concatenate(fresh), first) >= 0
    assert np.mean(found == (np.arange(400) % 2 == 0)) > 0.97


ODD = [(None, None, 1), (1, "", 2), (1, "", 2), (2, " \n\t", 3), (3, "a b\n" * 30_000, 4)]


@pytest.mark.parametrize("rows", [[], ODD])
@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (None, 1, 1), (3, None, None), (2, 0, 0)]])
def test_odd_rows(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for got in (line_quality.quality(docs, known).collect(), toxicity.toxicity(docs, known).collect()):
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.clean_rows(docs, toxicity.train(docs, known)).columns == docs.columns


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_and_its_step_equal_plain_loops_and_differences(prior):
    """The estimate of single documents summed up by loops; the gradient by differences, in either branch."""
    rng = np.random.default_rng(4)

    def rows(n):
        sets = [np.sort(rng.choice(6, rng.integers(0, 5), replace=False)) for _ in range(n)]
        return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))

    p, u, w = rows(9), rows(14), rng.normal(size=7) - (1.5 if prior > 0.5 else 0)

    def parts(w):
        def g(x):
            return [sum(w[c] for c in x[0][x[1][i]:x[1][i + 1]]) + w[-1] for i in range(len(x[1]) - 1)]

        toxic = prior * sum(np.log(1 + np.exp(-v)) for v in g(p)) / 9
        clean = sum(np.log(1 + np.exp(v)) for v in g(u)) / 14 - prior * sum(np.log(1 + np.exp(v)) for v in g(p)) / 9
        return toxic, clean

    for shift in (0.0, 2.0, 4.0):
        at = w + np.append(np.zeros(6), shift)
        toxic, clean = parts(at)
        value, step = toxicity.risk(p, u, at, prior)
        assert value == pytest.approx(toxic + max(0, clean))
        for i in range(7):
            move = np.eye(7)[i] * 1e-6
            (t1, c1), (t0, c0) = parts(at + move), parts(at - move)
            want = (t1 + c1 - t0 - c0) / 2e-6 if clean >= 0 else -(c1 - c0) / 2e-6
            assert step[i] == pytest.approx(want, abs=1e-5)


def test_features_counted_by_tasks_are_those_of_the_whole_sample(spark):
    """The model from Spark equals the one from the same sample held in memory."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, max_unlabelled=500)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~toxicity.held_out()).collect()
    order = toxicity.F.xxhash64(toxicity.F.lit(3), "doc_id")
    other = docs.where(~toxicity.held_out()).select("doc_id").distinct().orderBy(order, "doc_id").limit(500).collect()

    def sets(ids):
        values, first = toxicity.features([texts[i] for i in sorted(ids)])
        return [values[a:b] for a, b in zip(first, first[1:])]

    want = toxicity.fit(sets({r.doc_id for r in known if r.toxic == 1}), sets({r.doc_id for r in other}),
                        sum(r.toxic == 1 for r in known) / len(known))
    assert list(model.features) == list(want.features) and len(want.features) > 0
    assert model.weights == pytest.approx(want.weights, abs=1e-6)
