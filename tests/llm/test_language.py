from __future__ import annotations

import numpy as np
import pytest

from threadmine.llm import language
from threadmine.llm.queries import QUERIES


def by_loops(model, raw):
    """Mean probabilities of a text, byte by byte."""
    hidden, total = len(model.products[0]), np.zeros(len(model.langs))
    for start in range(0, len(raw), language.WINDOW):
        part, states = raw[start:start + language.WINDOW], [{}, {}]
        for way in range(2):
            state = [0.0] * hidden
            for i in range(len(part)) if way == 0 else reversed(range(len(part))):
                moved = [sum(state[k] * model.products[way][k, j] for k in range(hidden)) for j in range(3 * hidden)]
                given = model.tables[way][part[i]]
                new = []
                for j in range(hidden):
                    update = min(max(0.25 * (given[j] + moved[j]) + 0.5, 0), 1)
                    reset = min(max(0.25 * (given[hidden + j] + moved[hidden + j]) + 0.5, 0), 1)
                    candidate = min(max(given[2 * hidden + j] + reset * moved[2 * hidden + j], -1), 1)
                    new.append(state[j] + update * (candidate - state[j]))
                state = states[way][i] = new
        for i in range(len(part)):
            z = np.array(states[0][i] + states[1][i]) @ model.out + model.bias
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return total / len(raw)


def test_probabilities_equal_plain_loops():
    model = language.new_model(["de", "en", "fr"], hidden=3)
    raws = [b"a", b"some words " * 20, bytes(range(256)), b"x" * language.WINDOW]
    got = language.pooled(model, [b"", *raws])
    assert got[0] == pytest.approx([1 / 3] * 3)
    for p, raw in zip(got[1:], raws):
        assert p == pytest.approx(by_loops(model, raw), abs=1e-5)


def test_gradient_equals_differences():
    model = language.new_model(["a", "b", "c"], hidden=3)
    for part in (model.tables, model.products):
        part[:] = [x.astype(np.float64) for x in part]
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    rng = np.random.default_rng(2)
    data, lengths, labels = rng.integers(97, 103, (5, 7)), np.array([7, 3, 1, 7, 5]), np.array([0, 1, 2, 1, 0])
    for _ in range(3):
        _, gradients = language.loss_and_gradient(model, data, lengths, labels)
        for p, g in zip(model.parameters(), gradients):
            for _ in range(12):
                at = tuple(rng.integers(0, n) for n in p.shape)
                if p.shape[0] == 256:
                    at = (int(rng.choice(data.reshape(-1))), at[1])
                held, sides = p[at], []
                for shift in (1e-3, -1e-3):
                    p[at] = held + shift
                    sides.append(language.loss_and_gradient(model, data, lengths, labels)[0])
                p[at] = held
                assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[at], abs=2e-4, rel=2e-2)
        for p, g in zip(model.parameters(), gradients):
            p -= 0.5 * g


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = QUERIES["op13_language"](spark, sf_dir).join(docs, ["doc_id"]).where("held_out AND text RLIKE '[a-z]'").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, "the cat and the dog sat there" if i % 2 else "le chat et le chien étaient là", "en" if i % 2 else "fr", "x") for i in range(100)]
    rows += [(None, "the dog", "en", ""), (None, None, None, ""), (1000, "", "en", ""), (1001, "12 34", "en", ""), (1002, None, "fr", ""),
             (1003, "the cat and the dog sat there " * 10_000, None, ""), (1003, "the cat and the dog sat there " * 10_000, None, "")]
    docs = spark.createDataFrame(rows, schema)
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(found[i].lang_pred == ("en" if i % 2 else "fr") for i in range(100))
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == ["en", "und"]
    assert all(r.held_out is None for r in got if r.doc_id is None)
    assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert language.identify(empty, language.train(empty)).collect() == []
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}
    raw = spark.sql("SELECT 1L doc_id, cast(X'61FF62' AS string) text, 'en' lang")
    assert language.identify(raw, language.train(docs)).first().score > 0
