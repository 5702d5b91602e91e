"""Each stage of the pipeline against a brute-force version on its own input."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from tests.conftest import SF_DIR
from tests.llm.test_native import shingles
from tests.llm.test_neardup import brute
from tests.llm.test_sharding import balanced
from threadmine.llm import mixture, toxicity
from threadmine.session import stage


@pytest.fixture(scope="module")
def steps(spark):
    """Rows that go into each stage and come out of the last."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF_DIR), name)
        out.append(docs)
    return out


def test_columns_and_names(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_toxic_documents_go(spark, steps):
    scored = toxicity.toxicity(steps[0], spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(r.doc_id for r in scored if not r.predicted)


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    root = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(i for i, _ in rows if root[i] == i)


def test_leaks_go(spark, steps):
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in steps[2].collect()
             if not any(q and 100 * len(q & shingles(r.text)) >= 80 * len(q) for q in items)]
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(clean)


def test_mixture_meets_its_targets(steps):
    def words(rows):
        out = defaultdict(list)
        for r in rows:
            out[r.source].append(len((r.text or "").encode().split()))
        return out

    before, after = words(steps[3].collect()), words(steps[4].collect())
    want = mixture.targets({s: sum(n) for s, n in before.items()})
    for s, n in before.items():
        assert abs(sum(after[s]) - want[s]) <= max(n) / 2 + 1
    times = defaultdict(int)
    for r in steps[4].collect():
        times[r.doc_id] += 1
    assert max(times.values()) <= 3


def test_shards_are_balanced(steps):
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in steps[4].collect())
    balanced(rows, 24)


def test_run_is_registered(spark, steps):
    got = {tuple(r) for r in queries()["pipeline"](spark, SF_DIR).collect()}
    assert got == {tuple(r) for r in steps[5].collect()}


@pytest.mark.parametrize("rows", [[], [
    (None, None, None, None, 1, "x"), (1, "", "en", "a", 0, "x"), (2, "a b c d e f g", "en", "a", 0, "x"),
    (2, "a b c d e f g", "en", "a", 0, "x"), (3, "a b c d e f g", "de", None, 0, "x"), (None, "a b c d e f g", "de", "b", 0, "x"),
    (4, "word " * 100_000, "de", "b", 0, "x")]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF_DIR), name)
    assert (docs.count() > 0) == bool(rows)


def test_rows_are_judged_by_their_own_text(spark):
    """Null ids are searched too, and a copy or leak takes no other text of its id with it."""
    leak = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    clean = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "pqrs"}
    rows = [(1, clean["p"]), (None, clean["p"]), (2, clean["p"]), (2, clean["q"]), (None, clean["r"]), (None, clean["r"] + " z"),
            (None, None), (None, None), (3, leak), (3, clean["s"]), (None, f"so {leak} on"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, key string")
    once = stage(corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR), "near_duplicates")
    assert once.columns == docs.columns
    got = [(r.doc_id, r.text) for r in once.collect()]
    r_kept = [(i, t) for i, t in got if i is None and t and t.startswith(clean["r"])]
    assert len(r_kept) == 1
    leaks = [(i, t) for i, t in got if t and leak in t]
    assert leaks
    others = [x for x in got if x not in r_kept and x not in leaks]
    assert sorted(others, key=str) == sorted(
        [(1, clean["p"]), (2, clean["q"]), (None, None), (None, None), (3, clean["s"]), (4, "")], key=str)
    assert {t for i, t in leaks if i is None} <= {f"so {leak} on"}
    out = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        ((i, t) for i, t in rows if not t or leak not in t), key=str)
