"""Chunks, index tables and evaluation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from threadmine.operators import evaluate as E
from threadmine.operators.chunk import chunk_comments, chunk_posts, token_sizes, window_chunks
from threadmine.operators import weights as W
from threadmine.operators.weights import count_rows
from threadmine.operators import search as Q
from threadmine.plans import evaluation, index
from threadmine.session import stage, staged
from threadmine.sources import store

POST = "id string, title string, content string, year int, month int, subreddit_name string, comments array<struct<id:string,score:int,body:string,year:int,month:int>>"


def _post(spark, content="Body text", body="Comment body text."):
    return spark.createDataFrame([("p1", "Sample Title", content, 2024, 5, "shopping", [("c1", 1, body, 2024, 5)])], POST)


def test_chunk_fixture(spark):
    rows = {r["type"]: r for r in chunk_posts(_post(spark)).collect()}
    assert rows["post"]["page_content"].startswith("[From 2024-05] Title: Sample Title")
    assert rows["comment"]["page_content"] == "Comment body text." and rows["comment"]["comment_id"] == "c1"
    assert rows["post"]["timestamp"] == 202405 and rows["post"]["date"] == "2024-05" and rows["post"]["comment_id"] is None


def test_custom_splitter_and_fallback(spark):
    seen = chunk_posts(_post(spark), splitter=lambda t: [t[:5], t[5:]]).where("type = 'post'").orderBy("chunk_id").collect()
    assert [r["page_content"] for r in seen] == ["[From 2024-05] Title", "[From 2024-05] : Sample Title\n\nBody text"]

    def broken(text):
        raise ValueError

    for splitter in (broken, lambda t: []):
        got = chunk_posts(_post(spark), splitter=splitter).where("type = 'post'").collect()
        assert [r["page_content"] for r in got] == ["[From 2024-05] Title: Sample Title\n\nBody text"]


@pytest.mark.parametrize("length", [0, 1, 999, 1000, 1001, 1800, 1801, 5000])
def test_windows_cover_the_text(spark, length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    chunks = spark.createDataFrame([(text,)], "t string").select(window_chunks(F.col("t")).alias("c")).first()["c"]
    assert chunks == [text[i:i + 1000] for i in range(0, max(length - 200, 1), 800)] if length else chunks == []
    assert not chunks or chunks[0] + "".join(c[200:] for c in chunks[1:]) == text


def test_token_sizes():
    assert token_sizes() == (250, 50) and token_sizes(1, 1) == (1, 0)
    assert token_sizes(100, 500) == (25, 24) and token_sizes(overlap_tokens=-3) == (250, 0)


def test_short_comments_are_left_out(spark):
    rows = [("p", "c1", "f", " \n short   ", 2024, 1), ("p", "c2", "f", "long enough text", 2024, 1), ("p", "c3", "f", None, 2024, 1)]
    comments = spark.createDataFrame(rows, "post_id string, comment_id string, subreddit_name string, body string, year int, month int")
    got = chunk_comments(comments).collect()
    assert [r["page_content"] for r in got] == ["[Comment from 2024-01] long enough text"]


def test_index_written_updated_and_searched(spark):
    points = index.index_rows(_post(spark, "red shoes " * 3, "blue shoes are good"))
    index.write_index(spark, "t_ix", points, parts=4)
    first = index.open_sparse(spark, "t_ix")
    assert first.postings.select("doc_id").distinct().count() == 2 == index.open_points(spark, "t_ix").count()
    more = index.index_rows(_post(spark, "green hats", "blue shoes are good"))
    index.write_index(spark, "t_ix", more, recreate=False)
    again = index.open_sparse(spark, "t_ix")
    terms = {r["term"]: r["df"] for r in again.terms.collect()}
    assert "red" not in terms and terms["hats"] == 1 and index.open_points(spark, "t_ix").count() == 2
    q = spark.createDataFrame([("q", "green hats")], "query_id string, text string")
    hits = Q.sparse_scores(q, again.postings_for(q), again.n_docs, ["query_id"], again.terms)
    assert hits.count() == 1
    # only the partitions of the terms that are asked for are read
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "term_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(again.postings_for(q).inputFiles()) < len(again.postings.inputFiles())
    whole = index.SparseIndex.of(index.open_points(spark, "t_ix"), "id", "page_content")
    for one, other in ((again.terms, whole.terms), (again.postings.drop("term_part", "block"), whole.postings)):
        assert {tuple(r) for r in one.select(*sorted(one.columns)).collect()} == {
            tuple(r) for r in other.select(*sorted(other.columns)).collect()}
    store.drop_index(spark, "t_ix")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("t_ix")]


def _found(spark, name):
    q = spark.createDataFrame([("q", "green hats and blue shoes")], "query_id string, text string")
    held = index.open_sparse(spark, name)
    scores = Q.sparse_scores(q, held.postings_for(q), held.n_docs, ["query_id"], held.terms)
    return sorted((r.doc_id, round(r.score, 9)) for r in scores.collect())


def _points(spark, rows):
    return spark.createDataFrame([(i, i, t) for i, t in rows], "id string, post_id string, page_content string")


OLD = [("a", "red shoes"), ("b", "blue shoes"), ("c", "green hats"), ("d", "")]
NEW = [("b", "green shoes"), ("e", "blue hats and hats"), ("d", "blue")]


def test_a_write_that_ends_early_changes_nothing_and_can_be_repeated(spark, monkeypatch):
    """The write is ended before each of its steps in turn, then repeated, then repeated once more after its commit."""
    index.write_index(spark, "t_want", _points(spark, [*dict([*OLD, *NEW]).items()]), parts=2)
    want = _found(spark, "t_want")
    steps = [(store, "write_by_term"), (store, "commit"), (type(spark.range(1).write), "saveAsTable")]
    for at, (owner, step) in enumerate(steps):
        for nth in range(2 if step == "saveAsTable" else 1):
            name, calls, real = f"t_retry_{at}_{nth}", [], getattr(owner, step)
            index.write_index(spark, name, _points(spark, OLD), parts=2)
            before = _found(spark, name)

            def failing(*args, **kwargs):
                calls.append(args)
                if len(calls) > nth + (step == "saveAsTable") * nth:  # the postings are a table too
                    raise OSError("ended")
                return real(*args, **kwargs)

            monkeypatch.setattr(owner, step, failing)
            with pytest.raises(OSError):
                index.write_index(spark, name, _points(spark, NEW), recreate=False, batch="1")
            monkeypatch.setattr(owner, step, real)
            assert _found(spark, name) == before
            for _ in range(2):
                index.write_index(spark, name, _points(spark, NEW), recreate=False, batch="1")
            assert _found(spark, name) == want
            assert store.read_manifest(spark, name)["version"] == 2
            held = {t for s in store.read_manifest(spark, name)["segments"] for t in store.segment_tables(s)}
            store.vacuum(spark, name)
            assert {t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_segment")} == held
            store.drop_index(spark, name)
    store.drop_index(spark, "t_want")


def test_blocks_that_cannot_win_are_not_read(spark, monkeypatch):
    """Best lists equal those from all postings, with ties, and fewer rows of postings are scored."""
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(60_000)]
    docs, at = [], 0
    for i in range(1_500):
        n = rng.choice([3, 8, 20, 60, 200])
        docs.append((i, " ".join(words[at % 50_000:at % 50_000 + n])))
        at += n
    docs = spark.createDataFrame([*docs, (9_000, ""), (9_001, docs[0][1])], "doc_id bigint, text string").repartition(4)
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=5))) for i in range(12)] + [(99, "no such"), (98, "")], "q int, text string")
    post = stage(Q.with_blocks(W.postings(docs), 3))
    bounds, frequency, read = Q.block_bounds(post), W.document_frequency(post), spark.sparkContext.accumulator(0)

    for k in (1, 10, 2_000):
        want = Q.ranked(Q.sparse_scores(q, post, F.lit(1_502), ["q"], frequency), ["q"], k)
        got = Q.pruned_topk(q, post, bounds, F.lit(1_502), ["q"], k, frequency)
        assert sorted((r.q, r["rank"], r.doc_id, round(r.score, 9)) for r in got.collect()) == sorted(
            (r.q, r["rank"], r.doc_id, round(r.score, 9)) for r in want.collect())
    real = Q.lookup_join

    def counting(big, small, on, *args, **kwargs):
        out = real(big, small, on, *args, **kwargs)
        if on == ["term", "block"]:
            read.add(out.count())
        return out

    monkeypatch.setattr(Q, "lookup_join", counting)
    Q.pruned_topk(q, post, bounds, F.lit(1_502), ["q"], 5, frequency).collect()
    every = W.query_terms(q, ["q"]).join(post, ["term"]).count()
    assert 0 < read.value < 0.5 * every, (read.value, every)


def test_many_segments_are_merged_and_a_rebuild_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(index, "MAX_SEGMENTS", 3)
    rows = dict(OLD)
    index.write_index(spark, "t_many", _points(spark, OLD), parts=2)
    for i in range(4):
        change = {"abcdef"[i]: f"hats {i} shoes", "x": "green " * i}
        rows |= change
        index.write_index(spark, "t_many", _points(spark, list(change.items())), recreate=False)
        assert len(store.read_manifest(spark, "t_many")["segments"]) <= 3
    index.write_index(spark, "t_once", _points(spark, list(rows.items())), parts=2)
    assert _found(spark, "t_many") == _found(spark, "t_once")
    index.rebuild_sparse(spark, "t_many")
    assert _found(spark, "t_many") == _found(spark, "t_once")
    stale = store.read_manifest(spark, "t_many")
    with pytest.raises(RuntimeError):
        store.commit(spark, "t_many", stale)
    for name in ("t_many", "t_once"):
        store.drop_index(spark, name)


def test_a_page_reads_the_files_that_hold_it(spark):
    points = spark.range(5_000).select(F.format_string("%06d", F.col("id") * 3).alias("id"), F.col("id").alias("v")).repartition(6)
    store.write_sorted(points, "t_sorted", rows_per_file=100)
    assert len(spark.table("t_sorted").inputFiles()) > 30
    want = sorted(r.id for r in points.collect())
    for after, limit in ((None, 150), ("000003", 1), (want[3_333], 250), (want[-20], 100), (want[-1], 5), ("0", 10_000)):
        page = store.scroll_sorted(spark, "t_sorted", after, limit)
        assert [r.id for r in page.collect()] == [i for i in want if after is None or i > after][:limit]
        if limit <= 250:
            assert len(page.inputFiles()) <= limit // 60 + 3
            assert "rangepartitioning" not in page._jdf.queryExecution().executedPlan().toString()
    store.drop_sorted(spark, "t_sorted")


def test_compat_ids_collide_and_full_ids_do_not(spark):
    post = spark.createDataFrame([("p1", "t", "c", 2024, 5, "shopping", [("c1", 1, "one", 2024, 5), ("c2", 1, "two", 2024, 5)])], POST)
    new = {r["id"] for r in index.index_rows(post).collect()}
    old = {r["id"] for r in index.index_rows(post, compat_ids=True).collect()}
    assert len(new) == 3 and old == {"6ee505de-8c09-56f5-a95a-78d1c3f0cf3d", "68422116-165f-522d-96f8-715f89d4f58f"}


def test_embedder_runs_in_tasks(spark):
    chunks = chunk_posts(_post(spark))
    got = index.embed(chunks, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert all(r["vector"] == [float(len(r["page_content"])), 1.0] for r in got)


def _evaluated(spark, **judges):
    base = {"response": "plain words", "run_id": "r", "faithfulness_json": None, "actionability_json": None, "retrieval_json": None, "query_id": "q"}
    row = {**base, **judges}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return evaluation.evaluate(df)


def test_overall_score(spark):
    r = _evaluated(spark, faithfulness_json='{"faithfulness": 0.9}', actionability_json='{"actionability": 0.8}').first()
    assert r["overall_score"] == pytest.approx(0.64) and r["retrieval_relevance"] is None
    assert _evaluated(spark).first()["overall_score"] == 0.5
    bad = _evaluated(spark, retrieval_json="{oops").first()
    assert (bad["retrieval_relevance"], bad["retrieval_reasoning"]) == (0.5, "Parse failed")
    df = E.with_judges(E.with_checks(spark.createDataFrame([("x", '{"faithfulness": 0.9}', None, None)],
                       "response string, faithfulness_json string, actionability_json string, retrieval_json string")))
    assert E.with_overall(df, renormalise=True).first()["overall_score"] == pytest.approx(0.9)


def test_feedback_rows(spark):
    rows = {r["key"]: r for r in evaluation.feedback(_evaluated(spark, faithfulness_json='{"faithfulness": 0.9, "reasoning": ""}')).collect()}
    assert set(rows) == {"overall_score", "heuristic_score", "faithfulness", "faithfulness_reasoning"}
    assert rows["faithfulness_reasoning"]["comment"] == "N/A"
    assert rows["heuristic_score"]["comment"].endswith('{"has_products": false, "has_specifics": false, "response_length": 2}')
    assert evaluation.feedback(_evaluated(spark, run_id="")).count() == 0


def test_count_is_a_subquery(spark):
    df = spark.range(5)
    assert df.withColumn("n", count_rows(df)).first()["n"] == 5


def test_a_write_leaves_no_intermediate_tables(spark):
    before = staged()
    index.write_index(spark, "t_left", _points(spark, [("a", "alpha beta"), ("b", "beta")]), parts=1)
    index.write_index(spark, "t_left", _points(spark, [("b", "gamma")]), recreate=False)
    index.rebuild_sparse(spark, "t_left")
    assert staged() == before and index.open_points(spark, "t_left").count() == 2
    store.drop_index(spark, "t_left")


def test_stored_postings_are_small_and_score_as_flat_ones(spark, monkeypatch):
    """Best lists of a stored index in three segments, with replaced points, ties, a null id and queries in several groups,
    equal those over all points; postings have a row for each term and block, not for each document."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.8)) % 200}" for _ in range(40_000)]
    texts = [" ".join(words[i * 20:i * 20 + rng.choice([0, 1, 5, 20])]) for i in range(1_500)]
    rows = {f"p{i}": t for i, t in enumerate(texts)}
    index.write_index(spark, "t_small", _points(spark, list(rows.items()) + [(None, "w1 w2 w3")]), parts=3)
    for i in range(2):
        change = {f"p{j}": texts[(j * 7 + i) % 1_500] for j in range(i * 50, i * 50 + 200)} | {f"n{i}": "w1 w2"}
        rows |= change
        index.write_index(spark, "t_small", _points(spark, list(change.items())), recreate=False)
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(40)] + [(98, "nothing here"), (99, "")], "q int, text string")
    held = index.open_sparse(spark, "t_small")
    whole = index.SparseIndex.of(_points(spark, list(rows.items()) + [(None, "w1 w2 w3")]), "id", "page_content")
    for k, most in ((1, 4_096), (10, 4_096), (3_000, 4_096), (10, 7)):
        monkeypatch.setattr(Q, "_SCORE_CELLS", 128 * 42 * (1 if k < 100 else 5))
        live = held.docs.join(held.dead, ["block", "no"], "left_anti")
        got = Q.packed_topk(q, held.packed, live, held.n_docs, ["q"], k, held.terms, max_queries=most)
        want = whole.topk(q, ["q"], k)
        assert sorted((r.q, r["rank"], str(r.doc_id), round(r.score, 9)) for r in got.collect()) == sorted(
            (r.q, r["rank"], str(r.doc_id), round(r.score, 9)) for r in want.collect())
    by_term = {t: round(w, 6) for t, w in held.weights(named=False).groupBy("term").agg(F.sum("weight")).collect()}
    assert by_term == {t: round(w, 6) for t, w in whole.weights().groupBy("term").agg(F.sum("weight")).collect()}
    assert held.packed.count() < 0.25 * whole.postings.count()
    store.drop_index(spark, "t_small")
