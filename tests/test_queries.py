"""Every named query against its SQL at the smallest scale, and against rules on its plan."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_DIR
from tests.oracle import compare, connect
from threadmine.operators import search as Q


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) == ""
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


PRODUCT_FREE = ["hybrid_search", "sparse_topk", "dense_topk", "merge_top", "merge_daily", "tfidf_weights",
                "land_daily", "join_reports", "first_event_flag", "session_states", "build_index"]


@pytest.mark.parametrize("name", PRODUCT_FREE)
def test_no_cross_product_in_the_plan(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    df = queries()["since_predicate"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in plan


@pytest.mark.parametrize("name", ["top_posts_per_forum", "log_scan"])
def test_limits_are_whole(spark, name):
    """50 posts of each of 20 forums, 1,000 records; the small tables hold fewer, so the larger ones are read."""
    assert queries()[name](spark, "/root/testdata/sf0.1").count() == 1_000


def test_hits_go_to_the_texts(spark, monkeypatch):
    """The few hits are sent to where texts are read; texts are neither shuffled nor sorted for them."""
    joined, real = [], Q.with_text

    def counting(hits, docs, columns, bounded=False):
        joined.append(real(hits, docs, columns, bounded))
        return joined[-1]

    monkeypatch.setattr(Q, "with_text", counting)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("dedupe_first_text", "recall_at_k"):
            queries()[name](spark, SF_DIR)
        plans = [j._jdf.queryExecution().executedPlan().toString() for j in joined]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any("SortMergeJoin" in p for p in plans)
