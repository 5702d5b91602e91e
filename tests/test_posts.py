"""Sources, curation, merging and landing."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from threadmine.operators import curate as C
from threadmine.operators import tables as B
from threadmine.operators.ranking import order_statistics, with_row_index
from threadmine.plans import landing, merge
from threadmine.sources import posts as P
from threadmine.sources import store

ROW = "id string, subreddit_name string, score int, created_at_year int, created_at_month int, created_at_day int"


def _posts(spark, rows):
    return spark.createDataFrame(rows, ROW)


def _ids(df):
    return sorted((r["id"], r["score"]) for r in df.collect())


def test_json_array_becomes_rows_with_schema(spark, tmp_path):
    folder = tmp_path / "top_posts" / "subreddit_name=shoes"
    folder.mkdir(parents=True)
    post = {"id": "1", "title": "T", "unknown": 1, "score": 3, "year": 2024, "month": 5,
            "comments": [{"id": "c", "score": 1, "body": "b", "year": 2024, "month": 6}]}
    (folder / "data.json").write_text(json.dumps([post, {**post, "id": "2", "comments": None}]))
    rows = P.read_snapshots(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["1", "2"] and rows[0]["comments"][0]["body"] == "b"
    assert rows[0]["subreddit_name"] == "shoes" and rows[0]["url"] is None and "unknown" not in rows[0].asDict()


def test_forum_wrapper(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"subreddit": "Shoes", "post_count": 2, "posts": [{"id": "1"}, {"id": "2"}]}))
    rows = P.read_forum_files(spark, str(tmp_path / "f.json")).collect()
    assert {r["id"] for r in rows} == {"1", "2"} and {r["subreddit_name"] for r in rows} == {"shoes"}


def test_missing_table_is_none_and_other_errors_raise(spark, tmp_path):
    assert P.read_curated(spark, str(tmp_path / "nothing")) is None


def test_numeric_forum_and_padded_days_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "t")
    P.write_curated(_posts(spark, [("1", "123", 1, 2025, 9, 7)]), path)
    row = P.read_curated(spark, path).first()
    assert (row["subreddit_name"], row["created_at_month"], row["created_at_day"]) == ("123", 9, 7)


def test_full_merge_leaves_no_stale_partition(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    P.write_curated(_posts(spark, [("1", "f", 1, 2025, 9, 1), ("2", "f", 1, 2025, 9, 2)]), first)
    assert merge.run_merge_top(spark, _posts(spark, [("1", "f", 9, 2025, 9, 3)]), first, second)
    assert _ids(P.read_curated(spark, second)) == [("1", 9), ("2", 1)]


def test_daily_merge_in_place(spark, tmp_path):
    path = str(tmp_path / "a")
    P.write_curated(_posts(spark, [("1", "f", 1, 2025, 9, 1), ("2", "f", 1, 2025, 9, 1), ("3", "f", 1, 2025, 9, 2)]), path)
    new = _posts(spark, [("1", "f", 9, 2025, 9, 1), ("4", "f", 9, 2025, 9, 1)])
    for _ in range(2):  # the same day twice changes nothing more
        assert merge.run_merge_daily(spark, new, path)
        assert _ids(P.read_curated(spark, path)) == [("1", 9), ("2", 1), ("3", 1), ("4", 9)]


def test_nothing_new_writes_nothing(spark, tmp_path):
    empty = _posts(spark, [])
    assert not merge.run_merge_daily(spark, empty, str(tmp_path / "x"))
    assert not merge.run_merge_top(spark, empty, str(tmp_path / "x"), str(tmp_path / "y"))
    assert not (tmp_path / "x").exists() and not (tmp_path / "y").exists()


def test_merge_without_id_appends(spark):
    old, new = spark.createDataFrame([(1,)], "score int"), spark.createDataFrame([(1,), (2,)], "score int")
    assert merge.merge_top(old, new).count() == 3
    assert merge.merge_top(None, new).count() == 2


def test_date_predicates_differ_at_month_ends(spark):
    rows = _posts(spark, [("sep28", "f", 1, 2025, 9, 28), ("oct1", "f", 1, 2025, 10, 1), ("sep5", "f", 1, 2025, 9, 5)])
    real = C.since(rows, F.lit(dt.date(2025, 9, 28)))
    text = C.since_by_component(rows, 2025, 9, 28)
    assert {r["id"] for r in real.collect()} == {"sep28", "oct1"}
    # as text '10' < '9' loses October, and '5' >= '28' lets in the fifth
    assert {r["id"] for r in text.collect()} == {"sep28", "sep5"}


def test_date_predicate_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    P.write_curated(_posts(spark, [("1", "f", 1, 2025, 9, 1), ("2", "f", 1, 2025, 9, 2)]), path)
    df = C.since(P.read_curated(spark, path), F.lit(dt.date(2025, 9, 2)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "created_at_year" in filters and df.count() == 1


def test_seen_posts_expire_and_are_kept_row_by_row(spark):
    seen = spark.createDataFrame([("1", "f", 5, 100), ("2", "f", 5, 10)], "post_id string, subreddit string, pulled_at bigint, ttl bigint")
    posts = _posts(spark, [(i, "f", 1, 2025, 9, 1) for i in "123"])
    now = F.lit(50).cast("bigint")
    assert {r["id"] for r in C.unseen(posts, seen, now).collect()} == {"2", "3"}
    after = {r["post_id"]: (r["pulled_at"], r["ttl"]) for r in C.mark_seen(seen, posts, now).collect()}
    assert after["1"] == (5, 100) and after["2"] == after["3"] == (50, 50 + 360 * 86400) and len(after) == 3


def test_removed_comments_use_up_places(spark):
    bodies = ["[Removed]", "a", "b", "[deleted]", "c", "d"]
    comments = spark.createDataFrame([("p", f"c{i}", b, i) for i, b in enumerate(bodies)], "post_id string, id string, body string, seq int")
    kept = C.first_comments(comments)
    assert sorted(r["id"] for r in kept.collect()) == ["c1", "c2", "c4"]
    posts = spark.createDataFrame([("p",), ("q",)], "id string")
    out = {r["id"]: [c["id"] for c in r["comments"]] for r in C.attach_comments(posts, kept).collect()}
    assert out == {"p": ["c1", "c2", "c4"], "q": []}


def test_landing_skips_what_landed_and_what_was_seen(spark):
    posts = spark.createDataFrame([(f"{f}{i}", f, i) for f in ("a", "b") for i in range(60)], "id string, subreddit_name string, score int")
    comments = spark.createDataFrame([("a59", "c1", "text", 0)], "post_id string, id string, body string, seq int")
    seen = spark.createDataFrame([("a59", "a", 0, 10**10)], "post_id string, subreddit string, pulled_at bigint, ttl bigint")
    landed = _posts(spark, [("x", "b", 1, 2025, 10, 1)])
    out = landing.land_daily(posts, comments, seen, landed, F.lit(dt.date(2025, 10, 1)), F.lit(1)).collect()
    assert {r["id"] for r in out} == {f"a{i}" for i in range(10, 59)}


@pytest.mark.parametrize("most_sorted", [100_000, 3])
def test_order_statistics_equal_sorted_lists(spark, most_sorted):
    """Ties, few and many values, null keys and values; selection in one round and in several."""
    rng = random.Random(8)
    rows = [("ties", rng.choice([1.0, 2.0, 2.5])) for _ in range(900)] + [(None, rng.gauss(0, 1e6)) for _ in range(700)]
    rows += [("skew", 2.0 ** rng.randint(-300, 300)) for _ in range(800)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    fractions = {"low": 0.0, "p50": .5, "p95": .95, "p99": .99}
    got = order_statistics(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", fractions, most_sorted)
    want = {}
    for k in {k for k, v in rows if v is not None}:
        values = sorted(v for i, v in rows if i == k and v is not None)
        want[k] = tuple(values[int(len(values) * p)] for p in fractions.values())
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == want
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert order_statistics(spark.createDataFrame([], "k string, v double"), ["k"], "v", fractions).count() == 0


def test_row_index_and_order_statistics_with_a_hot_key(spark):
    values = [("hot", float(i % 7), i) for i in range(3000)] + [("cold", float(i), 5000 + i) for i in range(1, 21)]
    df = spark.createDataFrame(values, "k string, v double, id bigint").repartition(8)
    indexed = with_row_index(df, "k", "v", "id").orderBy("k", "v", "id").collect()
    assert [r["row_index"] for r in indexed] == list(range(len(values)))
    got = {r["k"]: r for r in order_statistics(df, ["k"], "v", {"p50": .5, "p95": .95, "p99": .99}).collect()}
    assert (got["cold"]["p50"], got["cold"]["p95"], got["cold"]["p99"]) == (11, 20, 20)
    hot = sorted(v for k, v, _ in values if k == "hot")
    assert (got["hot"]["p50"], got["hot"]["p95"]) == (hot[1500], hot[2850])


def test_keyed_table(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert sorted(map(tuple, B.upsert(table, changes, ["k"], ["n"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, B.delete_keys(table, changes, ["k"]).collect())) == [(1, "a")]
    assert sorted(map(tuple, B.get_keys(table, changes, ["k"]).collect())) == [(2, "b")]


def test_retention(spark):
    as_of = dt.date(2025, 11, 1)
    rows = [("p", f"k{i}", as_of - dt.timedelta(days=20 * i)) for i in range(8)]
    listing = spark.createDataFrame(rows, "prefix string, key string, modified date")
    gone = B.expired_objects(listing, F.lit(as_of), ["prefix"])
    assert {r["key"] for r in gone.collect()} == {"k5", "k6", "k7"}
    assert tuple(B.retention_report(listing, F.lit(as_of), ["prefix"]).first()) == ("p", 3, 5, 8)


def test_index_tables(spark):
    store.create_index(spark, "t_index", "id string, v int")
    store.create_index(spark, "t_index", "id string, v int")
    spark.sql("INSERT INTO t_index VALUES ('a', 1)")
    current = spark.table("t_index")
    store.replace_table(B.upsert(current, spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int"), ["id"]), "t_index")
    assert sorted(map(tuple, spark.table("t_index").collect())) == [("a", 2), ("b", 3)]
    store.create_index(spark, "t_index", "id string, v int", force=True)
    assert spark.table("t_index").count() == 0
    store.delete_index(spark, "t_index")
    assert not spark.catalog.tableExists("t_index")


def test_refresh_partitions(spark, tmp_path):
    path = str(tmp_path / "cat")
    spark.sql(f"CREATE TABLE t_cat (id string, y int) USING parquet PARTITIONED BY (y) LOCATION '{path}'")
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, y int").write.mode("append").partitionBy("y").parquet(path)
    P.refresh_partitions(spark, "t_cat")
    assert spark.table("t_cat").count() == 2
    spark.sql("DROP TABLE t_cat")


def test_layout_by_month(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2024, 5), ("2", 2024, 6), ("3", 2024, 5)], "id string, year int, month int")
    P.write_by_month(rows, str(tmp_path / "m"))
    assert (tmp_path / "m" / "year=2024" / "month=5").is_dir()
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "m")).where("month = 5").collect()} == {"1", "3"}
