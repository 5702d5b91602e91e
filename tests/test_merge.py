"""Merges through partitioned storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmine.plans.merge import merge_top, run_merge_daily
from threadmine.sources import posts as P

SCHEMA = "id string, subreddit_name string, year int, month int, score int, created_at_year int, created_at_month int, created_at_day int"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_a_post_that_comes_again_on_another_day_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "curated")
    P.write_curated(_rows(spark, ("1", "007", 2025, 8, 1, 2025, 9, 1), ("2", "007", 2025, 7, 1, 2025, 9, 1),
                          ("3", "007", 2025, 8, 1, 2025, 9, 3), ("9", "f", 2025, 8, 1, 2025, 9, 1)), path)
    assert run_merge_daily(spark, _rows(spark, ("1", "007", 2025, 8, 5, 2025, 9, 2), ("3", "007", 2025, 8, 6, 2025, 9, 2)), path)
    got = sorted((r.id, r.subreddit_name, r.score, r.created_at_day) for r in P.read_curated(spark, path).collect())
    assert got == [("1", "007", 5, 2), ("2", "007", 1, 1), ("3", "007", 6, 2), ("9", "f", 1, 1)]
    assert not (tmp_path / "curated/created_at_year=2025/created_at_month=9/created_at_day=3/subreddit_name=007").exists()


def test_columns_of_one_side_stay(spark, tmp_path):
    old = _rows(spark, ("1", "f", 2025, 8, 1, 2025, 9, 1)).withColumn("comments", F.lit("c"))
    new = _rows(spark, ("2", "f", 2025, 8, 1, 2025, 9, 1)).withColumn("flair", F.lit("x"))
    merged = {r.id: r for r in merge_top(old, new).collect()}
    assert merged["1"].comments == "c" and merged["1"].flair is None
    assert merged["2"].comments is None and merged["2"].flair == "x"
    path = str(tmp_path / "curated")
    P.write_curated(old, path)
    run_merge_daily(spark, new, path)
    assert {r.id: r.comments for r in P.read_curated(spark, path).collect()} == {"1": "c", "2": None}


def test_lines_that_are_no_json_are_listed_and_left_out(spark, tmp_path):
    folder = tmp_path / "created_at_year=2025/created_at_month=9/created_at_day=1/subreddit_name=007"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text('{"id": "1", "title": "t"}\n{broken\n\n{"id": "2"}\n')
    posts = P.read_posts_json(spark, str(tmp_path))
    assert sorted(r.id for r in posts.collect()) == ["1", "2"] and posts.count() == 2
    assert {r.subreddit_name for r in posts.collect()} == {"007"}
    assert [r.line for r in P.corrupt_lines(spark, str(tmp_path)).collect()] == ["{broken"]
