"""Landing fetched posts: what a day or a snapshot adds to the raw data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.operators import curate as C
from threadmine.schemas import PARTITIONS
from threadmine.session import stage
from threadmine.sources import posts as S


def _take(posts: DataFrame, comments: DataFrame, limit: int, hot: DataFrame | None) -> DataFrame:
    chosen = C.top_posts(posts, limit).drop("rank")
    if hot is not None:
        # The second list is only asked for with the daily limit.
        chosen = C.union_distinct(chosen, C.top_posts(hot, limit).drop("rank"), ["subreddit_name", "id"])
    kept = C.first_comments(
        comments.join(chosen.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    )
    return C.normalise_posts(C.attach_comments(chosen, kept))


def land_daily(
    posts: DataFrame, comments: DataFrame, seen: DataFrame, landed: DataFrame, as_of: Column, now: Column,
    hot: DataFrame | None = None, limit: int = C.DAILY_LIMIT,
) -> DataFrame:
    """Posts to write for one day: the best of each forum with comments, not seen before.

    Forums whose day has already landed are skipped before anything else.
    """
    dated = C.stamp_ingest_date(posts, as_of)
    fresh = C.not_landed(dated, landed, PARTITIONS)
    second = None if hot is None else C.not_landed(C.stamp_ingest_date(hot, as_of), landed, PARTITIONS)
    return C.unseen(_take(fresh, comments, limit, second), seen, now)


def land_top(posts: DataFrame, comments: DataFrame, landed: DataFrame, as_of: Column, limit: int = C.TOP_LIMIT) -> DataFrame:
    """Posts of an all-time snapshot, for the forums that have none yet."""
    fresh = C.not_landed(C.stamp_ingest_date(posts, as_of), landed, ["subreddit_name"])
    return _take(fresh, comments, limit, None)


def run_land_daily(
    posts: DataFrame, comments: DataFrame, seen: DataFrame, root: str, as_of: Column, now: Column,
    hot: DataFrame | None = None, limit: int = C.DAILY_LIMIT,
) -> DataFrame:
    """Land one day below ``root`` as raw JSON; gives the seen table with the landed posts added.

    What has landed is read from ``root`` itself. The day's posts are written out before they are
    appended and marked, so both hold the same posts.
    """
    landed = S.landed_partitions(posts.sparkSession, root)
    chosen = stage(land_daily(posts, comments, seen, landed, as_of, now, hot, limit), "landing")
    S.write_raw_json(chosen, root)
    return C.mark_seen(seen, chosen, now)


def run_land_top(posts: DataFrame, comments: DataFrame, root: str, as_of: Column, limit: int = C.TOP_LIMIT) -> DataFrame:
    """Land the snapshot of the forums that have none below ``root`` yet; gives the landed posts."""
    landed = S.landed_snapshots(posts.sparkSession, root)
    chosen = stage(land_top(posts, comments, landed, as_of, limit), "landing")
    S.write_snapshot_json(chosen, root, "append")
    return chosen


def landing_totals(landed: DataFrame, forums: DataFrame) -> DataFrame:
    """Posts per forum and whether the forum succeeded, for every forum that was asked for."""
    n = landed.groupBy("subreddit_name").agg(F.count(F.lit(1)).alias("n"))
    return forums.select("subreddit_name").distinct().join(n, "subreddit_name", "left").select(
        "subreddit_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_posts"),
        F.col("n").isNotNull().alias("success"),
    )
