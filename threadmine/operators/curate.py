"""Curation of posts: normalising, filtering, de-duplicating and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadmine.functions import text as X
from threadmine.functions import times
from threadmine.operators.bloom import bloom_anti_join, maybe_in
from threadmine.operators.ranking import latest, top_k
from threadmine.schemas import PARTITIONS
from threadmine.session import lookup_join, stage

# Posts taken per forum for all time and per day, and comments taken per post.
TOP_LIMIT, DAILY_LIMIT, COMMENTS_LIMIT = 200, 50, 5


# -- rows --------------------------------------------------------------------

def normalise_posts(posts: DataFrame) -> DataFrame:
    """Lower-case forum, integer score, year and month, an empty list for missing comments."""
    out = posts.withColumns({
        "subreddit_name": F.lower("subreddit_name"),
        **{c: F.col(c).try_cast("int") for c in ("score", "year", "month") if c in posts.columns},
    })
    if "comments" in posts.columns:
        kind = posts.schema["comments"].dataType
        out = out.withColumn("comments", F.coalesce("comments", F.array().cast(kind)))
    return out


def stamp_ingest_date(posts: DataFrame, as_of: Column) -> DataFrame:
    """Set the ingest date; rows that already have one keep it."""
    def keep(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name).cast("int"), value) if name in posts.columns else value

    return posts.withColumns({
        "created_at_year": keep("created_at_year", F.year(as_of)),
        "created_at_month": keep("created_at_month", F.month(as_of)),
        "created_at_day": keep("created_at_day", F.dayofmonth(as_of)),
    })


def post_rows(raw: DataFrame) -> DataFrame:
    """Rows of the remote forum (``selftext``, ``created_utc``, ``display_name``) as posts."""
    year, month = times.utc_year_month(F.col("created_utc"))
    return raw.select(
        "id", "title", F.col("title").alias("original_title"), "score", "url",
        F.col("selftext").alias("content"), year.alias("year"), month.alias("month"),
        F.lower("display_name").alias("subreddit_name"),
    )


def drop_removed(comments: DataFrame, body: str = "body") -> DataFrame:
    return comments.where(~F.coalesce(X.is_removed(F.col(body)), F.lit(False)))


def drop_short(comments: DataFrame, body: str = "body", minimum: int = 10) -> DataFrame:
    return comments.where(~X.is_short(F.col(body), minimum))


# -- dates -------------------------------------------------------------------

def since(posts: DataFrame, day: Column) -> DataFrame:
    """Posts ingested on ``day`` or later.

    On the partition columns alone, so that it prunes partitions of a stored table.
    """
    stored = times.day_of(F.col("created_at_year"), F.col("created_at_month"), F.col("created_at_day"))
    return posts.where(stored >= day)


def since_by_component(posts: DataFrame, year: int, month: int, day: int) -> DataFrame:
    """The date test as three comparisons of unpadded strings, each on its own.

    Kept for results that must equal those of stores that hold the parts as text:
    month 10 is not ``>= '9'`` and day 1 of the next month is not ``>= '28'``.
    """
    parts = zip(("created_at_year", "created_at_month", "created_at_day"), (year, month, day))
    return posts.where(reduce(
        lambda a, b: a & b, [F.col(c).cast("string") >= F.lit(str(v)) for c, v in parts]
    ))


def last_days(posts: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Posts of ``as_of`` and the ``days - 1`` days before."""
    stored = times.day_of(F.col("created_at_year"), F.col("created_at_month"), F.col("created_at_day"))
    return posts.where((stored > F.date_sub(as_of, days)) & (stored <= as_of))


def in_forums(posts: DataFrame, forums: list[str]) -> DataFrame:
    """Posts of the listed forums; names are compared in lower case and once each."""
    return posts.where(F.lower("subreddit_name").isin(*sorted({f.lower() for f in forums})))


# -- anti-joins and sets -----------------------------------------------------

def without_ids(existing: DataFrame, new: DataFrame, key: str = "id", pruned: bool = False) -> DataFrame:
    """Existing rows whose id the new data does not hold.

    ``pruned``: rows that a Bloom filter of the new ids rules out as partners are not shuffled for the join, which
    pays where rows are wide and the new ids too many to broadcast; the new ids are written first.
    """
    if pruned:
        return bloom_anti_join(existing, stage(new.select(key).distinct(), "ids"), [key])
    return existing.join(new.select(key).distinct(), key, "left_anti")


def unseen(posts: DataFrame, seen: DataFrame, now: Column, pruned: bool = False) -> DataFrame:
    """Posts that are not in the seen table of their forum, expired entries not counted.

    ``pruned``: of the seen table only rows that a Bloom filter of the posts lets through go into the join.
    """
    keys = ["id", "subreddit_name"]
    live = seen.where(F.col("ttl") > now).select(
        F.col("post_id").alias("id"), F.col("subreddit").alias("subreddit_name")
    )
    if pruned:
        live = maybe_in(live, stage(posts.select(*keys).distinct(), "ids"), keys)
    return posts.join(live, keys, "left_anti")


def mark_seen(seen: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    """Seen table with the posts added row by row where absent; an entry that is there stays."""
    added = posts.select(
        F.col("id").alias("post_id"), F.col("subreddit_name").alias("subreddit"), now.cast("bigint").alias("pulled_at"),
    ).distinct().withColumn("ttl", times.ttl(F.col("pulled_at"), times.SEEN_DAYS))
    fresh = added.join(seen.where(F.col("ttl") > now), ["post_id", "subreddit"], "left_anti")
    kept = seen.join(fresh, ["post_id", "subreddit"], "left_anti")
    return kept.unionByName(fresh)


def not_landed(incoming: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose whole (day, forum) has not been written yet."""
    return incoming.join(landed.select(*keys).distinct(), keys, "left_anti")


def seen_of_forum(seen: DataFrame, forum: str) -> DataFrame:
    return seen.where(F.col("subreddit") == forum.lower())


def union_distinct(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both lists, one per key; a row of the first list wins."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return latest(both, keys, [F.col("_side")]).drop("_side")


def dedupe_latest(posts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (newest first, by convention)."""
    return latest(posts, keys, order)


def duplicates_removed(posts: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows in, distinct keys, difference."""
    per_key = posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("combined"), F.count(F.lit(1)).alias("distinct_rows"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("removed"),
    )


def touched_partitions(new: DataFrame, keys: list[str] = PARTITIONS) -> DataFrame:
    return new.select(*keys).distinct()


def in_touched_partitions(existing: DataFrame, new: DataFrame, keys: list[str] = PARTITIONS) -> DataFrame:
    """Existing rows of the partitions that the new data touches.

    A semi-join on partition columns: on a stored table Spark prunes to those partitions.
    """
    return lookup_join(existing, touched_partitions(new, keys), keys, ["id"], "left_semi")


# -- posts and comments ------------------------------------------------------

def top_posts(posts: DataFrame, limit: int, forum: str = "subreddit_name") -> DataFrame:
    """Best ``limit`` posts of each forum by score, ties by id."""
    return top_k(posts, [forum], [F.col("score").desc(), F.col("id")], limit)


def first_comments(
    comments: DataFrame, limit: int = COMMENTS_LIMIT, order: list[Column] | None = None
) -> DataFrame:
    """The first ``limit`` comments of each post, and of those the ones that were not taken down.

    The cut comes first: a removed comment uses up one of the places.
    """
    order = order or [F.col("seq")]
    return drop_removed(top_k(comments, ["post_id"], order, limit, "place"))


def attach_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with their comments as an array in order of ``place``; none gives an empty array.

    ``comments`` comes from :func:`first_comments`, so the arrays are short.
    """
    fields = [c for c in comments.columns if c not in ("post_id", "seq", "place")]
    lists = comments.groupBy("post_id").agg(
        F.array_sort(F.collect_list(F.struct("place", *fields))).alias("comments")
    ).select(
        F.col("post_id").alias("id"),
        F.transform("comments", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("comments"),
    )
    joined = posts.drop("comments").join(lists, "id", "left")
    return joined.withColumn("comments", F.coalesce("comments", F.array().cast(lists.schema["comments"].dataType)))


class WrittenCounts:
    """Row counts of the steps of a job, taken while its result is written; no frame is read for them alone."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, counted under ``name`` by the next action on it. It may stand at one place of the plan only."""
        self._seen[name] = Observation()
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """Waits for the action."""
        return {name: seen.get["n"] for name, seen in self._seen.items()}


def stage_counts(**frames: DataFrame) -> DataFrame:
    """``(stage, n)`` for named frames; each is computed for its count. See :class:`WrittenCounts` for frames that are written anyway."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counted)
