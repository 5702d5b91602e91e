"""Merging new posts into the curated table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmine.operators import curate as C
from threadmine.schemas import PARTITIONS
from threadmine.session import stage
from threadmine.sources import posts as S

# What a daily merge touches: the forum and the month of the post, not the day it was ingested.
TOUCH = ["subreddit_name", "year", "month"]


def merge_top(
    existing: DataFrame | None, new: DataFrame, pruned: bool = False, counts: C.WrittenCounts | None = None
) -> DataFrame:
    """All-time merge: new rows replace existing ones of the same id.

    Without existing rows the new ones are the result; without an id on both
    sides the two are appended. A column that only one side has is null on the other's rows.
    ``pruned``: see :func:`curate.without_ids`. ``counts`` gets the rows ``new``, ``kept`` and ``merged``.
    """
    watch = counts.watch if counts else lambda name, df: df
    if existing is None:
        return watch("new", new)
    both = "id" in existing.columns and "id" in new.columns
    kept = watch("kept", C.without_ids(existing, new, pruned=pruned) if both else existing)
    return watch("merged", kept.unionByName(watch("new", new), allowMissingColumns=True))


def _touch(existing: DataFrame, new: DataFrame) -> list[str]:
    """The forum alone where a side does not know the posts' months."""
    return TOUCH if {*TOUCH} <= {*existing.columns} & {*new.columns} else TOUCH[:1]


def merge_daily(existing: DataFrame | None, new: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Daily merge: the (forum, year, month) the new rows touch, one row per forum and id, new rows first.

    The months are those of the posts, so a post is found again on whatever day it was ingested.
    Rows of a month that is not touched are not part of the result.
    """
    fresh = new.withColumn("_age", F.lit(0))
    both = fresh if existing is None else fresh.unionByName(
        C.in_touched_partitions(existing, new, _touch(existing, new)).withColumn("_age", F.lit(1)), allowMissingColumns=True
    )
    newest = [F.col("_age"), *(order or [F.col("score").desc()])]
    return C.dedupe_latest(both, ["subreddit_name", "id"], newest).drop("_age")


def run_merge_top(
    spark: SparkSession, raw: DataFrame, curated_path: str, next_path: str, counts: C.WrittenCounts | None = None
) -> bool:
    """Merge a snapshot into the table at ``curated_path`` and write the whole to ``next_path``.

    The result goes to a fresh folder, so no partition that lost its last row
    survives. Returns False, and writes nothing, if there are no new rows. Stored rows that no new id
    can replace are passed on without a shuffle. ``counts`` is filled by the write.
    """
    if raw.isEmpty():
        return False
    S.write_curated(merge_top(S.read_curated(spark, curated_path), raw, True, counts), next_path, replace_all=True)
    return True


def run_merge_daily(spark: SparkSession, raw: DataFrame, curated_path: str) -> bool:
    """Merge a day's rows into the months they touch, in place.

    Stored partitions are days of ingestion. Those that hold a touched row are written anew, with
    their untouched rows; those that lose their last row are removed. The new content is
    written out before anything is replaced, since the partitions are also its input.
    """
    if raw.isEmpty():
        return False
    existing = S.read_curated(spark, curated_path)
    merged = merge_daily(existing, raw)
    if existing is None:
        S.write_curated(merged, curated_path)
        return True
    keys = _touch(existing, raw)
    touched = C.touched_partitions(C.in_touched_partitions(existing, raw, keys))
    affected = stage(touched.unionByName(C.touched_partitions(raw)).distinct(), "affected")
    beside = C.in_touched_partitions(existing, affected).join(raw.select(*keys).distinct(), keys, "left_anti")
    content = stage(merged.unionByName(beside, allowMissingColumns=True), "merged")
    S.write_curated(content, curated_path)
    S.remove_partitions(spark, curated_path, affected.join(C.touched_partitions(content), PARTITIONS, "left_anti"))
    return True
