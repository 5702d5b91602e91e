"""Keyed tables: get, put, delete, upsert and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.operators.ranking import top_k
from threadmine.session import lookup_join


def get_keys(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return lookup_join(table, wanted.select(*keys).distinct(), keys, keys, "left_semi")


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def newest_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The whole row with the greatest ``order`` of each key; a plain aggregate with map-side combine."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Insert or replace by key. Several changes of one key: the last in ``order`` wins, any one without an order."""
    incoming = newest_per_key(changes, keys, F.struct(*order)) if order else changes.dropDuplicates(keys)
    kept = delete_keys(table, incoming, keys)
    return kept.unionByName(incoming.select(*table.columns))


def known_columns(rows: DataFrame, known: list[str]) -> DataFrame:
    """Only the columns that the target knows."""
    return rows.select(*[c for c in rows.columns if c in known])


def expired_objects(
    listing: DataFrame, as_of: Column, prefix: list[str], retention_days: int = 30, keep: int = 5
) -> DataFrame:
    """Objects older than the retention that are not among the newest ``keep`` of their prefix.

    ``listing`` is ``(*prefix, key, modified)``. The protected rows are found by a
    top-k and taken away by key, so a prefix with very many objects is never sorted as one group.
    """
    protected = top_k(listing, prefix, [F.col("modified").desc(), F.col("key")], max(keep, 0), "_n") if keep > 0 else None
    old = listing.where(F.col("modified") < F.date_sub(as_of, retention_days))
    if protected is None:
        return old
    return old.join(protected.select(*prefix, "key"), [*prefix, "key"], "left_anti")


def retention_report(
    listing: DataFrame, as_of: Column, prefix: list[str], retention_days: int = 30, keep: int = 5
) -> DataFrame:
    """``(*prefix, deleted, protected, total)``."""
    expired = expired_objects(listing, as_of, prefix, retention_days, keep).groupBy(*prefix).agg(
        F.count(F.lit(1)).alias("_deleted")
    )
    total = listing.groupBy(*prefix).agg(F.count(F.lit(1)).alias("total"))
    return total.join(expired, prefix, "left").select(
        *prefix, F.coalesce("_deleted", F.lit(0)).cast("bigint").alias("deleted"),
        F.least(F.col("total"), F.lit(max(keep, 0))).cast("bigint").alias("protected"), "total",
    )
