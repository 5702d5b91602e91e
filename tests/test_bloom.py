from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from threadmine import session
from threadmine.operators import bloom


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 1000 == 0, None).otherwise(F.col("id") % 20_000).alias("id"), F.col("id").cast("string").alias("a.b"))
    keys = session.stage(spark.range(0, 20_000, 7).select("id", F.lit("other").alias("a")).union(spark.sql("SELECT cast(null AS bigint), 'x'")))
    return rows, keys


def test_joins_equal_plain_ones(tables):
    rows, keys = tables
    for ours, how in ((bloom.bloom_anti_join, "left_anti"), (bloom.bloom_semi_join, "left_semi")):
        got, want = ours(rows, keys, ["id"]), rows.join(keys, ["id"], how)
        assert got.columns == rows.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_few_rows_without_a_partner_reach_the_join(tables):
    rows, keys = tables
    found, real = bloom.maybe_in(rows, keys, ["id"]).count(), rows.join(keys, ["id"], "left_semi").count()
    assert real <= found <= real + 0.03 * 30_000


def test_keys_of_several_columns_and_structs(spark, tables):
    rows = tables[0].select(F.struct("id", F.lit(None).cast("int").alias("n")).alias("k"), (F.col("id") % 5).alias("m"))
    keys = rows.where("m = 3").distinct()
    assert bloom.bloom_anti_join(rows, keys, ["k", "m"]).count() == rows.where("m IS NULL OR m <> 3").count()


def test_empty_tables(spark, tables):
    rows, keys = tables
    assert bloom.bloom_anti_join(rows, keys.limit(0), ["id"]).count() == 30_000
    assert bloom.bloom_anti_join(rows.limit(0), keys, ["id"]).count() == 0
    assert bloom.bloom_semi_join(rows, keys.limit(0), ["id"]).count() == 0


def test_intermediates_are_discarded_but_for_those_still_read(spark):
    before = session.staged()
    first, second = session.stage(spark.range(5), "first"), session.stage(spark.range(6), "second")
    folders = [os.path.dirname(df.inputFiles()[0]).removeprefix("file://") for df in (first, second)]
    session.discard_staged(spark, before, second)
    assert [os.path.exists(f) for f in folders] == [False, True]
    assert second.count() == 6
    assert session.staged() == before + 1
