"""Index tables in the catalog: create, drop, write, swap."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmine.operators.packed import unpacked
from threadmine.session import settings, stage

# Postings of one partition, and the most partitions of a table.
ROWS_PER_PART, MAX_PARTS = 20_000_000, 50_000
# Lanes that a task's postings are cut to.
MAX_LANES = 64


def create_index(spark: SparkSession, name: str, schema: str, force: bool = False) -> None:
    """Create an empty index table if it is not there; ``force`` drops it first."""
    if force:
        delete_index(spark, name)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def delete_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def replace_table(df: DataFrame, name: str) -> None:
    """Swap in new content for a table that ``df`` may read from.

    The content is written under another name first. The old table is renamed and dropped only after
    the new one has its name, so that a failure at any point leaves one of them whole.
    """
    spark = df.sparkSession
    delete_index(spark, f"{name}__next")
    df.write.saveAsTable(f"{name}__next")
    delete_index(spark, f"{name}__old")
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__old")
    spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")
    delete_index(spark, f"{name}__old")


def part_of(term: Column, parts: int) -> Column:
    """Partition of a term in a table of ``parts`` partitions."""
    return F.pmod(F.crc32(term.cast("binary")), F.lit(parts)).cast("int").alias("term_part")


def parts_for(rows: int) -> int:
    """Number of term partitions of a table with so many postings (at most ``MAX_PARTS``, beyond which they grow)."""
    return max(1, min(MAX_PARTS, -(-rows // ROWS_PER_PART)))


def lanes_for(parts: int | None) -> int:
    """Lanes that packets of postings are dealt to, before or after the number of partitions is known."""
    return min(parts or MAX_LANES, MAX_LANES)


def write_by_term(packets: DataFrame, name: str, parts: int) -> None:
    """Write a table of postings from their packets ``(lane, packet)``, partitioned by a hash of the term.

    A search reads the partitions of the terms it asks for and no others. A frequent term is spread over several
    files of its partition; in a file the blocks of one packet stand together.
    """
    dealt = packets.select(F.pmod("lane", F.lit(parts)).alias("lane"), "packet").hint("rebalance", F.col("lane"))
    rows = unpacked(dealt)
    with settings(packets.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "64"}):  # no sort by partition
        rows.select(*rows.columns, part_of(F.col("term"), parts)).write.mode("overwrite").option(
            "compression", "zstd").partitionBy("term_part").saveAsTable(name)


# -- seen posts ------------------------------------------------------------------
#
# A table that only grows, bucketed by its key: a batch is compared with it bucket by bucket, so the table is not
# shuffled, and what is written follows the batch.

SEEN_KEYS = ["subreddit", "post_id"]


def _write_seen(rows: DataFrame, name: str, buckets: int) -> None:
    columns = [*SEEN_KEYS, "pulled_at", "ttl", "batch"]
    rows.select(*columns).repartition(buckets, *SEEN_KEYS).write.bucketBy(buckets, *SEEN_KEYS).sortBy(*SEEN_KEYS).mode(
        "append").saveAsTable(name)


def create_seen(spark: SparkSession, name: str, buckets: int = 64) -> None:
    """An empty seen table. Choose buckets of some hundred MB for the size that the table will reach."""
    empty = spark.createDataFrame([], "subreddit string, post_id string, pulled_at bigint, ttl bigint, batch string")
    _write_seen(empty, name, buckets)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('seen_buckets' = '{buckets}')")


def seen_buckets(spark: SparkSession, name: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {name} ('seen_buckets')").first()["value"])


def add_unseen(spark: SparkSession, name: str, posts: DataFrame, now: Column, ttl: Column, batch: str) -> DataFrame:
    """The posts ``(id, subreddit_name, …)``, once each, that the table does not hold alive at ``now`` (seconds); they are added.

    A batch that is repeated after a failure gets the same answer, since its own rows are passed over: they may
    then stand in the table twice, which changes nothing and ends at the next ``compact_seen``.
    """
    live = spark.table(name).where((F.col("ttl") > now) & (F.col("batch") != batch)).select(*SEEN_KEYS)
    keyed = posts.dropDuplicates(["id", "subreddit_name"]).withColumns(
        {"subreddit": F.col("subreddit_name"), "post_id": F.col("id").cast("string")})
    fresh = stage(keyed.join(live.hint("merge"), SEEN_KEYS, "left_anti"), "fresh")
    _write_seen(fresh.select(*SEEN_KEYS, now.cast("bigint").alias("pulled_at"), ttl.cast("bigint").alias("ttl"), F.lit(batch).alias("batch")),
                name, seen_buckets(spark, name))
    return fresh.drop(*SEEN_KEYS)


def compact_seen(spark: SparkSession, name: str, now: Column) -> None:
    """Rewrite the table with one row for each key that is alive at ``now``, as one file for each bucket.

    The new content gets its name before the old one is dropped. Not while a batch is added.
    """
    buckets = seen_buckets(spark, name)
    rows = spark.table(name).where(F.col("ttl") > now)
    once = rows.groupBy(*SEEN_KEYS).agg(F.max(F.struct("ttl", "pulled_at", "batch")).alias("r")).select(*SEEN_KEYS, "r.*")
    delete_index(spark, f"{name}__next")
    _write_seen(once, f"{name}__next", buckets)
    spark.sql(f"ALTER TABLE {name}__next SET TBLPROPERTIES ('seen_buckets' = '{buckets}')")
    delete_index(spark, f"{name}__old")
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__old")
    spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")
    delete_index(spark, f"{name}__old")


# -- versions of an index ------------------------------------------------------
#
# An index is a list of segments, each with tables of points, postings, their documents, and changes in term counts.
# The list stands in one property of a small table, so it changes in one step: a reader sees all of a write or
# nothing, and tables of a write that ended early are never read.

KINDS = ("points", "postings", "docs", "terms")
LAYOUT = 2  # of the postings
_PROPERTY = "manifest"
KEPT_BATCHES = 1_000


def read_manifest(spark: SparkSession, name: str) -> dict | None:
    """Version, segments, number of points and committed batches of an index; None if there is none."""
    if not spark.catalog.tableExists(f"{name}_index"):
        return None
    held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}_index").collect()}
    return json.loads(held[_PROPERTY]) if _PROPERTY in held else None


def commit(spark: SparkSession, name: str, manifest: dict, batch: str | None = None) -> None:
    """Make ``manifest`` the next version. It must follow the current one; of two writers that started
    from one version the second is refused."""
    create_index(spark, f"{name}_index", "version bigint")
    current = read_manifest(spark, name)
    if (current or {"version": 0})["version"] != manifest["version"] - 1:
        raise RuntimeError(f"index {name} was changed by another writer")
    batches = [*(current or {"batches": []})["batches"], *([batch] if batch else [])][-KEPT_BATCHES:]
    text = json.dumps({**manifest, "batches": batches}).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {name}_index SET TBLPROPERTIES ('{_PROPERTY}' = '{text}')")


def segment_tables(segment: dict) -> list[str]:
    return list(segment.values())


def vacuum(spark: SparkSession, name: str) -> list[str]:
    """Drop the tables of segments that no version reads: replaced ones, and those of writes that ended early.

    Not while another writer is at work or a reader still uses an older version.
    """
    held = {t for s in (read_manifest(spark, name) or {"segments": []})["segments"] for t in segment_tables(s)}
    found = [t.name for t in spark.catalog.listTables(pattern=f"{name}_segment_*") if t.name not in held]
    for table in found:
        delete_index(spark, table)
    return found


def drop_index(spark: SparkSession, name: str) -> None:
    """Drop an index with all its tables."""
    delete_index(spark, f"{name}_index")
    vacuum(spark, name)


# -- tables in the order of a key ------------------------------------------------

def write_sorted(points: DataFrame, name: str, key: str = "id", rows_per_file: int = 1_000_000) -> None:
    """Replace a table with ``points`` in the order of a unique ``key``, and ``<name>_bounds`` with the range of each file.

    The ranges are those of a sampled range partitioning; each task sorts its own.
    """
    spark = points.sparkSession
    files = max(1, -(-points.count() // rows_per_file))
    drop_sorted(spark, name)
    points.repartitionByRange(files, key).sortWithinPartitions(key).write.saveAsTable(name)
    spark.table(name).groupBy(F.input_file_name().alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).write.saveAsTable(f"{name}_bounds")


def drop_sorted(spark: SparkSession, name: str) -> None:
    for table in (name, f"{name}_bounds"):
        delete_index(spark, table)


def scroll_sorted(spark: SparkSession, name: str, after=None, limit: int = 1_000, key: str = "id") -> DataFrame:
    """The next ``limit`` rows behind ``after`` of a table made by :func:`write_sorted`, in order.

    Only the files that hold the page are read, whichever page it is: the driver takes rows of the bounds, one for
    each file, until they hold enough rows.
    """
    table, wanted = spark.table(name), spark.table(f"{name}_bounds")
    if after is not None:
        wanted = wanted.where(F.col("high") > F.lit(after))
    files, held = [], 0
    # All rows of every file but the first are behind ``after``.
    for row in wanted.orderBy("low").limit(limit + 1).toLocalIterator():
        held += row["n"] if files or after is None or row["low"] > after else 0
        files.append(row["file"])
        if held >= limit:
            break
    if not files:
        return table.limit(0)
    rows = spark.read.schema(table.schema).parquet(*files)
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)
