"""Raw and curated posts on storage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine import schemas
from threadmine.operators.curate import normalise_posts
from threadmine.operators.ranking import with_row_index
from threadmine.schemas import PARTITIONS


def read_posts_json(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.POST) -> DataFrame:
    """Posts from JSON arrays or lines; unknown fields are dropped, missing ones are null.

    ``path`` may be a glob. Partition columns that are part of the path are read as text
    and cast, whatever Spark would infer for them. A line that is no JSON object of a post
    holds nothing and is left out; :func:`corrupt_lines` lists such lines.
    """
    posts = _typed(spark.read.schema(schema).option("mode", "PERMISSIVE").json(path))
    held = [F.col(f.name) for f in schema.fields if f.name not in PARTITIONS]
    return posts.where(reduce(or_, [c.isNotNull() for c in held]))


def corrupt_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, line)`` of the lines below ``path`` that are no JSON."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    return lines.where((F.trim("line") != "") & F.try_parse_json("line").isNull())


def _typed(posts: DataFrame) -> DataFrame:
    casts = {
        f.name: F.col(f.name).cast(f.dataType)
        for f in schemas.POST.fields if f.name in PARTITIONS and f.name in posts.columns
    }
    return posts.withColumns(casts)


def scan_days(
    spark: SparkSession, root: str, forums: list[str], days: list[Column] | Column, schema: T.StructType = schemas.POST
) -> DataFrame:
    """Raw posts of some forums on some days. One read of the root with partition filters;
    folders that are not there are simply not listed."""
    wanted = days if isinstance(days, list) else [days]
    posts = read_posts_json(spark, root, schema)
    day = F.make_date("created_at_year", "created_at_month", "created_at_day")
    names = sorted({f.lower() for f in forums})
    return posts.where(F.lower("subreddit_name").isin(*names) & day.isin(*wanted))


def read_forum_files(spark: SparkSession, path: str) -> DataFrame:
    """Wrapper files ``{subreddit, post_count, posts}`` as one row per post of that forum."""
    files = spark.read.schema(schemas.FORUM_FILE).option("multiLine", True).json(path)
    rows = files.select("subreddit", F.inline("posts"))
    return normalise_posts(rows.withColumn("subreddit_name", F.col("subreddit")).drop("subreddit"))


def _by_folder(rows: DataFrame, *columns: str) -> DataFrame:
    """Bring the rows of a folder together before a partitioned write. Spark splits a folder that
    is too large for one task and lets small ones share a task."""
    return rows.hint("rebalance", *[F.col(c) for c in columns])


def write_raw_json(posts: DataFrame, root: str, mode: str = "append") -> None:
    """Raw posts as JSON below ``year/month/day/forum`` folders."""
    _by_folder(posts, *PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS).json(root)


def _folders(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Partition values of the files below ``path``; no rows if there is no such folder. File contents are not read."""
    schema = T.StructType([f for f in schemas.POST.fields if f.name in columns])
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema)
    listed = spark.read.schema(schema).option("basePath", path).format("text").load(path)
    return listed.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).distinct()


def landed_partitions(spark: SparkSession, root: str) -> DataFrame:
    """(day, forum) of the raw posts below ``root``."""
    return _folders(spark, root, PARTITIONS)


def landed_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Forums that have a snapshot below ``root``."""
    return _folders(spark, f"{root.rstrip('/')}/top_posts", ["subreddit_name"])


def write_snapshot_json(posts: DataFrame, root: str, mode: str = "overwrite") -> None:
    """All-time snapshot as JSON below ``top_posts/subreddit_name=…``."""
    _by_folder(posts, "subreddit_name").write.mode(mode).partitionBy("subreddit_name").json(f"{root.rstrip('/')}/top_posts")


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    base = f"{root.rstrip('/')}/top_posts"
    reader = spark.read.schema(schemas.POST).option("basePath", base)
    return _typed(reader.json(f"{base}/subreddit_name=*/*"))


def read_curated(spark: SparkSession, path: str) -> DataFrame | None:
    """The curated table, or None if there is none yet. Any other failure is raised."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # Spark would infer a number from a forum named 007; partition columns have the types of the schema.
    kinds = {f.name: f.dataType for f in schemas.POST.fields if f.name in PARTITIONS}
    return spark.read.schema(
        T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])
    ).parquet(path)


def remove_partitions(spark: SparkSession, path: str, partitions: DataFrame) -> None:
    """Delete the folders of some partitions (one row each: those that a merge has emptied)."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in partitions.select(*PARTITIONS).distinct().toLocalIterator():
        folder = "/".join(f"{c}={escaped.escapePathName(str(row[c]))}" for c in PARTITIONS)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"), True)


def write_curated(posts: DataFrame, path: str, replace_all: bool = False) -> None:
    """Write partitions of the curated table.

    By default only the partitions present in ``posts`` are replaced. A row that has
    moved to another partition leaves its old one behind if that is not rewritten;
    write a complete merge with ``replace_all`` to a fresh folder for that reason.
    """
    _by_folder(posts, *PARTITIONS).write.mode("overwrite").option(
        "partitionOverwriteMode", "static" if replace_all else "dynamic"
    ).partitionBy(*PARTITIONS).parquet(path)


def write_by_month(posts: DataFrame, path: str) -> None:
    """The layout by post month. The post id is a column, not a folder."""
    _by_folder(posts, "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def refresh_partitions(spark: SparkSession, table: str) -> None:
    """Make partitions that were written to storage known to the catalog."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def fetch(posts: DataFrame, where: Column | None = None, total_size: int | None = None) -> DataFrame:
    """Posts in order of their ingest date, exactly ``total_size`` of them if it is given."""
    rows = posts if where is None else posts.where(where)
    rows = rows.orderBy("created_at_year", "created_at_month", "created_at_day", "id")
    return rows if total_size is None else rows.limit(total_size)


def with_pages(posts: DataFrame, page_size: int = 100) -> DataFrame:
    """Number the rows in date order and put ``page_size`` of them on a page (both from 0)."""
    order = ["created_at_year", "created_at_month", "created_at_day", "id"]
    numbered = with_row_index(posts, *order)
    return numbered.withColumn("page", F.floor(F.col("row_index") / F.lit(page_size)))
