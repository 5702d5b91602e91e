"""Curation, chunking, index tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from threadmine.catalog import sqlparts as S
from threadmine.catalog import tables as T
from threadmine.catalog.registry import query
from threadmine.operators import chunk as K
from threadmine.operators import curate as C
from threadmine.operators import search as Q
from threadmine.operators import tables as B
from threadmine.operators.ranking import with_row_index
from threadmine.operators.weights import with_idf
from threadmine.plans import index as I
from threadmine.plans import landing, merge
from threadmine.schemas import PARTITIONS
from threadmine.session import new_path, shuffles_removed, stage
from threadmine.sources import posts as P
from threadmine.sources.store import drop_index, drop_sorted, scroll_sorted, write_sorted

DAY_DATE = dt.date(2025, 10, 1)
NOW_SECONDS = 1_750_000_000
_OUT = ["id", "subreddit_name", "score", "created_at_year", "created_at_month", "created_at_day"]
_SQL_OUT = ", ".join(_OUT)
_DAY_SQL = "make_date(created_at_year, created_at_month, created_at_day)"


@query(S.clauses(S.POSTS, S.NEW_POSTS) + f"""SELECT {_SQL_OUT} FROM posts WHERE id NOT IN (SELECT id FROM new_posts)
  UNION ALL SELECT {_SQL_OUT} FROM new_posts""")
def merge_top(spark, sf_dir):
    return merge.merge_top(T.posts(spark, sf_dir), T.new_posts(spark, sf_dir)).select(*_OUT)


@query(S.clauses(S.POSTS, S.NEW_POSTS) + f"""SELECT {_SQL_OUT} FROM posts WHERE id NOT IN (SELECT id FROM new_posts)
  UNION ALL SELECT {_SQL_OUT} FROM new_posts""")
def merge_top_written(spark, sf_dir):
    """The same merge through partitioned storage: write, merge to a fresh folder, read back."""
    first, second = new_path(spark, "curated"), new_path(spark, "curated")
    P.write_curated(T.posts(spark, sf_dir), first)
    merge.run_merge_top(spark, T.new_posts(spark, sf_dir), first, second)
    return P.read_curated(spark, second).select(*_OUT)


@query(S.clauses(S.POSTS, S.NEW_POSTS) + """SELECT 'new' AS stage, count(*) AS n FROM new_posts
  UNION ALL SELECT 'kept', count(*) FROM posts WHERE id NOT IN (SELECT id FROM new_posts)
  UNION ALL SELECT 'merged', count(*) + (SELECT count(*) FROM new_posts) FROM posts WHERE id NOT IN (SELECT id FROM new_posts)""")
def merge_top_counts(spark, sf_dir):
    """What that job counts while it writes."""
    first, second, counts = new_path(spark, "curated"), new_path(spark, "curated"), C.WrittenCounts()
    P.write_curated(T.posts(spark, sf_dir), first)
    merge.run_merge_top(spark, T.new_posts(spark, sf_dir), first, second, counts)
    return spark.createDataFrame(list(counts.counts().items()), "stage string, n bigint")


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT}, false AS written FROM posts")
def merge_empty_written(spark, sf_dir):
    """A day without new posts changes nothing in the table, and the job says so."""
    path = new_path(spark, "curated")
    P.write_curated(T.posts(spark, sf_dir), path)
    done = merge.run_merge_daily(spark, T.new_posts(spark, sf_dir).limit(0), path)
    return P.read_curated(spark, path).select(*_OUT, F.lit(done).alias("written"))


_DAILY = (S.POSTS, S.NEW_POSTS,
          "both_sides AS (SELECT *, 0 AS age FROM new_posts UNION ALL SELECT p.*, 1 FROM posts p WHERE EXISTS ("
          "SELECT 1 FROM new_posts n WHERE n.subreddit_name = p.subreddit_name AND make_date(n.year, n.month, 1) = make_date(p.year, p.month, 1)))",
          "daily AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit_name, id ORDER BY age, score DESC) AS n FROM both_sides) WHERE n = 1)")


@query(S.clauses(*_DAILY) + f"SELECT {_SQL_OUT} FROM daily")
def merge_daily(spark, sf_dir):
    return merge.merge_daily(T.posts(spark, sf_dir), T.new_posts(spark, sf_dir)).select(*_OUT)


# A second version of some stored posts, ingested ten days later in the year's last days, so that they move to another day's folder.
_MOVED = "moved AS (SELECT * REPLACE (score + 1 AS score, 28 AS created_at_day, 12 AS created_at_month) FROM posts WHERE id LIKE '%3')"


@query(S.clauses(S.POSTS, _MOVED) + f"""SELECT {_SQL_OUT} FROM posts WHERE (subreddit_name, id) NOT IN (SELECT (subreddit_name, id) FROM moved)
  UNION ALL SELECT {_SQL_OUT} FROM moved""")
def merge_daily_written(spark, sf_dir):
    """The daily merge through partitioned storage: posts that come again on another day are stored once, all others stay."""
    path, posts = new_path(spark, "curated"), T.posts(spark, sf_dir)
    P.write_curated(posts, path)
    moved = posts.where("id LIKE '%3'").withColumns({
        "score": F.col("score") + 1, "created_at_day": F.lit(28), "created_at_month": F.lit(12)})
    merge.run_merge_daily(spark, moved, path)
    return P.read_curated(spark, path).select(*_OUT)


@query(S.clauses(S.POSTS, S.NEW_POSTS) + f"""SELECT {_SQL_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY subreddit_name, id ORDER BY score DESC) AS n
  FROM (SELECT * FROM posts UNION ALL SELECT * FROM new_posts)) WHERE n = 1""")
def dedupe_latest(spark, sf_dir):
    both = T.posts(spark, sf_dir).unionByName(T.new_posts(spark, sf_dir))
    return C.dedupe_latest(both, ["subreddit_name", "id"], [F.col("score").desc()]).select(*_OUT)


@query(S.clauses(S.POSTS, S.NEW_POSTS) + """SELECT count(*) AS combined, count(DISTINCT subreddit_name || '/' || id) AS distinct_rows,
  count(*) - count(DISTINCT subreddit_name || '/' || id) AS removed FROM (SELECT * FROM posts UNION ALL SELECT * FROM new_posts)""")
def duplicates_removed(spark, sf_dir):
    both = T.posts(spark, sf_dir).unionByName(T.new_posts(spark, sf_dir))
    return C.duplicates_removed(both, ["subreddit_name", "id"])


@query(S.clauses(*_DAILY) + """SELECT 'existing' AS stage, count(*) AS n FROM posts UNION ALL SELECT 'new', count(*) FROM new_posts
  UNION ALL SELECT 'new_ids', count(DISTINCT id) FROM new_posts UNION ALL SELECT 'kept', count(*) FROM posts WHERE id NOT IN (SELECT id FROM new_posts)
  UNION ALL SELECT 'merged', count(*) FROM daily""")
def stage_counts(spark, sf_dir):
    old, new = T.posts(spark, sf_dir), T.new_posts(spark, sf_dir)
    return C.stage_counts(
        existing=old, new=new, new_ids=new.select("id").distinct(), kept=C.without_ids(old, new),
        merged=merge.merge_daily(old, new),
    )


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT} FROM posts WHERE {_DAY_SQL} >= date '2025-10-01'")
def since_predicate(spark, sf_dir):
    return C.since(T.posts(spark, sf_dir), F.lit(DAY_DATE)).select(*_OUT)


@query(S.clauses(S.POSTS) + f"""SELECT {_SQL_OUT} FROM posts WHERE CAST(created_at_year AS VARCHAR) >= '2025'
  AND CAST(created_at_month AS VARCHAR) >= '9' AND CAST(created_at_day AS VARCHAR) >= '28'""")
def since_predicate_compat(spark, sf_dir):
    return C.since_by_component(T.posts(spark, sf_dir), 2025, 9, 28).select(*_OUT)


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT} FROM posts WHERE {_DAY_SQL} IN (date '2025-10-01', date '2025-09-30')")
def last_n_days(spark, sf_dir):
    return C.last_days(T.posts(spark, sf_dir), F.lit(DAY_DATE), 2).select(*_OUT)


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT} FROM posts WHERE {_DAY_SQL} IN (date '2025-10-01', date '2025-09-30') AND subreddit_name IN ('src9', 'src10', 'src11')")
def scan_days(spark, sf_dir):
    """Raw JSON written by day and forum, then read for three forums and two days; one name is given twice."""
    root = new_path(spark, "raw")
    P.write_raw_json(T.posts(spark, sf_dir), root)
    return P.scan_days(spark, root, ["SRC9", "src10", "Src11", "src9"], [F.lit(DAY_DATE), F.date_sub(F.lit(DAY_DATE), 1)]).select(*_OUT)


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT}, md5(content) AS content_id FROM posts")
def scan_snapshots(spark, sf_dir):
    root = new_path(spark, "raw")
    P.write_snapshot_json(T.posts(spark, sf_dir), root)
    return P.read_snapshots(spark, root).select(*_OUT, F.md5("content").alias("content_id"))


@query(S.clauses(S.NEW_POSTS) + f"SELECT DISTINCT {', '.join(PARTITIONS)} FROM new_posts")
def touched_partitions(spark, sf_dir):
    return C.touched_partitions(T.new_posts(spark, sf_dir))


@query(S.clauses(*_DAILY) + f"SELECT {_SQL_OUT} FROM posts p WHERE EXISTS (SELECT 1 FROM new_posts n WHERE n.subreddit_name = p.subreddit_name AND n.year = p.year AND n.month = p.month)")
def read_touched(spark, sf_dir):
    return C.in_touched_partitions(T.posts(spark, sf_dir), T.new_posts(spark, sf_dir), merge.TOUCH).select(*_OUT)


@query(S.clauses(S.POSTS, S.SEEN) + f"SELECT {_SQL_OUT} FROM posts p WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.post_id = p.id AND s.subreddit = p.subreddit_name AND ttl > 1750000000)")
def seen_anti_join(spark, sf_dir):
    return C.unseen(T.posts(spark, sf_dir), T.seen(spark, sf_dir), F.lit(NOW_SECONDS)).select(*_OUT)


@query(S.clauses(S.POSTS, S.SEEN) + """SELECT post_id, subreddit, max(pulled_at) AS pulled_at, max(ttl) AS ttl FROM (
  SELECT * FROM seen WHERE ttl > 1750000000
  UNION ALL SELECT id, subreddit_name, 1750000000, 1750000000 + 360 * 86400 FROM posts p
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.post_id = p.id AND s.subreddit = p.subreddit_name AND ttl > 1750000000)) GROUP BY ALL""")
def mark_seen(spark, sf_dir):
    return C.mark_seen(T.seen(spark, sf_dir), T.posts(spark, sf_dir), F.lit(NOW_SECONDS))


@query(S.clauses(S.SEEN) + "SELECT post_id, ttl FROM seen WHERE subreddit = 'src1'")
def seen_of_forum(spark, sf_dir):
    return C.seen_of_forum(T.seen(spark, sf_dir), "SRC1").select("post_id", "ttl")


@query(S.clauses(S.POSTS, S.NEW_POSTS) + f"SELECT {_SQL_OUT} FROM new_posts ANTI JOIN (SELECT DISTINCT {', '.join(PARTITIONS)} FROM posts) USING ({', '.join(PARTITIONS)})")
def skip_landed(spark, sf_dir):
    return C.not_landed(T.new_posts(spark, sf_dir), T.posts(spark, sf_dir), PARTITIONS).select(*_OUT)


@query(S.clauses(S.POSTS, S.NEW_POSTS) + f"""SELECT {_SQL_OUT} FROM posts UNION ALL
  SELECT {_SQL_OUT} FROM new_posts n WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.id = n.id)""")
def union_distinct(spark, sf_dir):
    return C.union_distinct(T.posts(spark, sf_dir), T.new_posts(spark, sf_dir), ["id"]).select(*_OUT)


@query("SELECT doc_id, lower(upper(source)) AS subreddit_name, CAST(n_chars AS INTEGER) AS score, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(2025 AS INTEGER) END AS year, 0 AS n_comments FROM documents")
def normalise_posts(spark, sf_dir):
    raw = T.table(spark, sf_dir, "documents").select(
        "doc_id", F.upper("source").alias("subreddit_name"), F.col("n_chars").cast("string").alias("score"),
        F.when(F.pmod("doc_id", F.lit(7)) == 0, "unknown").otherwise("2025").alias("year"),
        F.lit(None).cast("array<struct<id:string,body:string>>").alias("comments"),
    )
    n = C.normalise_posts(raw)
    return n.select("doc_id", "subreddit_name", "score", "year", F.size("comments").alias("n_comments"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 2025 ELSE 2024 END AS INTEGER) AS created_at_year, CAST(CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 2 END AS INTEGER) AS created_at_month,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 29 END AS INTEGER) AS created_at_day FROM documents""")
def stamp_ingest_date(spark, sf_dir):
    odd = F.pmod("doc_id", F.lit(2)) == 1
    rows = T.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(odd, "2024").alias("created_at_year"), F.when(odd, "2").alias("created_at_month"),
        F.when(odd, "29").alias("created_at_day"))
    return C.stamp_ingest_date(rows, F.lit(DAY_DATE))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 't' AS original_title, lower(source) AS subreddit_name,
  CAST(year(date '1970-01-01' + CAST(floor(doc_id * 86399.0 * 7 / 86400) AS INTEGER)) AS INTEGER) AS year,
  CAST(month(date '1970-01-01' + CAST(floor(doc_id * 86399.0 * 7 / 86400) AS INTEGER)) AS INTEGER) AS month FROM documents""")
def post_rows(spark, sf_dir):
    raw = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("n_chars").cast("int").alias("score"),
        F.lit("u").alias("url"), F.col("text").alias("selftext"), (F.col("doc_id") * 86_399 * 7).alias("created_utc"),
        F.upper("source").alias("display_name"))
    return C.post_rows(raw).select("id", "original_title", "subreddit_name", "year", "month")


@query(S.clauses(S.COMMENTS) + "SELECT id, post_id FROM comments WHERE lower(body) NOT IN ('[removed]', '[deleted]')")
def drop_removed_comments(spark, sf_dir):
    return C.drop_removed(T.comments(spark, sf_dir)).select("id", "post_id")


@query(S.clauses(S.COMMENTS) + f"SELECT id, post_id FROM comments WHERE length({S.strip('body')}) >= 10")
def drop_short_comments(spark, sf_dir):
    return C.drop_short(T.comments(spark, sf_dir)).select("id", "post_id")


_FIRST = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY seq) AS place FROM comments)
  WHERE place <= 5 AND lower(body) NOT IN ('[removed]', '[deleted]'))"""


@query(S.clauses(S.COMMENTS, _FIRST) + "SELECT post_id, id, place FROM kept")
def first_comments(spark, sf_dir):
    return C.first_comments(T.comments(spark, sf_dir)).select("post_id", "id", "place")


@query(S.clauses(S.POSTS, S.COMMENTS, _FIRST) + """SELECT id, coalesce(ids, '') AS comment_ids, coalesce(n, 0) AS n_comments FROM posts
  LEFT JOIN (SELECT post_id, string_agg(id, ',' ORDER BY place) AS ids, count(*) AS n FROM kept GROUP BY post_id) ON post_id = posts.id""")
def attach_comments(spark, sf_dir):
    p = C.attach_comments(T.posts(spark, sf_dir), C.first_comments(T.comments(spark, sf_dir)))
    return p.select("id", F.array_join(F.transform("comments", lambda c: c["id"]), ",").alias("comment_ids"),
                    F.size("comments").cast("bigint").alias("n_comments"))


@query(S.clauses(S.POSTS) + "SELECT id, subreddit_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY subreddit_name ORDER BY score DESC, id) AS rank FROM posts) WHERE rank <= 50")
def top_posts_per_forum(spark, sf_dir):
    return C.top_posts(T.posts(spark, sf_dir), C.DAILY_LIMIT).select("id", "subreddit_name", "rank")


# Landed before: every partition of the pages. Hot list: the posts of labelled documents.
_LAND = (S.POSTS, S.NEW_POSTS, S.COMMENTS, S.SEEN, _FIRST,
         "landed AS (SELECT * FROM new_posts WHERE subreddit_name = 'src1')",
         """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit_name ORDER BY score DESC, id) AS rank FROM posts
  ANTI JOIN landed USING (created_at_year, created_at_month, created_at_day, subreddit_name)) WHERE rank <= 50)""",
         """hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit_name ORDER BY score DESC, id) AS rank
  FROM (SELECT * FROM new_posts WHERE subreddit_name <> 'src1')
  ANTI JOIN landed USING (created_at_year, created_at_month, created_at_day, subreddit_name)) WHERE rank <= 50)""",
         "chosen AS (SELECT * FROM top UNION ALL SELECT * FROM hot WHERE (subreddit_name, id) NOT IN (SELECT (subreddit_name, id) FROM top))",
         "lists AS (SELECT post_id, string_agg(id, ',' ORDER BY place) AS ids FROM kept GROUP BY post_id)")


def _land_out(df):
    return df.select("id", "subreddit_name", "score", F.array_join(F.transform("comments", lambda c: c["id"]), ",").alias("comment_ids"))


@query(S.clauses(*_LAND) + """SELECT id, subreddit_name, score, coalesce(ids, '') AS comment_ids FROM chosen c LEFT JOIN lists ON post_id = c.id
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.post_id = c.id AND s.subreddit = c.subreddit_name AND ttl > 1750000000)""")
def land_daily(spark, sf_dir):
    new = T.new_posts(spark, sf_dir)
    out = landing.land_daily(
        T.posts(spark, sf_dir), T.comments(spark, sf_dir), T.seen(spark, sf_dir), new.where("subreddit_name = 'src1'"),
        F.lit(DAY_DATE), F.lit(NOW_SECONDS), hot=new.where("subreddit_name <> 'src1'"),
    )
    return _land_out(out)


@query(S.clauses(*_LAND).replace("rank <= 50", "rank <= 5") + """SELECT id, subreddit_name, score, coalesce(ids, '') AS comment_ids FROM chosen c LEFT JOIN lists ON post_id = c.id
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.post_id = c.id AND s.subreddit = c.subreddit_name AND ttl > 1750000000)
  UNION ALL SELECT id, subreddit_name, score, '' FROM landed""")
def land_daily_written(spark, sf_dir):
    """Five posts a forum landed as raw JSON behind what landed before, all read back."""
    root, new = new_path(spark, "raw"), T.new_posts(spark, sf_dir)
    P.write_raw_json(new.where("subreddit_name = 'src1'").drop("comments"), root)
    landing.run_land_daily(
        T.posts(spark, sf_dir), T.comments(spark, sf_dir), T.seen(spark, sf_dir), root, F.lit(DAY_DATE), F.lit(NOW_SECONDS),
        hot=new.where("subreddit_name <> 'src1'"), limit=5)
    back = P.read_posts_json(spark, root)
    return back.select("id", "subreddit_name", "score", F.coalesce(F.array_join(F.transform("comments", lambda c: c["id"]), ","), F.lit("")).alias("comment_ids"))


_TWO = "ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit_name ORDER BY score DESC, id) AS rank FROM posts)"


@query(S.clauses(S.POSTS, _TWO) + "SELECT id, subreddit_name, score FROM ranked WHERE rank <= 7")
def land_top_written(spark, sf_dir):
    """Snapshots of two calls: the second leaves the forums alone that the first has landed."""
    root, posts = new_path(spark, "raw"), T.posts(spark, sf_dir)
    few = posts.where(F.col("subreddit_name").isin("src1", "src2", "src3"))
    landing.run_land_top(few, T.comments(spark, sf_dir), root, F.lit(DAY_DATE), 7)
    landing.run_land_top(posts, T.comments(spark, sf_dir), root, F.lit(DAY_DATE), 7)
    return P.read_snapshots(spark, root).select("id", "subreddit_name", "score")


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT}, md5(content) AS content_id FROM posts")
def forum_files(spark, sf_dir):
    """Posts wrapped into documents of some 200 of a forum, a file each, read back as rows."""
    root = new_path(spark, "forums")
    posts = T.posts(spark, sf_dir)
    shape = P.schemas.FORUM_FILE["posts"].dataType.elementType
    row = F.struct(*[(F.col(f.name) if f.name in posts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
    part = F.pmod(F.xxhash64("id"), F.ceil(posts.select(F.count(F.lit(1))).scalar() / 200))
    posts.groupBy(F.upper("subreddit_name").alias("subreddit"), part.alias("part")).agg(
        F.count(F.lit(1)).cast("int").alias("post_count"), F.collect_list(row).alias("posts")).drop("part").write.option("maxRecordsPerFile", 1).json(root)
    return P.read_forum_files(spark, root).select(*_OUT, F.md5("content").alias("content_id"))


@query(S.clauses(S.POSTS) + "SELECT id, year, month, md5(content) AS content_id FROM posts")
def layout_by_month(spark, sf_dir):
    path = new_path(spark, "months")
    P.write_by_month(T.posts(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "year", "month", F.md5("content").alias("content_id"))


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT} FROM posts")
def refresh_partitions(spark, sf_dir):
    """Partitions written to the folder of a catalog table, made known to it."""
    path, name = new_path(spark, "table"), f"posts_{uuid.uuid4().hex}"
    P.write_curated(T.posts(spark, sf_dir).select(*_OUT), path, replace_all=True)
    spark.sql(f"CREATE TABLE {name} (id string, score int, created_at_year int, created_at_month int, created_at_day int, subreddit_name string) "
              f"USING parquet PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION '{path}'")
    P.refresh_partitions(spark, name)
    found = stage(spark.table(name).select(*_OUT), "table")
    spark.sql(f"DROP TABLE {name}")
    return found


_LAND_TOP = (S.POSTS, S.COMMENTS, _FIRST,
             "chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit_name ORDER BY score DESC, id) AS rank FROM posts WHERE subreddit_name NOT IN ('src1')) WHERE rank <= 200)",
             "lists AS (SELECT post_id, string_agg(id, ',' ORDER BY place) AS ids FROM kept GROUP BY post_id)")


def _land_top(spark, sf_dir):
    landed = T.new_posts(spark, sf_dir).where("id LIKE 'p%'")
    return landing.land_top(T.posts(spark, sf_dir), T.comments(spark, sf_dir), landed, F.lit(DAY_DATE))


@query(S.clauses(*_LAND_TOP) + "SELECT id, subreddit_name, score, coalesce(ids, '') AS comment_ids FROM chosen c LEFT JOIN lists ON post_id = c.id")
def land_top(spark, sf_dir):
    return _land_out(_land_top(spark, sf_dir))


@query(S.clauses(*_LAND_TOP) + """SELECT subreddit_name, count(c.id) AS n_posts, count(c.id) > 0 AS success FROM (SELECT DISTINCT subreddit_name FROM posts) LEFT JOIN chosen c USING (subreddit_name) GROUP BY subreddit_name""")
def landing_totals(spark, sf_dir):
    return landing.landing_totals(_land_top(spark, sf_dir), T.posts(spark, sf_dir))


@query(S.clauses(S.POSTS) + """SELECT id, row_index, CAST(floor(row_index / 100) AS BIGINT) AS page FROM (SELECT id,
  row_number() OVER (ORDER BY created_at_year, created_at_month, created_at_day, id) - 1 AS row_index FROM posts)""")
def page_numbers(spark, sf_dir):
    return P.with_pages(T.posts(spark, sf_dir)).select("id", "row_index", "page")


@query(S.clauses(S.POSTS) + f"SELECT {_SQL_OUT} FROM posts WHERE score > 500 ORDER BY {_DAY_SQL}, id LIMIT 150")
def fetch_limited(spark, sf_dir):
    """Exactly the asked-for number of rows, not rounded up to whole pages."""
    return P.fetch(T.posts(spark, sf_dir), F.col("score") > 500, 150).select(*_OUT)


@query(S.clauses(S.POSTS) + """SELECT id, row_number() OVER (ORDER BY CAST(created_at_year AS VARCHAR), CAST(created_at_month AS VARCHAR), CAST(created_at_day AS VARCHAR), id) - 1 AS text_place,
  row_number() OVER (ORDER BY created_at_year, created_at_month, created_at_day, id) - 1 AS date_place FROM posts""")
def order_by_day(spark, sf_dir):
    """Places in date order, and in the order of stores that hold the parts as text."""
    text = [F.col(c).cast("string") for c in PARTITIONS[:3]]
    p = with_row_index(T.posts(spark, sf_dir), *text, "id", name="text_place")
    return with_row_index(p, *PARTITIONS[:3], "id", name="date_place").select("id", "text_place", "date_place")


# -- keyed tables ------------------------------------------------------------

@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def newest_per_key(spark, sf_dir):
    e = T.events(spark, sf_dir).select("user_id", "event_id", "ts")
    return B.newest_per_key(e, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def get_keys(spark, sf_dir):
    return B.get_keys(T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_keys(spark, sf_dir):
    return B.delete_keys(T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN n_chars ELSE -quality END AS n_chars FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT page_id + 1000000000, page_id FROM pages")
def put_keys(spark, sf_dir):
    """Labels replace, pages insert; each change comes twice and the later one counts."""
    table = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    changes = T.table(spark, sf_dir, "labels").select("doc_id", (-F.col("quality")).cast("bigint").alias("n_chars")).unionByName(
        T.table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("doc_id"), F.col("page_id").alias("n_chars")))
    twice = changes.withColumn("batch", F.lit(2)).unionByName(changes.select("doc_id", F.lit(-99).cast("bigint").alias("n_chars"), F.lit(1).alias("batch")))
    return B.upsert(table, twice, ["doc_id"], ["batch"])


@query(S.clauses(S.LISTING) + """SELECT prefix, key FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY modified DESC, key) AS n FROM listing)
  WHERE n > 2 AND modified < date '2025-11-01' - 30""")
def retention_selection(spark, sf_dir):
    return B.expired_objects(T.listing(spark, sf_dir), F.lit("2025-11-01").cast("date"), ["prefix"], 30, 2).select("prefix", "key")


@query(S.clauses(S.LISTING) + """SELECT prefix, count(*) FILTER (n > 2 AND modified < date '2025-11-01' - 30) AS deleted, count(*) FILTER (n <= 2) AS protected, count(*) AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY modified DESC, key) AS n FROM listing) GROUP BY prefix""")
def retention_report(spark, sf_dir):
    return B.retention_report(T.listing(spark, sf_dir), F.lit("2025-11-01").cast("date"), ["prefix"], 30, 2)


# -- chunks and index --------------------------------------------------------

def _chunks(body: str, marker: str, kind: str, comment: str, source: str, id_: str) -> str:
    return f"""SELECT {marker} || substr({body}, i * 800 + 1, 1000) AS page_content, {id_} AS post_id, {comment} AS comment_id, year, month, '{kind}' AS type,
  subreddit_name, CAST(i AS INTEGER) AS chunk_id, year * 100 + month AS timestamp, printf('%d-%02d', year, month) AS date
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length({body}) - 200) / 800.0) AS BIGINT)))) AS i FROM {source} WHERE length({body}) > 0)"""


_REPLIES = "replies AS (SELECT c.*, p.subreddit_name FROM comments c JOIN posts p ON p.id = c.post_id)"
_TEXTS = "texts AS (SELECT *, 'Title: ' || title || chr(10) || chr(10) || content AS body FROM posts)"
_MARK = "printf('[From %d-%02d] ', year, month)"
_POST_CHUNKS = _chunks("body", _MARK, "post", "NULL", "texts", "id")
_REPLY_CHUNKS = _chunks("body", "''", "comment", "id", "replies", "post_id")
_ALL_CHUNKS = f"chunks AS ({_POST_CHUNKS} UNION ALL {_REPLY_CHUNKS})"
_CHUNKED = (S.POSTS, S.COMMENTS, _REPLIES, _TEXTS, _ALL_CHUNKS)


def _reply_rows(spark, sf_dir):
    p = T.posts(spark, sf_dir).select(F.col("id").alias("post_id"), "subreddit_name")
    return T.comments(spark, sf_dir).withColumnRenamed("id", "comment_id").join(p, "post_id")


_CHUNK_OUT = "post_id, comment_id, type, subreddit_name, chunk_id, timestamp, date, year, month, md5(page_content) AS content_id"


def _chunk_out(df):
    return df.select("post_id", "comment_id", "type", "subreddit_name", "chunk_id", "timestamp", "date", "year", "month",
                     F.md5("page_content").alias("content_id"))


@query(S.clauses(*_CHUNKED) + f"SELECT {_CHUNK_OUT} FROM chunks")
def chunk_posts(spark, sf_dir):
    return _chunk_out(K.chunk_posts(T.posts(spark, sf_dir), _reply_rows(spark, sf_dir)))


@query(S.clauses(S.POSTS, S.COMMENTS, _REPLIES, f"long_replies AS (SELECT * FROM replies WHERE length({S.strip('body')}) >= 10)",
                 "chunks AS (" + _chunks("body", "printf('[Comment from %d-%02d] ', year, month)", "comment", "id", "long_replies", "post_id") + ")")
       + f"SELECT {_CHUNK_OUT} FROM chunks")
def chunk_comments(spark, sf_dir):
    return _chunk_out(K.chunk_comments(_reply_rows(spark, sf_dir)))


def split_paragraphs(text: str) -> list[str]:
    """Example of a splitter a user brings along."""
    return [p for p in text.split("\n") if p.strip()]


_LINE_WITH_TEXT = r"lambda x: regexp_matches(x, '[^\s\x0b\x{85}\p{Z}]')"


def _split(body: str, marker: str, comment: str, source: str, id_: str, kind: str) -> str:
    """Non-blank lines of a text, or the text itself if there is none, numbered from 0."""
    return f"""SELECT post_id, comment_id, type, CAST(i - 1 AS INTEGER) AS chunk_id, marker || list_extract(parts, i) AS page_content FROM (
  SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT {id_} AS post_id, {comment} AS comment_id, '{kind}' AS type, {marker} AS marker,
      CASE WHEN len(list_filter(string_split({body}, chr(10)), {_LINE_WITH_TEXT})) = 0 THEN [{body}]
           ELSE list_filter(string_split({body}, chr(10)), {_LINE_WITH_TEXT}) END AS parts
    FROM {source} WHERE length({body}) > 0))"""


@query(S.clauses(S.POSTS, S.COMMENTS, _REPLIES, _TEXTS,
                 f"chunks AS ({_split('body', _MARK, 'NULL', 'texts', 'id', 'post')} UNION ALL {_split('body', chr(39) * 2, 'id', 'replies', 'post_id', 'comment')})")
       + "SELECT post_id, comment_id, type, chunk_id, md5(page_content) AS content_id FROM chunks")
def chunk_with_splitter(spark, sf_dir):
    c = K.chunk_posts(T.posts(spark, sf_dir), _reply_rows(spark, sf_dir), splitter=split_paragraphs)
    return c.select("post_id", "comment_id", "type", "chunk_id", F.md5("page_content").alias("content_id"))


def text_sizes(texts: list[str]) -> list[list[float]]:
    """Example of an embedder a user brings along: characters and spaces of each text."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query(S.clauses(*_CHUNKED) + """SELECT post_id, comment_id, chunk_id, type, CAST(length(page_content) AS DOUBLE) AS size,
  CAST(length(page_content) - length(replace(page_content, ' ', '')) AS DOUBLE) AS spaces FROM chunks""")
def embed_chunks(spark, sf_dir):
    c = I.embed(K.chunk_posts(T.posts(spark, sf_dir), _reply_rows(spark, sf_dir)), text_sizes)
    return c.select("post_id", "comment_id", "chunk_id", "type", *[
        F.col("vector")[i].cast("double").alias(n) for i, n in enumerate(("size", "spaces"))])


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return (f"left({h}, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
            f"substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)")


_NAME = "concat_ws('_', post_id, subreddit_name, CAST(chunk_id AS VARCHAR), type, comment_id)"


@query(S.clauses(*_CHUNKED) + f"SELECT {_uuid(_NAME)} AS id, {_uuid(_NAME.replace(', comment_id', ''))} AS compat_id, post_id, comment_id, chunk_id, type FROM chunks")
def chunk_ids(spark, sf_dir):
    c = K.chunk_posts(T.posts(spark, sf_dir), _reply_rows(spark, sf_dir))
    both = I.with_ids(I.with_ids(c, compat_ids=True).withColumnRenamed("id", "compat_id"))
    return both.select("id", "compat_id", "post_id", "comment_id", "chunk_id", "type")


@query(S.clauses(*_CHUNKED) + """SELECT 'total_posts' AS name, count(*) AS n FROM posts WHERE make_date(created_at_year, created_at_month, created_at_day) >= date '2025-10-15'
  UNION ALL SELECT 'total_documents', count(*) FROM chunks WHERE post_id IN (SELECT id FROM posts WHERE make_date(created_at_year, created_at_month, created_at_day) >= date '2025-10-15')""")
def build_index_incremental(spark, sf_dir):
    since = F.lit("2025-10-15").cast("date")
    p = T.posts(spark, sf_dir)
    points = I.index_rows(p, _reply_rows(spark, sf_dir), since)
    return I.index_totals(C.since(p, since), points)


@query(S.clauses(*_CHUNKED, f"points AS (SELECT {_uuid(_NAME)} AS doc_id, page_content AS text FROM chunks)",
                 S.POSTINGS.replace("FROM documents", "FROM points"))
       + "SELECT doc_id, count(*) AS n_terms, round(sum(tf * 1.0 / doc_len * idf), 6) AS total_weight FROM post JOIN idfs USING (term) GROUP BY doc_id")
def build_index(spark, sf_dir):
    """Full index of posts and comments: chunks, ids, corpus-wide weights; summed per point."""
    points = I.index_rows(T.posts(spark, sf_dir), _reply_rows(spark, sf_dir))
    weights = I.SparseIndex.of(points, "id", "page_content").weights()
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), T.r6(F.sum("weight")).alias("total_weight"))


def _index_search(points: str) -> str:
    """Best three points of each benchmark text by words and by vector, and their fusion."""
    return S.clauses(
        *_CHUNKED, points, S.POSTINGS.replace("FROM documents", "FROM points"),
        f"asked AS (SELECT item_id AS query_id, text, {S.sparse_tokens('text')} AS t FROM benchmark)",
        "aterm AS (SELECT query_id, n, term, count(*) AS qtf FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM asked) GROUP BY ALL)",
        "found AS (SELECT query_id, doc_id, sum(qtf * 1.0 / n * idf * (tf * 1.0 / doc_len) * idf) AS score FROM aterm JOIN idfs USING (term) JOIN post USING (term) GROUP BY ALL)",
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {S.key('score')} DESC, doc_id) AS rank FROM found)",
    ) + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 45"


def _search_stored(spark, sf_dir, name):
    """The keyword list of a stored index, which then goes."""
    asked = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = I.open_sparse(spark, name)
    with shuffles_removed(spark):
        found = stage(index.topk(asked, ["query_id"], 45), "found")
    drop_index(spark, name)
    return found.select("query_id", "rank", "doc_id", T.r6("score").alias("score"))


@query(_index_search(f"points AS (SELECT {_uuid(_NAME)} AS doc_id, page_content AS text FROM chunks)"))
def index_search(spark, sf_dir):
    """Index of posts and comments written to tables, opened again and searched; ids are UUID texts."""
    name = f"ix_{uuid.uuid4().hex}"
    I.write_index(spark, name, I.index_rows(T.posts(spark, sf_dir), _reply_rows(spark, sf_dir)), parts=64)
    return _search_stored(spark, sf_dir, name)


@query(_index_search(f"points AS (SELECT {_uuid(_NAME)} AS doc_id, CASE WHEN type = 'post' AND post_id LIKE '%3' THEN page_content || ' benchmark' ELSE page_content END AS text FROM chunks)"))
def index_incremental(spark, sf_dir):
    """The same in two writes: all points but some posts' comments, then those and new texts of the same posts."""
    name = f"ix_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        points = stage(I.index_rows(T.posts(spark, sf_dir), _reply_rows(spark, sf_dir)), "points", "zstd")
    again = F.col("post_id").endswith("3")
    changed = F.when(F.col("type") == "post", F.concat("page_content", F.lit(" benchmark"))).otherwise(F.col("page_content"))
    I.write_index(spark, name, points.where(~again | (F.col("type") == "post")), parts=64)
    I.write_index(spark, name, points.where(again).withColumn("page_content", changed), recreate=False)
    return _search_stored(spark, sf_dir, name)


_UPSERT = (S.POSTS, S.NEW_POSTS, f"old_points AS (SELECT id AS point_id, content AS text, score FROM posts)",
           "merged AS (SELECT * FROM old_points WHERE point_id NOT IN (SELECT id FROM new_posts) UNION ALL SELECT id, content, score FROM new_posts)")


def _merged_points(spark, sf_dir):
    old = T.posts(spark, sf_dir).select(F.col("id").alias("point_id"), F.col("content").alias("text"), "score")
    new = T.new_posts(spark, sf_dir).select(F.col("id").alias("point_id"), F.col("content").alias("text"), "score")
    return B.upsert(old, new, ["point_id"], ["score"])


@query(S.clauses(*_UPSERT) + "SELECT point_id, score, md5(text) AS content_id FROM merged")
def index_upsert(spark, sf_dir):
    return _merged_points(spark, sf_dir).select("point_id", "score", F.md5("text").alias("content_id"))


@query(S.clauses(*_UPSERT, "points AS (SELECT point_id AS doc_id, text FROM merged)", S.POSTINGS.replace("FROM documents", "FROM points"))
       + "SELECT term, df, round(idf, 6) AS idf, round(sum(tf * 1.0 / doc_len * idf), 6) AS total_weight FROM post JOIN idfs USING (term) GROUP BY term, df, idf")
def rebuild_sparse(spark, sf_dir):
    """Weights of a whole stored index, written, changed by an upsert and rebuilt, summed per term."""
    name = f"ix_{uuid.uuid4().hex}"
    old, new = (rows.select("id", F.col("id").alias("post_id"), F.col("content").alias("page_content"), "score")
                for rows in (T.posts(spark, sf_dir), T.new_posts(spark, sf_dir)))
    I.write_index(spark, name, old, parts=16)
    I.write_index(spark, name, B.newest_per_key(new, ["id"], F.struct("score")), recreate=False)
    I.rebuild_sparse(spark, name)
    index = I.open_sparse(spark, name)
    total = index.weights(named=False).groupBy("term").agg(T.r6(F.sum("weight")).alias("total_weight"))
    with shuffles_removed(spark):
        found = stage(with_idf(index.terms, index.n_docs).withColumn("idf", T.r6("idf")).join(total, "term").select(
            "term", "df", "idf", "total_weight"), "weights")
    drop_index(spark, name)
    return found


@query(S.clauses(S.POSTS) + "SELECT id FROM posts WHERE id > '5' ORDER BY id LIMIT 100")
def scroll_points(spark, sf_dir):
    """A page of a table of points that was written in the order of their ids."""
    name = f"points_{uuid.uuid4().hex}"
    write_sorted(T.posts(spark, sf_dir).select("id", "title"), name, rows_per_file=50)
    page = stage(scroll_sorted(spark, name, "5", 100).select("id"), "page")
    drop_sorted(spark, name)
    return page
