"""The given tables in the roles the operators expect (posts, comments, queries, logs, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadmine.functions import times
from threadmine.functions.text import words

VARIANTS = ("rewritten", "hyde")


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the file once; later reads need no job for it."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


# -- posts -------------------------------------------------------------------

def _post(rows: DataFrame, id_: Column, forum: Column, content: Column, score: Column, day: Column) -> DataFrame:
    return rows.select(
        id_.alias("id"), F.concat(F.lit("Post "), id_).alias("title"), content.alias("content"),
        F.concat(F.lit("https://forum.example/"), id_).alias("url"), score.cast("int").alias("score"),
        F.year(day).alias("year"), F.month(day).alias("month"), F.year(day).alias("created_at_year"),
        F.month(day).alias("created_at_month"), F.dayofmonth(day).alias("created_at_day"),
        F.lower(forum).alias("subreddit_name"),
    )


def _doc_day() -> Column:
    return F.date_add(F.lit("2025-09-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a post; the ingest days span two months' ends."""
    d = table(spark, sf_dir, "documents")
    return _post(d, F.col("doc_id").cast("string"), F.col("source"), F.col("text"), F.col("n_chars"), _doc_day())


def new_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a new score and, for those of low quality, a later day;
    and every web page as a post with an id that is not there yet."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    again = _post(
        labelled, F.col("doc_id").cast("string"), F.col("source"), F.col("text"), F.col("n_chars") + 100_000,
        F.date_add(_doc_day(), 1 - F.col("quality")),
    )
    p = table(spark, sf_dir, "pages")
    pages = _post(
        p, F.concat(F.lit("p"), F.col("page_id").cast("string")), F.lit("SRC1"), F.col("html"), F.length("html"),
        F.date_add(F.lit("2025-09-01").cast("date"), F.pmod("page_id", F.lit(90)).cast("int")),
    )
    return again.unionByName(pages)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a comment of the post of its conversation; some removed, some very short."""
    c = table(spark, sf_dir, "conversations")
    removed, short = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 0, F.pmod(
        F.col("conv_id") + F.col("turn"), F.lit(7)) == 0
    return c.select(
        F.col("conv_id").cast("string").alias("post_id"),
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"),
        F.length("text").alias("score"),
        F.when(removed, "[removed]").when(short, F.substring("text", 1, 6)).otherwise(F.col("text")).alias("body"),
        F.lit(2025).alias("year"), (F.pmod("conv_id", F.lit(12)) + 1).cast("int").alias("month"),
        F.col("turn").alias("seq"),
    )


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as seen posts; those labelled toxic have expired."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("post_id"), F.lower("source").alias("subreddit"),
        F.lit(1_700_000_000).cast("bigint").alias("pulled_at"),
        F.when(F.col("toxic") == 1, F.lit(1_700_000_001)).otherwise(F.lit(1_800_000_000)).cast("bigint").alias("ttl"),
    )


# -- search ------------------------------------------------------------------

def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")
    )


def queries(spark: SparkSession, sf_dir: str, vectors_too: bool = True) -> DataFrame:
    """Two variants of each benchmark text: its words at odd and at even places. The vectors of
    the variants are those at the item's place from the start and from the end of the table."""
    b = table(spark, sf_dir, "benchmark")
    w = words(F.col("text"))
    both = b.select(
        F.col("item_id").alias("query_id"),
        F.explode(F.array(
            F.struct(F.lit(VARIANTS[0]).alias("variant"),
                     F.array_join(F.filter(w, lambda x, i: i % 2 == 0), " ").alias("text")),
            F.struct(F.lit(VARIANTS[1]).alias("variant"),
                     F.array_join(F.filter(w, lambda x, i: i % 2 == 1), " ").alias("text")),
        )).alias("v"),
    ).select("query_id", "v.*")
    if not vectors_too:
        return both
    e = table(spark, sf_dir, "embeddings")
    last = e.select(F.max("vec_id")).scalar()
    place = F.when(F.col("variant") == VARIANTS[0], F.col("query_id")).otherwise(last - F.col("query_id"))
    return both.withColumn("vec_id", place).join(
        e.select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left"
    ).select("query_id", "variant", "text", "vector")


# -- conversations -----------------------------------------------------------

def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with four conversations joined to one history, so that histories are long enough to trim."""
    return table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 4).alias("history_id"), "conv_id", "turn", "role", F.col("text").alias("content")
    )


def response_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a response sent in pieces; every fifth has no end yet."""
    c = table(spark, sf_dir, "conversations")
    message = F.col("conv_id").cast("string").alias("message_id")
    chunks = c.select(message, F.lit("message_chunk").alias("type"), (F.col("turn") + 1).alias("seq"),
                      F.col("text").alias("content"))
    ids = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    starts = ids.select(message, F.lit("message_start").alias("type"), F.lit(0).cast("bigint").alias("seq"),
                        F.lit("").alias("content"))
    ends = ids.where(F.pmod("conv_id", F.lit(5)) != 0).select(
        message, F.lit("message_end").alias("type"), (F.col("last") + 2).cast("bigint").alias("seq"),
        F.lit("").alias("content"))
    return chunks.unionByName(starts).unionByName(ends)


# -- events ------------------------------------------------------------------

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def session_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but sign-ups as a request; the session id is missing on some."""
    e = events(spark, sf_dir).where(F.col("event_type") != "signup")
    return e.select(
        "event_id",
        F.when(F.pmod("event_id", F.lit(13)) == 0, F.lit(None)).otherwise(F.col("user_id").cast("string"))
        .alias("session_id"),
        times.epoch_seconds(F.col("ts")).alias("epoch"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sign-up of each user opens a session of ten days."""
    e = events(spark, sf_dir).where(F.col("event_type") == "signup")
    return e.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(
        F.min(times.epoch_seconds(F.col("ts"))).alias("created_at")
    ).withColumn("expiry", F.col("created_at") + 10 * 86_400)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log line; five neighbouring events share a request id."""
    e = events(spark, sf_dir)
    rid = F.md5(F.floor(F.col("event_id") / 5).cast("string"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    ms = F.concat(cents.cast("string"), F.lit(".5"))
    kind = F.col("event_type")
    message = (
        F.when(F.pmod("event_id", F.lit(9)) == 0, F.concat(
            F.lit('COLD_START_METRICS RequestId: '), rid,
            F.lit(' {"cold_start_metrics": "{\\"is_cold_start\\": true, \\"init_duration_ms\\": '), ms, F.lit('}"}')))
        .when(kind == "view", F.concat(F.lit("START RequestId: "), rid, F.lit(" Version: 1")))
        .when(kind == "click", F.concat(
            F.lit("REPORT RequestId: "), rid, F.lit("\tDuration: "), ms, F.lit(" ms\tInit Duration: "),
            ms, F.lit(" ms")))
        .when(kind == "purchase", F.concat(
            F.lit("🚀 Cold start detected for api | Init: "), ms, F.lit("ms | RequestId: "), rid))
        .when(kind == "signup", F.concat(F.lit("⚡ Warm start for api | RequestId: "), rid))
        .otherwise(F.concat(F.lit("ERROR RequestId: "), rid, F.lit(" Task timed out after "), ms, F.lit(" seconds")))
    )
    group = F.element_at(F.array(*[F.lit(g) for g in ("api", "indexer", "scraper", "layer_cleanup")]),
                         (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    return e.select("event_id", "ts", group.alias("log_group"), message.alias("message"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a stored object: the host is the prefix, the id gives the age."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("prefix"),
        F.col("page_id").cast("string").alias("key"),
        F.date_sub(F.lit("2025-11-01").cast("date"), F.pmod(F.col("page_id") * 7, F.lit(120)).cast("int")).alias("modified"),
    )


# -- answers -----------------------------------------------------------------

def _judge_json(id_: Column) -> dict[str, Column]:
    """Answers of the judges by id: some cut off, some without the score, some missing."""
    def answer(score: str, places: int, more: str) -> Column:
        value = F.concat(F.lit("0."), F.pmod(id_ * places, F.lit(10)).cast("string"))
        whole = F.concat(F.lit('{"' + score + '": '), value, F.lit(', ' + more + '"reasoning": "r'),
                         F.pmod(id_, F.lit(4)).cast("string"), F.lit('"}'))
        return (
            F.when(F.pmod(id_ + places, F.lit(17)) == 0, F.lit(None))
            .when(F.pmod(id_ + places, F.lit(11)) == 0, F.lit("{bad"))
            .when(F.pmod(id_ + places, F.lit(13)) == 0, F.lit('{"reasoning": "no score"}'))
            .otherwise(whole)
        )

    return {
        "faithfulness_json": answer("faithfulness", 1, '"grounded": true, '),
        "actionability_json": answer("actionability", 3, '"specific_products_count": 2, '),
        "retrieval_json": answer("avg_relevance", 7, ""),
    }


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the judges' answers."""
    return table(spark, sf_dir, "labels").select("doc_id").withColumns(_judge_json(F.col("doc_id")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a response; a third of the conversations talk about a price."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn",
        F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat("text", F.lit(" price $5"))).otherwise(F.col("text"))
        .alias("response"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answered query per benchmark item, with a run id on most."""
    return as_messages(table(spark, sf_dir, "benchmark"))


def as_messages(b: DataFrame) -> DataFrame:
    i = F.col("item_id")
    return b.select(
        i.alias("query_id"),
        F.when(F.pmod(i, F.lit(3)) == 0, F.concat("text", F.lit(" price $5"))).otherwise(F.col("text")).alias("response"),
        F.when(F.pmod(i, F.lit(6)) == 5, F.lit("")).otherwise(F.concat(F.lit("run-"), i.cast("string"))).alias("run_id"),
        *[c.alias(n) for n, c in _judge_json(i).items()],
    )
