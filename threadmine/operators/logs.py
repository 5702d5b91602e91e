"""Log records: scanning, parsing, start-up statistics and health counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.operators.ranking import latest, order_statistics
from threadmine.session import lookup_join, salted_join

# Marks of the log lines and the patterns of their numbers.
COLD_MARK, WARM_MARK = "🚀 Cold start detected", "⚡ Warm start"
REQUEST_ID = r"RequestId:\s*([a-f0-9-]+)"
INIT = r"Init:\s*([0-9.]+)ms"
INIT_DURATION = r"Init Duration:\s*([0-9.]+)\s*ms"
DURATION = r"Duration:\s*([0-9.]+)\s*ms"
METRICS_FIELD = r'"cold_start_metrics": "((?:[^"\\]|\\.)*)"'
FRACTIONS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}

# Look-back of the health counts in minutes, by job.
WINDOWS = {"indexer": 1440, "scraper": 1440, "scraper_worker": 1440, "glue_starter": 1440, "layer_cleanup": 20160}
DEFAULT_WINDOW = 15


def scan(
    logs: DataFrame, contains: str | None = None, start: Column | None = None, end: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Records in a time range whose message holds a text; with a ``limit`` the newest of them."""
    rows = logs
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") <= end)
    if contains is not None:
        rows = rows.where(F.contains(F.col("message"), F.lit(contains)))
    if limit is None:
        return rows
    tie = [c for c in ("event_id", "stream") if c in logs.columns]
    return rows.orderBy(F.col("ts").desc(), *tie).limit(limit)


def _number(message: Column, pattern: str) -> Column:
    return F.regexp_extract(message, pattern, 1).try_cast("double")


def request_id(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, REQUEST_ID, 1), F.lit(""))


def parse_reports(logs: DataFrame) -> DataFrame:
    """Add ``request_id``, ``init_duration_ms``, ``duration_ms``; lines without request id drop out.

    ``duration_ms`` is the first duration of the line, whichever kind that is.
    """
    message = F.col("message")
    return logs.withColumns({
        "request_id": request_id(message),
        "init_duration_ms": _number(message, INIT_DURATION),
        "duration_ms": _number(message, DURATION),
    }).where(F.col("request_id").isNotNull())


def parse_starts(logs: DataFrame) -> DataFrame:
    """Start-up lines with ``is_cold_start`` and the durations they hold.

    A line carries either the metrics as JSON or a cold or warm mark; other lines drop out.
    """
    message = F.col("message")
    embedded = F.regexp_replace(F.regexp_extract(message, METRICS_FIELD, 1), r"\\", "")
    data = F.from_json(
        F.nullif(embedded, F.lit("")),
        "is_cold_start boolean, init_duration_ms double, lambda_init_duration_ms double",
    )
    valid = F.try_parse_json(F.nullif(embedded, F.lit(""))).isNotNull()
    marked = F.when(F.contains(message, F.lit(COLD_MARK)), True).when(F.contains(message, F.lit(WARM_MARK)), False)
    return logs.withColumns({
        "request_id": request_id(message),
        "is_cold_start": F.when(valid, F.coalesce(data["is_cold_start"], F.lit(False))).otherwise(marked),
        "init_duration_ms": F.when(valid, data["init_duration_ms"]).otherwise(_number(message, INIT)),
        "lambda_init_duration_ms": F.when(valid, data["lambda_init_duration_ms"]),
    }).where(F.col("is_cold_start").isNotNull())


def join_reports(starts: DataFrame, reports: DataFrame, order: list[Column]) -> DataFrame:
    """Start-up lines with the init duration of their request's report.

    Several reports of a request: the first in ``order`` counts. A report without
    init duration leaves the value of the line.
    """
    one = latest(reports, ["request_id"], order).select(
        "request_id", F.col("init_duration_ms").alias("_reported")
    )
    spread = ["event_id"] if "event_id" in starts.columns else ["message"]
    joined = salted_join(starts, one, ["request_id"], spread, "left")
    return joined.withColumn(
        "lambda_init_duration_ms", F.coalesce("_reported", "lambda_init_duration_ms")
    ).drop("_reported")


def duration_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, avg and the three order statistics of ``value`` per key."""
    basic = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg")
    )
    return basic.join(order_statistics(rows, keys, value, FRACTIONS), keys)


def start_counts(starts: DataFrame, keys: list[str]) -> DataFrame:
    cold = F.count_if(F.col("is_cold_start"))
    total = F.count(F.lit(1))
    return starts.groupBy(*keys).agg(
        cold.alias("total_cold_starts"), (total - cold).alias("total_warm_starts"),
        total.alias("total_invocations"),
        F.when(total > 0, cold / total).otherwise(F.lit(0.0)).alias("cold_start_rate"),
    )


def newest_cold(starts: DataFrame, n: int = 10) -> DataFrame:
    return scan(starts.where("is_cold_start"), limit=n)


def health_counts(
    logs: DataFrame, as_of: Column, windows: dict[str, int] = WINDOWS, default: int = DEFAULT_WINDOW
) -> DataFrame:
    """Lines, invocations, timeouts and error lines per ``log_group`` within its look-back.

    A group's name ends with the name of its job; the first job that fits counts.
    """
    minutes = F.lit(default)
    for job, m in reversed(windows.items()):
        minutes = F.when(F.col("log_group").endswith(job), F.lit(m)).otherwise(minutes)
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), as_of)
    message = F.col("message")
    return logs.where((age >= 0) & (age <= minutes * F.lit(60_000_000).cast("bigint"))).groupBy("log_group").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.rlike(message, F.lit(r"START\s+RequestId"))).alias("n_starts"),
        F.count_if(F.rlike(message, F.lit(r"(?i)task timed out"))).alias("n_timeouts"),
        F.count_if(F.rlike(message, F.lit(r"(?i)error|exception"))).alias("n_errors"),
    )


def first_event_flag(events: DataFrame, keys: list[str], event_id: str = "event_id") -> DataFrame:
    """Add ``is_cold_start``: true for the first event of each key, false for the others.

    The first events come from an aggregate and are matched by their unique id, so
    a key with very many events is neither sorted nor joined as one group.
    """
    first = events.groupBy(*keys).agg(F.min(F.struct("ts", event_id)).alias("_f")).select(
        F.col(f"_f.{event_id}").alias(event_id), F.lit(True).alias("_first")
    )
    return lookup_join(events, first, [event_id], [event_id], "left").withColumn(
        "is_cold_start", F.coalesce("_first", F.lit(False))
    ).drop("_first")
