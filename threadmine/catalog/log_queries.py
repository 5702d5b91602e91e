"""Log records and start-up statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmine.catalog import sqlparts as S
from threadmine.catalog import tables as T
from threadmine.catalog.registry import query
from threadmine.operators import logs as L
from threadmine.plans import report

GROUP = ["log_group"]


@query(S.clauses(S.LOGS) + "SELECT event_id, message FROM logs WHERE contains(message, 'REPORT') AND ts >= '2024-01-05' AND ts <= '2024-01-20' ORDER BY ts DESC, event_id LIMIT 1000")
def log_scan(spark, sf_dir):
    start, end = (F.to_timestamp_ntz(F.lit(t)) for t in ("2024-01-05 00:00:00", "2024-01-20 00:00:00"))
    return L.scan(T.logs(spark, sf_dir), "REPORT", start, end, 1000).select("event_id", "message")


@query(S.clauses(S.LOGS, S.STARTS) + r"""SELECT event_id, request_id, TRY_CAST(regexp_extract(message, 'Init Duration:\s*([0-9.]+)\s*ms', 1) AS DOUBLE) AS init_duration_ms,
  TRY_CAST(regexp_extract(message, 'Duration:\s*([0-9.]+)\s*ms', 1) AS DOUBLE) AS duration_ms FROM parsed WHERE request_id IS NOT NULL""")
def parse_report(spark, sf_dir):
    return L.parse_reports(T.logs(spark, sf_dir)).select("event_id", "request_id", "init_duration_ms", "duration_ms")


@query(S.clauses(S.LOGS, S.STARTS) + "SELECT event_id, request_id, is_cold_start, init_duration_ms FROM starts")
def parse_starts(spark, sf_dir):
    return L.parse_starts(T.logs(spark, sf_dir)).select("event_id", "request_id", "is_cold_start", "init_duration_ms")


@query(S.clauses(S.LOGS, S.STARTS) + "SELECT event_id, is_cold_start, lambda_init_duration_ms FROM invocations")
def join_reports(spark, sf_dir):
    return report.invocations(T.logs(spark, sf_dir)).select("event_id", "is_cold_start", "lambda_init_duration_ms")


@query(S.clauses(S.LOGS, S.STARTS) + """SELECT log_group, count(*) FILTER (is_cold_start) AS total_cold_starts, count(*) FILTER (NOT is_cold_start) AS total_warm_starts,
  count(*) AS total_invocations, round(count(*) FILTER (is_cold_start) * 1.0 / count(*), 6) AS cold_start_rate FROM starts GROUP BY log_group""")
def cold_start_counts(spark, sf_dir):
    c = L.start_counts(L.parse_starts(T.logs(spark, sf_dir)), GROUP)
    return c.withColumn("cold_start_rate", T.r6("cold_start_rate"))


def _stats(column: str, prefix: str) -> str:
    v = f"list_sort(list({column}) FILTER (is_cold_start AND {column} IS NOT NULL))"
    n = f"count({column}) FILTER (is_cold_start)"
    parts = [f"round({f}({column}) FILTER (is_cold_start), 6) AS {prefix}_{f}" for f in ("min", "max", "avg")]
    parts += [f"round({v}[CAST(floor({n} * {p}e0) AS BIGINT) + 1], 6) AS {prefix}_{name}" for name, p in L.FRACTIONS.items()]
    return ", ".join(parts)


_STAT_NAMES = [f"{p}_{s}" for p in ("init", "lambda_init") for s in ("min", "max", "avg", *L.FRACTIONS)]


@query(S.clauses(S.LOGS, S.STARTS) + f"""SELECT log_group, count(*) FILTER (is_cold_start) AS total_cold_starts, count(*) FILTER (NOT is_cold_start) AS total_warm_starts,
  count(*) AS total_invocations, round(count(*) FILTER (is_cold_start) * 1.0 / count(*), 6) AS cold_start_rate,
  {_stats('init_duration_ms', 'init')}, {_stats('lambda_init_duration_ms', 'lambda_init')} FROM invocations GROUP BY log_group""")
def cold_start_report(spark, sf_dir):
    r = report.cold_start_report(T.logs(spark, sf_dir), GROUP)
    return r.withColumns({c: T.r6(c) for c in ["cold_start_rate", *_STAT_NAMES]})


@query("SELECT event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, "
       + ", ".join(f"list_sort(list(value))[CAST(floor(count(value) * {p}e0) AS BIGINT) + 1] AS {n}" for n, p in L.FRACTIONS.items())
       + " FROM events GROUP BY event_type")
def duration_percentiles(spark, sf_dir):
    s = L.duration_stats(T.events(spark, sf_dir), ["event_type"], "value")
    return s.withColumns({c: T.r6(c) for c in ("min", "max", "avg")})


@query(S.clauses(S.LOGS) + r"""SELECT log_group, count(*) AS n_lines, count(*) FILTER (regexp_matches(message, 'START\s+RequestId')) AS n_starts,
  count(*) FILTER (regexp_matches(message, '(?i)task timed out')) AS n_timeouts, count(*) FILTER (regexp_matches(message, '(?i)error|exception')) AS n_errors
  FROM logs WHERE ts <= '2024-01-25' AND ts >= TIMESTAMP '2024-01-25' - CASE WHEN log_group LIKE '%indexer' THEN INTERVAL 1440 MINUTE WHEN log_group LIKE '%scraper' THEN INTERVAL 1440 MINUTE
      WHEN log_group LIKE '%layer_cleanup' THEN INTERVAL 20160 MINUTE ELSE INTERVAL 600 MINUTE END GROUP BY log_group""")
def log_health_counts(spark, sf_dir):
    as_of = F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00"))
    return L.health_counts(T.logs(spark, sf_dir), as_of, default=600)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_cold_start FROM events")
def first_event_flag(spark, sf_dir):
    return L.first_event_flag(T.events(spark, sf_dir), ["user_id"]).select("event_id", "is_cold_start")


@query(S.clauses(S.LOGS, S.STARTS) + "SELECT event_id FROM starts WHERE is_cold_start ORDER BY ts DESC, event_id LIMIT 10")
def newest_cold_starts(spark, sf_dir):
    return L.newest_cold(L.parse_starts(T.logs(spark, sf_dir))).select("event_id")


@query(S.clauses(S.LOGS) + "SELECT event_id FROM logs WHERE contains(message, 'START RequestId') ORDER BY ts DESC, event_id LIMIT 5")
def newest_start_lines(spark, sf_dir):
    return L.scan(T.logs(spark, sf_dir), "START RequestId", limit=5).select("event_id")
