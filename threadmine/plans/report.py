"""Start-up report from log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.operators import logs as L
from threadmine.session import stage



def invocations(logs: DataFrame) -> DataFrame:
    """Start-up lines with the init duration that the report of their request gives."""
    starts = L.parse_starts(logs)
    reports = L.parse_reports(logs.where(F.contains(F.col("message"), F.lit("REPORT"))))
    # The reports are read newest first and a later one replaces an earlier one, so the oldest counts.
    return L.join_reports(starts, reports, [F.col("ts"), F.col("event_id")])


def cold_start_report(logs: DataFrame, keys: list[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Counts, rate and duration statistics of cold starts per key (a log group, a handler)."""
    found = invocations(L.scan(logs, start=start, end=end, limit=None))
    # Few columns of few lines; written once, since counts and both statistics read them.
    rows = stage(found.select(
        *keys, "event_id", "is_cold_start", "init_duration_ms", "lambda_init_duration_ms"), "starts")
    cold = rows.where("is_cold_start")
    out = L.start_counts(rows, keys)
    for value in ("init_duration_ms", "lambda_init_duration_ms"):
        stats = L.duration_stats(cold, keys, value)
        prefix = value.removesuffix("_duration_ms")
        out = out.join(stats.withColumnsRenamed({c: f"{prefix}_{c}" for c in ("min", "max", "avg", *L.FRACTIONS)}), keys, "left")
    return out
