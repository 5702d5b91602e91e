"""Evaluation of answered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.operators import evaluate as E
from threadmine.operators.metrics import metric_names, retrieval_metrics


def evaluate(
    messages: DataFrame, retrieved: DataFrame | None = None, judged: DataFrame | None = None,
    keys: list[str] | None = None, renormalise: bool = False,
) -> DataFrame:
    """Checks, judge scores, retrieval metrics and overall score of each message.

    ``messages`` is ``(*keys, response, run_id, faithfulness_json, actionability_json,
    retrieval_json, …)``. Metrics stay null for messages without results or judgments.
    """
    scored = E.with_overall(E.with_judges(E.with_checks(messages)), renormalise)
    names = [n for n in metric_names() if not n.startswith("num_")]
    if retrieved is None or judged is None:
        return scored.withColumns({n: F.lit(None).cast("double") for n in names})
    keys = keys or ["query_id"]
    metrics = retrieval_metrics(retrieved, judged, keys).select(*keys, *names)
    return scored.join(metrics, keys, "left")


def feedback(evaluated: DataFrame) -> DataFrame:
    return E.feedback_rows(evaluated)
