"""Evaluation of answers: checks, judge answers, overall score, feedback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine import schemas
from threadmine.functions.decode import judge_answer
from threadmine.functions.text import response_checks
from threadmine.operators.metrics import metric_names

# Weights of the overall score.
WEIGHTS = {"faithfulness": 0.4, "actionability_llm": 0.35, "retrieval_relevance": 0.25}
TIER = "full_llm"

# What is posted beside each score, in this library's own words; readers match on the keys alone.
COMMENTS = {
    "overall_score": "judge scores 0.4 / 0.35 / 0.25, tier ",
    "heuristic_score": "rules on the answer's text: ",
    "faithfulness": "share of the answer that its sources support, from 0 to 1",
    "actionability": "how concrete the advice is, from 0 to 1",
    "retrieval_relevance": "how well the sources fit the question, from 0 to 1",
    "recall": "part of the judged documents that was found, first ranks: ",
    "ndcg": "discounted gain against the best order, first ranks: ",
    "hit_rate": "1 if a judged document was found, first ranks: ",
    "mrr": "one over the rank of the first judged document",
}


def with_checks(messages: DataFrame, response: str = "response") -> DataFrame:
    return messages.withColumns(response_checks(F.col(response)))


def with_judges(messages: DataFrame) -> DataFrame:
    """Parse the judge columns ``faithfulness_json``, ``actionability_json``, ``retrieval_json``."""
    f = judge_answer(F.col("faithfulness_json"), schemas.FAITHFULNESS)
    a = judge_answer(F.col("actionability_json"), schemas.ACTIONABILITY)
    r = judge_answer(F.col("retrieval_json"), schemas.RETRIEVAL)
    return messages.withColumns({
        "faithfulness": f["faithfulness"], "grounded": f["grounded"], "faithfulness_reasoning": f["reasoning"],
        "actionability_llm": a["actionability"], "specific_products_count": a["specific_products_count"],
        "actionability_reasoning": a["reasoning"],
        "retrieval_relevance": r["avg_relevance"], "retrieval_reasoning": r["reasoning"],
    })


def overall_score(heuristic: Column, renormalise: bool = False) -> Column:
    """Weighted sum of the judge scores that are there, else the heuristic score.

    The sum is not divided by the weights of the scores that are there unless
    ``renormalise`` is set.
    """
    zero = F.lit(0.0)
    total, weight = zero, zero
    for name, w in WEIGHTS.items():
        total = total + F.coalesce(F.col(name) * F.lit(w), zero)
        weight = weight + F.when(F.col(name).isNotNull(), F.lit(w)).otherwise(zero)
    score = total / weight if renormalise else total
    return F.when(weight > 0, score).otherwise(heuristic)


def with_overall(messages: DataFrame, renormalise: bool = False) -> DataFrame:
    return messages.withColumn(
        "overall_score", overall_score(F.col("heuristic_score"), renormalise)
    ).withColumn("evaluation_tier", F.lit(TIER))


def _metric_comment(name: str) -> str:
    kind, _, k = name.partition("_at_")
    return COMMENTS[kind] + k


def feedback_rows(evaluated: DataFrame) -> DataFrame:
    """``(run_id, key, score, comment)``: one row per score, only for rows with a run id."""
    rows = evaluated.where(F.coalesce("run_id", F.lit("")) != "")
    details = F.format_string(
        '{"has_products": %s, "has_specifics": %s, "response_length": %d}',
        F.col("has_products").cast("string"), F.col("has_specifics").cast("string"), F.col("response_length"),
    )

    def entry(key: str, score: str, comment: Column) -> Column:
        return F.struct(
            F.lit(key).alias("key"), F.col(score).cast("double").alias("score"), comment.alias("comment")
        )

    entries = [
        entry("overall_score", "overall_score", F.concat(F.lit(COMMENTS["overall_score"]), F.col("evaluation_tier"))),
        entry("heuristic_score", "heuristic_score", F.concat(F.lit(COMMENTS["heuristic_score"]), details)),
    ]
    for key, score, reason in (
        ("faithfulness", "faithfulness", "faithfulness_reasoning"),
        ("actionability", "actionability_llm", "actionability_reasoning"),
        ("retrieval_relevance", "retrieval_relevance", "retrieval_reasoning"),
    ):
        entries.append(entry(key, score, F.lit(COMMENTS[key])))
        entries.append(entry(
            f"{key}_reasoning", score, F.when(F.coalesce(reason, F.lit("")) == "", F.lit("N/A")).otherwise(F.col(reason))
        ))
    metrics = [n for n in metric_names() if not n.startswith("num_") and n in evaluated.columns]
    entries += [entry(n, n, F.lit(_metric_comment(n))) for n in metrics]
    return (
        rows.select("run_id", F.inline(F.array(*entries)))
        .where(F.col("score").isNotNull())
    )


def query_log(queries: DataFrame, as_of: Column) -> DataFrame:
    """Append-only log rows: metadata with session, time and query length; given entries win."""
    base = F.create_map(
        F.lit("session_id"), F.col("session_id"), F.lit("timestamp"), as_of.cast("string"),
        F.lit("query_length"), F.length("query").cast("string"),
    )
    given = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k))
    return queries.select(
        "query", F.nullif(F.col("response"), F.lit("")).alias("response"), F.map_concat(kept, given).alias("metadata")
    )
