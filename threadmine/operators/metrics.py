"""Retrieval metrics for every query of a table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmine.operators.ranking import latest, top_k

K_VALUES = (5, 10, 15)


def metric_names(k_values: tuple[int, ...] = K_VALUES) -> list[str]:
    return [
        *[f"{m}_at_{k}" for m in ("recall", "ndcg", "hit_rate") for k in k_values],
        "mrr", "num_relevant_docs", "num_retrieved_docs",
    ]


def with_positions(lists: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """1-based ``rank`` for lists that come with an ordering column only."""
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def last_judgments(judged: DataFrame, keys: list[str], seq: str | None = "seq") -> DataFrame:
    """One relevance per query and document; the last in ``seq`` order wins."""
    order = [F.col(seq).desc()] if seq else [F.col("relevance_score").desc()]
    return latest(judged, [*keys, "doc_id"], order).select(*keys, "doc_id", "relevance_score")


def _gain(relevance: Column, position: Column) -> Column:
    return relevance / F.log2(position + F.lit(1.0))


def retrieval_metrics(
    retrieved: DataFrame, judged: DataFrame, keys: list[str], queries: DataFrame | None = None,
    k_values: tuple[int, ...] = K_VALUES, threshold: float = 0.5, seq: str | None = "seq",
) -> DataFrame:
    """Recall, nDCG, hit rate at each k, MRR and the two counts, one row per query.

    ``retrieved`` is ``(*keys, rank, doc_id)`` with ranks 1, 2, …, ``judged`` is
    ``(*keys, doc_id, relevance_score)``. A document without judgment has relevance 0;
    the ideal order for nDCG is that of the retrieved list. A query without
    results or without judgments has zeros throughout. All but the ideal order are
    plain aggregates, and the ideal order is cut to ``max(k)`` rows per partition,
    so a very long list is never gathered.
    """
    judged = last_judgments(judged, keys, seq)
    rows = retrieved.select(*keys, "rank", "doc_id").join(judged, [*keys, "doc_id"], "left").withColumn(
        "rel", F.coalesce("relevance_score", F.lit(0.0))
    )
    rank, rel = F.col("rank"), F.col("rel")
    relevant = rel >= threshold

    def dcg(position: Column, k: int, name: str) -> Column:
        return F.sum(F.when(position <= k, _gain(rel, position)).otherwise(0.0)).alias(name)

    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_retrieved"),
        F.coalesce(F.lit(1.0) / F.min(F.when(relevant, rank)), F.lit(0.0)).alias("_mrr"),
        *[F.count_if(relevant & (rank <= k)).alias(f"_hits_{k}") for k in k_values],
        *[dcg(rank, k, f"_dcg_{k}") for k in k_values],
    )
    ideal = top_k(rows, keys, [rel.desc(), rank], max(k_values), "_ideal").groupBy(*keys).agg(
        *[dcg(F.col("_ideal"), k, f"_idcg_{k}") for k in k_values]
    )
    known = judged.groupBy(*keys).agg(
        F.count_if(F.col("relevance_score") >= threshold).alias("_relevant")
    )
    scored = found.join(ideal, keys).join(known, keys)
    if queries is not None:
        scored = queries.select(*keys).distinct().join(scored, keys, "left")

    zero = F.lit(0.0)
    n_rel = F.coalesce("_relevant", F.lit(0))
    out = []
    for k in k_values:
        hits = F.coalesce(f"_hits_{k}", F.lit(0))
        out += [
            F.when(n_rel > 0, hits / n_rel).otherwise(zero).alias(f"recall_at_{k}"),
            F.coalesce(F.when(F.col(f"_idcg_{k}") > 0, F.col(f"_dcg_{k}") / F.col(f"_idcg_{k}")), zero)
            .alias(f"ndcg_at_{k}"),
            F.when(hits > 0, F.lit(1.0)).otherwise(zero).alias(f"hit_rate_at_{k}"),
        ]
    return scored.select(
        *keys, *out, F.coalesce("_mrr", zero).alias("mrr"),
        n_rel.cast("bigint").alias("num_relevant_docs"),
        F.coalesce("_retrieved", F.lit(0)).cast("bigint").alias("num_retrieved_docs"),
    )
