"""BM25 re-ranking of each query's candidate list, with the statistics of that list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmine.functions.ids import text_id
from threadmine.functions.text import tokenize_words
from threadmine.operators.ranking import score_key, top_k
from threadmine.operators.search import LIMIT, scaled

# BM25 (Okapi) parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25_scores(
    candidates: DataFrame, queries: DataFrame, keys: list[str],
    k1: float = K1, b: float = B, epsilon: float = EPSILON,
) -> DataFrame:
    """``(*keys, position, bm25)`` for candidates ``(*keys, position, text)``.

    N, average length and document frequency are those of the query's own
    candidates. A term in more than half of them has a negative IDF and gets
    ``epsilon`` times the mean IDF instead. Repeated query words count repeatedly.

    A query's candidates are a short list (two searches' limit), so everything is
    computed where the query's rows are: one shuffle by query, then windows whose
    keys extend it.
    """
    asked = queries.select(*keys, tokenize_words(F.col("text")).alias("_asked"))
    by_query, by_term = Window.partitionBy(*keys), Window.partitionBy(*keys, "term")
    tokens = (
        candidates.select(*keys, "position", tokenize_words(F.col("text")).alias("_t")).repartition(*keys)
        .withColumns({"_n": F.count(F.lit(1)).over(by_query), "_avg": F.avg(F.size("_t")).over(by_query)})
    )
    terms = (
        tokens.select(*keys, "position", "_n", "_avg", F.size("_t").alias("_len"), F.explode_outer("_t").alias("term"))
        # A text without words stays as one row without term, and scores 0.
        .groupBy(*keys, "position", "_n", "_avg", "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
        .withColumn("_df", F.when(F.col("term").isNotNull(), F.count(F.lit(1)).over(by_term)))
        .withColumn("_idf", F.log(F.col("_n") - F.col("_df") + F.lit(0.5)) - F.log(F.col("_df") + F.lit(0.5)))
        # Mean over distinct terms: a term has _df rows here and weighs 1 / _df in each.
        .withColumn("_mean", F.sum(F.col("_idf") / F.col("_df")).over(by_query) / F.sum(F.lit(1.0) / F.col("_df")).over(by_query))
    )
    q = F.size(F.filter("_asked", lambda t: t == F.col("term")))
    idf = F.when(F.col("_idf") < 0, F.lit(epsilon) * F.col("_mean")).otherwise(F.col("_idf"))
    norm = F.col("_tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("_len") / F.col("_avg"))
    # Only rows of terms that were asked for add to the score; the test is cheap, counting is not.
    hit = F.array_contains("_asked", F.col("term"))
    part = F.when(hit, q * idf * F.col("_tf") * F.lit(k1 + 1.0) / norm)
    return terms.join(asked, keys).groupBy(*keys, "position").agg(
        F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25")
    )


def rerank(
    candidates: DataFrame, queries: DataFrame, keys: list[str], limit: int = LIMIT,
) -> DataFrame:
    """The top ``limit`` candidates of each query, best BM25 first.

    A query with no more than ``limit`` candidates keeps its order and gets no
    relevance. Columns added: ``rank``, ``bm25`` and ``relevance`` (BM25 scaled to
    0..1 within the query's candidates, null if it was not re-ranked).
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    scored = scaled(bm25_scores(candidates, queries, keys), keys, "bm25", "relevance")
    reranked = F.col("_n") > limit
    scored = scored.withColumn("_n", size).select(
        *keys, "position", F.when(reranked, F.col("bm25")).alias("bm25"),
        F.when(reranked, F.col("relevance")).alias("relevance"),
    )
    order = [score_key(F.coalesce("relevance", F.lit(0.0))).desc(), F.col("position")]
    return candidates.join(top_k(scored, keys, order, limit), [*keys, "position"])


def judgments(reranked: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, doc_id, relevance_score, seq)`` of the re-ranked rows; the id is that of the text."""
    return reranked.where(F.col("relevance").isNotNull()).select(
        *keys, text_id(F.col("text")).alias("doc_id"), F.col("relevance").alias("relevance_score"),
        F.col("rank").alias("seq"),
    )


def is_relevant(score: Column, threshold: float = 0.5) -> Column:
    return score >= threshold
