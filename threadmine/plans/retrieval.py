"""Hybrid retrieval and re-ranking for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.functions import text as X
from threadmine.functions.ids import text_id
from threadmine.operators import search as Q
from threadmine.operators import weights as W
from threadmine.operators.rerank import judgments, rerank
from threadmine.plans.index import SparseIndex
from threadmine.session import stage


def candidate_lists(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, keys: list[str], limit: int = Q.LIMIT,
    index: SparseIndex | None = None, size: Q.QuerySize | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse lists of ``3 * limit`` documents per query.

    Without a stored ``index`` the texts of ``docs`` are scored as they are read and
    only the frequency of the terms that are asked for is counted.
    """
    size = size or Q.QuerySize.of(queries)
    k = limit * Q.OVERFETCH
    dense = Q.dense_topk(queries, vectors, keys, k)
    if index:
        return dense, index.topk(queries, keys, k, size.terms_bounded)
    return dense, Q.sparse_topk(queries, W.tokens_of(docs), W.count_rows(docs), keys, k)


def _with_text_after(
    fused: DataFrame, docs: DataFrame, keys: list[str], limit: int, columns: list[str], size: Q.QuerySize
) -> DataFrame:
    """The best hits that have a text, with their columns. Texts are attached after the cut: what is ranked and
    shuffled before it are numbers."""
    few = size.hits_bounded(2 * limit * Q.OVERFETCH)
    top = Q.fused_top(Q.with_text(fused, docs, [], few), keys, limit)
    return Q.with_text(top, docs, columns, few)


def hybrid_search(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, keys: list[str], limit: int = Q.LIMIT,
    alpha: float = Q.ALPHA, rrf_k: int = Q.RRF_K, index: SparseIndex | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """Reciprocal rank fusion of dense and sparse search.

    ``queries`` is ``(*keys, text, vector)``, ``docs`` ``(doc_id, text, …)`` and ``vectors``
    ``(doc_id, vector)``. The result has ``rank``, ``score``, the two rank terms and the
    document ``columns`` (the text by default).
    """
    columns = columns or ["text"]
    size = Q.QuerySize.of(queries)
    dense, sparse = candidate_lists(queries, docs, vectors, keys, limit, index, size)
    fused = Q.rrf_fuse(dense, sparse, keys, alpha, rrf_k)
    top = _with_text_after(fused, docs, keys, limit, columns, size)
    return top.select(*keys, "rank", "doc_id", "score", "rrf_dense", "rrf_sparse", *columns)


def blend_search(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, keys: list[str], limit: int = Q.LIMIT,
    alpha: float = Q.ALPHA, index: SparseIndex | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """Blend of dense and keyword scores, each list scaled to 0..1; otherwise as :func:`hybrid_search`."""
    columns = columns or ["text"]
    size = Q.QuerySize.of(queries)
    k = limit * Q.OVERFETCH
    if index:
        post = index.postings_for(queries)
        average = W.average_length(post, index.n_docs)
        keyword = Q.ranked(Q.keyword_scores(queries, post, index.n_docs, average, keys, bounded=size.terms_bounded), keys, k)
    else:
        keyword = Q.keyword_topk(queries, W.tokens_of(docs), W.count_rows(docs), keys, k)
    fused = Q.blend_fuse(Q.dense_topk(queries, vectors, keys, k), keyword, keys, alpha)
    top = _with_text_after(fused, docs, keys, limit, columns, size)
    return top.select(*keys, "rank", "doc_id", "score", *columns)


SEARCHES = {"rrf": hybrid_search, "blend": blend_search}


def search(kind: str, *args, **kwargs) -> DataFrame:
    """Search by the kind of index: ``rrf`` or ``blend``."""
    if kind not in SEARCHES:
        raise ValueError(f"unknown kind of index {kind!r}; known are {sorted(SEARCHES)}")
    return SEARCHES[kind](*args, **kwargs)


@dataclass(frozen=True)
class Retrieval:
    """The stages of :func:`retrieve_and_rerank`, all keyed by the query."""

    hits: DataFrame      # both variants' lists
    combined: DataFrame  # one row per text, before re-ranking
    reranked: DataFrame  # the final list
    judged: DataFrame    # relevance of the re-ranked texts


def retrieve(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, keys: list[str], variants: tuple[str, str],
    limit: int = Q.LIMIT, alpha: float = Q.ALPHA, index: SparseIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lists of both variants of each query, and the combined list of the query.

    ``queries`` is ``(*keys, variant, text, vector)``. Both variants go through one search.
    The lists (at most ``2 * limit`` rows per query) are written, since they are read
    several times from there on and the search must not run again.
    """
    hits = stage(hybrid_search(queries, docs, vectors, [*keys, "variant"], limit, alpha, index=index), "hits")
    order = F.struct(F.when(F.col("variant") == variants[0], 0).otherwise(1).alias("list"), F.col("rank"))
    return hits, stage(Q.combine_best(hits, keys, order), "combined")


def retrieve_and_rerank(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, keys: list[str], variants: tuple[str, str],
    limit: int = Q.LIMIT, alpha: float = Q.ALPHA, index: SparseIndex | None = None,
) -> Retrieval:
    """Search with both variants of each query, combine, re-rank by the first variant's text."""
    hits, combined = retrieve(queries, docs, vectors, keys, variants, limit, alpha, index)
    main = queries.where(F.col("variant") == variants[0]).select(*keys, "text")
    reranked = rerank(combined.drop("rank"), main, keys, limit)
    return Retrieval(hits, combined, reranked, judgments(reranked, keys))


def contexts(reranked: DataFrame, keys: list[str], top: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """One context string per query from its best ``top`` texts.

    With the ``queries`` that were asked, those that found nothing have the sentence for that.
    """
    best = reranked.where(F.col("rank") <= top).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]).alias("top_texts")
    )
    if queries is not None:
        best = queries.select(*keys).distinct().join(best, keys, "left").withColumn(
            "top_texts", F.coalesce("top_texts", F.array().cast("array<string>")))
    return best.withColumn("context", X.context_string(F.col("top_texts"), top))


def result_counts(stages: Retrieval, queries: DataFrame, keys: list[str], variants: tuple[str, str]) -> DataFrame:
    """Sizes of the lists of each query, 0 where a search found nothing."""
    asked = queries.select(*keys).distinct()
    by_variant = stages.hits.groupBy(*keys).agg(
        F.count_if(F.col("variant") == variants[0]).alias("num_rewritten_results"),
        F.count_if(F.col("variant") == variants[1]).alias("num_hyde_results"),
    )
    combined = stages.combined.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_combined_results"))
    final = stages.reranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_reranked_results"))
    out = asked
    for part in (by_variant, combined, final):
        out = out.join(part, keys, "left")
    names = ["num_rewritten_results", "num_hyde_results", "num_combined_results", "num_reranked_results"]
    return out.select(*keys, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def metric_rows(combined: DataFrame, keys: list[str]) -> DataFrame:
    """The list before re-ranking as input of the metrics; documents are identified by their text."""
    return combined.select(*keys, F.col("position").alias("rank"), text_id(F.col("text")).alias("doc_id"))
