"""Search, fusion, re-ranking, metrics and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadmine import schemas
from threadmine.catalog import sqlparts as S
from threadmine.catalog import tables as T
from threadmine.catalog.registry import query
from threadmine.functions import text as X
from threadmine.functions.decode import judge_answer
from threadmine.operators import evaluate as E
from threadmine.operators import metrics as M
from threadmine.operators import rerank as R
from threadmine.operators import search as Q
from threadmine.operators import weights as W
from threadmine.plans import evaluation, index, retrieval
from threadmine.session import shuffles_removed, stage
from threadmine.sources.store import drop_index

KEYS = ["query_id", "variant"]
QID = ["query_id"]


def _sparse(spark, sf_dir):
    d, q = T.docs(spark, sf_dir), T.queries(spark, sf_dir, vectors_too=False)
    return Q.sparse_topk(q, W.tokens_of(d), W.count_rows(d), KEYS, 45)


def _dense(spark, sf_dir):
    return Q.dense_topk(T.queries(spark, sf_dir), T.vectors(spark, sf_dir), KEYS, 45)


def _hits(spark, sf_dir):
    return retrieval.search("rrf", T.queries(spark, sf_dir), T.docs(spark, sf_dir), T.vectors(spark, sf_dir), KEYS)


def _combined(spark, sf_dir):
    return retrieval.retrieve(
        T.queries(spark, sf_dir), T.docs(spark, sf_dir), T.vectors(spark, sf_dir), QID, T.VARIANTS)[1]


def _stages(spark, sf_dir):
    return retrieval.retrieve_and_rerank(
        T.queries(spark, sf_dir), T.docs(spark, sf_dir), T.vectors(spark, sf_dir), QID, T.VARIANTS
    )


_LIST = "SELECT query_id, variant, rank, doc_id, round(score, 6) AS score FROM "


@query(S.clauses(S.QUERIES, S.POSTINGS, S.QUERY_TERMS, S.SPARSE) + _LIST + "sparse")
def sparse_topk(spark, sf_dir):
    return _sparse(spark, sf_dir).select(*KEYS, "rank", "doc_id", T.r6("score").alias("score"))


@query(S.clauses(S.QUERIES, S.DENSE) + _LIST + "dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select(*KEYS, "rank", "doc_id", T.r6("score").alias("score"))


@query(S.clauses(S.QUERIES, S.DENSE) + _LIST + "dense")
def dense_topk_blocks(spark, sf_dir):
    """The same search by the grid of blocks that serves query tables too large to broadcast."""
    hits = Q.dense_topk(T.queries(spark, sf_dir), T.vectors(spark, sf_dir), KEYS, 45, max_broadcast=0)
    return hits.select(*KEYS, "rank", "doc_id", T.r6("score").alias("score"))


@query(S.clauses(S.QUERIES, S.POSTINGS, S.QUERY_TERMS, S.SPARSE, S.DENSE, S.FUSED)
       + "SELECT query_id, variant, doc_id, dense_rank, sparse_rank, round(rrf_dense, 6) AS rrf_dense, "
         "round(rrf_sparse, 6) AS rrf_sparse, round(score, 6) AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    fused = Q.rrf_fuse(_dense(spark, sf_dir), _sparse(spark, sf_dir), KEYS)
    return fused.select(*KEYS, "doc_id", "dense_rank", "sparse_rank", *[
        T.r6(c).alias(c) for c in ("rrf_dense", "rrf_sparse", "score")])


_BM25_ALL = f"""stats AS (SELECT count(*) * 1.0 AS n, avg(len(t)) AS avgdl FROM toks),
kw_all AS (SELECT query_id, variant, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))) AS score
  FROM qterms JOIN terms USING (term) JOIN post USING (term), stats GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY {S.key('score')} DESC, doc_id) AS rank
  FROM kw_all) WHERE rank <= 45)"""


def _scaled(name: str, source: str) -> str:
    return (f"{name} AS (SELECT query_id, variant, doc_id, rank, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w > min(score) OVER w "
            f"THEN max(score) OVER w - min(score) OVER w ELSE 1 END) AS score FROM {source} WINDOW w AS (PARTITION BY query_id, variant))")


_KEYWORD = (S.QUERIES, S.POSTINGS, S.QUERY_TERMS, _BM25_ALL)


def _keyword(spark, sf_dir):
    d, q = T.docs(spark, sf_dir), T.queries(spark, sf_dir, vectors_too=False)
    return Q.keyword_topk(q, W.tokens_of(d), W.count_rows(d), KEYS, 45)


@query(S.clauses(*_KEYWORD) + _LIST + "kw")
def keyword_topk(spark, sf_dir):
    return _keyword(spark, sf_dir).select(*KEYS, "rank", "doc_id", T.r6("score").alias("score"))


@query(S.clauses(*_KEYWORD, S.DENSE, _scaled("kws", "kw"), _scaled("ds", "dense"),
                 "blend AS (SELECT query_id, variant, doc_id, d.rank AS dense_rank, k.rank AS sparse_rank, "
                 "0.5e0 * coalesce(d.score, 0) + 0.5e0 * coalesce(k.score, 0) AS score FROM ds d FULL OUTER JOIN kws k USING (query_id, variant, doc_id))",
                 f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY {S.key('score')} DESC,
                 dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id) AS rank FROM blend JOIN documents USING (doc_id) WHERE coalesce(text, '') <> '') WHERE rank <= 15)""")
       + _LIST + "top")
def blend_search(spark, sf_dir):
    hits = retrieval.search("blend", T.queries(spark, sf_dir), T.docs(spark, sf_dir), T.vectors(spark, sf_dir), KEYS)
    return hits.select(*KEYS, "rank", "doc_id", T.r6("score").alias("score"))


@query(S.clauses(*S.RETRIEVE) + "SELECT query_id, variant, rank, doc_id, round(score, 6) AS score, md5(text) AS text_id FROM hits")
def hybrid_search(spark, sf_dir):
    return _hits(spark, sf_dir).select(*KEYS, "rank", "doc_id", T.r6("score").alias("score"), F.md5("text").alias("text_id"))


@query(S.clauses(*S.RETRIEVE).replace(", embeddings e)", ", (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) e)")
       + "SELECT query_id, variant, rank, doc_id, round(score, 6) AS score, md5(text) AS text_id FROM hits")
def index_hybrid(spark, sf_dir):
    """The same on a stored index of texts and their vectors that was written in two versions, the second one twice."""
    name = f"ix_{uuid.uuid4().hex}"
    points = stage(T.docs(spark, sf_dir).join(T.vectors(spark, sf_dir), ["doc_id"], "left").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("post_id"), F.col("text").alias("page_content"), "vector"), "points", "zstd")
    later = F.pmod("id", F.lit(3)) == 0
    stale = F.when(F.pmod("id", F.lit(6)) == 0, F.lit("an older text")).otherwise(F.col("page_content"))
    index.write_index(spark, name, points.where(~later | (F.pmod("id", F.lit(6)) == 0)).withColumn("page_content", stale), parts=16)
    for _ in range(2):
        index.write_index(spark, name, points.where(later), recreate=False, batch="second")
    held = index.open_points(spark, name)
    with shuffles_removed(spark):
        hits = retrieval.hybrid_search(
            T.queries(spark, sf_dir), held.select(F.col("id").alias("doc_id"), F.col("page_content").alias("text")),
            held.where("vector IS NOT NULL").select(F.col("id").alias("doc_id"), "vector"), KEYS, index=index.open_sparse(spark, name))
        found = stage(hits.select(*KEYS, "rank", "doc_id", T.r6("score").alias("score"), F.md5("text").alias("text_id")), "hits")
    drop_index(spark, name)
    return found


@query(S.clauses(*S.RETRIEVE, S.COMBINED) + "SELECT query_id, position, variant, doc_id, round(score, 6) AS score FROM combined")
def combine_dedupe(spark, sf_dir):
    return _combined(spark, sf_dir).select(*QID, "position", "variant", "doc_id", T.r6("score").alias("score"))


@query(S.clauses(S.QUERIES, S.POSTINGS, S.QUERY_TERMS, S.SPARSE, S.DENSE)
       + """SELECT query_id, variant, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant, text ORDER BY side, rank, doc_id) AS n
  FROM (SELECT query_id, variant, doc_id, rank, 'dense' AS source, 0 AS side FROM dense
        UNION ALL SELECT query_id, variant, doc_id, rank, 'sparse', 1 FROM sparse) JOIN documents d USING (doc_id) WHERE coalesce(d.text, '') <> '')
  WHERE n = 1""".replace("query_id, variant, doc_id, source FROM (SELECT *,", "query_id, variant, doc_id, origin AS source FROM (SELECT *,").replace("'dense' AS source", "'dense' AS origin"))
def dedupe_first_text(spark, sf_dir):
    lists = _dense(spark, sf_dir).withColumns({"source": F.lit("dense"), "side": F.lit(0)}).unionByName(
        _sparse(spark, sf_dir).withColumns({"source": F.lit("sparse"), "side": F.lit(1)}))
    size = Q.QuerySize.of(T.queries(spark, sf_dir, vectors_too=False))
    rows = Q.with_text(lists, T.docs(spark, sf_dir), ["text"], size.hits_bounded(2 * 45))
    first = Q.first_by_text(rows, KEYS, [F.col("side"), F.col("rank"), F.col("doc_id")])
    return first.select(*KEYS, "doc_id", "source")


_RERANK = (*S.RETRIEVE, S.COMBINED, S.bm25())
_RERANKED = "SELECT query_id, rank, position, doc_id, round(score, 6) AS score, round(bm25, 6) AS bm25, round(relevance, 6) AS relevance FROM reranked"


def _final(stages):
    return stages.reranked.select(*QID, "rank", "position", "doc_id", *[T.r6(c).alias(c) for c in ("score", "bm25", "relevance")])


@query(S.clauses(*_RERANK) + "SELECT query_id, position, round(bm25, 6) AS bm25 FROM bm")
def bm25_scores(spark, sf_dir):
    combined = _combined(spark, sf_dir)
    main = T.queries(spark, sf_dir, vectors_too=False).where("variant = 'rewritten'")
    return R.bm25_scores(combined, main, QID).select(*QID, "position", T.r6("bm25").alias("bm25"))


@query(S.clauses(*_RERANK) + _RERANKED)
def retrieve_and_rerank(spark, sf_dir):
    return _final(_stages(spark, sf_dir))


@query(S.clauses(*_RERANK) + "SELECT query_id, doc_id, round(relevance_score, 6) AS relevance_score FROM judged")
def rerank_judgments(spark, sf_dir):
    return _stages(spark, sf_dir).judged.select(*QID, "doc_id", T.r6("relevance_score").alias("relevance_score"))


@query(S.clauses(*_RERANK) + """SELECT DISTINCT q.query_id,
  (SELECT count(*) FROM hits h WHERE h.query_id = q.query_id AND variant = 'rewritten') AS num_rewritten_results,
  (SELECT count(*) FROM hits h WHERE h.query_id = q.query_id AND variant = 'hyde') AS num_hyde_results,
  (SELECT count(*) FROM combined c WHERE c.query_id = q.query_id) AS num_combined_results,
  (SELECT count(*) FROM reranked r WHERE r.query_id = q.query_id) AS num_reranked_results FROM queries q""")
def result_counts(spark, sf_dir):
    return retrieval.result_counts(_stages(spark, sf_dir), T.queries(spark, sf_dir, vectors_too=False), QID, T.VARIANTS)


@query(S.clauses(S.QUERIES, S.POSTINGS, S.QUERY_TERMS, S.SPARSE)
       + """, asked AS (SELECT query_id, variant FROM queries UNION ALL SELECT doc_id, 'label' FROM labels)
SELECT variant, count(*) AS n_queries, count(*) FILTER (n IS NULL) AS n_without_results
FROM asked LEFT JOIN (SELECT query_id, variant, count(*) AS n FROM sparse GROUP BY ALL) USING (query_id, variant) GROUP BY variant""")
def zero_result_queries(spark, sf_dir):
    """Labels stand for queries that nothing was searched for."""
    asked = T.queries(spark, sf_dir, vectors_too=False).select(*KEYS).unionByName(
        T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.lit("label").alias("variant")))
    found = _sparse(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(found, KEYS, "left").groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("n").isNull()).alias("n_without_results"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(S.clauses(*_RERANK, "c3_best AS (SELECT query_id, list(text ORDER BY rank) AS ts FROM reranked WHERE rank <= 3 GROUP BY query_id)",
                 "c3_all AS (SELECT DISTINCT query_id FROM queries UNION SELECT -1 - doc_id FROM labels)",
                 "c3_escaped AS (SELECT query_id, ts, [CAST(to_json(t) AS VARCHAR) for t in ts] AS es FROM c3_all LEFT JOIN c3_best USING (query_id))")
       + f"""SELECT query_id, coalesce(len(ts), 0) AS n_texts, CASE WHEN ts IS NULL THEN {_sql_text(X.NO_CONTEXT)} ELSE {_sql_text(X.CONTEXT_HEADER)}
  || array_to_string(['- ' || e[2:length(e) - 1] || chr(10) for e in es], '') || {_sql_text(X.CONTEXT_FOOTER)} END AS context FROM c3_escaped""")
def context_top3(spark, sf_dir):
    """Context strings, labels standing for queries that found nothing."""
    nothing = T.table(spark, sf_dir, "labels").select((-1 - F.col("doc_id")).alias("query_id"))
    asked = T.queries(spark, sf_dir, vectors_too=False).select(*QID).unionByName(nothing)
    c = retrieval.contexts(_stages(spark, sf_dir).reranked, QID, queries=asked)
    return c.select(*QID, F.size("top_texts").alias("n_texts"), "context")


@query(S.clauses(*_RERANK) + """SELECT query_id, string_agg('Document ' || rank || ': ' || CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END,
  chr(10) || chr(10) ORDER BY rank) AS documents FROM reranked WHERE rank <= 3 GROUP BY query_id""")
def judge_documents(spark, sf_dir):
    c = retrieval.contexts(_stages(spark, sf_dir).reranked, QID)
    return c.select(*QID, X.judge_documents(F.col("top_texts")).alias("documents"))


# -- metrics -----------------------------------------------------------------
# Retrieved: the fused list of the first variant. Judged: its dense list, scaled to 0..1.

_METRIC = (*S.RETRIEVE, _scaled("ds", "dense"),
           "retrieved AS (SELECT query_id, rank, doc_id FROM hits WHERE variant = 'rewritten')",
           "given AS (SELECT query_id, doc_id, score AS relevance_score, rank AS seq FROM ds WHERE variant = 'rewritten')",
           S.metrics("retrieved", "given"))


def _metrics(spark, sf_dir):
    q = T.queries(spark, sf_dir).where("variant = 'rewritten'")
    d = T.docs(spark, sf_dir)
    dense, sparse = retrieval.candidate_lists(q, d, T.vectors(spark, sf_dir), KEYS)
    dense = stage(dense, "dense")
    few = Q.QuerySize.of(q).hits_bounded(2 * 45)
    hits = stage(Q.fused_top(Q.with_text(Q.rrf_fuse(dense, sparse, KEYS), d, [], few), KEYS), "hits")
    judged = Q.scaled(dense, KEYS).select(*QID, "doc_id", F.col("scaled").alias("relevance_score"), F.col("rank").alias("seq"))
    return M.retrieval_metrics(hits.select(*QID, "rank", "doc_id"), judged, QID)


def _metric_query(name: str, columns: list[str]) -> None:
    sql = S.clauses(*_METRIC) + "SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + " FROM metrics"

    def run(spark, sf_dir):
        return _metrics(spark, sf_dir).select(*QID, *[T.r6(c).alias(c) for c in columns])

    query(sql, name)(run)


for _m in ("recall", "ndcg", "hit_rate"):
    _metric_query(f"{_m}_at_k", [f"{_m}_at_{k}" for k in M.K_VALUES])
_metric_query("mrr", ["mrr"])


_COUNTS = ("num_relevant_docs", "num_retrieved_docs")
_RATES = [n for n in M.metric_names() if n not in _COUNTS]


@query(S.clauses(*_METRIC) + ", everyone AS (SELECT item_id AS query_id FROM benchmark UNION SELECT doc_id FROM labels) SELECT query_id, "
       + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in _RATES) + ", "
       + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTS) + " FROM everyone LEFT JOIN metrics USING (query_id)")
def all_metrics(spark, sf_dir):
    """Metrics of every query and, as queries without any result, of every labelled id."""
    everyone = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).unionByName(
        T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))).distinct()
    m = everyone.join(_metrics(spark, sf_dir), QID, "left")
    return m.select(*QID, *[T.r6(F.coalesce(c, F.lit(0.0))).alias(c) for c in _RATES],
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _COUNTS])


@query(S.clauses(*S.RETRIEVE, S.COMBINED, S.bm25(),
                 "retrieved AS (SELECT query_id, position AS rank, md5(text) AS doc_id FROM combined)", S.metrics("retrieved", "judged"))
       + "SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES) + ", num_relevant_docs, num_retrieved_docs FROM metrics")
def rerank_metrics(spark, sf_dir):
    """The list before re-ranking against the relevance of the re-ranked one."""
    st = _stages(spark, sf_dir)
    m = M.retrieval_metrics(retrieval.metric_rows(st.combined, QID), st.judged, QID)
    return m.select(*QID, *[T.r6(c).alias(c) for c in _RATES], *_COUNTS)


# -- evaluation --------------------------------------------------------------

@query(f"SELECT doc_id, {S.judge_fields()} FROM (SELECT doc_id, {S.judge_columns('doc_id')} FROM labels)")
def judge_decode(spark, sf_dir):
    decoded = E.with_judges(T.judged_documents(spark, sf_dir))
    return decoded.select("doc_id", *S.JUDGE_FIELDS)


@query(S.clauses(S.MESSAGES.replace("FROM benchmark)", "FROM benchmark)"), S.EVALUATED)
       + "SELECT query_id, round(heuristic_score, 6) AS heuristic_score, round(overall_score, 6) AS overall_score FROM scored")
def overall_score(spark, sf_dir):
    e = evaluation.evaluate(T.messages(spark, sf_dir))
    return e.select("query_id", T.r6("heuristic_score").alias("heuristic_score"), T.r6("overall_score").alias("overall_score"))


_EVAL_COLUMNS = ["has_products", "has_specifics", "response_length", "faithfulness_reasoning",
                 "actionability_reasoning", "retrieval_reasoning"]
_EVAL_SCORES = ["heuristic_score", "overall_score", "faithfulness", "actionability_llm", "retrieval_relevance", *_RATES]
_EVALUATE = (*S.RETRIEVE, S.COMBINED, S.bm25(),
             "retrieved AS (SELECT query_id, position AS rank, md5(text) AS doc_id FROM combined)",
             S.metrics("retrieved", "judged"), S.MESSAGES, S.EVALUATED)


def _evaluated(spark, sf_dir):
    st = _stages(spark, sf_dir)
    return evaluation.evaluate(T.messages(spark, sf_dir), retrieval.metric_rows(st.combined, QID), st.judged, QID)


@query(S.clauses(*_EVALUATE) + "SELECT query_id, 'full_llm' AS evaluation_tier, " + ", ".join(_EVAL_COLUMNS) + ", "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _EVAL_SCORES) + " FROM scored LEFT JOIN metrics USING (query_id)")
def evaluate_messages(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(
        *QID, "evaluation_tier", *_EVAL_COLUMNS, *[T.r6(c).alias(c) for c in _EVAL_SCORES])


def _feedback_sql() -> str:
    rows = [("overall_score", "overall_score"), ("heuristic_score", "heuristic_score")]
    for key, column in (("faithfulness", "faithfulness"), ("actionability", "actionability_llm"),
                        ("retrieval_relevance", "retrieval_relevance")):
        rows += [(key, column), (f"{key}_reasoning", column)]
    rows += [(c, c) for c in _RATES]
    union = " UNION ALL ".join(f"SELECT run_id, '{k}' AS key, round({c}, 6) AS score FROM whole WHERE {c} IS NOT NULL" for k, c in rows)
    return S.clauses(*_EVALUATE, "whole AS (SELECT * FROM scored LEFT JOIN metrics USING (query_id) WHERE coalesce(run_id, '') <> '')") + union


@query(_feedback_sql())
def feedback_long(spark, sf_dir):
    return evaluation.feedback(_evaluated(spark, sf_dir)).select("run_id", "key", T.r6("score").alias("score"))


@query("""SELECT text AS query, md5(text) AS session_id, length(text) AS query_length, CASE WHEN item_id % 2 = 0 THEN 'given' ELSE NULL END AS topic,
  CASE WHEN item_id % 2 = 0 THEN 'mine' ELSE '2025-11-01' END AS stamp FROM benchmark""")
def query_log(spark, sf_dir):
    b = T.table(spark, sf_dir, "benchmark")
    even = F.pmod("item_id", F.lit(2)) == 0
    given = F.when(even, F.create_map(F.lit("topic"), F.lit("given"), F.lit("timestamp"), F.lit("mine")))
    rows = b.select(F.col("text").alias("query"), F.lit("").alias("response"), F.md5("text").alias("session_id"),
                    given.alias("metadata"))
    log = E.query_log(rows, F.lit("2025-11-01"))
    m = F.col("metadata")
    return log.select("query", m["session_id"].alias("session_id"), m["query_length"].cast("bigint").alias("query_length"),
                      m["topic"].alias("topic"), m["timestamp"].alias("stamp"))
