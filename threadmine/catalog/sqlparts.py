"""The same views in SQL, for the checks."""

from __future__ import annotations

from threadmine.functions.text import STOP_WORDS

WS = r"[\s\x0b\x{85}\p{Z}]"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def word_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def sparse_tokens(c: str) -> str:
    return (f"list_filter({word_tokens(c)}, lambda t: regexp_full_match(t, '[a-z0-9]+') and length(t) > 1 "
            f"and not list_contains({STOP}, t))")


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def key(score: str) -> str:
    return f"floor(({score}) * 1e9 + 0.5)"


def clauses(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


DOC_DAY = "date '2025-09-01' + CAST(doc_id % 60 AS INTEGER)"


def _post(id_: str, forum: str, content: str, score: str, day: str, source: str) -> str:
    return (f"SELECT {id_} AS id, 'Post ' || {id_} AS title, {content} AS content, 'https://forum.example/' || {id_} AS url, "
            f"CAST({score} AS INTEGER) AS score, CAST(year({day}) AS INTEGER) AS year, CAST(month({day}) AS INTEGER) AS month, "
            f"CAST(year({day}) AS INTEGER) AS created_at_year, CAST(month({day}) AS INTEGER) AS created_at_month, "
            f"CAST(day({day}) AS INTEGER) AS created_at_day, lower({forum}) AS subreddit_name FROM {source}")


POSTS = "posts AS (" + _post("CAST(doc_id AS VARCHAR)", "source", "text", "n_chars", f"({DOC_DAY})", "documents") + ")"
NEW_POSTS = (
    "new_posts AS ("
    + _post("CAST(doc_id AS VARCHAR)", "source", "text", "n_chars + 100000",
            f"({DOC_DAY} + CAST(1 - quality AS INTEGER))", "documents JOIN labels USING (doc_id)")
    + " UNION ALL "
    + _post("('p' || CAST(page_id AS VARCHAR))", "'SRC1'", "html", "length(html)",
            "(date '2025-09-01' + CAST(page_id % 90 AS INTEGER))", "pages")
    + ")"
)
COMMENTS = """comments AS (SELECT CAST(conv_id AS VARCHAR) AS post_id, 'c-' || conv_id || '-' || turn AS id,
  CAST(length(text) AS INTEGER) AS score,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN '[removed]' WHEN (conv_id + turn) % 7 = 0 THEN left(text, 6) ELSE text END AS body,
  2025 AS year, CAST(conv_id % 12 + 1 AS INTEGER) AS month, turn AS seq FROM conversations)"""
SEEN = """seen AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, lower(source) AS subreddit, 1700000000 AS pulled_at,
  CASE WHEN toxic = 1 THEN 1700000001 ELSE 1800000000 END AS ttl FROM documents JOIN labels USING (doc_id))"""

QUERIES = f"""words AS (SELECT item_id AS query_id, {words('text')} AS w FROM benchmark),
queries AS (
  SELECT query_id, 'rewritten' AS variant, array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ') AS text,
         query_id AS vec_id FROM words
  UNION ALL
  SELECT query_id, 'hyde', array_to_string(list_filter(w, lambda x, i: i % 2 = 0), ' '),
         (SELECT max(vec_id) FROM embeddings) - query_id FROM words)"""

POSTINGS = f"""toks AS (SELECT doc_id, {sparse_tokens('text')} AS t FROM documents),
post AS (SELECT doc_id, doc_len, term, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM toks) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idfs AS (SELECT term, df, ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1.0 AS idf FROM terms)"""

QUERY_TERMS = f"""qtoks AS (SELECT query_id, variant, {sparse_tokens('text')} AS t FROM queries),
qterms AS (SELECT query_id, variant, query_len, term, count(*) AS qtf
  FROM (SELECT query_id, variant, len(t) AS query_len, unnest(t) AS term FROM qtoks) GROUP BY ALL),
qweights AS (SELECT query_id, variant, qterms.term, qtf * 1.0 / query_len * idf AS weight, idf FROM qterms JOIN idfs ON qterms.term = idfs.term)"""

SPARSE = f"""sparse_all AS (SELECT query_id, variant, doc_id, sum(weight * (tf * 1.0 / doc_len) * idf) AS score
  FROM qweights JOIN post USING (term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY {key('score')} DESC, doc_id) AS rank
  FROM sparse_all) WHERE rank <= 45)"""

DENSE = f"""dense_all AS (SELECT query_id, variant, e.vec_id AS doc_id,
    list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM queries JOIN embeddings q ON q.vec_id = queries.vec_id, embeddings e),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY {key('score')} DESC, doc_id) AS rank
  FROM dense_all WHERE score >= 0) WHERE rank <= 45)"""

FUSED = """fused AS (SELECT query_id, variant, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank,
    coalesce(1.0e0 / (60.0e0 + d.rank), 0) AS rrf_dense, coalesce(1.0e0 / (60.0e0 + s.rank), 0) AS rrf_sparse,
    0.5e0 * coalesce(1.0e0 / (60.0e0 + d.rank), 0) + 0.5e0 * coalesce(1.0e0 / (60.0e0 + s.rank), 0) AS score
  FROM dense d FULL OUTER JOIN sparse s USING (query_id, variant, doc_id))"""

HITS = f"""hits AS (SELECT query_id, variant, doc_id, score, rrf_dense, rrf_sparse, text, rank FROM (
  SELECT f.*, text, row_number() OVER (PARTITION BY query_id, variant
    ORDER BY {key('score')} DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, f.doc_id) AS rank
  FROM fused f JOIN documents USING (doc_id) WHERE coalesce(text, '') <> '') WHERE rank <= 15)"""

RETRIEVE = (QUERIES, POSTINGS, QUERY_TERMS, SPARSE, DENSE, FUSED, HITS)

COMBINED = f"""seqd AS (SELECT *, CASE WHEN variant = 'rewritten' THEN 0 ELSE 1000000 END + rank AS seq, {strip('text')} AS stripped FROM hits),
firsts AS (SELECT *, min(seq) OVER (PARTITION BY query_id, stripped) AS first_seq,
    row_number() OVER (PARTITION BY query_id, stripped ORDER BY {key('score')} DESC, seq) AS n FROM seqd),
combined AS (SELECT query_id, variant, doc_id, score, text,
    row_number() OVER (PARTITION BY query_id ORDER BY {key('score')} DESC, first_seq) AS position FROM firsts WHERE n = 1)"""


def bm25(text: str = "text") -> str:
    """BM25 of each candidate in ``combined``, and the scaled relevance."""
    return f"""ctoks AS (SELECT query_id, position, {word_tokens(text)} AS t FROM combined),
clen AS (SELECT query_id, position, len(t) AS dl FROM ctoks),
cterm AS (SELECT query_id, position, dl, term, count(*) AS tf
  FROM (SELECT query_id, position, len(t) AS dl, unnest(t) AS term FROM ctoks) GROUP BY ALL),
corpus AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM clen GROUP BY query_id),
cidf AS (SELECT query_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf
  FROM cterm JOIN corpus USING (query_id) GROUP BY query_id, term, n),
cmean AS (SELECT query_id, avg(idf) AS mean FROM cidf GROUP BY query_id),
asked AS (SELECT query_id, term, count(*) AS q FROM (SELECT query_id, unnest({word_tokens('text')}) AS term
  FROM queries WHERE variant = 'rewritten') GROUP BY ALL),
cscore AS (SELECT query_id, position, sum(q * (CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END)
    * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM cterm JOIN asked USING (query_id, term) JOIN cidf USING (query_id, term) JOIN cmean USING (query_id)
       JOIN corpus USING (query_id) GROUP BY ALL),
bm AS (SELECT c.query_id, c.position, coalesce(bm25, 0) AS bm25 FROM clen c LEFT JOIN cscore USING (query_id, position)),
scaled AS (SELECT *, (bm25 - min(bm25) OVER w) / (CASE WHEN max(bm25) OVER w > min(bm25) OVER w
    THEN max(bm25) OVER w - min(bm25) OVER w ELSE 1 END) AS relevance, count(*) OVER w AS n FROM bm WINDOW w AS (PARTITION BY query_id)),
reranked AS (SELECT query_id, position, doc_id, score, text, bm25, relevance, rank FROM (
  SELECT c.*, CASE WHEN n > 15 THEN bm25 END AS bm25, CASE WHEN n > 15 THEN relevance END AS relevance,
    row_number() OVER (PARTITION BY query_id ORDER BY {key('CASE WHEN n > 15 THEN relevance ELSE 0 END')} DESC, position) AS rank
  FROM combined c JOIN scaled USING (query_id, position)) WHERE rank <= 15),
judged AS (SELECT query_id, md5(text) AS doc_id, relevance AS relevance_score, rank AS seq FROM reranked WHERE relevance IS NOT NULL)"""


def metrics(retrieved: str, judged: str, ks=(5, 10, 15), threshold: float = 0.5) -> str:
    """Metrics per query from ``retrieved(query_id, rank, doc_id)`` and ``judged(query_id, doc_id, relevance_score, seq)``."""
    per_k = ", ".join(
        f"CASE WHEN n_rel > 0 THEN sum(CASE WHEN rank <= {k} AND rel >= {threshold} THEN 1 ELSE 0 END) * 1.0 / n_rel ELSE 0 END AS recall_at_{k}, "
        f"coalesce(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= {k} THEN rel / log2(ideal + 1) ELSE 0 END), 0), 0) AS ndcg_at_{k}, "
        f"max(CASE WHEN rank <= {k} AND rel >= {threshold} THEN 1.0 ELSE 0.0 END) AS hit_rate_at_{k}"
        for k in ks
    )
    return f"""jlast AS (SELECT query_id, doc_id, relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY seq DESC) AS n
  FROM {judged}) WHERE n = 1),
jcount AS (SELECT query_id, count(*) FILTER (relevance_score >= {threshold}) AS n_rel FROM jlast GROUP BY query_id),
rels AS (SELECT r.query_id, r.rank, coalesce(relevance_score, 0) AS rel,
    row_number() OVER (PARTITION BY r.query_id ORDER BY coalesce(relevance_score, 0) DESC, r.rank) AS ideal
  FROM {retrieved} r LEFT JOIN jlast USING (query_id, doc_id)),
metrics AS (SELECT query_id, {per_k},
    coalesce(1.0 / min(CASE WHEN rel >= {threshold} THEN rank END), 0) AS mrr,
    n_rel AS num_relevant_docs, count(*) AS num_retrieved_docs
  FROM rels JOIN jcount USING (query_id) GROUP BY query_id, n_rel)"""


TURNS = "turns AS (SELECT CAST(floor(conv_id / 4) AS BIGINT) AS history_id, conv_id, turn, role, text AS content FROM conversations)"

RESPONSE_EVENTS = """response_events AS (
  SELECT CAST(conv_id AS VARCHAR) AS message_id, 'message_chunk' AS type, turn + 1 AS seq, text AS content FROM conversations
  UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'message_start', 0, '' FROM conversations
  UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'message_end', 1000000, '' FROM conversations WHERE conv_id % 5 <> 0)"""

EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"
SESSIONS = f"""requests AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS session_id,
    {EPOCH} AS epoch FROM events WHERE event_type <> 'signup'),
sessions AS (SELECT CAST(user_id AS VARCHAR) AS session_id, min({EPOCH}) AS created_at, min({EPOCH}) + 864000 AS expiry
  FROM events WHERE event_type = 'signup' GROUP BY user_id),
states AS (SELECT r.*, created_at, expiry, CASE WHEN coalesce(r.session_id, '') = '' THEN 'new'
    WHEN created_at <= epoch AND epoch <= expiry THEN 'valid' ELSE 'invalid' END AS status
  FROM requests r LEFT JOIN sessions s ON r.session_id = s.session_id)"""

LOGS = """raw AS (SELECT *, md5(CAST(CAST(floor(event_id / 5) AS BIGINT) AS VARCHAR)) AS rid,
    CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '.5' AS ms FROM events),
logs AS (SELECT event_id, ts, ['api', 'indexer', 'scraper', 'layer_cleanup'][user_id % 4 + 1] AS log_group,
  CASE WHEN event_id % 9 = 0 THEN 'COLD_START_METRICS RequestId: ' || rid || ' {"cold_start_metrics": "{\\"is_cold_start\\": true, \\"init_duration_ms\\": ' || ms || '}"}'
    WHEN event_type = 'view' THEN 'START RequestId: ' || rid || ' Version: 1'
    WHEN event_type = 'click' THEN 'REPORT RequestId: ' || rid || chr(9) || 'Duration: ' || ms || ' ms' || chr(9) || 'Init Duration: ' || ms || ' ms'
    WHEN event_type = 'purchase' THEN '🚀 Cold start detected for api | Init: ' || ms || 'ms | RequestId: ' || rid
    WHEN event_type = 'signup' THEN '⚡ Warm start for api | RequestId: ' || rid
    ELSE 'ERROR RequestId: ' || rid || ' Task timed out after ' || ms || ' seconds' END AS message FROM raw)"""

STARTS = r"""parsed AS (SELECT *, nullif(regexp_extract(message, 'RequestId:\s*([a-f0-9-]+)', 1), '') AS request_id,
    nullif(replace(regexp_extract(message, '"cold_start_metrics": "((?:[^"\\]|\\.)*)"', 1), '\', ''), '') AS data FROM logs),
starts AS (SELECT event_id, ts, log_group, request_id,
    CASE WHEN data IS NOT NULL THEN coalesce(CAST(json_extract_string(data, '$.is_cold_start') AS BOOLEAN), false)
      WHEN contains(message, '🚀 Cold start detected') THEN true WHEN contains(message, '⚡ Warm start') THEN false END AS is_cold_start,
    CASE WHEN data IS NOT NULL THEN CAST(json_extract_string(data, '$.init_duration_ms') AS DOUBLE)
      ELSE TRY_CAST(regexp_extract(message, 'Init:\s*([0-9.]+)ms', 1) AS DOUBLE) END AS init_duration_ms
  FROM parsed WHERE data IS NOT NULL OR contains(message, '🚀 Cold start detected') OR contains(message, '⚡ Warm start')),
reports AS (SELECT *, TRY_CAST(regexp_extract(message, 'Init Duration:\s*([0-9.]+)\s*ms', 1) AS DOUBLE) AS init_duration,
    TRY_CAST(regexp_extract(message, 'Duration:\s*([0-9.]+)\s*ms', 1) AS DOUBLE) AS duration_ms
  FROM parsed WHERE contains(message, 'REPORT') AND request_id IS NOT NULL),
report_one AS (SELECT request_id, init_duration FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS n FROM reports) WHERE n = 1),
invocations AS (SELECT s.*, r.init_duration AS lambda_init_duration_ms FROM starts s LEFT JOIN report_one r ON s.request_id = r.request_id)"""

LISTING = r"""listing AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS prefix, CAST(page_id AS VARCHAR) AS key,
    date '2025-11-01' - CAST((page_id * 7) % 120 AS INTEGER) AS modified FROM pages)"""


def _judge(id_: str, score: str, places: int, more: str) -> str:
    return (f"CASE WHEN ({id_} + {places}) % 17 = 0 THEN NULL WHEN ({id_} + {places}) % 11 = 0 THEN '{{bad' "
            f"WHEN ({id_} + {places}) % 13 = 0 THEN '{{\"reasoning\": \"no score\"}}' "
            f"ELSE '{{\"{score}\": 0.' || (({id_} * {places}) % 10) || ', {more}\"reasoning\": \"r' || ({id_} % 4) || '\"}}' END")


def judge_columns(id_: str) -> str:
    return (_judge(id_, "faithfulness", 1, '"grounded": true, ') + " AS faithfulness_json, "
            + _judge(id_, "actionability", 3, '"specific_products_count": 2, ') + " AS actionability_json, "
            + _judge(id_, "avg_relevance", 7, "") + " AS retrieval_json")


def decoded(column: str, key_: str, kind: str, default: str) -> str:
    """A field of a judge's answer with its default."""
    if key_ == "reasoning":
        return (f"CASE WHEN {column} IS NULL THEN NULL WHEN NOT json_valid({column}) THEN 'Parse failed' "
                f"ELSE coalesce(json_extract_string({column}, '$.reasoning'), '') END")
    return (f"CASE WHEN {column} IS NULL THEN NULL WHEN NOT json_valid({column}) THEN {default} "
            f"ELSE coalesce(CAST(json_extract_string({column}, '$.{key_}') AS {kind}), {default}) END")


JUDGE_FIELDS = {
    "faithfulness": ("faithfulness_json", "faithfulness", "DOUBLE", "0.5"),
    "grounded": ("faithfulness_json", "grounded", "BOOLEAN", "false"),
    "faithfulness_reasoning": ("faithfulness_json", "reasoning", "VARCHAR", "''"),
    "actionability_llm": ("actionability_json", "actionability", "DOUBLE", "0.5"),
    "specific_products_count": ("actionability_json", "specific_products_count", "INTEGER", "0"),
    "actionability_reasoning": ("actionability_json", "reasoning", "VARCHAR", "''"),
    "retrieval_relevance": ("retrieval_json", "avg_relevance", "DOUBLE", "0.5"),
    "retrieval_reasoning": ("retrieval_json", "reasoning", "VARCHAR", "''"),
}


def judge_fields() -> str:
    return ", ".join(f"{decoded(*spec)} AS {name}" for name, spec in JUDGE_FIELDS.items())


def checks(response: str = "response") -> str:
    marks = " OR ".join(f"contains(lower({response}), '{m}')" for m in ("product", "brand", "$", "price", "buy", "purchase"))
    caps = f"len(list_filter({words(response)}, lambda w: length(w) > 3 AND regexp_matches(w, '^\\p{{Lu}}')))"
    return f"({marks}) AS has_products, {caps} >= 2 AS has_specifics, CAST(len({words(response)}) AS INTEGER) AS response_length"


HEURISTIC = ("least(1.0, 0.5 + CASE WHEN has_products THEN 0.15 ELSE 0 END + CASE WHEN has_specifics THEN 0.15 ELSE 0 END "
             "+ CASE WHEN response_length > 50 THEN 0.1 ELSE 0 END + CASE WHEN response_length > 100 THEN 0.1 ELSE 0 END)")

OVERALL = ("CASE WHEN faithfulness IS NULL AND actionability_llm IS NULL AND retrieval_relevance IS NULL THEN heuristic_score "
           "ELSE coalesce(faithfulness * 0.4, 0) + coalesce(actionability_llm * 0.35, 0) + coalesce(retrieval_relevance * 0.25, 0) END")

MESSAGES = ("messages AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN text || ' price $5' ELSE text END AS response, "
            "CASE WHEN item_id % 6 = 5 THEN '' ELSE 'run-' || item_id END AS run_id, " + judge_columns("item_id") + " FROM benchmark)")
EVALUATED = (f"checked AS (SELECT *, {checks()}, {judge_fields()} FROM messages),\n"
             f"heur AS (SELECT *, {HEURISTIC} AS heuristic_score FROM checked),\n"
             f"scored AS (SELECT *, {OVERALL} AS overall_score FROM heur)")
