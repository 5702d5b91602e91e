"""Text functions and sparse weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmine.catalog import sqlparts as S
from threadmine.catalog import tables as T
from threadmine.catalog.registry import query
from threadmine.functions import ids
from threadmine.functions import text as X
from threadmine.functions import times
from threadmine.operators import weights as W


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {S.sparse_tokens('text')} AS t FROM documents)")
def tokenize_sparse(spark, sf_dir):
    t = T.docs(spark, sf_dir).select("doc_id", X.tokenize_sparse(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {S.word_tokens('text')} AS t FROM documents)")
def tokenize_bm25(spark, sf_dir):
    t = T.docs(spark, sf_dir).select("doc_id", X.tokenize_words(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{S.WS}+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return T.docs(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


_LENGTHS = (4000, 2000, 1000, 200)


@query("SELECT doc_id, " + ", ".join(f"md5(left(text, {n})) AS first_{n}" for n in _LENGTHS)
       + ", md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END) AS dotted_300 FROM documents")
def text_truncation(spark, sf_dir):
    text = F.col("text")
    return T.docs(spark, sf_dir).select(
        "doc_id", *[F.md5(X.clip(text, n)).alias(f"first_{n}") for n in _LENGTHS],
        F.md5(X.clip_with_dots(text)).alias("dotted_300"),
    )


@query(S.clauses(S.POSTS) + """SELECT id, md5('Title: ' || title || chr(10) || chr(10) || content) AS full_text_id,
  printf('[From %d-%02d] ', year, month) AS post_marker, printf('[Comment from %d-%02d] ', year, month) AS comment_marker,
  year * 100 + month AS timestamp, printf('%d-%02d', year, month) AS date FROM posts""")
def full_text(spark, sf_dir):
    y, m = F.col("year"), F.col("month")
    return T.posts(spark, sf_dir).select(
        "id", F.md5(X.full_text(F.col("title"), F.col("content"))).alias("full_text_id"),
        X.post_marker(y, m).alias("post_marker"), X.comment_marker(y, m).alias("comment_marker"),
        X.yyyymm(y, m).alias("timestamp"), X.year_month(y, m).alias("date"),
    )


@query("SELECT doc_id, md5(text) AS text_id FROM documents")
def text_ids(spark, sf_dir):
    return T.docs(spark, sf_dir).select("doc_id", ids.text_id(F.col("text")).alias("text_id"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) END,
  CASE WHEN doc_id % 4 = 1 THEN 'i' || doc_id END, CASE WHEN doc_id % 4 = 2 THEN 'm' || doc_id END, text, '') AS resolved FROM documents""")
def resolve_doc_id(spark, sf_dir):
    d, n = F.col("doc_id"), F.pmod("doc_id", F.lit(4))
    return T.docs(spark, sf_dir).select("doc_id", ids.resolve_doc_id(
        F.when(n == 0, d.cast("string")), F.when(n == 1, F.concat(F.lit("i"), d.cast("string"))),
        F.when(n == 2, F.concat(F.lit("m"), d.cast("string"))), F.col("text"),
    ).alias("resolved"))


@query(f"""SELECT conv_id, turn, has_products, has_specifics, response_length, round({S.HEURISTIC}, 6) AS heuristic_score FROM (
  SELECT conv_id, turn, {S.checks()} FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text || ' price $5' ELSE text END AS response FROM conversations))""")
def heuristic_scores(spark, sf_dir):
    r = T.responses(spark, sf_dir)
    return r.select("conv_id", "turn", *[
        (T.r6(c) if n == "heuristic_score" else c).alias(n) for n, c in X.response_checks(F.col("response")).items()
    ])


@query("SELECT conv_id, turn, CASE WHEN r IN ('system', 'assistant', 'user') THEN r ELSE 'user' END AS role FROM "
       "(SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 'tool' ELSE role END AS r FROM conversations)")
def role_mapping(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    role = F.when(F.pmod("conv_id", F.lit(9)) == 0, "tool").otherwise(F.col("role"))
    return c.select("conv_id", "turn", X.mapped_role(role).alias("role"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN user_id || '=x' ELSE CAST(user_id + 1 AS VARCHAR) END AS session_id FROM events""")
def cookie_session(spark, sf_dir):
    e = T.events(spark, sf_dir)
    n, user = F.pmod("event_id", F.lit(3)), F.col("user_id")
    cookies = (
        F.when(n == 0, F.concat(F.lit("theme=dark; my_session_id="), user.cast("string")))
        .when(n == 1, F.concat(F.lit("theme=dark; session_id="), user.cast("string"), F.lit("=x; flag")))
        .otherwise(F.concat(F.lit("session_id=old; lang=en; session_id="), (user + 1).cast("string")))
    )
    return e.select("event_id", X.cookie_value(cookies).alias("session_id"))


@query(f"""SELECT event_id, {S.EPOCH} + 86400 AS connection_ttl, {S.EPOCH} + 30 * 86400 AS session_ttl,
  {S.EPOCH} + 360 * 86400 AS seen_ttl, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month FROM events""")
def time_to_live(spark, sf_dir):
    epoch = times.epoch_seconds(F.col("ts"))
    year, month = times.utc_year_month(epoch)
    return T.events(spark, sf_dir).select(
        "event_id", times.ttl(epoch, times.CONNECTION_DAYS).alias("connection_ttl"),
        times.ttl(epoch, times.SESSION_DAYS).alias("session_ttl"), times.ttl(epoch, times.SEEN_DAYS).alias("seen_ttl"),
        year.alias("year"), month.alias("month"),
    )


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round({S.EPOCH} * 1.0, 6) WHEN event_id % 3 = 1 THEN round({S.EPOCH} * 1.0, 6) END AS seconds FROM events""")
def parse_timestamps(spark, sf_dir):
    n = F.pmod("event_id", F.lit(3))
    epoch = times.epoch_seconds(F.col("ts"))
    value = (
        F.when(n == 0, (epoch * 1000).cast("string"))
        .when(n == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .otherwise(F.lit("not a time"))
    )
    return T.events(spark, sf_dir).select("event_id", T.r6(times.parse_epoch_seconds(value)).alias("seconds"))


# -- weights -----------------------------------------------------------------

@query(S.clauses(S.POSTINGS) + "SELECT doc_id, doc_len, term, tf FROM post")
def term_frequency(spark, sf_dir):
    return W.postings(T.docs(spark, sf_dir)).select("doc_id", F.col("doc_len").cast("bigint").alias("doc_len"), "term", "tf")


@query(f"SELECT doc_id, len({S.sparse_tokens('text')}) AS doc_len, greatest(len({S.sparse_tokens('text')}), 1) AS doc_len_rebuild FROM documents")
def document_length(spark, sf_dir):
    n = F.size(X.tokenize_sparse(F.col("text"))).cast("bigint")
    return T.docs(spark, sf_dir).select("doc_id", n.alias("doc_len"), F.greatest(n, F.lit(1)).alias("doc_len_rebuild"))


@query(S.clauses(S.POSTINGS) + "SELECT term, df FROM terms")
def document_frequency(spark, sf_dir):
    return W.document_frequency(W.postings(T.docs(spark, sf_dir)))


@query(S.clauses(S.POSTINGS) + "SELECT term, df, round(idf, 6) AS idf FROM idfs")
def inverse_document_frequency(spark, sf_dir):
    d = T.docs(spark, sf_dir)
    f = W.with_idf(W.document_frequency(W.postings(d)), W.count_rows(d))
    return f.select("term", "df", T.r6("idf").alias("idf"))


@query(S.clauses(S.POSTINGS) + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_index FROM terms")
def vocabulary_index(spark, sf_dir):
    return W.vocabulary(W.postings(T.docs(spark, sf_dir)))


@query(S.clauses(S.POSTINGS) + "SELECT doc_id, term, round(tf * 1.0 / doc_len * idf, 6) AS weight FROM post JOIN idfs USING (term)")
def tfidf_weights(spark, sf_dir):
    d = T.docs(spark, sf_dir)
    return W.tfidf(W.postings(d), W.count_rows(d)).withColumn("weight", T.r6("weight"))


@query(S.clauses(S.QUERIES, S.POSTINGS, S.QUERY_TERMS) + "SELECT query_id, variant, term, round(weight, 6) AS weight FROM qweights")
def query_weights(spark, sf_dir):
    d, q = T.docs(spark, sf_dir), T.queries(spark, sf_dir, vectors_too=False)
    terms = W.query_terms(q, ["query_id", "variant"])
    w = W.query_weights(terms, W.document_frequency(W.postings(d)), W.count_rows(d))
    return w.select("query_id", "variant", "term", T.r6("weight").alias("weight"))
