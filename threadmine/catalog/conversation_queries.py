"""Conversations, messages and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmine import schemas
from threadmine.catalog import sqlparts as S
from threadmine.catalog import tables as T
from threadmine.catalog.registry import query
from threadmine.functions import decode, times
from threadmine.operators import conversation as V
from threadmine.operators import search as Q
from threadmine.operators.tables import known_columns
from threadmine.streaming import queues as U

HID = ["history_id"]
ORDER = ["conv_id", "turn"]
PERSONA = "e"  # found in most system turns, so both branches of the rule are met


def _trim_sql(tail: int) -> str:
    return (S.clauses(S.TURNS) + "SELECT history_id, conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY conv_id, turn) AS a, "
            f"row_number() OVER (PARTITION BY history_id ORDER BY conv_id DESC, turn DESC) AS z FROM turns) WHERE a = 1 OR z <= {tail}")


@query(_trim_sql(7))
def history_trim(spark, sf_dir):
    return V.trim_history(T.turns(spark, sf_dir), HID, ORDER).select(*HID, *ORDER, "role")


@query(_trim_sql(6))
def rewrite_history_trim(spark, sf_dir):
    return V.trim_history(T.turns(spark, sf_dir), HID, ORDER, V.REWRITE_TAIL).select(*HID, *ORDER, "role")


@query(S.clauses(S.TURNS) + "SELECT history_id, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY conv_id DESC, turn DESC) AS z FROM turns) WHERE z <= 3")
def recent_turns(spark, sf_dir):
    return V.last_turns(T.turns(spark, sf_dir), HID, ORDER).select(*HID, *ORDER)


@query(S.clauses(
    S.TURNS,
    "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY conv_id, turn) AS a, row_number() OVER (PARTITION BY history_id ORDER BY conv_id DESC, turn DESC) AS z FROM turns))",
    f"own AS (SELECT history_id FROM firsts WHERE a = 1 AND role = 'system' AND contains(content, '{PERSONA}'))",
    "requests AS (SELECT CAST(doc_id AS BIGINT) AS history_id, left(text, 0) || 'q' || doc_id AS query, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE 'q' || doc_id END AS rewritten, md5(text) AS context FROM documents SEMI JOIN turns ON history_id = doc_id)",
) + f"""SELECT history_id, 0 AS section, conv_id, turn, role, content FROM firsts WHERE (a = 1 OR z <= 7) AND history_id IN (SELECT history_id FROM own) AND history_id IN (SELECT history_id FROM requests)
UNION ALL SELECT history_id, 0, NULL, NULL, 'system', '{PERSONA}' FROM requests WHERE history_id NOT IN (SELECT history_id FROM own)
UNION ALL SELECT history_id, 1, NULL, NULL, 'system', context FROM requests
UNION ALL SELECT history_id, 2, NULL, NULL, 'system', 'The user''s original question was: "' || query || '"' || chr(10) || 'It has been interpreted as: "' || rewritten || '"' FROM requests WHERE rewritten <> query
UNION ALL SELECT history_id, 3, NULL, NULL, 'user', rewritten FROM requests""")
def history_assembly(spark, sf_dir):
    turns = T.turns(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    requests = T.docs(spark, sf_dir).select(
        F.col("doc_id").alias("history_id"), F.concat(F.lit("q"), i).alias("query"),
        F.concat(F.when(F.pmod("doc_id", F.lit(2)) == 0, "r").otherwise("q"), i).alias("rewritten"),
        F.md5("text").alias("context"),
    ).join(turns.select("history_id"), HID, "left_semi")
    return V.assemble_history(turns, requests, HID, ORDER, PERSONA)


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'ping' WHEN (conv_id + turn) % 6 = 0 THEN 'reject' ELSE 'accept' END AS route,
  CASE WHEN turn % 4 <> 3 AND (conv_id + turn) % 6 = 0 THEN 400 ELSE 200 END AS status_code FROM conversations""")
def message_route(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(12))
    rows = c.select("conv_id", "turn", F.when(F.pmod("turn", F.lit(4)) == 3, "ping").alias("type"),
                    F.when(n == 0, "").when(n == 6, F.lit(None)).otherwise(F.col("text")).alias("content"))
    return V.route(rows).select("conv_id", "turn", "route", "status_code")


@query("SELECT event_id FROM events WHERE event_id % 4 <> 0")
def keep_warm_filter(spark, sf_dir):
    n = F.pmod("event_id", F.lit(4))
    q = F.when(n == 0, "stage=x&keep-warm=1").when(n == 1, "keep-warm=10").when(n == 2, "keep-warm=0")
    return V.without_keep_warm(T.events(spark, sf_dir).select("event_id", q.alias("query_string"))).select("event_id")


def _payloads(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.when(F.pmod("conv_id", F.lit(7)) == 0, F.lit(None)).otherwise(F.col("conv_id").cast("string")).alias("connection_id"),
        F.lit("chat.example").alias("domain_name"), F.when(F.pmod("turn", F.lit(5)) == 4, "").otherwise("live").alias("stage"),
        F.col("text").alias("message"), F.lit("2025-10-01").alias("timestamp"),
    )


@query("SELECT conv_id || '-' || turn AS request_id FROM conversations WHERE conv_id % 7 <> 0 AND turn % 5 <> 4 AND text <> ''")
def required_fields(spark, sf_dir):
    return V.complete_messages(_payloads(spark, sf_dir)).select("request_id")


@query("""SELECT conv_id || '-' || turn AS request_id, CASE WHEN conv_id % 7 = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS connection_id,
  CASE WHEN turn % 5 = 4 THEN '' ELSE 'live' END AS stage, md5(text) AS message_id FROM conversations""")
def decode_messages(spark, sf_dir):
    """Payloads written as JSON without their null fields, and read back with defaults."""
    body = F.to_json(F.struct(*[F.col(c) for c in ("connection_id", "domain_name", "stage", "message", "request_id", "timestamp")]))
    m = _payloads(spark, sf_dir).select(decode.chat_message(body).alias("m"))
    return m.select("m.request_id", "m.connection_id", "m.stage", F.md5("m.message").alias("message_id"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 's' || user_id END AS session_id, CASE WHEN event_id % 2 = 0 THEN '2025-11-01' ELSE 'then' END AS timestamp,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS n_metadata FROM events""")
def decode_evaluations(spark, sf_dir):
    e = T.events(spark, sf_dir)
    n = F.col("event_id")
    body = F.to_json(F.struct(
        F.lit("q").alias("query"),
        F.when(F.pmod(n, F.lit(3)) != 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session_id"),
        F.when(F.pmod(n, F.lit(2)) == 0, "").otherwise("then").alias("timestamp"),
        F.when(F.pmod(n, F.lit(5)) != 0, F.create_map(F.lit("run_id"), F.lit("r"))).alias("metadata"),
    ))
    m = e.select("event_id", decode.evaluation_message(body, F.lit("2025-11-01")).alias("m"))
    return m.select("event_id", "m.session_id", "m.timestamp", F.size("m.metadata").alias("n_metadata"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'user' WHEN event_id % 4 = 1 THEN 'type,user' ELSE 'type,user' END AS kept FROM events")
def drop_null_fields(spark, sf_dir):
    e = T.events(spark, sf_dir)
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"),
                     F.lit("type"), F.when(F.pmod("event_id", F.lit(4)) != 0, F.col("event_type")),
                     F.lit("none"), F.lit(None).cast("string"))
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(decode.drop_null_values(m))), ",").alias("kept"))


@query("SELECT event_id, event_type FROM events")
def known_fields(spark, sf_dir):
    return known_columns(T.events(spark, sf_dir), ["event_id", "event_type", "not_there"])


@query("SELECT doc_id, md5(text) AS text_id, lang, n_chars * 1.0 AS score FROM documents")
def reshape_results(spark, sf_dir):
    """Flat result → re-ranker record with payload → flat result."""
    flat = T.table(spark, sf_dir, "documents").select("doc_id", "text", F.struct("lang").alias("metadata"), F.col("n_chars").cast("double").alias("score"))
    back = Q.from_records(Q.to_records(flat, ["doc_id"]), ["doc_id"])
    return back.select("doc_id", F.md5("text").alias("text_id"), "metadata.lang", "score")


@query("SELECT doc_id AS post_id, lower(source) AS subreddit_name, 'post' AS type FROM documents")
def nested_fields(spark, sf_dir):
    """Three fields of nested metadata; the others are not read."""
    d = T.table(spark, sf_dir, "documents").select("text", F.struct(
        F.col("doc_id").alias("post_id"), F.lower("source").alias("subreddit_name"), F.lit("post").alias("type"), "lang",
        "n_chars").alias("metadata"))
    return d.select("metadata.post_id", "metadata.subreddit_name", "metadata.type")


@query("SELECT count(*) FILTER (conv_id % 4 <> 0) AS processed, count(*) FILTER (conv_id % 4 = 0) AS failed FROM conversations")
def consumer_counts(spark, sf_dir):
    """Queue bodies of which every fourth conversation's are cut off."""
    body = F.to_json(F.struct(F.col("message"), F.col("request_id")))
    cut = F.when(F.pmod(F.split("request_id", "-")[0].cast("bigint"), F.lit(4)) == 0, F.expr("substring(b, 1, length(b) - 1)")).otherwise(F.col("b"))
    bodies = _payloads(spark, sf_dir).select("request_id", body.alias("b")).select(cut.alias("body"))
    return U.consumer_counts(U.decode(bodies, schemas.CHAT_MESSAGE))


@query(S.clauses(S.RESPONSE_EVENTS) + """SELECT message_id, count(*) FILTER (type = 'message_chunk') AS n_chunks, count(*) FILTER (type = 'message_end') > 0 AS complete,
  md5(string_agg(content, '' ORDER BY seq)) AS content_id FROM response_events GROUP BY message_id""")
def message_reassembly(spark, sf_dir):
    m = V.reassemble(T.response_events(spark, sf_dir))
    return m.select("message_id", F.col("n_chunks").cast("bigint").alias("n_chunks"), "complete", F.md5("content").alias("content_id"))


@query(S.clauses(S.SESSIONS) + "SELECT event_id, status FROM states")
def session_states(spark, sf_dir):
    return V.session_states(T.session_requests(spark, sf_dir), T.sessions(spark, sf_dir)).select("event_id", "status")


@query(S.clauses(S.SESSIONS) + """SELECT session_id, min(created_at) AS created_at, max(epoch) AS last_active, count(*) AS n_valid, max(epoch) + 30 * 86400 AS expiry_time
  FROM states WHERE status = 'valid' GROUP BY session_id""")
def session_upsert(spark, sf_dir):
    return V.touch_sessions(V.session_states(T.session_requests(spark, sf_dir), T.sessions(spark, sf_dir)))


@query(S.clauses(S.SESSIONS) + "SELECT event_id, r.session_id AS connection_id, created_at FROM requests r JOIN sessions s ON r.session_id = s.session_id WHERE expiry > 1704900000")
def live_connection_join(spark, sf_dir):
    requests = T.session_requests(spark, sf_dir).select(F.col("session_id").alias("connection_id"), F.col("event_id").alias("request_id"))
    connections = T.sessions(spark, sf_dir).select(F.col("session_id").alias("connection_id"), "created_at", F.col("expiry").alias("ttl"))
    live = V.with_live_connection(requests, connections, F.lit(1_704_900_000))
    return live.select(F.col("request_id").alias("event_id"), "connection_id", "created_at")


@query(f"SELECT 'SESSION_API_' || upper(event_type) AS event_type, {S.EPOCH} AS epoch, CAST(user_id AS VARCHAR) AS session_id FROM events")
def session_event_log(spark, sf_dir):
    e = T.events(spark, sf_dir)
    fields = F.create_map(F.lit("session_id"), F.col("user_id").cast("string"))
    rows = V.session_events(e, "event_type", times.epoch_seconds(F.col("ts")), fields)
    return rows.select("event_type", "epoch", F.col("fields")["session_id"].alias("session_id"))


@query("""SELECT conv_id, count(*) AS history_length, max(length(text)) AS longest_query FROM conversations GROUP BY conv_id""")
def history_lengths(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("history_length"), F.max(F.length("text")).cast("bigint").alias("longest_query"))
