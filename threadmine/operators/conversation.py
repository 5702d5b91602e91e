"""Conversations, messages and sessions (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmine.functions import times
from threadmine.functions.decode import all_filled
from threadmine.operators.ranking import top_k
from threadmine.session import salted_join, stage

# Rows kept beside the first one in the chat history and for query rewriting.
CHAT_TAIL, REWRITE_TAIL = 7, 6
# Fixed value: the system message about a rewritten question; histories hold it word for word.
READING = 'The user\'s original question was: "%s"\nIt has been interpreted as: "%s"'


def trim_history(turns: DataFrame, keys: list[str], order: list[str], tail: int = CHAT_TAIL) -> DataFrame:
    """The first turn and the last ``tail`` turns of each conversation.

    Two top-k cuts instead of a full numbering: a conversation with very many
    turns sends at most ``tail + 1`` rows per partition through the shuffle.
    """
    last = top_k(turns, keys, [F.col(c).desc() for c in order], tail, "_n")
    first = top_k(turns, keys, [F.col(c).asc() for c in order], 1, "_n")
    return last.unionByName(first).drop("_n").dropDuplicates([*keys, *order])


def last_turns(turns: DataFrame, keys: list[str], order: list[str], n: int = 3) -> DataFrame:
    return top_k(turns, keys, [F.col(c).desc() for c in order], n, "_n").drop("_n")


def assemble_history(
    turns: DataFrame, requests: DataFrame, keys: list[str], order: list[str], persona: str, tail: int = CHAT_TAIL
) -> DataFrame:
    """Messages for the model, one row each: ``(*keys, section, *order, role, content)``.

    ``requests`` is ``(*keys, query, rewritten, context)``. A history that does not
    begin with a system turn holding ``persona`` is replaced by the persona alone.
    Then come the context, the reading of the query if it was rewritten, and the query.
    Sections are 0 to 3; within section 0 the rows are in ``order``.
    """
    first = top_k(turns, keys, [F.col(c) for c in order], 1, "_n")
    own = first.where((F.col("role") == "system") & F.contains(F.col("content"), F.lit(persona))).select(*keys)
    kept = trim_history(turns, keys, order, tail).join(own, keys, "left_semi").join(
        requests.select(*keys), keys, "left_semi"
    )
    none = {c: F.lit(None).cast(turns.schema[c].dataType) for c in order}

    def section(rows: DataFrame, number: int, role: str, content: Column) -> DataFrame:
        return rows.select(
            *keys, F.lit(number).alias("section"), *[none[c].alias(c) for c in order],
            F.lit(role).alias("role"), content.alias("content"),
        )

    rewritten = (F.coalesce("rewritten", F.lit("")) != "") & (F.col("rewritten") != F.col("query"))
    reading = F.format_string(READING, F.col("query"), F.col("rewritten"))
    return (
        kept.select(*keys, F.lit(0).alias("section"), *order, "role", "content")
        .unionByName(section(requests.join(own, keys, "left_anti"), 0, "system", F.lit(persona)))
        .unionByName(section(requests, 1, "system", F.col("context")))
        .unionByName(section(requests.where(rewritten), 2, "system", reading))
        .unionByName(section(requests, 3, "user", F.when(rewritten, F.col("rewritten")).otherwise(F.col("query"))))
    )


def route(messages: DataFrame) -> DataFrame:
    """Add ``route`` (ping, reject, accept) and ``status_code``."""
    ping = F.coalesce(F.col("type") == "ping", F.lit(False))
    empty = F.coalesce("content", F.lit("")) == ""
    return messages.withColumns({
        "route": F.when(ping, "ping").when(empty, "reject").otherwise("accept"),
        "status_code": F.when(~ping & empty, 400).otherwise(200),
    })


def without_keep_warm(connections: DataFrame, query_string: str = "query_string") -> DataFrame:
    """Drop synthetic traffic that asks for ``keep-warm=1``."""
    pairs = F.split(F.coalesce(query_string, F.lit("")), "&")
    return connections.where(~F.array_contains(pairs, "keep-warm=1"))


def complete_messages(messages: DataFrame) -> DataFrame:
    return messages.where(all_filled(*[F.col(c) for c in ("connection_id", "domain_name", "stage", "message")]))


def with_live_connection(messages: DataFrame, connections: DataFrame, now: Column) -> DataFrame:
    """Messages of known connections with the connection's columns; others drop out."""
    live = connections.where(F.col("ttl") > now)
    return salted_join(messages, live, ["connection_id"], ["request_id"])


def reassemble(events: DataFrame, block: int = 512) -> DataFrame:
    """Join the chunks of each message in order of ``seq``.

    ``events`` is ``(message_id, type, seq, content)``. Chunks are first joined in
    blocks of neighbouring ``seq``, which spreads the work for a long message;
    the second step then handles one text per block. ``complete`` tells whether
    start and end were seen.
    """
    chunk = F.col("type") == "message_chunk"
    parts = events.groupBy("message_id", F.floor(F.col("seq") / F.lit(block)).alias("_block")).agg(
        F.array_sort(F.collect_list(F.when(chunk, F.struct("seq", "content")))).alias("_chunks"),
        F.count_if(F.col("type") == "message_start").alias("_starts"),
        F.count_if(F.col("type") == "message_end").alias("_ends"),
    ).select(
        "message_id", "_block", "_starts", "_ends", F.size("_chunks").alias("_n"),
        F.array_join(F.transform("_chunks", lambda c: c["content"]), "").alias("_text"),
    )
    return parts.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_text"))).alias("_parts"),
        F.sum("_n").alias("n_chunks"),
        ((F.sum("_starts") > 0) & (F.sum("_ends") > 0)).alias("complete"),
    ).select(
        "message_id", "n_chunks", "complete",
        F.array_join(F.transform("_parts", lambda p: p["_text"]), "").alias("content"),
    )


def session_states(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Classify requests ``(session_id, epoch)``: new, valid or invalid.

    No id makes a new session, an id that ``sessions (session_id, created_at, expiry)`` holds
    and that has not expired is valid, any other is invalid. Adds ``status``.
    """
    joined = salted_join(
        requests, sessions.select("session_id", "created_at", "expiry"), ["session_id"], ["epoch"], "left"
    )
    blank = F.coalesce("session_id", F.lit("")) == ""
    alive = F.coalesce((F.col("created_at") <= F.col("epoch")) & (F.col("epoch") <= F.col("expiry")), F.lit(False))
    return joined.withColumn("status", F.when(blank, "new").when(alive, "valid").otherwise("invalid"))


def touch_sessions(states: DataFrame) -> DataFrame:
    """Sessions after the requests: ``last_active`` and the expiry moved on by valid requests."""
    return states.where(F.col("status") == "valid").groupBy("session_id").agg(
        F.min("created_at").alias("created_at"), F.max("epoch").alias("last_active"),
        F.count(F.lit(1)).alias("n_valid"),
        times.ttl(F.max("epoch"), times.SESSION_DAYS).alias("expiry_time"),
    )


def session_fold(requests: DataFrame, keep_days: int = times.SESSION_DAYS, block: int = 86_400_000) -> DataFrame:
    """Status of each request of a session with an expiry that every accepted request moves on.

    ``requests`` is ``(session_id, seq, kind, ms)``, kind ``create`` or ``touch``; the result has ``status`` (new, valid,
    invalid) and ``created_ms`` besides. A request is accepted if it creates the session or the session lives; a
    session lives until ``keep_days`` pass without an accepted request. Equal times are taken in the order of ``seq``.

    Requests with no longer pause between them are one run of the session, and in a run all requests after its
    first creation are accepted. Pauses are found within ``block`` milliseconds of a session and then between such
    blocks, so a session with a large part of all requests is spread over tasks. A null session_id is a session.
    """
    keep = keep_days * 86_400_000
    rows = requests.withColumn("_key", F.coalesce(F.col("session_id").cast("string"), F.lit("\0"))).withColumn(
        "_block", F.floor(F.col("ms") / block))
    order = Window.partitionBy("_key", "_block").orderBy("ms", "seq")
    rows = stage(rows.withColumn("_pause", F.coalesce(F.col("ms") - F.lag("ms").over(order) > keep, F.lit(False)).cast("int")).withColumn(
        "_within", F.sum("_pause").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "requests")
    ends = Window.partitionBy("_key").orderBy("_block")
    blocks = rows.groupBy("_key", "_block").agg(F.min("ms").alias("_from"), F.max("ms").alias("_to"), F.max("_within").alias("_n")).withColumn(
        "_fresh", F.coalesce(F.col("_from") - F.lag("_to").over(ends) > keep, F.lit(False)).cast("int"))
    before = F.coalesce(F.sum("_n").over(ends.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_key", "_block", (before + F.sum("_fresh").over(ends)).alias("_start"))
    runs = stage(salted_join(rows, starts, ["_key", "_block"], ["seq", "ms"]).withColumn("_run", F.col("_start") + F.col("_within")), "runs")
    first = runs.where("kind = 'create'").groupBy("_key", "_run").agg(F.min(F.struct("ms", "seq")).alias("_first"))
    lives = F.coalesce(F.struct("ms", "seq") >= F.col("_first"), F.lit(False))
    return salted_join(runs, first, ["_key", "_run"], ["seq", "ms"], "left").select(
        *requests.columns,
        F.when(F.col("kind") == "create", "new").when(lives, "valid").otherwise("invalid").alias("status"),
        F.when(lives, F.col("_first.ms")).alias("created_ms"))


def session_events(rows: DataFrame, event: str, epoch: Column, fields: Column) -> DataFrame:
    """Append-only log of session events: prefixed type, time and a map of free fields."""
    return rows.select(
        F.concat(F.lit("SESSION_API_"), F.upper(F.col(event))).alias("event_type"), epoch.alias("epoch"),
        fields.alias("fields"),
    )
