"""Splitting posts and comments into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.functions import text as X
from threadmine.schemas import CHUNK_COLUMNS

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200


def token_sizes(
    chunk_size: int = CHUNK_SIZE, chunk_overlap: int = CHUNK_OVERLAP,
    size_tokens: int | None = None, overlap_tokens: int | None = None,
) -> tuple[int, int]:
    """Chunk size and overlap in tokens: a quarter of the characters, the overlap in proportion.

    The overlap is always smaller than the chunk.
    """
    tokens = max(1, size_tokens or round(chunk_size / 4))
    if overlap_tokens is None:
        share = min(1.0, max(0.0, chunk_overlap / chunk_size)) if chunk_size > 0 else 0.0
        overlap_tokens = round(tokens * share)
    return tokens, min(max(overlap_tokens, 0), tokens - 1)


def window_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before.

    The last window is the first that reaches the end of the text. Empty text: no chunks.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - F.lit(overlap)) / F.lit(step)).cast("int") - 1)
    starts = F.sequence(F.lit(0), last)
    pieces = F.transform(starts, lambda i: F.substr(text, i * step + 1, F.lit(size)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, pieces).otherwise(F.array().cast("array<string>"))


Splitter = Callable[[str], list[str]]


def _split(df: DataFrame, source: str, size: int, overlap: int, splitter: Splitter | None) -> DataFrame:
    """Replace ``source`` by ``chunk_id`` and ``chunk``, one row per chunk."""
    others = [c for c in df.columns if c != source]
    native = window_chunks(F.col(source), size, overlap)
    if splitter is None:
        return df.select(*others, F.posexplode_outer(native).alias("chunk_id", "chunk")).where(
            F.col("chunk").isNotNull()
        )
    with_default = df.select(*others, F.col(source).alias("_text"), native.alias("_default"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_default.schema if f.name in others)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces(text: str | None, default: list[str]) -> list[str]:
            if not text:
                return []
            try:
                return list(splitter(text)) or list(default)
            except Exception:  # a text the splitter cannot handle is split by the default rule
                return list(default)

        for batch in batches:
            chunks = [pieces(t, d) for t, d in zip(batch["_text"], batch["_default"])]
            out = batch[others].assign(chunk=chunks, chunk_id=[list(range(len(c))) for c in chunks])
            out = out[[len(c) > 0 for c in chunks]].explode(["chunk_id", "chunk"], ignore_index=True)
            out["chunk_id"] = out["chunk_id"].astype("int32")
            yield out[[*others, "chunk_id", "chunk"]]

    return with_default.mapInPandas(run, f"{schema}, chunk_id int, chunk string")


def _chunk_rows(rows: DataFrame, kind: str, marker: Column | None) -> DataFrame:
    content = F.col("chunk") if marker is None else F.concat(marker, F.col("chunk"))
    return rows.select(
        content.alias("page_content"), "post_id", "comment_id", "year", "month", F.lit(kind).alias("type"),
        "subreddit_name", F.col("chunk_id").cast("int").alias("chunk_id"),
        X.yyyymm(F.col("year"), F.col("month")).alias("timestamp"),
        X.year_month(F.col("year"), F.col("month")).alias("date"),
    ).select(*CHUNK_COLUMNS)


def comment_rows(posts: DataFrame) -> DataFrame:
    """Nested comments of posts as rows."""
    return posts.select(
        F.col("id").alias("post_id"), "subreddit_name", F.inline("comments")
    ).withColumnRenamed("id", "comment_id")


def chunk_posts(
    posts: DataFrame, comments: DataFrame | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    splitter: Splitter | None = None,
) -> DataFrame:
    """Chunks of post texts, marked with their month, and of comments, not marked.

    ``comments`` is ``(post_id, subreddit_name, comment_id, body, year, month)``; if it is
    left out the nested ``comments`` column of the posts is used.
    """
    year, month = F.col("year"), F.col("month")
    bodies = posts.select(
        F.col("id").alias("post_id"), F.lit(None).cast("string").alias("comment_id"), "subreddit_name",
        "year", "month", X.full_text(F.col("title"), F.col("content")).alias("_body"),
    )
    own = _chunk_rows(_split(bodies, "_body", size, overlap, splitter), "post", X.post_marker(year, month))
    replies = comment_rows(posts) if comments is None else comments
    replies = replies.select("post_id", "comment_id", "subreddit_name", "year", "month", F.col("body").alias("_body"))
    return own.unionByName(_chunk_rows(_split(replies, "_body", size, overlap, splitter), "comment", None))


def chunk_comments(
    comments: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, splitter: Splitter | None = None
) -> DataFrame:
    """Chunks of the comments that are long enough, marked with their month."""
    rows = comments.where(~X.is_short(F.col("body"))).select(
        "post_id", "comment_id", "subreddit_name", "year", "month", F.col("body").alias("_body")
    )
    return _chunk_rows(
        _split(rows, "_body", size, overlap, splitter), "comment",
        X.comment_marker(F.col("year"), F.col("month")),
    )
