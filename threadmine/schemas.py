"""Schemas of the tables the library reads and writes. No reader infers one."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


COMMENT = _struct(id=STR, score=INT, body=STR, year=INT, month=INT)

# Partition columns are integers here; files that hold them as strings are cast on read.
PARTITIONS = ["created_at_year", "created_at_month", "created_at_day", "subreddit_name"]

POST = _struct(
    id=STR, title=STR, original_title=STR, content=STR, url=STR, score=INT, year=INT, month=INT,
    comments=T.ArrayType(COMMENT, True),
    created_at_year=INT, created_at_month=INT, created_at_day=INT, subreddit_name=STR,
)

FORUM_FILE = _struct(subreddit=STR, post_count=INT, posts=T.ArrayType(POST, True))

CHUNK_COLUMNS = [
    "page_content", "post_id", "comment_id", "year", "month", "type",
    "subreddit_name", "chunk_id", "timestamp", "date",
]

SEEN_POST = _struct(post_id=STR, subreddit=STR, pulled_at=LONG, ttl=LONG)

CHAT_MESSAGE = _struct(connection_id=STR, domain_name=STR, stage=STR, message=STR, request_id=STR, timestamp=STR)

EVALUATION_MESSAGE = _struct(
    query=STR, response=STR, session_id=STR, request_id=STR,
    metadata=T.MapType(STR, STR, True), timestamp=STR,
)

RESPONSE_EVENT = _struct(type=STR, content=STR, request_id=STR, timestamp=STR, messageId=STR, seq=LONG)

LOG_RECORD = _struct(ts=T.TimestampType(), message=STR, stream=STR)

# Judge answers, one schema per judge.
FAITHFULNESS = _struct(faithfulness=DBL, grounded=BOOL, reasoning=STR)
ACTIONABILITY = _struct(actionability=DBL, specific_products_count=INT, reasoning=STR)
RETRIEVAL = _struct(avg_relevance=DBL, reasoning=STR)

MESSAGE_TYPES = ["processing", "message", "error", "message_start", "message_chunk", "message_end"]
TIME_FILTERS = ["all", "day", "hour", "month", "week", "year"]
