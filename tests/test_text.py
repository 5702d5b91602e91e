from __future__ import annotations

import hashlib
import re
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmine.functions import ids, times
from threadmine.functions import text as X


def _one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"x": 1}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("r")).first()["r"]


def test_sparse_tokens_follow_unicode_boundaries(spark):
    got = _one(spark, X.tokenize_sparse(F.col("t")), t="The Étion a b2 it's X-ray über 7 42 naïve ok_no")
    words = re.findall(r"\b[a-z0-9]+\b", "the étion a b2 it's x-ray über 7 42 naïve ok_no")
    assert got == [w for w in words if w not in X.STOP_WORDS and len(w) > 1]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aéB1 _-.ß\u00a0\n", max_size=30), min_size=5, max_size=20))
def test_word_tokens_equal_the_regular_expression(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["w"] for r in df.select(X.tokenize_words(F.col("t")).alias("w")).collect()]
    assert got == [re.findall(r"\b\w+\b", t.lower()) for t in texts]


def test_cleaning(spark):
    assert _one(spark, X.clean_text(F.col("t")), t="\u00a0 a \n\t b\u2003c ") == "a b c"
    assert _one(spark, X.clean_text(F.col("t")), t=None) == ""
    assert _one(spark, X.strip(F.col("t")), t="\n\u00a0 a b \t") == "a b"


def test_markers_and_full_text(spark):
    assert _one(spark, X.post_marker(F.lit(2024), F.lit(5))) == "[From 2024-05] "
    assert _one(spark, X.comment_marker(F.lit(2024), F.lit(11))) == "[Comment from 2024-11] "
    assert _one(spark, X.yyyymm(F.lit(2024), F.lit(5))) == 202405
    assert _one(spark, X.full_text(F.lit("T"), F.lit(None))) == "Title: T\n\n"


def test_response_checks(spark):
    text = "Buy the Sony WH-1000 from Sony Store " + "word " * 100
    df = spark.createDataFrame([(text,), ("nothing here",), (None,)], "r string")
    rows = df.select(*[c.alias(n) for n, c in X.response_checks(F.col("r")).items()]).collect()
    assert (rows[0]["has_products"], rows[0]["has_specifics"], rows[0]["response_length"]) == (True, True, 107)
    assert abs(rows[0]["heuristic_score"] - 1.0) < 1e-9
    assert (rows[1]["has_products"], rows[1]["has_specifics"], rows[1]["heuristic_score"]) == (False, False, 0.5)
    assert rows[2]["response_length"] == 0


def test_context_and_judge_documents(spark):
    df = spark.createDataFrame([(['say "hi"\nthere', "b" * 301, "c", "d"],), ([],)], "t array<string>")
    full, none = [r["c"] for r in df.select(X.context_string(F.col("t")).alias("c")).collect()]
    assert full.startswith(X.CONTEXT_HEADER + '- say \\"hi\\"\\nthere\n- ') and full.endswith("- c\n" + X.CONTEXT_FOOTER)
    assert none == X.NO_CONTEXT
    judged = df.select(X.judge_documents(F.col("t")).alias("c")).first()["c"]
    assert judged == 'Document 1: say "hi"\nthere\n\nDocument 2: ' + "b" * 300 + "...\n\nDocument 3: c"


def test_cookie(spark):
    read = lambda c: _one(spark, X.cookie_value(F.col("t")), t=c)
    assert read("a=1; session_id=x=y; b") == "x=y"
    assert read("session_id=old; session_id=new") == "new"
    assert read("my_session_id=1") is None and read(None) is None and read("session_id") is None


def test_ids(spark):
    for name in ("p1_shopping_0_post", "p1_shopping_0_comment", "ünï_1"):
        assert _one(spark, ids.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert _one(spark, ids.uuid5(F.col("n")), n="p1_shopping_0_post") == "6ee505de-8c09-56f5-a95a-78d1c3f0cf3d"
    text = "Great headphones for music"
    assert _one(spark, ids.text_id(F.col("n")), n=text) == hashlib.md5(text.encode()).hexdigest()


def test_times(spark):
    parse = lambda v: _one(spark, times.parse_epoch_seconds(F.col("t")), t=v)
    assert parse("1700000000123") == 1700000000.123
    assert parse("2024-01-01T00:00:01Z") == 1704067201.0
    assert parse("2024-01-01 00:00:01.5") == 1704067201.5
    assert parse("soon") is None
    year, month = times.utc_year_month(F.col("t"))
    assert (_one(spark, year, t=1704067199), _one(spark, month, t=1704067199)) == (2023, 12)
