from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.conftest import SF_DIR
from threadmine.llm import tokens
from threadmine.llm.queries import QUERIES, VOCABULARY


def library(vocabulary, byte_fallback=True):
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.read_vocabulary(VOCABULARY)


def test_random_texts_equal_the_library(vocabulary):
    count, other, rng = tokens.Counter(vocabulary), library(vocabulary), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("ab th e▁\n\t  é漢😀<0x0A>İ\x00​", k=rng.randint(0, 40)))
        assert count.of_text(text) == other(text), text


def test_ties_and_unknown_runs_of_a_tiny_vocabulary():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {"".join(rng.choices("abc▁", k=rng.randint(1, 3))): float(-rng.randint(1, 3)) for _ in range(8)}
        vocabulary = [("<unk>", 0.0), *pieces.items()]
        count, other = tokens.Counter(vocabulary), library(vocabulary, False)
        for _ in range(30):
            text = "".join(rng.choices("abcd ", k=rng.randint(0, 12)))
            assert count.of_text(text) == other(text), (vocabulary, text)


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    count, other = tokens.Counter(vocabulary), library(vocabulary)
    text = " ".join(f"word{i % 7}" for i in range(200))
    assert count.of_text(text) == other(text)
    assert len(count) <= 3


def test_query_equals_the_library(spark, vocabulary):
    other = library(vocabulary)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op9_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: other(t or "") for i, t in texts.items()}


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (1, "", 2), (2, "a b", 3), (2, "a b", 3), (3, "x " * 300_000, 4)]])
def test_odd_rows(spark, vocabulary, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_chars) for r in tokens.count_tokens(docs, vocabulary).collect())
    assert got == sorted((i or 0, len(t or "")) for i, t, _ in rows)


def test_ill_formed_bytes_are_replaced(spark, vocabulary):
    docs = spark.sql("SELECT 1L doc_id, cast(X'61FF62' AS string) text")
    assert [r.n_tokens for r in tokens.count_tokens(docs, vocabulary).collect()] == [tokens.Counter(vocabulary).of_text("a�b")]
