from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tests.conftest import SF_DIR
from threadmine.llm import secrets
from threadmine.llm.queries import QUERIES

PATTERNS = {
    "assign": r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text: str) -> list[tuple[int, int, int]]:
    """The base spans by a search over the whole text."""
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            if (kind == "assign" and len(m[2]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (
                    kind == "hex" and len(m[0]) >= 32):
                found.append((m.start(), secrets.KINDS.index(kind), m.end()))
    return sorted(found)


def github_token(body: str) -> str:
    number, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = secrets.BASE62[digit] + digits
    return "ghp_" + body + digits


def test_random_texts_equal_a_full_search():
    rng = random.Random(3)
    parts = ["password", "PassWord", "passwd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", "'", '"', "AKIA",
             "akia", "ABCD1234EFGH", "0123456789abcdef", "deadbeefdeadbeef", "x", "é", "ſecret", "Key", "\n", "tok", "en",
             "abcdefgh", "-", "İ", "𝄞"]
    words = secrets.automaton()
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        got = [s for s in secrets.find_spans(text.encode(), words) if s[1] < 3]
        assert got == brute(text), text


def test_checksums_decide():
    good = github_token("a1B2" * 7 + "zz")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    words = secrets.automaton()
    assert secrets.find_spans(f"é {good}.".encode(), words) == [(2, 3, 2 + len(good))]
    assert secrets.find_spans(f"é {bad}.".encode(), words) == []
    # Fixed value: a test vector of BIP 173.
    assert secrets.bech32_is_valid("A12UEL5L")
    assert not secrets.bech32_is_valid("A12UEL5M")


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op4_secrets"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (1, "", 2), (1, "", 2), (2, "token=abcdefgh " * 50_000, 3)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r.doc_id or 0, len(r.spans)) for r in secrets.scan_secrets(docs).collect()))
    assert got == ([] if not rows else [(0, 0), (1, 0), (1, 0), (2, 50_000)])


def test_ill_formed_bytes_are_single_characters(spark):
    docs = spark.sql("SELECT 1L doc_id, cast(X'C3FF' || cast(' password=abcdefgh12 ' AS binary) || X'FF' AS string) text")
    assert [(s.kind, s.start, s.end) for s in secrets.scan_secrets(docs).first().spans] == [("assign", 3, 22)]
