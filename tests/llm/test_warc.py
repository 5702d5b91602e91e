from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pytest

from tests.conftest import SF_DIR
from threadmine.llm import warc
from threadmine.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, record_type int"
LONG = "x" * 99 + "é"


def expected(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        revisit = len(data) >= 100 and same and page != min(same)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    min(same) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [],
    [(3, "u", LONG, 1), (1, "a\r\nb", LONG, 1), (1, "é", LONG, 1), (None, None, LONG, 1), (2, "u", None, 1),
     (4, "u", "", 1), (5, "u", "x" * 99, 1), (6, "u", "x" * 99, 1), (7, "u", "WARC/1.1\r\n\r\n" * 400_000, 1)],
])
def test_round_trip(spark, rows):
    got = warc.round_trip(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    by_id = {r[0]: r[2] for r in rows}
    for r in got:
        if r.record_type == "response" and r.page_id not in (None, 1):
            assert r.payload.decode() == (by_id[r.page_id] or "")


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op7_warc"](spark, SF_DIR).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(rows)


def test_normaliser_makes_members_and_index():
    parts = [warc.record("response", str(i), "u", b"p" * i, i, "d", None) for i in (0, 5, 3_000_000)]
    for whole in (gzip.compress(b"".join(parts)), b"".join(gzip.compress(p) for p in parts) + b"\0" * 9):
        out = io.BytesIO()
        index = list(warc.normalise_file(io.BytesIO(whole), out))
        data = out.getvalue()
        assert gzip.decompress(data) == b"".join(parts)
        for entry, part in zip(index, parts, strict=True):
            assert zlib.decompress(data[entry["offset"]:entry["offset"] + entry["length"]], 31) == part


def test_cut_archives_are_refused():
    whole = gzip.compress(warc.record("response", "1", "u", bytes(range(256)) * 99, 1, "d", None))
    with pytest.raises(EOFError):
        list(warc.normalise_file(io.BytesIO(whole[:-20]), io.BytesIO()))
    assert list(warc.normalise_file(io.BytesIO(b""), io.BytesIO())) == []


def test_ids_are_quoted(spark):
    """No id can be taken for the missing one or for a header."""
    ids = ["null", "a\r\nWARC-Type: revisit", "", "%0D", "é>", None]
    rows = [(i, "u", LONG if k % 2 else f"page {k}", 1) for k, i in enumerate(ids)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, SCHEMA.replace("page_id long", "page_id string"))).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
