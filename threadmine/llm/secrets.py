"""Find secrets in texts: keyword automaton, anchored patterns at its hits, checksums inside tokens.

One Aho-Corasick pass over a text finds the keywords of all kinds. A kind's pattern is
tried only where its keyword begins, at that place and nowhere else; since every match of the
pattern begins with a keyword, this gives the same leftmost non-overlapping matches as a
search over the whole text. Runs of hexadecimal digits have no keyword: the text is
mapped to two character classes, in which 32 class characters in a row are the keyword.

Tokens that carry a checksum (GitHub and npm access tokens, age keys) are reported only
if the checksum is right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.llm.common import ship_package

KINDS = ("assign", "access", "hex", "github", "npm", "age")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z_])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z_])"),
    "age": re.compile(r"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![0-9A-Z])"),
}
# The keywords that matches of each kind begin with, in lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "age": ("age-secret-key-1",),
}
HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"

Span = tuple[int, int, int]  # start, kind, end


def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            words.add_word(word, (KINDS.index(kind), len(word)))
    words.make_automaton()
    return words


def crc_token_is_valid(token: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body = token.partition("_")[2]
    number, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits == body[30:]


def bech32_is_valid(text: str) -> bool:
    """Checksum of BIP 173 over the readable part and the data."""
    prefix, _, data = text.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.find(c) for c in data]
    check = 1
    for value in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ value
        for i, generator in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= generator if top >> i & 1 else 0
    return check == 1


def _accepted(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """End of the match that begins at ``at`` and whether it counts; None without a match."""
    if kind == "assign":
        found = ASSIGN.match(text, at)
        return found and (found.end(), len(found[2]) >= MIN_VALUE)
    if kind == "access":
        found = ACCESS.match(text, at)
        return found and (found.end(), len(found[0]) >= MIN_ACCESS)
    found = CHECKED[kind].match(text, at)
    valid = bech32_is_valid if kind == "age" else crc_token_is_valid
    return found and (found.end(), valid(found[0]))


def _hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    """Runs of hexadecimal digits that are long enough, in code points."""
    classes, wanted, at, points, done = raw.translate(HEX_CLASS), b"h" * MIN_HEX, 0, 0, 0
    while (at := classes.find(wanted, at)) >= 0:
        end = HEX.match(raw, at).end()
        points += len(raw[done:at].decode())
        yield points, points + end - at
        points, done, at = points + end - at, end, end


def find_spans(raw: bytes, words: ahocorasick.Automaton) -> list[Span]:
    """All spans (start, kind, end) of a text in UTF-8, in code points, by start and kind."""
    spans: list[Span] = [(start, 2, end) for start, end in _hex_runs(raw)]
    hits = [(end + 1 - length, kind) for end, (kind, length) in words.iter(raw.lower().decode())]
    if hits:
        text, behind = raw.decode(), [0] * len(KINDS)
        for at, kind in sorted(hits):
            if at >= behind[kind] and (found := _accepted(KINDS[kind], text, at)):
                behind[kind] = found[0]
                if found[1]:
                    spans.append((at, kind, found[0]))
    return sorted(spans)


def _utf8(raw: bytes) -> bytes:
    """The text; where it is no UTF-8, with U+FFFD for what can't be read."""
    return raw if raw.isascii() else raw.decode(errors="replace").encode()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans is an array of (kind, start, end) in code points, end exclusive.

    A null or empty text has an empty array, an ill-formed piece of UTF-8 is one character, a null doc_id stays, repeated rows are
    scanned each for itself, an empty table gives an empty result. Needs (doc_id, text); other
    columns are ignored.
    """
    ship_package(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = T.StructType([
        docs.schema["doc_id"],
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType())]))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(_utf8(raw.as_py() or b""), words)]
                for raw in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(scan, schema)
