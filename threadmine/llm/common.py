"""Column expressions and task helpers that the operators share.

Words are runs of characters other than the six ASCII white-space characters
(space, \\t, \\n, \\v, \\f, \\r), everywhere in this folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmine.session import ship_package  # noqa: F401

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words of a text that is not null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Counts the pieces between white space, without the empty ends."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.split(text, SPACES)
    size = F.size(pieces)
    return (size - (F.get(pieces, F.lit(0)) == "").cast("int")
            - ((size > 1) & (F.get(pieces, size - 1) == "")).cast("int")).cast("long")


def held_out() -> Column:
    """True for the fifth of the ids that no model may learn labels from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together (a longer text stands alone)."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
