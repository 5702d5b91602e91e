"""Bloom filters as small tables: rows that surely have no partner need not be shuffled to learn it.

A filter is a table of blocks, each a bitmap of ``BITS`` bits. A key's hash names one block and ``PROBES`` bits in it,
so one look-up in a broadcast table of at most ``MAX_BLOCKS`` rows (16 MB) tells whether the key may be there.
Beyond the number of keys that this holds well, more rows are taken for possible partners; results stay exact,
since possible partners go through a real join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.session import stage

BITS, PROBES, BITS_PER_KEY = 32_768, 4, 12
MAX_BLOCKS = 4_096


def _block(on: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(41), *on), F.lit(blocks))


def _places(on: list[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(probe), *on), F.lit(BITS)) for probe in range(PROBES)]


def bloom_filter(keys: DataFrame, on: list[str]) -> tuple[DataFrame, int]:
    """(_block, _bits) of the keys without nulls, written, and the number of blocks. The keys are read twice."""
    keys = keys.select(*on).dropna("any")
    blocks = min(MAX_BLOCKS, max(1, -(-keys.count() * BITS_PER_KEY // BITS)))
    bits = keys.select(_block(on, blocks).alias("_block"), F.explode(F.array(*_places(on))).alias("_place")).groupBy("_block").agg(
        F.bitmap_construct_agg("_place").alias("_bits"))
    return stage(bits, "bloom"), blocks


def with_maybe(rows: DataFrame, held: tuple[DataFrame, int], on: list[str], name: str = "_maybe") -> DataFrame:
    """``rows`` with a boolean column: false where the filter ``held`` rules out that the row's key is among its keys.

    Names that begin with ``_block`` or ``_bits`` must not be among the columns. A key with a null is in no filter.
    """
    bits, blocks = held

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0

    some = F.lit(True)
    for column in on:
        some = some & F.col(column).isNotNull()
    found = F.col("_bits").isNotNull() & some
    for place in _places(on):
        found = found & is_set(place)
    marked = rows.withColumn("_block", _block(on, blocks)).join(F.broadcast(bits), ["_block"], "left")
    return marked.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(found, F.lit(False)).alias(name))


def maybe_in(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among ``keys``, and by chance some others; nothing is shuffled."""
    return with_maybe(rows, bloom_filter(keys, on), on).where("_maybe").drop("_maybe")


def bloom_semi_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose key is among ``keys``; only possible partners meet in the join."""
    return maybe_in(rows, keys, on).join(keys.select(*on).distinct(), on, "left_semi")


def bloom_anti_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose key is not among ``keys`` (a key with a null never is).

    Rows that the filter rules out are passed on where they are; ``rows`` are read twice, and ``keys`` three times:
    write either before, if it is dear to compute.
    """
    marked = with_maybe(rows, bloom_filter(keys, on), on)
    rest = marked.where("_maybe").drop("_maybe").join(keys.select(*on).distinct(), on, "left_anti")
    return marked.where(~F.col("_maybe")).drop("_maybe").unionByName(rest.select(*[F.col(f"`{c}`") for c in rows.columns]))
