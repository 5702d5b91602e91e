"""Postings of stored indexes: counted in tasks, dealt by term as packets, a row for each term and block of documents.

A task reads some documents at a time, puts those of like length together into blocks of ``BLOCK_DOCS`` and counts the
terms of all of them at once. A document is known by its block and its number in it, so a posting is three small
numbers; ids stand once in a table of their own. Until they are written by term, rows travel as compressed packets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.functions.text import tokenize_sparse
from threadmine.session import ship_package

BLOCK_DOCS = 128
# Tokens that a task gathers before it makes packets of them.
_TOKENS = 1_000_000
# Bits of a block's number for its place in its task, and for that and the task.
_OF_TASK, _OF_WRITE = 22, 44

ROWS = "term string, block bigint, most double, list array<struct<no:int,tf:int,doc_len:int>>"
_NUMBERS = pa.struct([("no", pa.int32()), ("tf", pa.int32()), ("doc_len", pa.int32())])
_PACKED = pa.schema([("term", pa.string()), ("block", pa.int64()), ("most", pa.float64()), ("list", pa.list_(_NUMBERS))])


def _lists(ids: list[pa.Array], tokens: list[pa.Array], first: int, lanes: int) -> tuple[pa.Table, np.ndarray, list[pa.Array]] | None:
    """Rows of some documents in the order of their lanes, where each lane starts, and (block, no, doc_id) of the documents."""
    lens = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in tokens]).astype(np.int64)
    order = np.argsort(lens, kind="stable")
    order = order[lens[order] > 0]
    if not len(order):
        return None
    words = pa.chunked_array([x.flatten() for x in tokens]).combine_chunks().dictionary_encode()
    place = np.zeros(len(lens), np.int64)
    place[order] = np.arange(len(order))
    pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(place, lens), return_counts=True)
    term, doc = pair // len(order), pair % len(order)
    block, doc_len = doc // BLOCK_DOCS, lens[order][doc]
    starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
    sizes = np.diff(np.append(starts, len(pair)))
    lane = (np.array([zlib.crc32(x.encode()) for x in words.dictionary.to_pylist()], np.int64) % lanes)[term[starts]]
    rows, cells = np.argsort(lane, kind="stable"), np.argsort(np.repeat(lane, sizes), kind="stable")
    numbers = pa.StructArray.from_arrays(
        [pa.array(x[cells].astype(np.int32)) for x in (doc % BLOCK_DOCS, tf, doc_len)], fields=list(_NUMBERS))
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[rows]))).astype(np.int32))
    most = np.maximum.reduceat(tf / doc_len, starts)
    table = pa.RecordBatch.from_arrays([
        words.dictionary.take(pa.array(term[starts][rows])), pa.array(first + block[starts][rows]), pa.array(most[rows]),
        pa.ListArray.from_arrays(offsets, numbers)], schema=_PACKED)
    at = np.arange(len(order))
    named = [pa.array(first + at // BLOCK_DOCS), pa.array((at % BLOCK_DOCS).astype(np.int32)),
             pa.chunked_array(ids).take(pa.array(order)).combine_chunks()]
    return table, np.searchsorted(lane[rows], np.arange(lanes + 1)), named


def packets(docs: DataFrame, doc_id: str, text: str, lanes: int, serial: int) -> DataFrame:
    """Rows (lane, packet, n) with the postings of some documents whose terms fall to a lane, n of them, and rows (block, no, doc_id).

    ``serial`` tells the blocks of this write from those of others. Documents without terms are in no row.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    base = serial << _OF_WRITE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = base + (TaskContext.get().partitionId() << _OF_TASK)
        ids, tokens, held, blocks = [], [], 0, 0
        schema = None

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal blocks
            made = _lists(ids, tokens, first + blocks, lanes)
            if made is None:
                return
            table, starts, named = made
            blocks += -(-len(named[0]) // BLOCK_DOCS)
            found = [i for i in range(lanes) if starts[i] < starts[i + 1]]
            cut = [table.slice(starts[i], starts[i + 1] - starts[i]) for i in found]
            yield _filled(schema, lane=pa.array(found, pa.int32()), packet=pa.array([_bytes(x) for x in cut], pa.binary()),
                          n=pa.array([int(pc.sum(pc.list_value_length(x.column(3))).as_py()) for x in cut], pa.int64()))
            yield _filled(schema, block=named[0], no=named[1], doc_id=named[2])

        for batch in batches:
            schema = schema or pa.schema([("lane", pa.int32()), ("packet", pa.binary()), ("n", pa.int64()),
                                          ("block", pa.int64()), ("no", pa.int32()), ("doc_id", batch.schema[0].type)])
            ids.append(batch.column(0))
            tokens.append(batch.column(1))
            held += len(batch.column(1).flatten())
            if held > _TOKENS:
                yield from given()
                ids, tokens, held = [], [], 0
        if ids:
            yield from given()

    return docs.select(F.col(doc_id).alias("doc_id"), tokenize_sparse(F.col(text)).alias("tokens")).mapInArrow(
        pack, f"lane int, packet binary, n bigint, block bigint, no int, doc_id {kind}")


def _filled(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(packets: DataFrame) -> DataFrame:
    """``ROWS`` of (packet): ``most`` is the greatest ``tf / doc_len`` of the list."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet in batch.column(0):
                yield from pa.ipc.open_stream(packet.as_buffer())

    return packets.select("packet").mapInArrow(unpack, ROWS)


def listed(rows: DataFrame) -> DataFrame:
    """A row for each posting: ``no``, ``tf`` and ``doc_len`` in place of the list."""
    return rows.select(*[c for c in rows.columns if c not in ("list", "most")], F.inline("list"))
