"""WARC archives: write them, give every record its own gzip member, read them back by offset.

A whole-file gzip stream must be inflated from its start for any record. The normaliser
inflates such a file once, in pieces of bounded size, compresses each record as a member
of its own and writes a sidecar index (one JSON line per record: offset, length, id).
A reader then seeks to a record and inflates nothing else.

Tasks write to the shared folder only, under a name of their own, and report it when the file is
closed; what is reported is written to a table once. A task that runs again (or twice) writes other
files, and only reported files are ever read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.llm.common import ship_package
from threadmine.session import new_path, stage

MIN_REVISIT = 100
PIECE = 1 << 20
MEMBER, HEAD_END = 31, b"\r\n\r\n"
ARCHIVE = "path string, records long"
INDEX = "path string, offset long, length long, id string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _urn(page_id: str | None) -> str:
    """Name of a page's record; ids are quoted, so none can hold a line end or another header. Without an id, the bare name."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _page_of(urn: str) -> str | None:
    return unquote(urn[len("<urn:page:"):-1]) if urn.startswith("<urn:page:") else None


def record(kind: str, page_id: str | None, url: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload but the length and digest of what it stands for."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {quote(url, safe=':/?&=#%+,;@~!$*()[]')}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    body = payload if kind == "response" else b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + HEAD_END + body + HEAD_END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}


def inflate(source) -> Iterator[bytes]:
    """The content of a gzip file, piece by piece; it may have one member or many."""
    engine, waiting, any_data = zlib.decompressobj(MEMBER), b"", False
    while True:
        if not waiting:
            waiting = source.read(PIECE)
        ended = not waiting
        if engine.eof:
            waiting = waiting.lstrip(b"\0")
            if ended:
                return
            if not waiting:
                continue
            engine = zlib.decompressobj(MEMBER)
        any_data = any_data or not ended
        out = engine.decompress(waiting, PIECE)
        waiting = engine.unused_data if engine.eof else engine.unconsumed_tail
        if out:
            yield out
        elif ended:
            if any_data and not engine.eof:
                raise EOFError("gzip file ends early")
            return


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """(headers, head, body pieces) of each record of a content; read a body before the next record."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(HEAD_END)) < 0:
            if not more():
                if held.strip():
                    raise EOFError("archive ends within a record")
                return
        head = bytes(held[: end + 4])
        del held[: end + 4]
        fields = parse_head(head[:-4])
        left = int(fields["content-length"]) + len(HEAD_END)

        def body(left: int = left) -> Iterator[bytes]:
            while left:
                if not held and not more():
                    raise EOFError("archive ends within a record")
                part = bytes(held[:left])
                del held[:left]
                left -= len(part)
                yield part

        yield fields, head, body()


def normalise_file(source, target) -> Iterator[dict]:
    """Copy a gzip archive so that every record is its own member; yields (offset, length, id)."""
    offset = 0
    for fields, head, body in records(inflate(source)):
        packer = zlib.compressobj(6, zlib.DEFLATED, MEMBER)
        length = target.write(packer.compress(head))
        for part in body:
            length += target.write(packer.compress(part))
        length += target.write(packer.flush())
        yield {"offset": offset, "length": length, "id": fields["warc-record-id"]}
        offset += length


def plan_records(pages: DataFrame) -> DataFrame:
    """Payload, digest, type and response of each page.

    Of equal payloads of at least ``MIN_REVISIT`` bytes the smallest page_id is the
    response and all other ids are revisits of it. Rows that repeat that id are responses
    too. A null id is never the response of another page.
    """
    rows = pages.select(
        "page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long")) \
        .withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(first, ["payload_digest"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(planned: DataFrame, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """Write the planned records as whole-file gzip archives; (path, records) of each."""
    ship_package(planned.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        sink = packer = path = None
        size = count = 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.write(packer.flush())
                sink.close()
                done.append((path, count))
                sink = None

        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    path = f"{base}/whole-{uuid.uuid4().hex}.warc.gz"
                    sink, packer = files.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, MEMBER)
                    size = count = 0
                data = record(row["record_type"], row["page_id"], row["url"], row["payload"], row["payload_bytes"],
                              row["payload_digest"], row["refers_to"])
                sink.write(packer.compress(data))
                size, count = size + len(data), count + 1
                if size >= max_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(
            [{"path": p, "records": n} for p, n in done], pa.schema([("path", pa.string()), ("records", pa.int64())]))

    ids = planned.withColumn("page_id", F.col("page_id").cast("string")).withColumn(
        "refers_to", F.col("refers_to").cast("string"))
    return stage(ids.mapInArrow(write, ARCHIVE), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives`` (path) with one member per record, beside a ``.idx`` file; (path, records)."""
    spark = archives.sparkSession
    ship_package(spark)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                target, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                with files.open_input_stream(path, compression=None) as source, \
                        files.open_output_stream(target, compression=None) as out, \
                        files.open_output_stream(target + ".idx", compression=None) as index:
                    for entry in normalise_file(source, out):
                        index.write(json.dumps(entry).encode() + b"\n")
                        count += 1
                done.append({"path": target, "records": count})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    paths = archives.select("path")
    # One archive is one task: a gzip stream can't be split, and each is of bounded size.
    return stage(paths.repartition(max(1, paths.count()), "path").mapInArrow(rewrite, ARCHIVE), "warc-members")


def read_index(archives: DataFrame) -> DataFrame:
    """(path, offset, length, id) of every record of the normalised archives, from their sidecars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = _open(path)
                with files.open_input_stream(place + ".idx", compression=None) as index:
                    rows = [{"path": path, **json.loads(line)} for line in index.read().splitlines()]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i:i + 10_000], schema)

    return archives.select("path").mapInArrow(read, INDEX)


def read_records(index: DataFrame, id_type: T.DataType) -> DataFrame:
    """Read each indexed record by its offset: (page_id, payload_bytes, payload_digest, record_type, refers_to, payload).

    A response's length and digest are computed from the payload that was read, a
    revisit's are those of its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        opened: dict[str, object] = {}
        for batch in batches:
            rows, held = [], 0
            for entry in batch.to_pylist():
                if entry["path"] not in opened:
                    for stream in opened.values():
                        stream.close()
                    files, place = _open(entry["path"])
                    opened = {entry["path"]: files.open_input_file(place)}
                source = opened[entry["path"]]
                source.seek(entry["offset"])
                data = zlib.decompress(source.read(entry["length"]), MEMBER)
                head, _, rest = data.partition(HEAD_END)
                fields = parse_head(head)
                payload = rest[: int(fields["content-length"])]
                response = fields["warc-type"] == "response"
                rows.append({
                    "page_id": _page_of(fields["warc-record-id"]),
                    "payload_bytes": len(payload) if response else int(fields["x-payload-length"]),
                    "payload_digest": hashlib.sha256(payload).hexdigest() if response
                    else fields["warc-payload-digest"].partition(":")[2],
                    "record_type": fields["warc-type"],
                    "refers_to": _page_of(fields.get("warc-refers-to", "")),
                    "payload": payload,
                })
                held += len(payload)
                if held > 8 * PIECE:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = ("page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
              "payload binary")
    return index.mapInArrow(read, schema).withColumn("page_id", F.col("page_id").cast(id_type)).withColumn(
        "refers_to", F.col("refers_to").cast(id_type))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as whole-file archives, normalise them and read every record back.

    A null html is an empty payload, a null url an empty address, a null page_id stays null, repeated rows
    are records of their own, an empty table gives no archive and an empty result; other columns are ignored.
    """
    whole, members = new_path(spark, "warc-whole"), new_path(spark, "warc")
    written = write_archives(plan_records(pages), whole)
    normal = normalise(written, members)
    _remove(spark, whole)
    return read_records(read_index(normal), pages.schema["page_id"].dataType)


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete the archives that have been rewritten."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
