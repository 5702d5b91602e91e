"""Alignment of the tokens of two tokenizers over the same bytes.

Tokens of either side are laid end to end over the bytes of a text. The ends of each side are the keys of a
dictionary to token numbers; the ends that both sides have, found as an intersection of the two key sets, cut both
lists of tokens into groups. Within a group every token of one side is linked with every token of the other.

How many rows hold an id pair linked is counted over the whole table: tasks sum the pairs of their rows, which are
then added up by pair. The table of pairs is bounded by the product of the vocabularies only, so it comes back to the
rows in parts of at most ``MAX_PAIRS``, each broadcast for itself; what a row gets from the parts is summed.
Texts are encoded once: the token ids are kept, compressed, in the table that the second pass reads.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from threadmine.llm.common import ship_package, slices
from threadmine.session import stage

MAX_PAIRS = 2_000_000
# Links expanded at a time, and pairs that a task gathers before it hands them on.
EXPANDED, HELD = 1_000_000, 1_000_000
MARK = "▁"
# Fixed value: how byte-level vocabularies part a text before the merges.
PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in turn."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """The tokenizer in a ``tokenizers`` JSON file with a byte-level vocabulary; a space is put before every text.

    A plain one, whose ids follow the order of its merges, is run by ``tiktoken``, which gives the same ids in a quarter
    of the time; any other by ``tokenizers``.
    """

    def __init__(self, content: str):
        self.content, table, held = content, _byte_characters(), json.loads(content)
        model, parts = held["model"], held["pre_tokenizer"] or {}
        vocabulary = model["vocab"]
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
        self.plain = (held["normalizer"] is None and parts.get("type") == "ByteLevel" and parts.get("use_regex", True)
                      and not parts.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout")
                      and {vocabulary.get(c) for c in table} == set(range(256)) and merged == list(range(256, 256 + len(merged))))
        self.pieces = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.pieces[i] = bytes(table[c] for c in entry)

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        if self.plain:
            ranks = {piece: i for i, piece in enumerate(self.pieces)}
            fast = tiktoken.Encoding("plain", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [fast.encode_ordinary(" " + t) for t in texts]
        tokenizer = Tokenizer.from_str(self.content)
        tokenizer.encode_special_tokens = True
        return lambda texts: [x.ids for x in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceLevel:
    """The tokenizer in a SentencePiece model file, which puts a space before every text itself."""

    def __init__(self, content: bytes):
        self.content = content
        processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(MARK, " ").encode()
                       for i, p in enumerate(names)]

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=self.content)
        return lambda texts: processor.encode(texts, num_threads=1)


# How to make an encoder in a task, and the bytes of each id.
Side = ByteLevel | PieceLevel


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Numbers of the tokens of either side that end where one of the other side ends, given all ends (ascending)."""
    at_a, at_b = dict(zip(a.tolist(), range(len(a)))), dict(zip(b.tolist(), range(len(b))))
    ends = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, ends)), list(map(at_b.__getitem__, ends))


def linked_pairs(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs ``a * width + b`` that are linked, ascending, and the links of each. ``cut``: last token of each group."""
    from_a, from_b = np.concatenate(([0], cut_a[:-1] + 1)), np.concatenate(([0], cut_b[:-1] + 1))
    n_a, n_b = cut_a + 1 - from_a, cut_b + 1 - from_b
    links = n_a * n_b
    codes, times = [], []
    large = links > EXPANDED
    for g in np.flatnonzero(large):  # by distinct ids, some at a time
        ids_a, c_a = np.unique(a[from_a[g]:cut_a[g] + 1], return_counts=True)
        ids_b, c_b = np.unique(b[from_b[g]:cut_b[g] + 1], return_counts=True)
        codes.append((ids_a.astype(np.int64)[:, None] * width + ids_b[None, :]).reshape(-1))
        times.append((c_a[:, None] * c_b[None, :]).reshape(-1))
    rest = np.flatnonzero(~large)
    upto = np.cumsum(links[rest])
    lo = 0
    while lo < len(rest):
        before = upto[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(upto, before + EXPANDED, side="right")), lo + 1)
        g = rest[lo:hi]
        owner = np.repeat(g, links[g])
        r = np.arange(len(owner)) - np.repeat(upto[lo:hi] - links[g] - before, links[g])
        i, j = np.divmod(r, n_b[owner])
        found, n = np.unique(a[from_a[owner] + i].astype(np.int64) * width + b[from_b[owner] + j], return_counts=True)
        codes.append(found)
        times.append(n)
        lo = hi
    if len(codes) == 1 and not large.any():
        return codes[0], times[0]
    return summed(codes, times)


def summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, times = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(values, kind="stable")
    values, times = values[order], times[order]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.add.reduceat(times, at)


class Groups:
    """Encodes texts and writes the groups of both sides down."""

    def __init__(self, a: Side, b: Side):
        self.encode = a.encoder(), b.encoder()
        self.pieces = a.pieces, b.pieces
        self.lengths = [np.array([len(p) for p in s.pieces], np.int64) for s in (a, b)]
        # Each id with the mark that follows it: a comma, and at the end of a group a bar (left side) or a semicolon.
        n = max(len(a.pieces), len(b.pieces))
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], object)
        self.n = n

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token ids of both sides; none for a text that is null or empty, or whose tokens spell other bytes."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = [none] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        held = [texts[i] for i in some]
        for i, *both in zip(some, *(e(held) for e in self.encode)) if some else ():
            whole = b" " + texts[i].encode()
            if all(b"".join(map(p.__getitem__, ids)) == whole for p, ids in zip(self.pieces, both)):
                out[i] = tuple(np.array(ids, np.int64) for ids in both)
        return out

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = common_ends(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        return tuple(np.array(x, np.int64) for x in found)

    def digest(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``."""
        mark_a, mark_b = a.copy(), b.copy()
        mark_a[cut_a] += self.n
        mark_b[cut_b] += 2 * self.n
        group_a = np.zeros(len(a), np.int64)
        group_b = np.zeros(len(b), np.int64)
        group_a[cut_a[:-1] + 1] = group_b[cut_b[:-1] + 1] = 1
        # Left tokens of group g stand behind all right tokens of the groups before it, and so on.
        group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], cut_b + 1))[group_a]] = mark_a
        order[np.arange(len(b)) + (cut_a + 1)[group_b]] = mark_b
        return hashlib.sha256("".join(self.written[order].tolist())[:-1].encode()).hexdigest()


def _encoded(docs: DataFrame, a: Side, b: Side, width: int) -> DataFrame:
    """A row (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, ids, cuts) for each row, and rows (code, n) of each task's pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    long, names = T.LongType(), ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "code", "n"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, long) for c in names[1:5]],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("code", long), T.StructField("n", long)])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, packer = Groups(*shared.value), zstandard.ZstdCompressor(level=1)
        codes, times, held = [], [], 0
        id_type = None

        def pairs() -> pa.RecordBatch:
            n = len(codes[0])
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()),
                 pa.array(codes[0]), pa.array(times[0])], names)

        for batch in batches:
            id_type = batch.column(0).type
            for lo, hi in slices(batch.column(1)):
                rows = []
                for a, b in groups.ids([_text(x.as_py()) for x in batch.column(1)[lo:hi]]):
                    if not len(a):
                        rows.append((0, 0, 0, 0, "", b""))
                        continue
                    cut_a, cut_b = groups.cuts(a, b)
                    found, n = linked_pairs(a, b, cut_a, cut_b, width)
                    codes.append(found)
                    times.append(np.ones(len(found), np.int64))
                    held += len(found)
                    packed = packer.compress(np.concatenate([a, b]).astype(np.uint32 if groups.n > 65536 else np.uint16).tobytes())
                    rows.append((len(a), len(b), len(cut_a), int(n.sum()), groups.digest(a, b, cut_a, cut_b), packed))
                    if held > HELD:
                        codes, times = ([x] for x in summed(codes, times))
                        held = len(codes[0])
                        if held > HELD // 2:
                            yield pairs()
                            codes, times, held = [], [], 0
                n = hi - lo
                types = [*[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *[pa.array(c, t) for c, t in zip(zip(*rows), types)],
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        if held:
            codes, times = ([x] for x in summed(codes, times))
            yield pairs()

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(align, schema)


def _text(raw: bytes | None) -> str | None:
    """The text, or none for null and for bytes that are no UTF-8."""
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def _from_part(rows: DataFrame, part: DataFrame, a: Side, b: Side, width: int) -> DataFrame:
    """(row, n_best, count_sum): what the pairs of a bounded part give to each row."""
    table = part.select("code", "n", "best").toArrow().sort_by("code")
    shared = rows.sparkSession.sparkContext.broadcast((
        *(table.column(c).to_numpy() for c in ("code", "n", "best")),
        *(np.array([len(p) for p in s.pieces], np.int64) for s in (a, b))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best, *lengths = shared.value
        kind, unpacker = (np.uint32 if max(map(len, lengths)) > 65536 else np.uint16), zstandard.ZstdDecompressor()
        for batch in batches:
            sums = []
            for n_a, ids in zip(batch.column(1).to_pylist(), batch.column(2)):
                if not n_a or not len(known):
                    sums.append((0, 0))
                    continue
                ids = np.frombuffer(unpacker.decompress(ids.as_py()), kind).astype(np.int64)
                x, y = ids[:n_a], ids[n_a:]
                ends = np.cumsum(lengths[0][x]), np.cumsum(lengths[1][y])
                both = np.intersect1d(*ends, assume_unique=True)
                codes, times = linked_pairs(x, y, *(np.searchsorted(e, both) for e in ends), width)
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                times = np.where(known[at] == codes, times, 0)
                sums.append((int((times * best[at]).sum()), int((times * counts[at]).sum())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*sums) if sums else ([], [])))], ["row", "n_best", "count_sum"])

    return rows.select("row", "n_a", "ids").mapInArrow(add, "row long, n_best long, count_sum long")


def align_tokens(docs: DataFrame, a: Side, b: Side, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Tokens are those of space + text on either side. An id pair counts in as many rows as hold it linked; n_best is
    the number of links whose pair has the highest count of its left id (ties included), count_sum adds the counts up
    over the links. groups_sha256 is the hash of the groups, written ``a1,a2|b1;a3|b2,b3``.

    A text that is null, empty, no UTF-8, or whose tokens of either side spell other bytes has no tokens: zeros and ''.
    Repeated rows and rows with null ids are rows like any other. An empty table gives an empty result.
    Needs (doc_id, text); other columns are ignored.
    """
    ship_package(docs.sparkSession)
    width = len(b.pieces)
    read = stage(_encoded(docs.select("doc_id", "text"), a, b, width).withColumn("row", F.monotonically_increasing_id()), "aligned")
    rows = read.where(F.col("n_a").isNotNull())
    counts = stage(read.where(F.col("code").isNotNull()).groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    highest = counts.groupBy(F.expr(f"code div {width}").alias("a")).agg(F.max("n").alias("most"))  # one row for each left id
    pairs = stage(counts.withColumn("a", F.expr(f"code div {width}")).join(F.broadcast(highest), ["a"]).select(
        "code", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs")
    parts = max(1, -(-5 * pairs.count() // (4 * max_pairs)))
    sums = [stage(_from_part(rows, pairs.where(F.pmod(F.xxhash64("code"), F.lit(parts)) == i), a, b, width), "sums")
            for i in range(parts)]
    total = reduce(DataFrame.unionByName, sums).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("ids", "code", "n").join(total, ["row"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
