"""MinHash near-duplicates with tensored banding.

Two collections of ``m`` bands of ``a`` minhashes each are computed. A table key is a pair of
bands, one of either collection, so ``m * m`` tables of ``2 a`` minhashes each need
``2 m a`` minhashes instead of ``2 m m a``. Two sets of similarity s share a table unless all
bands of one collection differ: they are missed with probability below ``2 (1 - s**a)**m``,
which is 7e-5 for s = 0.85, a = 2, m = 8, and 6e-4 for s = 0.8.

Sets are linked only after their full shingle sets were compared.

* Equal sets are one node, named by the number of one of its rows, so neither copies nor repeated rows meet in a
  bucket. Different sets under one doc_id are nodes of their own with a link that needs no comparison.
* In each bucket every node is compared with the smallest one. This joins large groups in a number
  of comparisons linear in their size.
* Buckets that still hold several components are finished: nodes outside the bucket's largest
  component meet all others, in blocks of ``BLOCK``; a join on the block pair drops pairs of the
  same component, of unlike sizes and of unlike 128-bit sketches before anything is passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.llm.common import ship_package, slices
from threadmine.llm.components import components
from threadmine.llm.hashing import Words, distinct, mix, shingles
from threadmine.operators.bloom import maybe_in
from threadmine.session import stage

BLOCK = 512
PARITY = [f"o{i}" for i in range(8)]
SKETCH = ["n", "s1", "s2", *PARITY]
_SEEDS = np.random.default_rng(97).integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of lower-cased texts, and the first of each text."""
    return distinct(*shingles(Words([r.lower() for r in raws]), k))


def _per_text(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``ufunc`` over the values of each text that has any."""
    return ufunc.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)


def signature(raws: list[bytes], k: int, m: int, a: int) -> dict[str, np.ndarray]:
    """Of each text: set size, 128-bit set hash, m left and m right bands, 128-bit sketch."""
    values, first = shingle_sets(raws, k)
    size = np.diff(first)
    at = first[:-1][size > 0]
    k1, k2 = set_hashes(values, first)

    def full(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(raws), *x.shape[1:]), np.int64)
        out[size > 0] = x.view(np.int64)
        return out

    bands, sketch = [], [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
    for band in range(2 * m):
        joined = np.full(len(at), band, np.uint64)
        for i in range(band * a, band * a + a):
            least = mix(_per_text(np.minimum, (values ^ _SEEDS[2 * i]) * _SEEDS[2 * i + 1], at))
            joined = mix(joined + least)
            if i < 32:
                sketch[i % 2] |= (least & np.uint64(15)) << np.uint64(4 * (i // 2))
        bands.append(joined)
    bands = np.stack(bands, axis=1)
    place = mix(values + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(55)
    bit = np.uint64(1) << (place & np.uint64(63))
    parity = {name: full(_per_text(np.bitwise_xor, np.where(place >> np.uint64(6) == i, bit, np.uint64(0)), at))
              for i, name in enumerate(PARITY)}
    return {
        "n": size, "k1": k1, "k2": k2,
        "left": full(np.ascontiguousarray(bands[:, :m])), "right": full(np.ascontiguousarray(bands[:, m:])),
        "s1": full(sketch[0]), "s2": full(sketch[1]), **parity,
    }


def signatures(docs: DataFrame, k: int, m: int, a: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    long, longs = T.LongType(), T.ArrayType(T.LongType(), False)
    names = {"n": long, "k1": long, "k2": long, "left": longs, "right": longs} | dict.fromkeys(SKETCH[1:], long)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(x, t) for x, t in names.items()]])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = signature([x.as_py() for x in batch.column(1)[lo:hi]], k, m, a)
                arrays = [
                    pa.array(x) if x.ndim == 1 else
                    pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
                    for x in part.values()
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *arrays], ["doc_id", *part])

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select("doc_id", raw).mapInArrow(sign, schema)


def set_hashes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's set, 0 for the empty one."""
    k1, k2 = (np.zeros(len(first) - 1, np.uint64) for _ in range(2))
    some = np.diff(first) > 0
    at = first[:-1][some]
    k1[some], k2[some] = _per_text(np.add, mix(values), at), _per_text(np.add, mix(~values), at)
    return k1.view(np.int64), k2.view(np.int64)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(k1, k2, blob) of the texts under ``ids`` (and, by chance, of some others): set hash and sorted shingle hashes.

    A task gives each set once. The texts are picked by a Bloom filter as they are read, they are not shuffled."""
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                           T.StructField("blob", T.BinaryType())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                values, first = shingle_sets([x.as_py() for x in batch.column(0)[lo:hi]], k)
                k1, k2 = set_hashes(values, first)
                new = []
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
                blobs = [values[first[i]:first[i + 1]].tobytes() for i in new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[new]), pa.array(k2[new]), pa.array(blobs, pa.binary())], ["k1", "k2", "blob"])

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return maybe_in(docs, ids, ["doc_id"]).select(raw).mapInArrow(collect, schema)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(reps.select("node", "doc_id", "k1", "k2").join(nodes, ["node"]), "wanted")
    # Tasks may give the same set; a pair is compared on one of them. The choice is made on numbers, without the sets.
    sets = stage(_sets(docs, stage(wanted.select("doc_id").distinct(), "ids"), k).withColumn(
        "place", F.monotonically_increasing_id()), "sets")
    places = stage(sets.select("k1", "k2", "place").join(wanted, ["k1", "k2"]).groupBy("node").agg(
        F.min("place").alias("place")), "places")
    both = pairs
    for end, place in (("a", "p"), ("b", "q")):
        both = both.join(places.select(F.col("node").alias(end), F.col("place").alias(place)), [end])
    for place, blob in (("p", "x"), ("q", "y")):
        both = both.join(sets.select(F.col("place").alias(place), F.col("blob").alias(blob)), [place])
    schema = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                merged = np.sort(np.concatenate((x, y)))
                common = int((merged[1:] == merged[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(compare, schema).distinct()


def _alike(x: str, y: str, percent: int) -> Column:
    """Condition that the sizes allow the similarity and the sketches do not rule it out.

    At a similarity of s the sets differ in (1 - s) / (1 + s) of their sizes' sum at most. Of 32 minhashes a share
    of 1 - s differs, each in 2 of its 4 bits on average; the limit lies 5.5 standard deviations above that mean.
    """
    def bits(columns: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in columns), F.lit(0))

    differ = 1 - percent / 100
    limit = int(64 * differ + 5.5 * math.sqrt(128 * differ * (1 - differ) + 32 * differ)) + 1
    n, o = F.col(f"{x}.n"), F.col(f"{y}.n")
    return ((100 * F.least(n, o) >= percent * F.greatest(n, o)) & (bits(["s1", "s2"]) <= limit)
            & ((100 + percent) * bits(PARITY) <= (100 - percent) * (n + o)))


def _first_shared(x: str, y: str, m: int) -> Column:
    """Condition that no table before this one has both nodes in one bucket, so a pair is passed on once.

    Nodes share table (i, j) if their left bands i and right bands j are equal: the first has the first equal band of either.
    """
    table = F.col(f"{x}.key").bitwiseAND((1 << (m * m - 1).bit_length()) - 1).cast("int")
    out = F.lit(True)
    for side, before in (("left", F.floor(table / m).cast("int")), ("right", table % m)):
        pairs = F.zip_with(F.slice(f"{x}.{side}", F.lit(1), before), F.slice(f"{y}.{side}", F.lit(1), before), lambda p, q: p == q)
        out = out & ~F.exists(pairs, lambda equal: equal)
    return out


def _rest_of_buckets(members: DataFrame, reps: DataFrame, found: DataFrame, percent: int, m: int) -> DataFrame:
    """Pairs of one bucket in different components, where the comparison with the smallest node left several."""
    # 32 bits of a band tell equal ones apart well enough here: the chance to pass a pair over is 4e-9.
    bands = [F.transform(side, lambda x: F.call_function("shiftright", x, F.lit(32)).cast("int")).alias(side) for side in ("left", "right")]
    info = reps.select("node", *bands, *SKETCH).join(
        found.withColumnRenamed("component", "c"), ["node"], "left").withColumn("c", F.coalesce("c", "node"))
    rows = stage(members.where(F.col("many") > 2).select("key", "node", "many").join(info, ["node"]), "members")
    top = rows.groupBy("key", "c").agg(F.count("*").alias("of")).groupBy("key").agg(
        F.max(F.struct("of", "c")).alias("top"), F.sum("of").alias("all")).where(F.col("top.of") < F.col("all")).select(
        "key", F.col("top.c").alias("top"), "all", (F.col("all") - F.col("top.of")).alias("others"))
    rows = rows.join(top, ["key"]).select(
        "key", "node", "left", "right", *SKETCH, "c", (F.col("c") != F.col("top")).alias("outer"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("others") / BLOCK).cast("int").alias("outer_blocks"))

    def block(count: str):
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    x = rows.where("outer").withColumn("i", block("outer_blocks")).withColumn("j", each("blocks")).alias("x")
    y = rows.withColumn("j", block("blocks")).withColumn("i", each("outer_blocks")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "i", "j")]
    differ = (F.col("x.c") != F.col("y.c")) & (~F.col("y.outer") | (F.col("x.node") < F.col("y.node")))
    return x.join(y, [*same, differ, _alike("x", "y", percent), _first_shared("x", "y", m)]).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = 8, a: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked if the intersection of their sets of distinct ``k``-word shingles (lower
    case A-Z) holds at least ``percent`` per cent of the union. component_id is the smallest
    doc_id reachable over links, kept tells whether it is the document's own.

    A text with fewer than ``k`` words is one shingle; a null text or one without words has no shingles and is
    linked with nothing. Rows with the same doc_id are one document and have all their links. A row with a null doc_id
    gets the component of its equal texts (null and kept without any). An empty table gives an empty result.
    Needs (doc_id, text); other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    # Rows get numbers, fixed by being written. A node is the least number of the rows with its set and a doc_id.
    signed = stage(signatures(docs, k, m, a).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # Rows without shingles are one node for each doc_id.
    signed = signed.withColumns({c: F.when(F.col("n") > 0, F.col(c)).when(
        F.col("doc_id").isNotNull(), F.xxhash64(F.lit(c), "doc_id")) for c in ("k1", "k2")})
    # Written, so that the joins below have an exchange on either side and a huge group of copies can be split.
    copies = stage(signed.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.col("row"))).alias("node"), F.min("doc_id").alias("low"),
        F.count("*").alias("many")).where(F.col("many") > 1).drop("many"), "copies")
    labelled = signed.join(copies, ["k1", "k2"], "left").withColumns({
        "node": F.coalesce("node", F.when(F.col("doc_id").isNotNull(), F.col("row"))), "low": F.coalesce("low", "doc_id")})
    reps = stage(labelled.where((F.col("n") > 0) & (F.col("row") == F.col("node"))).select(
        "node", "doc_id", "k1", "k2", "left", "right", *SKETCH), "representatives")
    labelled = stage(labelled.select("doc_id", "n", "node", "low"), "labelled")
    several = stage(labelled.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("last")).where(F.col("a") < F.col("last")).drop("last"), "several")
    same_id = stage(labelled.join(several, ["doc_id"]).where(F.col("a") < F.col("node")).select(
        "a", F.col("node").alias("b")).distinct(), "links")
    # Key rows hold a number and a node only. They are shuffled twice: counted, then joined with the counts above one.
    keys = reps.select("node", F.explode(F.flatten(F.transform("left", lambda x, i: F.transform(
        "right", lambda y, j: F.call_function("shiftleft", F.xxhash64(i * m + j, x, y), F.lit((m * m - 1).bit_length())).bitwiseOR(
            (i * m + j).cast("long")))))).alias("key"))  # the number of the table in the lowest bits
    buckets = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("least")).where(F.col("many") > 1)
    members = stage(keys.join(buckets, ["key"]), "buckets")
    stars = members.where(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    slim = reps.select("node", *SKETCH)
    stars = stage(stars.join(slim.alias("x"), F.col("a") == F.col("x.node")).join(slim.alias("y"), F.col("b") == F.col("y.node"))
                  .where(_alike("x", "y", percent)).select("a", "b").distinct(), "pairs")
    links = stage(_verified(stars, reps, docs, k, percent).unionByName(same_id), "links")
    found = components(links)
    rest = stage(_rest_of_buckets(members, reps, found, percent, m).join(stars, ["a", "b"], "left_anti"), "pairs")
    more = _verified(rest, reps, docs, k, percent)
    nodes = stage(components(links.unionByName(more)).join(
        labelled.groupBy("node").agg(F.min("low").alias("low")), ["node"]), "nodes")
    least = stage(nodes.groupBy("component").agg(F.min("low").alias("component_id")), "components")
    named = stage(nodes.join(least, ["component"]).select("node", "component_id"), "nodes")
    return labelled.join(named, ["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "low").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
