"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

The sketch of a document is a one-permutation MinHash: the hash range is cut into a power of two of bins and
the least hash of each bin is kept. Documents are partitioned by size: those with more shingles have more
bins, so that a bin holds about ``load`` of a document's shingles at every size, and a short item is found in
a document of any length. An item is a set of few shingles and is not sketched: it is a candidate of every
document whose sketch holds one of its shingles.

Of the shingles that a document shares with an item, each is the least of its bin with a probability of
about (1 - exp(-load)) / load. An item with q shingles of which a share t must be in the document is missed
with the complement of that to the power t q. ``load`` is the largest power of two that keeps
this below ``MISS`` for the smallest item there is.

Candidates are verified on the document's whole set of shingles. All work is done by built-in
functions on arrays within the row; what is shuffled is candidates, never the shingles of all documents
(unless the items are too many to be broadcast).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.llm.common import text_or_empty, words_of
from threadmine.operators.bloom import maybe_in
from threadmine.session import stage

MISS = 1e-4
MAX_BROADCAST_ROWS = 200_000


def shingle_set(frame: DataFrame, k: int) -> DataFrame:
    """Replace ``text`` by ``shingles``: the sorted distinct hashes of its lower-cased k-word shingles.

    Only A-Z is lowered. A text with fewer than k words has none: it can neither hold nor be found.
    """
    lowered = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = frame.withColumn("_h", F.transform(words_of(lowered), lambda w: F.xxhash64(w)))
    windows = F.transform(
        F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (k - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get("_h", i + j) for j in range(1, k)]))
    return hashed.withColumn("shingles", F.sort_array(F.array_distinct(windows))).drop("_h", "text")


def partition_of(size: Column, load: float) -> Column:
    """Logarithm of the number of bins (two at least): at least ``size / load`` of them."""
    return F.greatest(F.ceil(F.log2(size / F.lit(load))), F.lit(1)).cast("int")


def sketch(shingles: Column, level: Column) -> Column:
    """The least hash of each bin of a sorted set: where the leading bits differ from the one before."""
    def bin_of(x: Column) -> Column:
        return F.call_function("shiftright", x, 64 - level)

    return F.filter(shingles, lambda x, i: F.coalesce(bin_of(x) != bin_of(F.get(shingles, i - 1)), F.lit(True)))


def load_for(smallest: int, percent: int) -> float:
    """Shingles per bin so that the smallest item is missed with probability ``MISS`` at most."""
    load, shared = 4.0, max(1, -(-smallest * percent // 100))
    while (1 - (1 - math.exp(-load)) / load) ** shared > MISS:
        load /= 2
    return load


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) where a document holds ``percent`` of an item's distinct shingles.

    A null or empty text, or one of fewer than ``k`` words, matches nothing on either side; a null doc_id
    matches nothing. Rows that share a doc_id are searched each for itself and reported once, with the larger
    share; rows that share an item_id likewise. Empty tables give an empty result.
    Needs (doc_id, text) and (item_id, text); other columns are ignored.
    """
    wanted = stage(shingle_set(items.select("item_id", "text"), k), "items").where(F.size("shingles") > 0)
    facts = wanted.agg(F.min(F.size("shingles")), F.sum(F.size("shingles"))).first()
    if facts[0] is None:
        facts = (1, 0)
    load = load_for(facts[0], percent)
    sets = shingle_set(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), k)
    sized = sets.withColumn("level", partition_of(F.size("shingles"), load))
    # explode_outer: for explode, the optimiser infers a filter on the size of the array and pushes it below the
    # projections, which then evaluates the word hashes anew for every shingle.
    signs = sized.select("doc_id", F.explode_outer(sketch(F.col("shingles"), F.col("level"))).alias("sign"))
    probes = wanted.select("item_id", F.explode("shingles").alias("sign"))
    if facts[1] <= MAX_BROADCAST_ROWS:  # counted, of two numbers each
        probes = F.broadcast(probes)
    candidates = stage(signs.join(probes, ["sign"]).select("doc_id", "item_id").distinct(), "candidates")
    return _verify(docs, wanted, candidates, k, percent)


def _verify(docs: DataFrame, wanted: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    # Picked by a Bloom filter as they are read; the few others that come along find no candidate.
    texts = maybe_in(docs.select("doc_id", "text"), candidates.select("doc_id").distinct(), ["doc_id"])
    sets = shingle_set(texts, k).withColumnRenamed("shingles", "held")
    return (
        candidates.join(wanted, ["item_id"]).join(sets, ["doc_id"])
        .select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"),
                F.size(F.array_intersect("shingles", "held")).cast("long").alias("n_shared"))
        .where(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    )


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)
  UNION ALL
  SELECT 'i', item_id, unnest(ws), generate_subscripts(ws, 1)
  FROM (SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark)
), s AS (
  SELECT DISTINCT kind, id, word, w2, w3, w4, w5 FROM (
    SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5
    FROM w WINDOW o AS (PARTITION BY kind, id ORDER BY pos))
  WHERE w5 IS NOT NULL
), n AS (
  SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM (SELECT * FROM s WHERE kind = 'd') d JOIN (SELECT * FROM s WHERE kind = 'i') i USING (word, w2, w3, w4, w5)
  GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared FROM shared JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n_item
"""
