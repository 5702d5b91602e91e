"""Building and rebuilding the search index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmine.functions.ids import point_id
from threadmine.functions.text import tokenize_sparse
from threadmine.operators import curate as C
from threadmine.operators import search as Q
from threadmine.operators import weights as W
from threadmine.operators.bloom import bloom_anti_join, bloom_semi_join
from threadmine.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_posts
from threadmine.operators.packed import listed, packets
from threadmine.operators.tables import newest_per_key, upsert
from threadmine.session import discard_staged, ship_package, shuffles_removed, stage, staged
from threadmine.sources import store


def with_ids(chunks: DataFrame, compat_ids: bool = False) -> DataFrame:
    """Add the point id. ``compat_ids`` leaves the comment id out of it, as older indexes do;
    the n-th chunks of a post's comments then share one id."""
    comment = None if compat_ids else F.col("comment_id")
    return chunks.withColumn(
        "id", point_id(F.col("post_id"), F.col("subreddit_name"), F.col("chunk_id"), F.col("type"), comment)
    )


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "page_content") -> DataFrame:
    """Add ``vector`` by calling an embedder on Arrow batches of texts, in the tasks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=list(embedder(batch[text].fillna("").tolist())))

    ship_package(chunks.sparkSession)
    return chunks.mapInPandas(run, f"{schema}, vector array<float>")


_DOCS_OF_TASK = 10_000


@dataclass(frozen=True)
class SparseIndex:
    """Postings, term statistics and the number of documents, empty ones included.

    Of a stored index ``parts`` is the number of term partitions, ``packed`` has the postings as they are stored (see
    ``operators.packed``) and ``docs`` the ids ``(block, no, doc_id)`` of all documents in them; ``dead`` are those replaced, if any.
    """

    postings: DataFrame
    terms: DataFrame
    n_docs: Column
    parts: int | None = None
    packed: DataFrame | None = None
    docs: DataFrame | None = None
    dead: DataFrame | None = None

    @staticmethod
    def of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> SparseIndex:
        """Postings are written once, since they are read several times; a task makes those of some 10,000 documents,
        so that what it holds does not grow with the table."""
        n = docs.count()
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // _DOCS_OF_TASK))
        post = stage(W.postings(docs, doc_id, text, parts=parts), "postings")
        return SparseIndex(post, W.document_frequency(post), F.lit(n))

    def topk(self, queries: DataFrame, keys: list[str], k: int, bounded: bool | None = None) -> DataFrame:
        """Best ``k`` documents of each query by sparse score; stored postings are scored block by block."""
        if self.packed is None:
            return Q.ranked(Q.sparse_scores(queries, self.postings, self.n_docs, keys, self.terms, bounded=bounded), keys, k)
        live = self.docs if self.dead is None else self.docs.join(self.dead, _DOC, "left_anti")
        return Q.packed_topk(queries, self._asked(queries, self.packed), live, self.n_docs, keys, k, self.terms)

    def postings_for(self, queries: DataFrame, text: str = "text") -> DataFrame:
        """The postings, of stored ones only the partitions with a term that ``queries`` ask for."""
        return self.postings if self.parts is None else self._asked(queries, self.postings, text)

    def _asked(self, queries: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
        """The driver collects partition numbers, ``parts`` of them at most."""
        term = F.explode(tokenize_sparse(F.col(text))).alias("term")
        asked = queries.select(term).select(store.part_of(F.col("term"), self.parts)).distinct().collect()
        return rows.where(F.col("term_part").isin([r.term_part for r in asked]))

    def weights(self, named: bool = True) -> DataFrame:
        """``(doc_id, term, weight)``. Of a stored index ``named=False`` gives (block, no) for ``doc_id``, without looking it up."""
        if self.packed is None:
            return W.tfidf(self.postings, self.n_docs)
        post = listed(W.with_frequency(self.packed, self.terms, ["block"]))
        if self.dead is not None:
            post = post.join(self.dead, _DOC, "left_anti")
        weights = post.select(*_DOC, "term", W.weight(self.n_docs).alias("weight"))
        return weights.join(self.docs, _DOC).select("doc_id", "term", "weight") if named else weights


def index_rows(
    posts: DataFrame, comments: DataFrame | None = None, since: Column | None = None,
    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, splitter=None, compat_ids: bool = False,
) -> DataFrame:
    """Chunks with ids, of all posts or of those ingested since a day."""
    chosen = posts if since is None else C.since(posts, since)
    if comments is not None and since is not None:
        comments = comments.join(chosen.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return with_ids(chunk_posts(chosen, comments, size, overlap, splitter), compat_ids)


def one_per_id(points: DataFrame) -> DataFrame:
    """Points of which several have one id (as with ``compat_ids``) leave the one stored last: the last comment's."""
    place = F.struct(*[c for c in ("post_id", "comment_id", "chunk_id") if c in points.columns])
    return newest_per_key(points, ["id"], place)


# Segments from which on a write is merged with all before it.
MAX_SEGMENTS = 8
# Columns of stored postings that name a document.
_DOC = ["block", "no"]
# Points and what is made from their texts are compressed well.
_CODEC = "zstd"


def write_index(
    spark: SparkSession, name: str, points: DataFrame, recreate: bool = True, parts: int | None = None, batch: str | None = None
) -> None:
    """Write points and the sparse tables made from them as the next version of an index.

    ``recreate`` replaces everything. Else the points are merged in by id: they, their postings and the changes in term
    counts become a segment of their own, and points that they replace are passed over when older segments are
    read. What is written follows the batch, not the index. After ``MAX_SEGMENTS`` segments all are made one.

    Readers see the new version when everything is written, in one step. A write that ends early changes nothing
    and can be repeated; with a ``batch`` id, one that was committed is not applied again.
    """
    manifest = store.read_manifest(spark, name)
    if manifest is not None and batch is not None and batch in manifest["batches"]:
        return
    mark = staged()
    with shuffles_removed(spark):
        if recreate or manifest is None:
            _commit_whole(spark, name, one_per_id(points), manifest, parts, batch)
        elif len(manifest["segments"]) >= MAX_SEGMENTS:
            points = stage(one_per_id(points), "points", _CODEC)
            _commit_whole(spark, name, upsert(open_points(spark, name), points, ["id"]), manifest, manifest["parts"], batch)
        else:
            _commit_segment(spark, name, one_per_id(points), _current(manifest, name), batch)
    discard_staged(spark, mark)  # all of it stands in the tables now


def _commit_segment(spark: SparkSession, name: str, points: DataFrame, manifest: dict, batch: str | None) -> None:
    segment, points = _write_points(spark, name, points)
    version = manifest["version"] + 1
    _write_postings(points, segment, manifest["parts"], version)
    gone = stage(bloom_semi_join(open_points(spark, name).select("id", "page_content"), points, ["id"]), "gone", _CODEC)
    terms = gone.select(F.explode(F.array_distinct(tokenize_sparse(F.col("page_content")))).alias("term"))
    change = _frequency(spark, segment).unionByName(terms.groupBy("term").agg((-F.count(F.lit(1))).alias("df"))).groupBy(
        "term").agg(F.sum("df").alias("df")).where("df <> 0")
    change.write.saveAsTable(segment["terms"])
    store.commit(spark, name, {
        "version": version, "layout": store.LAYOUT, "parts": manifest["parts"],
        "n": manifest["n"] + points.count() - gone.count(), "segments": [*manifest["segments"], segment]}, batch)


def _write_points(spark: SparkSession, name: str, points: DataFrame) -> tuple[dict, DataFrame]:
    """A new segment with its table of points, which other tables are made from; none is read before the commit."""
    segment = {kind: f"{name}_segment_{uuid4().hex}_{kind}" for kind in store.KINDS}
    points.write.option("compression", _CODEC).saveAsTable(segment["points"])
    return segment, spark.table(segment["points"])


def _write_postings(points: DataFrame, segment: dict, parts: int | None, version: int) -> int:
    """Write the segment's postings and their documents; the number of partitions."""
    made = stage(packets(points, "id", "page_content", store.lanes_for(parts), version), "packets")
    rows = made.where(F.col("packet").isNotNull())
    parts = parts or store.parts_for(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    store.write_by_term(rows.select("lane", "packet"), segment["postings"], parts)
    made.where(F.col("packet").isNull()).select(*_DOC, "doc_id").write.option("compression", _CODEC).saveAsTable(segment["docs"])
    return parts


def _frequency(spark: SparkSession, segment: dict) -> DataFrame:
    return spark.table(segment["postings"]).groupBy("term").agg(F.sum(F.size("list").cast("bigint")).alias("df"))


def _commit_whole(spark: SparkSession, name: str, points: DataFrame, manifest: dict | None, parts: int | None, batch: str | None) -> None:
    segment, points = _write_points(spark, name, points)
    version = manifest["version"] + 1 if manifest else 1
    parts = _write_postings(points, segment, parts, version)
    _frequency(spark, segment).write.saveAsTable(segment["terms"])
    store.commit(spark, name, {
        "version": version, "layout": store.LAYOUT, "parts": parts, "n": points.count(), "segments": [segment]}, batch)


def rebuild_sparse(spark: SparkSession, name: str, parts: int | None = None) -> None:
    """Make postings and term statistics again from the stored texts, as one segment; dense vectors stay as they are."""
    mark = staged()
    with shuffles_removed(spark):
        _commit_whole(spark, name, open_points(spark, name), _manifest(spark, name), parts, None)
    discard_staged(spark, mark)


def _manifest(spark: SparkSession, name: str) -> dict:
    manifest = store.read_manifest(spark, name)
    if manifest is None:
        raise ValueError(f"no index {name}")
    return manifest


def _current(manifest: dict, name: str) -> dict:
    if manifest.get("layout") != store.LAYOUT:
        raise ValueError(f"the postings of index {name} have an older layout; rebuild_sparse makes them again")
    return manifest


def _later(spark: SparkSession, segments: list[dict], key: str = "id") -> DataFrame:
    """Ids of the points of some segments."""
    return reduce(DataFrame.unionByName, [spark.table(s["points"]).select(F.col("id").alias(key)) for s in segments])


def open_points(spark: SparkSession, name: str) -> DataFrame:
    """Points of all segments, but for those that a later segment holds too."""
    segments, parts = _manifest(spark, name)["segments"], []
    for i, segment in enumerate(segments):
        rows = spark.table(segment["points"])
        parts.append(bloom_anti_join(rows, _later(spark, segments[i + 1:]), ["id"]) if segments[i + 1:] else rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def open_sparse(spark: SparkSession, name: str) -> SparseIndex:
    manifest = _current(_manifest(spark, name), name)
    segments = manifest["segments"]
    counts = reduce(DataFrame.unionByName, [spark.table(s["terms"]) for s in segments])
    if len(segments) > 1:
        counts = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    packed, docs = ([spark.table(s[kind]) for s in segments] for kind in ("postings", "docs"))
    gone = [bloom_semi_join(rows, _later(spark, segments[i + 1:], "doc_id"), ["doc_id"]).select(*_DOC) for i, rows in enumerate(docs[:-1])]
    live = [rows.join(out, _DOC, "left_anti") for rows, out in zip(docs, gone)] + docs[-1:]
    post = [listed(rows).join(named, _DOC).select("doc_id", "doc_len", "term", "tf", "block", "term_part") for rows, named in zip(packed, live)]
    every = [reduce(DataFrame.unionByName, x) if x else None for x in (post, packed, docs, gone)]
    return SparseIndex(every[0], counts, F.lit(manifest["n"]), manifest["parts"], *every[1:])


def index_totals(posts: DataFrame, points: DataFrame) -> DataFrame:
    """One row: posts read and documents made."""
    n_posts = posts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_posts").alias("name"), "n")
    n_docs = points.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_documents").alias("name"), "n")
    return n_posts.unionByName(n_docs)
