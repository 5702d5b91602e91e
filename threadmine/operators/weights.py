"""Sparse weights: term counts, document frequency, IDF, TF-IDF, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmine.functions.text import tokenize_sparse
from threadmine.operators.ranking import with_row_index
from threadmine.session import BROADCAST_ROWS, salted_join, stage


def postings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer=tokenize_sparse,
    repartition: bool = True, parts: int | None = None,
) -> DataFrame:
    """``(doc_id, doc_len, term, tf)``, one row per document and term.

    The documents are hash-partitioned by id once. Counting terms, and later
    summing scores per document, then need no shuffle of their own; the text is
    smaller than the postings made from it. Pass ``repartition=False`` if the
    source is already bucketed by id, and ``parts`` to fix the number of tasks.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if repartition:
        source = source.repartition(parts, "doc_id") if parts else source.repartition("doc_id")
    return count_terms(source.select("doc_id", tokenizer(F.col("text")).alias("tokens")))


def count_terms(tokens: DataFrame) -> DataFrame:
    """Postings of ``(doc_id, tokens)``."""
    return (
        # explode_outer: plain explode would test size(tokens) in a pushed-down filter
        # and tokenise every text a second time for it.
        tokens.select("doc_id", F.size("tokens").alias("doc_len"), F.explode_outer("tokens").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("doc_id", "doc_len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def tokens_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer=tokenize_sparse) -> DataFrame:
    """``(doc_id, tokens)``, one row per document, dealt evenly; for searches that need no postings."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id")
    return source.select("doc_id", tokenizer(F.col("text")).alias("tokens"))


def count_rows(df: DataFrame) -> Column:
    """Row count as a scalar subquery; it is computed within the query that uses it."""
    return df.select(F.count(F.lit(1))).scalar()


def average_length(post: DataFrame, n_docs: Column) -> Column:
    """Mean number of tokens of a document, those without tokens included, as a scalar subquery."""
    total = post.select(F.coalesce(F.sum("tf"), F.lit(0)).cast("double")).scalar()
    return total / n_docs


def document_frequency(post: DataFrame) -> DataFrame:
    """``(term, df)``; postings hold a document and term once, so a count is enough."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + F.lit(1.0)) / (df + F.lit(1.0))) + F.lit(1.0)


def with_idf(frequency: DataFrame, n_docs: Column) -> DataFrame:
    return frequency.withColumn("idf", idf(F.col("df"), n_docs))


def with_frequency(rows: DataFrame, terms: DataFrame, spread_by: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the frequency of their ``term``, from ``(term, df)``; the order of the columns may change.

    Most rows belong to the most frequent terms, which are broadcast, up to ``max_rows``; where the other terms are
    those of a single document, their frequency is known. Only rows of terms between the two are shuffled, and none
    of these is frequent. ``rows`` are read once, or twice where there are such terms.
    """
    # Terms by frequency, a row for each frequency: there are at most sqrt(2 * postings) of them.
    above = Window.orderBy(F.col("df").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_df = terms.groupBy("df").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.sum("n").over(above))
    least = by_df.where((F.col("n") <= max_rows) & (F.col("df") > 1)).agg(F.min("df")).first()[0]
    largest = terms.agg(F.max("df")).first()[0] or 1
    least = largest + 1 if least is None else least
    between = terms.where((F.col("df") > 1) & (F.col("df") < least))
    marked = rows.join(F.broadcast(terms.where(F.col("df") >= least)), "term", "left")
    if between.isEmpty():
        return marked.withColumn("df", F.coalesce("df", F.lit(1)))
    # The largest frequency of the rest may be high where nothing could be broadcast.
    rest = salted_join(marked.where(F.col("df").isNull()).drop("df"), terms.where(F.col("df") < least), ["term"], spread_by)
    return marked.where(F.col("df").isNotNull()).unionByName(rest.select(*marked.columns))


def tfidf(post: DataFrame, n_docs: Column, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, term, weight)`` with weight ``tf / doc_len * idf``; ``post`` is read twice or three times (see ``with_frequency``)."""
    marked = with_frequency(post, stage(document_frequency(post), "frequency"), ["doc_id"], max_rows)
    return marked.select("doc_id", "term", weight(n_docs).alias("weight"))


def weight(n_docs: Column) -> Column:
    return F.col("tf") / F.col("doc_len") * idf(F.col("df"), n_docs)


def vocabulary(post: DataFrame) -> DataFrame:
    """``(term, term_index)`` in sorted order. Postings are keyed by the term itself;
    the index is only for exchange with vector stores that need integer positions."""
    return with_row_index(post.select("term").distinct(), "term", name="term_index")


def query_terms(queries: DataFrame, keys: list[str], text: str = "text", tokenizer=tokenize_sparse) -> DataFrame:
    """``(*keys, term, qtf, query_len)`` for each query; unknown terms still count in the length."""
    tokens = queries.select(*keys, tokenizer(F.col(text)).alias("tokens"))
    return (
        tokens.select(*keys, F.size("tokens").alias("query_len"), F.explode_outer("tokens").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*keys, "query_len", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def query_weights(terms: DataFrame, frequency: DataFrame, n_docs: Column) -> DataFrame:
    """TF-IDF weights of queries; terms that no document holds drop out."""
    joined = terms.join(with_idf(frequency, n_docs), "term")
    return joined.withColumn("weight", F.col("qtf") / F.col("query_len") * F.col("idf"))
