"""Identifiers: content hashes and name-based UUIDs, from built-in hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def text_id(text: Column) -> Column:
    """MD5 of the text; identifies a document by what it says."""
    return F.md5(text)


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Version 5 UUID of ``name``: SHA-1 of namespace and name with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(
        F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1)
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def point_id(
    post_id: Column, forum: Column, chunk_id: Column, kind: Column, comment_id: Column | None = None
) -> Column:
    """Id of an index point. Without ``comment_id`` chunk n of every comment of a post has the same id."""
    parts = [post_id, forum, chunk_id.cast("string"), kind]
    if comment_id is not None:
        parts.append(comment_id)  # concat_ws skips a null, so post chunks keep the short form
    return uuid5(F.concat_ws("_", *parts))


def resolve_doc_id(doc_id: Column, id_: Column, metadata_id: Column, text: Column) -> Column:
    """The first id that is there, else the text itself."""
    return F.coalesce(doc_id, id_, metadata_id, text, F.lit(""))
