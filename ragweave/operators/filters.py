"""Which rows a search may see: search filters, permissions, and links that every user sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_link(file_col: str = "file_id") -> Column:
    return F.col(file_col).isNull()


def in_buckets(buckets: list[str], bucket_col: str = "bucket_name") -> Column:
    if not buckets:
        raise ValueError("no bucket names given")
    return F.coalesce(F.col(bucket_col).isin(list(buckets)), F.lit(False))


def is_object(bucket: str, name: str, bucket_col: str = "bucket_name", object_col: str = "object_name") -> Column:
    if not bucket or not name:
        raise ValueError("bucket and object are both needed")
    return F.coalesce((F.col(bucket_col) == bucket) & (F.col(object_col) == name), F.lit(False))


def of_page(doc_id: str, page: int) -> Column:
    """Chunks (not summaries) of a page."""
    return F.coalesce((F.col("doc_id") == doc_id) & (F.col("page") == page) & (F.col("summary") == 0), F.lit(False))


def header_like(header: Column | str, wanted: Column | str, edits: int = 1) -> Column:
    """A header within ``edits`` edits of the one wanted, in whatever case; colons of that one don't count."""
    own, other = (F.lower(F.col(x) if isinstance(x, str) else x) for x in (header, wanted))
    return F.coalesce(F.levenshtein(own, F.replace(other, F.lit(":"), F.lit(""))) <= edits, F.lit(False))


def requested(search_by: dict[str, object] | None, **names: str) -> Column | None:
    """The predicate of a request: bucket names win over bucket and object; None if nothing is asked."""
    if not search_by:
        return None
    if search_by.get("bucket_names"):
        return in_buckets(list(search_by["bucket_names"]), names.get("bucket_col", "bucket_name"))
    if search_by.get("bucket_name") and search_by.get("object_name"):
        return is_object(search_by["bucket_name"], search_by["object_name"], **names)
    return None


def visible(search: Column | None, permitted: Column | None, enforce: bool, link: Column, extra: Column | None = None, links_always_visible: bool = True) -> Column | None:
    """All predicates in one; None means every row.

    With permissions enforced and none given only links are left. ``extra`` narrows what isn't a link.
    """
    own = [p for p in (search, extra, permitted if enforce else None) if p is not None]
    if enforce and permitted is None:
        inner: Column | None = F.lit(False)
    elif own:
        inner = own[0]
        for p in own[1:]:
            inner = inner & p
    else:
        return None
    return inner | link if links_always_visible else inner


def permitted_rows(rows: DataFrame, permissions: DataFrame, user: str, bucket_col: str = "bucket_name", user_col: str = "user", link: Column | None = None) -> DataFrame:
    """Rows of buckets that ``permissions`` (user, bucket) gives to ``user``, and links."""
    own = permissions.filter(F.col(user_col) == user).select(F.col(bucket_col)).distinct()
    seen = rows.join(own, bucket_col, "left_semi")
    return seen if link is None else seen.unionByName(rows.filter(link).join(own, bucket_col, "left_anti"))


def fresh_permissions(cache: DataFrame, now: Column, seconds: int = 3600, user_col: str = "user", at_col: str = "asked_at") -> DataFrame:
    """Cached permissions (user, bucket, asked_at) that still hold: given less than ``seconds`` ago. Refusals aren't cached."""
    return cache.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at_col).cast("timestamp")) < seconds * 1_000_000)


def to_ask(users: DataFrame, cache: DataFrame, now: Column, seconds: int = 3600, user_col: str = "user", at_col: str = "asked_at") -> DataFrame:
    """The users whose permissions must be asked for again."""
    held = fresh_permissions(cache, now, seconds, user_col, at_col).select(user_col).distinct()
    return users.select(user_col).distinct().join(held, user_col, "left_anti")
