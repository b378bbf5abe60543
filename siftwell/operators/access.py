"""Who may read what, as predicates and joins that are applied before any ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed(doc: Column, collection: Column, documents=None, collections=None, denied=()) -> Column:
    """(document or collection granted) and not denied. None leaves an axis open only if both are None; an empty set grants
    nothing."""
    granted = F.lit(True)
    if documents is not None or collections is not None:
        granted = doc.isin(list(documents or ())) | collection.isin(list(collections or ()))
    return granted & ~doc.isin(list(denied)) if len(denied) else granted


def readable(users: DataFrame, docs: DataFrame, grants: DataFrame, members: DataFrame, overrides: DataFrame) -> DataFrame:
    """user_id, doc_id of every document a user may read.

    Collections without grants are open; others are open to members of a granted group. An override denies or allows one
    document to one user. Users and grants are joined by key; the open part pairs each user with open documents, which is the
    result's own size.
    """
    collections = docs.select("collection_id").distinct()
    open_ = collections.join(grants, "collection_id", "left_anti").join(users.select("user_id"), how="cross")
    by_group = grants.join(members, "group_id").select("collection_id", "user_id")
    seen = open_.select("collection_id", "user_id").unionByName(by_group).distinct()
    base = docs.select("doc_id", "collection_id").join(seen, "collection_id").select("user_id", "doc_id")
    own = overrides.where("effect = 'read'").join(docs.select("doc_id"), "doc_id", "left_semi").select("user_id", "doc_id")
    return base.unionByName(own).distinct().join(overrides.where("effect = 'deny'").select("user_id", "doc_id"), ["user_id", "doc_id"], "left_anti")


def counted(docs: DataFrame, visible: Column) -> DataFrame:
    """Candidates before and after the filter; zero, not null, for an empty corpus."""
    return docs.agg(F.count("*").alias("before"), F.coalesce(F.sum(F.when(visible, 1).otherwise(0)), F.lit(0)).cast("long").alias("after"))
