"""Tables of stored documents and the reader's state, always scoped to owners.

Workspace columns: owner_id, doc_id, filename, content_hash, completed (array),
profile (string or null), sequence (position of the first write), written
(position of the last write).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIST_LIMIT, RETAINED = 20, 64


def apply_uploads(workspace: DataFrame, uploads: DataFrame) -> DataFrame:
    """Upsert: owner, text and position stay as first written, the rest is replaced.

    ``uploads`` carry ``arrival``, their position in the write log. One
    aggregation with map-side partials, so repeated writes of one document do
    not pile up anywhere.
    """
    log = workspace.withColumn("arrival", F.col("sequence")).drop("sequence", "written").unionByName(
        workspace.withColumn("arrival", F.col("written")).drop("sequence", "written")
    ).unionByName(uploads)
    return log.groupBy("doc_id").agg(
        F.min_by("owner_id", "arrival").alias("owner_id"),
        F.min_by("content_hash", "arrival").alias("content_hash"),
        F.max_by("filename", "arrival").alias("filename"),
        F.max_by("completed", "arrival").alias("completed"),
        F.max_by("profile", "arrival").alias("profile"),
        F.min("arrival").alias("sequence"),
        F.max("arrival").alias("written"),
    )


def recent_documents(workspace: DataFrame, k: int = LIST_LIMIT) -> DataFrame:
    """The newest ``k`` documents of each owner.

    The rank filter becomes a group limit before the shuffle, so an owner of a
    third of all documents sends k rows per task.
    """
    newest = W.partitionBy("owner_id").orderBy(F.desc("sequence"))
    return workspace.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def owner_scoped(workspace: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with ``found``; a document of someone else is simply not found."""
    owned = workspace.select("doc_id", "owner_id", "filename", F.lit(True).alias("_hit"))
    return requests.join(owned, ["doc_id", "owner_id"], "left").withColumn(
        "found", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def erase(workspace: DataFrame, requests: DataFrame) -> DataFrame:
    """What is left after single (owner, doc) and whole-owner (doc null) requests."""
    single = requests.where("doc_id IS NOT NULL").select("owner_id", "doc_id").distinct()
    whole = requests.where("doc_id IS NULL").select("owner_id").distinct()
    return workspace.join(single, ["owner_id", "doc_id"], "left_anti").join(
        whole, "owner_id", "left_anti"
    )


def erased_counts(workspace: DataFrame, requests: DataFrame) -> DataFrame:
    """How many documents each owner loses."""
    single = requests.where("doc_id IS NOT NULL").select("owner_id", "doc_id").distinct()
    whole = requests.where("doc_id IS NULL").select("owner_id").distinct()
    gone = workspace.join(single.withColumn("one", F.lit(True)), ["owner_id", "doc_id"], "left").join(
        whole.withColumn("every", F.lit(True)), "owner_id", "left"
    ).where("one OR every")
    return gone.groupBy("owner_id").agg(F.count("*").alias("removed"))


def apply_patches(workspace: DataFrame, patches: DataFrame, plans: DataFrame) -> DataFrame:
    """Patched state with a status per document.

    ``patches``: owner_id, doc_id, arrival, completed (null leaves it), profile
    (null leaves it), clear_profile. ``plans``: doc_id, action_ids. Each patch
    is judged by itself: unknown action ids reject the whole patch. The valid
    ones take effect in the order of their arrival, field by field, in one
    aggregate. A document its owner does not have yields a ``not_found`` row.
    ``unknown`` are the ids of the last rejected patch.
    """
    judged = patches.join(plans, "doc_id", "left").withColumn(
        "unknown",
        F.expr(
            "array_sort(array_except(coalesce(completed, cast(array() as array<string>)), "
            "coalesce(action_ids, cast(array() as array<string>))))"
        ),
    )
    valid = "size(unknown) = 0"
    last = judged.groupBy("owner_id", "doc_id").agg(
        F.expr(f"count_if({valid})").alias("applied"),
        F.expr("max_by(unknown, arrival) FILTER (WHERE size(unknown) > 0)").alias("refused"),
        F.expr(
            f"max_by(completed, arrival) FILTER (WHERE {valid} AND completed IS NOT NULL)"
        ).alias("new_completed"),
        F.expr(
            "max_by(struct(CASE WHEN clear_profile THEN NULL ELSE profile END as value), arrival) "
            f"FILTER (WHERE {valid} AND (clear_profile OR profile IS NOT NULL))"
        ).alias("new_profile"),
    ).withColumn("asked", F.lit(True))
    known = workspace.select("owner_id", "doc_id", "completed", "profile", F.lit(True).alias("known"))
    return known.join(last, ["owner_id", "doc_id"], "full_outer").selectExpr(
        "owner_id", "doc_id",
        "CASE WHEN known IS NULL THEN 'not_found' WHEN asked IS NULL THEN 'unchanged' "
        "WHEN applied > 0 THEN 'patched' ELSE 'rejected' END as status",
        "coalesce(refused, cast(array() as array<string>)) as unknown",
        "CASE WHEN known THEN coalesce(new_completed, completed) END as completed",
        "CASE WHEN known IS NULL THEN NULL WHEN new_profile IS NULL THEN profile "
        "ELSE new_profile.value END as profile",
    )


def retain_newest(workspace: DataFrame, n: int = RETAINED) -> DataFrame:
    """Bounded retention: the ``n`` documents written last."""
    return workspace.orderBy(F.desc("written")).limit(n)
