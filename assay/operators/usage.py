"""Usage reports over tables of users, sessions, queries and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import col


def totals(users: DataFrame, sessions: DataFrame, feedback: DataFrame,
           queries: DataFrame) -> DataFrame:
    """Number of users, sessions, feedback entries and queries in one row."""
    def size(df: DataFrame):
        return df.agg(F.count("*")).scalar()

    return (
        users.agg(F.count("*").alias("n_users"))
        .withColumn("n_sessions", size(sessions)).withColumn("n_feedback", size(feedback))
        .withColumn("n_queries", size(queries))
    )


def activity_rollup(users: DataFrame, sessions: DataFrame, queries: DataFrame) -> DataFrame:
    """Every user with distinct sessions and queries, newest user first.

    ``users``: user_id, created_at, ...; ``sessions``: session_id, user_id; ``queries``: query_id,
    user_id. Each side is counted per user before it is joined, so a busy user is one row.
    """
    s = sessions.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        F.count_distinct("session_id").alias("session_count"))
    q = queries.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        F.count_distinct("query_id").alias("query_count"))
    return (
        users.join(s, "user_id", "left").join(q, "user_id", "left")
        .withColumn("session_count", F.coalesce("session_count", F.lit(0)))
        .withColumn("query_count", F.coalesce("query_count", F.lit(0)))
        .orderBy(F.col("created_at").desc_nulls_last(), "user_id")
    )


def sessions_with_owner(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with the owner's e-mail where there is an owner, newest first."""
    owners = users.select("user_id", col("email").alias("user_email"))
    return (
        sessions.join(owners, "user_id", "left")
        .orderBy(F.col("created_at").desc_nulls_last(), "session_id")
    )


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("sign") == "positive").alias("positive"),
        F.count_if(F.col("sign") == "negative").alias("negative"))


def feedback_by_user(feedback: DataFrame, users: DataFrame) -> DataFrame:
    """Feedback counts per user with e-mail; entries without a user form one anonymous group.

    Counting comes first: the join sees one row per user, however much feedback they left.
    """
    counts = feedback.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("sign") == "positive").alias("positive"),
        F.count_if(F.col("sign") == "negative").alias("negative"))
    owners = users.select("user_id", col("email").alias("user_email"))
    return counts.join(owners, "user_id", "left")


def recent_sessions(sessions: DataFrame, owner: object = None, n: int | None = None) -> DataFrame:
    """Sessions by last access, newest first; optionally of one owner, optionally the first n."""
    if owner is not None:
        sessions = sessions.filter(F.col("user_id") == F.lit(owner))
    out = sessions.orderBy(F.col("last_access").desc_nulls_last(), "session_id")
    return out if n is None else out.limit(n)


def merge_sessions(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored and live session lists as one; a stored entry wins over a live one of the same id.

    Ids holding a double underscore are internal copies and are left out.
    """
    fields = [c for c in stored.columns if c != "session_id"]
    both = (
        stored.withColumn("__order", F.lit(0))
        .unionByName(live.select(*stored.columns).withColumn("__order", F.lit(1)))
        .filter(~F.col("session_id").cast("string").contains("__"))
    )
    first = F.min(F.struct("__order", *[col(f) for f in fields])).alias("e")
    return both.groupBy("session_id").agg(first).select(
        "session_id", *[F.col(f"e.{f}").alias(f) for f in fields])


def query_history(queries: DataFrame, session_id: object) -> DataFrame:
    """The queries of one session, newest first."""
    return (
        queries.filter(F.col("session_id") == F.lit(session_id))
        .orderBy(F.col("created_at").desc_nulls_last(), "query_id")
    )
