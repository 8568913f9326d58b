"""The keyed session fold (AGG-7) and its state after every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PURCHASE, VIEW, LOGIN, LOGOUT = "purchase", "view_page", "login", "logout"


def fold(activity: DataFrame) -> DataFrame:
    """One session per user of ``activity`` (seq, user_id, action, ts, amount), in order of seq.

    A user is logged in if the last login or logout was a login, and not before any.  ``last_activity`` is the last
    message's time, which need not be the greatest.  Only partial aggregates are shuffled.
    """
    flag = F.when(F.col("action").isin(LOGIN, LOGOUT), F.col("seq"))
    return activity.groupBy("user_id").agg(
        F.coalesce(F.max_by(F.col("action") == LOGIN, flag), F.lit(False)).alias("is_logged_in"),
        F.max_by("ts", "seq").alias("last_activity"),
        F.count_if(F.col("action") == VIEW).alias("page_views"),
        F.count_if(F.col("action") == PURCHASE).alias("purchase_count"),
        F.round(F.coalesce(F.sum(F.when(F.col("action") == PURCHASE, F.col("amount"))), F.lit(0.0)), 2).alias("total_purchase_amount"),
    )


def after_batches(batched: DataFrame) -> DataFrame:
    """(user_id, batch_no, ...): the running session after each of a user's batches.

    Batches are folded first, so the window runs over one row per batch and not per message.
    """
    flag = F.when(F.col("action").isin(LOGIN, LOGOUT), F.col("seq"))
    one = batched.groupBy("user_id", "batch_no").agg(
        F.max(F.struct(flag.alias("at"), (F.col("action") == LOGIN).alias("into"))).alias("flag"), F.max_by("ts", "seq").alias("last_activity"),
        F.count_if(F.col("action") == VIEW).alias("views"), F.count_if(F.col("action") == PURCHASE).alias("purchases"),
        F.coalesce(F.sum(F.when(F.col("action") == PURCHASE, F.col("amount"))), F.lit(0.0)).alias("spent"),
    )
    so_far = Window.partitionBy("user_id").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = F.last(F.when(F.col("flag")["at"].isNotNull(), F.col("flag")["into"]), ignorenulls=True).over(so_far)
    return one.select(
        "user_id", "batch_no", F.coalesce(flags, F.lit(False)).alias("is_logged_in"), "last_activity", F.sum("views").over(so_far).alias("page_views"),
        F.sum("purchases").over(so_far).alias("purchase_count"), F.round(F.sum("spent").over(so_far), 2).alias("total_purchase_amount"),
    )
